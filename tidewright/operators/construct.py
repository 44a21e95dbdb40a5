"""Cells supplied by hand: which are needed, which of the supplied ones can be applied, and applying them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import full_match, trim_to_null
from tidewright.operators.transform import ERRORS, PK, RN, STATUS, FieldRule
from tidewright.operators.validate import failures

NEEDED = ("MANDATORY", "LOOKUP_FAILED")


def needs(staging: DataFrame, rules: tuple[FieldRule, ...], child: str | None = None) -> DataFrame:
    """__rn, _SRC_PK, target, kind: cells that only a person can fill."""
    return failures(staging, rules, child).where(F.col("kind").isin(*NEEDED))


def _allowed(rules: tuple[FieldRule, ...]) -> Column:
    """Why a value can't go into its target; null if it can."""
    why = F.lit("UNKNOWN_COLUMN")
    value = F.col("value")
    for r in rules:
        t = r.target
        bad = F.when(value.rlike(r"[\x{0}-\x{1f}\x{7f}-\x{9f}]"), "CONTROL_CHARACTER")
        if t.length:
            bad = bad.when(F.length(value) > t.length, "LENGTH")
        if t.kind == "numc":
            bad = bad.when(~full_match(value, "[0-9]+"), "FORMAT")
        if t.check_values:
            bad = bad.when(~value.isin(list(t.check_values)), "CHECKTABLE")
        why = F.when(F.col("target") == t.name, bad).otherwise(why)
    return why


def judge(patches: DataFrame, staging: DataFrame, rules: tuple[FieldRule, ...]) -> DataFrame:
    """patches (row_ref, pk, target, value) with outcome APPLIED, REJECTED (and why) or IGNORED (nothing supplied).

    A patch must name a row that exists and its key; of several for one cell the greatest value counts, so the result is fixed.
    """
    cut = patches.select("row_ref", "pk", "target", trim_to_null(F.col("value")).alias("value"))
    one = cut.groupBy("row_ref", "target").agg(F.max(F.struct("value", "pk")).alias("m")).select("row_ref", "target", "m.value", "m.pk")
    rows = staging.select(F.col(RN).alias("row_ref"), F.col(PK).alias("row_pk"))
    found = one.join(rows, "row_ref", "left")
    why = F.when(F.col("row_pk").isNull(), "NO_SUCH_ROW").when(~F.col("pk").eqNullSafe(F.col("row_pk")), "OTHER_KEY").otherwise(_allowed(rules))
    why = F.when(F.col("value").isNotNull(), why)
    outcome = F.when(F.col("value").isNull(), "IGNORED").when(F.col("why").isNotNull(), "REJECTED").otherwise("APPLIED")
    return found.withColumn("why", why).select("row_ref", "pk", "target", "value", outcome.alias("outcome"), "why")


def apply(staging: DataFrame, judged: DataFrame, rules: tuple[FieldRule, ...]) -> DataFrame:
    """The staging table with the applied cells, their errors taken out of the error text and the status worked out again."""
    names = [r.target.name for r in rules]
    good = judged.where("outcome = 'APPLIED'")
    wide = good.groupBy("row_ref").agg(*[F.max(F.when(F.col("target") == n, F.col("value"))).alias(f"__{n}") for n in names])
    joined = staging.join(wide, F.col(RN) == F.col("row_ref"), "left")
    cells = {n: F.coalesce(F.col(f"__{n}").try_cast(staging.schema[n].dataType), F.col(n)) for n in names}
    def without(kept: Column, r: FieldRule) -> Column:
        patched = F.col(f"__{r.target.name}").isNotNull()
        return F.filter(kept, lambda e: ~(patched & e.startswith(f"{r.target.table}.{r.target.column}: ")))

    fixed = reduce(without, rules, F.split(F.coalesce(ERRORS, F.lit("")), "; "))
    text = F.nullif(F.array_join(F.filter(fixed, lambda e: e != ""), "; "), F.lit(""))
    out = joined.withColumns({**cells, "__e": text})
    return out.withColumns({STATUS: F.when(F.col("__e").isNull(), "OK").otherwise("FAILED"), ERRORS: F.col("__e")}).select(*staging.columns)


def patch_lineage(judged: DataFrame, staging: DataFrame, rules: tuple[FieldRule, ...]) -> DataFrame:
    """_SRC_PK, target, old_value, new_value of the applied cells."""
    cells = F.array(*[F.struct(F.lit(r.target.name).alias("target"), F.col(r.target.name).cast("string").alias("old_value")) for r in rules])
    old = staging.select(F.col(RN).alias("row_ref"), F.inline(cells))
    return judged.where("outcome = 'APPLIED'").join(old, ["row_ref", "target"]).select(F.col("pk").alias(PK), "target", "old_value", F.col("value").alias("new_value"))
