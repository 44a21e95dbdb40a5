"""Pre-load validation of a staging table: one failure kind per cell, a three-way split, breakdowns and a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import full_match
from tidewright.operators.transform import ERRORS, PK, RN, FieldRule, Target

#: Kinds in the order in which they win, with their severity.
KINDS = {"LOOKUP_FAILED": "HIGH", "LENGTH": "MEDIUM", "CONVERSION": "HIGH", "MANDATORY": "CRITICAL", "FORMAT": "MEDIUM", "CHECKTABLE": "HIGH"}
SAMPLES = 5


def _tagged(target: Target, tag: str) -> Column:
    return F.coalesce(F.concat(F.lit("; "), F.col(ERRORS)).contains(f"; {target.table}.{target.column}: {tag}"), F.lit(False))


def cell_kind(target: Target, mandatory: Column | None = None, domain: tuple[str, ...] | None = None) -> Column:
    """The kind of failure of a target's cell, null if it is sound. Reads the value and the error recorded for it, so that the true
    cause survives. domain: allowed values; a target without one is not checked against any."""
    value = F.col(target.name).cast("string")
    empty = value.isNull() | (F.trim(value) == "")
    out = F.when(_tagged(target, "LOOKUP_FAILED"), "LOOKUP_FAILED").when(
        _tagged(target, "LENGTH_EXCEEDED") | (F.length(value) > target.length if target.length else F.lit(False)), "LENGTH"
    )
    out = out.when(_tagged(target, "CONVERSION_FAILED"), "CONVERSION")
    out = out.when(empty & (mandatory if mandatory is not None else F.lit(target.mandatory)), "MANDATORY")
    out = out.when(~empty & ~full_match(value, "[0-9]+"), "FORMAT") if target.kind == "numc" else out
    if domain:
        out = out.when(~empty & ~value.isin(list(domain)), "CHECKTABLE")
    return out


def kinds(staging: DataFrame, rules: tuple[FieldRule, ...]) -> DataFrame:
    """The staging table with k_<target> per target."""
    return staging.select("*", *[cell_kind(r.target, domain=r.target.check_values).alias(f"k_{r.target.name}") for r in rules])


def _failed(rules: tuple[FieldRule, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"k_{r.target.name}").isNotNull() for r in rules], F.lit(False))


def split(staging: DataFrame, rules: tuple[FieldRule, ...], child: str | None = None) -> dict[str, DataFrame]:
    """valid, rejected, duplicates: filters of one plan. Duplicate children are never judged."""
    df = kinds(staging, rules)
    is_child = F.coalesce(F.col(child), F.lit(False)) if child else F.lit(False)
    plain = [c for c in staging.columns]
    return {
        "valid": df.where(~is_child & ~_failed(rules)).select(*plain),
        "rejected": df.where(~is_child & _failed(rules)).select(*plain),
        "duplicates": df.where(is_child).select(*plain),
    }


def counts(staging: DataFrame, rules: tuple[FieldRule, ...], child: str | None = None) -> DataFrame:
    """evaluated, valid, rejected, duplicates, score (share of valid records in percent, 2 digits; 100 without records)."""
    df = kinds(staging, rules)
    is_child = F.coalesce(F.col(child), F.lit(False)) if child else F.lit(False)
    row = df.agg(
        F.count_if(~is_child).alias("evaluated"), F.count_if(~is_child & ~_failed(rules)).alias("valid"), F.count_if(~is_child & _failed(rules)).alias("rejected"), F.count_if(is_child).alias("duplicates")
    )
    return row.withColumn("score", F.round(F.when(F.col("evaluated") > 0, 100 * F.col("valid") / F.col("evaluated")).otherwise(100.0), 2))


def failures(staging: DataFrame, rules: tuple[FieldRule, ...], child: str | None = None) -> DataFrame:
    """One row per failed cell: __rn, _SRC_PK, target, kind."""
    df = kinds(staging, rules)
    if child:
        df = df.where(~F.coalesce(F.col(child), F.lit(False)))
    cells = F.array(*[F.struct(F.lit(r.target.name).alias("target"), F.col(f"k_{r.target.name}").alias("kind")) for r in rules])
    return df.select(RN, PK, F.inline(F.filter(cells, lambda c: c["kind"].isNotNull())))


def breakdown(staging: DataFrame, rules: tuple[FieldRule, ...], child: str | None = None) -> DataFrame:
    """signature, target, kind, severity, n and the first five keys by row, joined with commas. Ranks are cut before keys are gathered."""
    long = failures(staging, rules, child)
    columns = [r.target.column for r in rules]
    short = {r.target.name: r.target.column if columns.count(r.target.column) == 1 else r.target.name for r in rules}
    label = F.create_map(*[x for k, v in short.items() for x in (F.lit(k), F.lit(v))])
    severity = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    total = long.groupBy("target", "kind").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("target", "kind").orderBy(RN))
    first = long.withColumn("rk", rank).where(F.col("rk") <= SAMPLES).groupBy("target", "kind").agg(F.array_sort(F.collect_list(F.struct("rk", PK))).alias("s"))
    return total.join(first, ["target", "kind"]).select(
        F.concat(F.lit("ERR_"), F.col("kind"), F.lit("_"), label[F.col("target")]).alias("signature"),
        "target",
        "kind",
        severity[F.col("kind")].alias("severity"),
        "n",
        F.array_join(F.transform("s", lambda x: x[PK]), ",").alias("sample_keys"),
    )


def root_cause(kind: Column) -> Column:
    """A sentence for each kind."""
    texts = {
        "LOOKUP_FAILED": "the value has no entry in the lookup", "LENGTH": "the value is longer than the field", "CONVERSION": "the value is not of the field's type",
        "MANDATORY": "the field must be filled", "FORMAT": "the value has characters the field does not take", "CHECKTABLE": "the value is not in the check table",
    }
    return F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), F.lit(v))])[kind]
