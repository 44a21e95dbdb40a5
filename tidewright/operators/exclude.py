"""Row exclusion: each row is attributed to the first rule that matches it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.combine import predicate
from tidewright.operators.profile import value_counts

#: What a deletion flag holds, and column names that say they are one.
FLAG_VALUES = ["x", "y", "yes", "true", "1", "j", "d", "deleted"]
FLAG_NAME = r"(?i)(^|_)(DEL|DELETED|LOEVM|DELETION|INACTIVE|BLOCKED|OBSOLETE|FLAG)(_|\d|$)"
TEST_NAME = "(?i)(^|[^a-z])(test|dummy|do not use|delete me|xxx)([^a-z]|$)"
EXAMPLES = 3


@dataclass(frozen=True)
class Exclusion:
    rule_id: str
    column: str
    op: str
    values: tuple[str, ...] = ()
    ignore_case: bool = True
    reason: str = ""


def tag(df: DataFrame, rules: list[Exclusion]) -> DataFrame:
    """Adds _EXCLUDED_BY and _EXCLUDED_REASON of the first matching rule, null if none matches. Null never matches but is_blank."""
    by = reason = F.lit(None).cast("string")
    for r in reversed(rules):
        hit = F.coalesce(predicate(F.col(f"`{r.column}`"), r.op, r.values, r.ignore_case, null_matches=False), F.lit(False))
        by, reason = F.when(hit, r.rule_id).otherwise(by), F.when(hit, r.reason).otherwise(reason)
    return df.withColumns({"_EXCLUDED_BY": by, "_EXCLUDED_REASON": reason})


def split(df: DataFrame, rules: list[Exclusion]) -> tuple[DataFrame, DataFrame]:
    """(included without the two columns, excluded with them). Rules that would leave no row at all are an error when there are rows."""
    tagged = tag(df, rules)
    included = tagged.where("_EXCLUDED_BY is null").drop("_EXCLUDED_BY", "_EXCLUDED_REASON")
    if rules and included.isEmpty() and not df.isEmpty():
        raise ValueError("the rules exclude every row")
    return included, tagged.where("_EXCLUDED_BY is not null")


def counts(df: DataFrame, rules: list[Exclusion]) -> DataFrame:
    """rule_id, excluded, examples: per rule the rows it takes and up to three different values of its column, in order, joined with |."""
    value = F.lit(None).cast("string")
    for r in rules:
        value = F.when(F.col("_EXCLUDED_BY") == r.rule_id, F.col(f"`{r.column}`").cast("string")).otherwise(value)
    hits = tag(df, rules).where("_EXCLUDED_BY is not null").groupBy(F.col("_EXCLUDED_BY").alias("rule_id"), value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = hits.selectExpr("*", "row_number() over (partition by rule_id order by v nulls last) as rk")
    return ranked.groupBy("rule_id").agg(
        F.sum("n").alias("excluded"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rk") <= EXAMPLES, F.col("v")))), "|").alias("examples")
    )


def suggest(df: DataFrame, flag_columns: list[str], name_columns: list[str]) -> DataFrame:
    """column_name, kind, value, n: flag columns whose commonest value is a deletion mark on less than half of the rows, and name
    columns with test or dummy names."""
    cells = value_counts(df, [*flag_columns, *name_columns])
    rows = cells.groupBy("column_name").agg(F.sum("n").alias("t"))
    filled = cells.where("value is not null")
    top = filled.where(F.col("column_name").isin(flag_columns)).groupBy("column_name").agg(F.max(F.struct("n", "value")).alias("m"))
    flags = top.join(rows, "column_name").where((F.col("m.n") * 2 < F.col("t")) & F.lower("m.value").isin(FLAG_VALUES))
    tests = filled.where(F.col("column_name").isin(name_columns) & F.col("value").rlike(TEST_NAME)).groupBy("column_name").agg(F.sum("n").alias("n"))
    return flags.select("column_name", F.lit("flag").alias("kind"), F.col("m.value").alias("value"), F.col("m.n").alias("n")).unionByName(
        tests.select("column_name", F.lit("test_name").alias("kind"), F.lit(None).cast("string").alias("value"), "n")
    )
