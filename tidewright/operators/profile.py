"""Column and table profile, type and key inference.

Statistics of all columns come from one scan (conditional counts, minima and maxima). Distinct counts come from value counts of
the unpivoted table, which shrink on the map side, instead of one Expand per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import full_match, trim_to_null

#: Patterns every trimmed value is held against.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "iso_country_2": r"[A-Z]{2}",
    "postal_code": r"[A-Za-z0-9][A-Za-z0-9 \-]{2,9}",
    "numeric_string": r"[0-9]+",
    "leading_zero_numeric": r"0[0-9]+",
}
#: A column's pattern that its name hints at.
HINTS = {"email": r"MAIL|SMTP", "iso_country_2": r"COUNTRY|LAND|CTRY", "postal_code": r"POST|ZIP|PSTLZ"}
INTEGER = r"-?(0|[1-9][0-9]{0,17})"
DECIMAL = r"-?(0|[1-9][0-9]*)\.[0-9]+"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?"


def unpivot(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns column_name, value: one row per cell, trimmed, blank as null."""
    cells = [F.struct(F.lit(c).alias("column_name"), trim_to_null(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns or df.columns]
    return df.select(F.inline(F.array(*cells)))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns column_name, value, n."""
    return unpivot(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_columns(counts: DataFrame) -> DataFrame:
    """From value counts, per column: rows, nulls, distincts and their ratios (4 digits), lengths, leading-zero numbers.

    The distinct ratio is over the rows that have a value. A column without any value has ratio 0 and no lengths.
    """
    has = F.col("value").isNotNull()
    zero = has & full_match(F.col("value"), PATTERNS["leading_zero_numeric"])
    agg = counts.groupBy("column_name").agg(
        F.sum("n").alias("total_rows"),
        F.sum(F.when(has, 0).otherwise(F.col("n"))).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
        F.sum(F.when(zero, F.col("n")).otherwise(0)).alias("leading_zero_matches"),
    )
    filled = F.col("total_rows") - F.col("null_count")
    return agg.withColumns(
        {
            "null_ratio": F.round(F.col("null_count") / F.col("total_rows"), 4),
            "distinct_ratio": F.round(F.when(filled > 0, F.col("distinct_count") / filled).otherwise(0.0), 4),
        }
    )


def pattern_conformity(counts: DataFrame) -> DataFrame:
    """Per column and pattern: matching rows and their share of the rows that have a value."""
    names = F.array(*[F.lit(p) for p in PATTERNS])
    hit = F.array(*[full_match(F.col("value"), p).cast("bigint") * F.col("n") for p in PATTERNS.values()])
    cells = counts.where("value is not null").select("column_name", "n", F.explode(F.arrays_zip(names.alias("pattern"), hit.alias("hits"))).alias("c"))
    sums = cells.groupBy("column_name", F.col("c.pattern").alias("pattern")).agg(F.sum("c.hits").alias("matches"), F.sum("n").alias("checked"))
    return sums.withColumn("ratio", F.round(F.col("matches") / F.col("checked"), 4))


def health(profile: DataFrame, conformity: DataFrame) -> DataFrame:
    """Score of 0 to 100 per column and flags: full values score 100; leading zeros in a number column, a constant column and a
    hinted pattern that fits only partly cost points."""
    hinted = F.lit(False)
    for pattern, hint in HINTS.items():
        hinted = hinted | ((F.col("pattern") == pattern) & F.col("column_name").rlike("(?i)" + hint))
    gaps = conformity.where(hinted & (F.col("ratio") >= 0.2) & (F.col("ratio") < 1)).groupBy("column_name").agg(F.sum(20 * (1 - F.col("ratio"))).alias("gap"))
    constant = (F.col("distinct_count") == 1) & (F.col("total_rows") > 1)
    score = 100 * (1 - F.col("null_ratio")) - F.when(F.col("leading_zero_matches") > 0, 10).otherwise(0) - F.when(constant, 5).otherwise(0) - F.coalesce("gap", F.lit(0.0))
    flags = F.array_join(
        F.filter(
            F.array(F.when(F.col("null_ratio") > 0.2, "HIGH_NULLS"), F.when(constant, "CONSTANT"), F.when(F.col("distinct_ratio") >= 0.95, "NEAR_UNIQUE_KEY")), lambda x: x.isNotNull()
        ),
        ",",
    )
    return profile.join(gaps, "column_name", "left").select("column_name", F.round(F.greatest(score, F.lit(0.0)), 2).alias("score"), flags.alias("flags"))


def top_values(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values per column, ties by value."""
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts.where("value is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("column_name", "rank", "value", "n")


def sample_values(counts: DataFrame, k: int = 5) -> DataFrame:
    """k different values per column in the order of their md5: the same sample on every run and engine."""
    w = Window.partitionBy("column_name").orderBy(F.md5("value"), "value")
    return counts.where("value is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("column_name", "rank", "value")


def full_row_duplicates(df: DataFrame) -> DataFrame:
    """total_rows, distinct_rows, duplicate_rows; blanks don't count, as everywhere."""
    rows = df.select(*[trim_to_null(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    groups = rows.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows")).withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))


def key_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """key_value (parts joined with |) and n, for keys without a missing part that occur more than once."""
    parts = [trim_to_null(F.col(f"`{k}`").cast("string")) for k in keys]
    rows = df.select(F.concat_ws("|", *parts).alias("key_value"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]).dropna()
    return rows.groupBy("key_value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: groups, surplus_rows and the five worst keys (most rows first, ties by key), joined with commas."""
    groups = key_groups(df, keys)
    totals = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))
    worst = groups.orderBy(F.desc("n"), "key_value").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "key_value"))), lambda x: x["key_value"]), ",").alias("sample_keys"))
    return totals.crossJoin(worst)  # one row each


def key_problems(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, rows with a blank key part, repeated key values, rows in them."""
    parts = [trim_to_null(F.col(f"`{k}`").cast("string")) for k in keys]
    rows = df.select(F.when(sum((p.isNull().cast("int") for p in parts), F.lit(0)) == 0, F.concat_ws("|", *parts)).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    repeated = F.col("k").isNotNull() & (F.col("n") > 1)
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("blank_rows"),
        F.count_if(repeated).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("repeated_rows"),
    )


def candidate_keys(profile: DataFrame, least: float = 0.95, most: int = 5) -> DataFrame:
    """Columns without nulls that are nearly unique, at most five, in the order of their names."""
    return profile.where((F.col("null_count") == 0) & (F.col("total_rows") > 0) & (F.col("distinct_ratio") >= least)).select("column_name", "distinct_ratio").orderBy("column_name").limit(most)


def infer_types(counts: DataFrame) -> DataFrame:
    """Type per column from its text: BIGINT, DOUBLE, DATE, TIMESTAMP, BOOLEAN, else VARCHAR. Leading zeros keep a column text."""
    v, n = F.col("value"), F.col("n")
    share = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    is_int, is_dec = full_match(v, INTEGER), full_match(v, DECIMAL)
    is_date = full_match(v, DATE) & v.try_cast("date").isNotNull()
    is_time = full_match(v, TIME) & v.try_cast("timestamp_ntz").isNotNull()
    agg = (
        counts.where("value is not null")
        .groupBy("column_name")
        .agg(F.sum("n").alias("filled"), share(is_int).alias("i"), share(is_dec).alias("d"), share(is_date).alias("dt"), share(is_time).alias("ts"), share(F.lower(v).isin("true", "false")).alias("b"))
    )
    kind = F.lit("VARCHAR")
    for name, cond in (("BOOLEAN", "b"), ("TIMESTAMP", None), ("DATE", "dt"), ("DOUBLE", None), ("BIGINT", "i")):
        test = F.col(cond) == F.col("filled") if cond else (F.col("i") + F.col("d") if name == "DOUBLE" else F.col("dt") + F.col("ts")) == F.col("filled")
        kind = F.when(test, name).otherwise(kind)
    names = counts.select("column_name").distinct()
    return names.join(agg, "column_name", "left").select("column_name", F.coalesce(F.when(F.col("filled").isNotNull(), kind), F.lit("VARCHAR")).alias("inferred_type"))
