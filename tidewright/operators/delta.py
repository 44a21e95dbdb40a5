"""Difference of two populations, order-independent fingerprints, and merges that can be taken back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import portable_hash

UNIT = "\x1f"


def digest(columns: list[str]):
    """md5 over the columns in the order of their names, null as empty."""
    return F.md5(F.concat_ws(UNIT, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sorted(columns)]))


def kinds(current: DataFrame, baseline: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key NEW, CHANGED, UNCHANGED or REMOVED. Only key and digest are shuffled."""
    for df in (current, baseline):
        if set(columns) - set(df.columns):
            raise ValueError("the two populations have different target columns")
    a = current.select(F.col(f"`{key}`").alias("k"), digest(columns).alias("a"))
    b = baseline.select(F.col(f"`{key}`").alias("k"), digest(columns).alias("b"))
    kind = F.when(F.col("b").isNull(), "NEW").when(F.col("a").isNull(), "REMOVED").when(F.col("a") == F.col("b"), "UNCHANGED").otherwise("CHANGED")
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), kind.alias("kind"))


def payload(current: DataFrame, baseline: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The new and changed records with _DELTA_KIND; a key that occurs several times keeps all its rows."""
    found = kinds(current, baseline, key, columns).where(F.col("kind").isin("NEW", "CHANGED")).distinct().withColumnRenamed("kind", "_DELTA_KIND")
    return current.join(found, key)


def removed_why(current: DataFrame, baseline: DataFrame, key: str, columns: list[str], rejected: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """The removed keys with _WHY: NOW_DUPLICATE before NOW_REJECTED before NOT_IN_CURRENT_VALID."""
    gone = kinds(current, baseline, key, columns).where("kind = 'REMOVED'").select(key).distinct()
    why = F.lit("NOT_IN_CURRENT_VALID")
    for df, label in ((rejected, "NOW_REJECTED"), (duplicates, "NOW_DUPLICATE")):
        if df is not None:
            gone = gone.join(df.select(key).distinct().withColumn(f"__{label}", F.lit(True)), key, "left")
            why = F.when(F.col(f"__{label}").isNotNull(), label).otherwise(why)
    return gone.select(key, why.alias("_WHY"))


def fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column_name, n_rows, total: per column the sum of 60-bit hashes of key, column and value. The same for any order of rows;
    null and empty are one. Exact decimals, so nothing overflows."""
    sums = [
        F.sum(portable_hash(F.concat_ws(UNIT, F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))).cast("decimal(38,0)")).alias(f"s{i}")
        for i, c in enumerate(columns)
    ]
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    out = [F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string").alias("total")) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*out)))


def fingerprint_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns whose fingerprints differ: all of them when the row counts do."""
    x, y = fingerprint(a, key, columns), fingerprint(b, key, columns).toDF("column_name", "m_rows", "other")
    return x.join(y, "column_name").where((F.col("n_rows") != F.col("m_rows")) | (F.col("total") != F.col("other"))).select("column_name")


def merge(target: DataFrame, changes: DataFrame, key: str, run: str, run_id: str, deletes: DataFrame | None = None) -> dict[str, DataFrame]:
    """after: the target with each changed key replaced or inserted and the deleted keys gone; before_image: every replaced or deleted
    row as it was. Rows written carry the run's id."""
    columns = target.columns
    new = changes.withColumn(run, F.lit(run_id)).select(*columns)
    touched = reduce(DataFrame.unionByName, [df.select(key) for df in (changes, deletes) if df is not None]).distinct()
    return {"after": target.join(touched, key, "left_anti").select(*columns).unionByName(new), "before_image": target.join(touched, key, "left_semi").select(*columns)}


def roll_back_merge(after: DataFrame, before_image: DataFrame, run: str, run_id: str) -> DataFrame:
    """The target as it was: the run's rows removed, the before-image put back."""
    return after.where(~F.col(run).eqNullSafe(F.lit(run_id))).unionByName(before_image)


def merge_counts(target: DataFrame, changes: DataFrame, key: str, deletes: DataFrame | None = None) -> DataFrame:
    """before, inserted, replaced, deleted, after and whether after = before + inserted - deleted. Keys are unique in both tables."""
    t = target.select(F.col(key).alias("k"), F.lit(1).alias("t"))
    c = changes.select(F.col(key).alias("k"), F.lit(1).alias("c"))
    d = (deletes if deletes is not None else changes.limit(0)).select(F.col(key).alias("k"), F.lit(1).alias("d"))
    all_ = t.join(c, "k", "full_outer").join(d, "k", "full_outer")
    out = all_.agg(
        F.count("t").alias("before"),
        F.count_if(F.col("c").isNotNull() & F.col("t").isNull()).alias("inserted"),
        F.count_if(F.col("c").isNotNull() & F.col("t").isNotNull()).alias("replaced"),
        F.count_if(F.col("d").isNotNull() & F.col("t").isNotNull() & F.col("c").isNull()).alias("deleted"),
        F.count_if(F.col("c").isNotNull() | (F.col("t").isNotNull() & F.col("d").isNull())).alias("after"),
    )
    return out.withColumn("balanced", F.col("after") == F.col("before") + F.col("inserted") - F.col("deleted"))
