"""Row numbers without gathering rows, deterministic samples, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import Stage

RN = "__rn"


def number_rows(df: DataFrame, stage: Stage, name: str = RN, order: list | None = None) -> DataFrame:
    """Adds consecutive numbers from 1 in the given order (range-sorted), or in the order of the partitions.

    Each task writes its rows with their place in the task; the tasks' offsets are a running sum over one count per task. The
    numbers are data from then on: reading them again gives the same.
    """
    ordered = df.orderBy(*order) if order else df
    written = stage.write(ordered.withColumns({"__pid": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    counts = written.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as tasks
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return written.join(offsets, "__pid").withColumn(name, (F.col("__before") + F.col("__at") + 1).cast("bigint")).drop("__pid", "__at", "__before")


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of the md5 of their key: the same sample on every run and engine."""
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return df.orderBy(F.md5(text), text).limit(n)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of the order."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(max(limit, 0))


def page_with_totals(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page, each row with the number of all rows."""
    return page(df, order, offset, limit).crossJoin(df.agg(F.count(F.lit(1)).alias("total")))  # one row
