"""The stateless operators over streams of landed rows, and uniqueness within a watermark. An extension: the batch operators are the
measure, and on a bounded stream (trigger AvailableNow) the results are theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.exclude import Exclusion, tag
from tidewright.operators.quality import flag_rows


def read_landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a landing folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def violations(stream: DataFrame, column: str, rule_id: str, country: str | None = None) -> DataFrame:
    """The rows that break a row rule."""
    return flag_rows(stream, column, rule_id, country)


def exclusions(stream: DataFrame, rules: list[Exclusion]) -> DataFrame:
    """Rows tagged with the first rule that matches."""
    return tag(stream, rules)


def first_deliveries(stream: DataFrame, key: str, time: str, lateness: str = "1 day") -> DataFrame:
    """The first row of each key, for keys that come again within the lateness."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, size: str, lateness: str) -> DataFrame:
    """window_start, value of ``by``, n per tumbling window."""
    counts = stream.withWatermark(time, lateness).groupBy(F.window(time, size).alias("w"), F.col(by).alias(by)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), by, "n")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there to Parquet and stops; a restart goes on after the last finished batch."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
