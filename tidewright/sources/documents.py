"""Document stores: nested documents flattened to text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH, MAX_COLUMNS = 4, 500


def flatten(df: DataFrame, depth: int = MAX_DEPTH, most: int = MAX_COLUMNS) -> DataFrame:
    """Nested objects as dotted columns down to ``depth`` levels; deeper ones and every array as compact JSON text; the rest as text.
    More than ``most`` columns are an error."""
    out = []

    def walk(kind: T.DataType, c, name: str, level: int) -> None:
        if isinstance(kind, T.StructType) and level < depth and kind.fields:
            for f in kind.fields:
                walk(f.dataType, c.getField(f.name), f"{name}.{f.name}" if name else f.name, level + 1)
        elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(c).alias(name))
        elif isinstance(kind, T.BinaryType):
            out.append(F.when(c.isNotNull(), F.hex(c)).alias(name))
        else:
            out.append(c.cast("string").alias(name))

    for f in df.schema.fields:
        walk(f.dataType, F.col(f"`{f.name}`"), f.name, 1)
    if len(out) > most:
        raise ValueError(f"{len(out)} columns; at most {most} are taken")
    return df.select(*out)


def from_json_text(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Documents held as JSON text in a column: their schema is the union over all documents, then they are flattened. A text that is
    no object gives nulls."""
    spark: SparkSession = df.sparkSession
    schema = spark.read.option("primitivesAsString", True).json(df.select(column).where(F.col(column).isNotNull()).rdd.map(lambda r: r[0])).schema
    if not schema.fields:
        return df.select(*keep)
    parsed = df.select(*keep, F.from_json(column, schema, {"primitivesAsString": "true"}).alias("d"))
    return flatten(parsed.select(*keep, "d.*"))


def union_of_columns(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts under the union of their columns; what a part lacks is null."""
    out = flatten(parts[0])
    for p in parts[1:]:
        out = out.unionByName(flatten(p), allowMissingColumns=True)
    return out


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """field, n: the top-level fields of JSON objects and how many documents have them, without inferring a schema."""
    keys = df.select(F.explode(F.json_object_keys(column)).alias("field"))
    return keys.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def geo_point(c, name: str) -> list:
    """Latitude and longitude of a point as two text columns."""
    return [c.getField("latitude").cast("string").alias(f"{name}.latitude"), c.getField("longitude").cast("string").alias(f"{name}.longitude")]
