"""A combined table as a source: landed with its specification and the fingerprints of its inputs, so that it can say what changed."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import portable_hash
from tidewright.operators.combine import Spec, combine
from tidewright.operators.delta import UNIT
from tidewright.operators.rows import number_rows
from tidewright.session import Stage
from tidewright.sources.deliver import _Files


def content(df: DataFrame) -> dict:
    """Rows and the sum of the rows' 60-bit hashes: the same for any order of rows, another if any value changes."""
    row = F.concat_ws(UNIT, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(portable_hash(row).cast("decimal(38,0)")).cast("string").alias("s")).first()
    return {"rows": got["n"], "sum": got["s"] or "0", "columns": df.columns}


def land_combined(spark: SparkSession, spec: Spec, tables: dict[str, DataFrame], out: str) -> dict:
    """Writes the combined table with row numbers to out/data and its evidence to out/evidence; gives the evidence."""
    df = number_rows(combine(spec, tables), Stage(spark, "combined"))
    df.write.mode("overwrite").parquet(f"{out}/data")
    used = {spec.base, *(j.table for j in spec.joins)}
    evidence = {"spec": json.loads(json.dumps(asdict(spec))), "inputs": {t: content(tables[t]) for t in sorted(used)}, "rows": spark.read.parquet(f"{out}/data").count()}
    _Files(spark, out).write("evidence", evidence)
    return evidence


def changed_inputs(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> list[str]:
    """The inputs that are not what they were when the combined table was landed."""
    evidence = _Files(spark, out).read("evidence")
    if evidence is None:
        raise ValueError("there is no combined table")
    return [t for t, was in evidence["inputs"].items() if t not in tables or content(tables[t]) != was]
