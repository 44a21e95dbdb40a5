"""Column-level quality profile and what changes between loads.

The profile is exact: the columns are unpivoted and counted per (load, column, value) with map-side partial counts, so a value
that fills a third of all rows travels as a few counts. Everything else (no values, distincts, lengths, pattern violations,
shapes) is aggregated from those counts, and loads are compared through their shape counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import full_match


def shape_of(c):
    """Runs of 0-9, A-Z, a-z become 9, A, a; other characters stay; no value is the empty shape."""
    s = F.regexp_replace(c, "[0-9]+", "9")
    s = F.regexp_replace(s, "[A-Z]+", "A")
    return F.coalesce(F.regexp_replace(s, "[a-z]+", "a"), F.lit(""))


def shape_counts(df: DataFrame, load: str, columns: list[str], patterns: dict[str, str]) -> DataFrame:
    """Per (load, column_name, shape): n, nulls, distincts, min_len, max_len, violations. Outer blanks (U+0020) are cut, empty is null."""
    cells = df.select(
        F.col(f"`{load}`").alias("load"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias("value")) for c in columns])
        ).alias("cell"),
    )
    counts = cells.groupBy("load", F.col("cell.column_name").alias("column_name"), F.col("cell.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    broken = F.lit(False)
    for c, p in patterns.items():
        broken = F.when(F.col("column_name") == c, ~full_match(F.col("value"), p)).otherwise(broken)
    is_null = F.col("value").isNull()
    return counts.groupBy("load", "column_name", shape_of(F.col("value")).alias("shape")).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(is_null, F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distincts"),
        F.min(F.length("value")).alias("min_len"),
        F.max(F.length("value")).alias("max_len"),
        F.sum(F.when(~is_null & broken, F.col("n")).otherwise(0)).alias("violations"),
    )


def load_profile(shapes: DataFrame) -> DataFrame:
    """Per (load, column_name): n_rows, nulls, distincts, min_len, max_len, violations, shapes (number of different shapes)."""
    return shapes.groupBy("load", "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum("nulls").alias("nulls"),
        F.sum("distincts").alias("distincts"),
        F.min("min_len").alias("min_len"),
        F.max("max_len").alias("max_len"),
        F.sum("violations").alias("violations"),
        F.count(F.lit(1)).alias("shapes"),
    )


def load_drift(shapes: DataFrame) -> DataFrame:
    """Per (load, column_name) but the first load: the profile beside that of the load before (prev_ columns), with

    moved (sum over shapes of abs(n * prev_rows - prev_n * rows), an exact decimal: half of it over rows * prev_rows is the
    total-variation distance), psi (population stability index, shares floored at 1e-6) and chi2 (two-sample chi-square).
    The load before is the next lower load present; rows without a load number take no part. No rows for one load only.
    """
    shapes = shapes.where("load is not null")
    w = Window.partitionBy("column_name").orderBy("load")
    names = ["n_rows", "nulls", "distincts", "min_len", "max_len", "violations"]
    steps = (
        load_profile(shapes)
        .select("*", F.lag("load").over(w).alias("prev_load"), *[F.lag(x).over(w).alias(f"prev_{x}") for x in names])
        .where("prev_load is not null")
    )
    totals = steps.select("column_name", "load", "prev_load", "n_rows", "prev_n_rows")
    sides = (
        shapes.join(totals, ["column_name", "load"])
        .select("column_name", "load", "shape", "n_rows", "prev_n_rows", F.col("n").alias("cur"), F.lit(0).cast("long").alias("prev"))
        .unionByName(
            shapes.withColumnRenamed("load", "prev_load")
            .join(totals, ["column_name", "prev_load"])
            .select("column_name", "load", "shape", "n_rows", "prev_n_rows", F.lit(0).cast("long").alias("cur"), F.col("n").alias("prev"))
        )
    )
    both = sides.groupBy("column_name", "load", "shape", "n_rows", "prev_n_rows").agg(F.sum("cur").alias("cur"), F.sum("prev").alias("prev"))
    d = lambda c: F.col(c).cast("decimal(19,0)")
    p, q = F.greatest(F.col("cur") / F.col("n_rows"), F.lit(1e-6)), F.greatest(F.col("prev") / F.col("prev_n_rows"), F.lit(1e-6))
    ratio = F.sqrt(F.col("prev_n_rows") / F.col("n_rows"))
    distances = both.groupBy("column_name", "load").agg(
        F.sum(F.abs(d("cur") * d("prev_n_rows") - d("prev") * d("n_rows"))).alias("moved"),
        F.sum((p - q) * F.log(p / q)).alias("psi"),
        F.sum(F.pow(F.col("cur") * ratio - F.col("prev") / ratio, 2) / (F.col("cur") + F.col("prev"))).alias("chi2"),
    )
    return steps.join(distances, ["column_name", "load"])


def drift_findings(drift: DataFrame, rate: float = 0.1, length: int = 3, distance: float = 0.25) -> DataFrame:
    """Columns load, column_name, finding (null_rate, distinct, range, pattern, distribution), one row per finding.

    Shares are compared exactly, as products of counts. Lengths of a load without any value count as unknown and give no finding
    of range unless just one of the two loads has values.
    """
    d = lambda c: F.col(c).cast("decimal(19,0)")
    area = d("n_rows") * d("prev_n_rows")

    def share(c: str):
        return F.abs(d(c) * d("prev_n_rows") - d(f"prev_{c}") * d("n_rows")) > area * F.lit(str(rate)).cast("decimal(6,4)")

    def far(c: str):
        return F.coalesce(F.abs(F.col(c) - F.col(f"prev_{c}")) > length, F.col(c).isNull() != F.col(f"prev_{c}").isNull())

    found = {
        "null_rate": share("nulls"),
        "distinct": share("distincts"),
        "range": far("min_len") | far("max_len"),
        "pattern": share("violations"),
        "distribution": F.col("moved") > area * F.lit(str(2 * distance)).cast("decimal(6,4)"),
    }
    return drift.select(
        "load",
        "column_name",
        F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]), lambda x: x.isNotNull())).alias("finding"),
    )
