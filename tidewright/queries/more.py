"""Queries over reports and reviews: what resolution did, human decisions, error combinations, combined sources, delivery plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewright.operators import combine, dedup, dedup_report
from tidewright.queries import migrate, read
from tidewright.queries.assess import LEFT
from tidewright.session import Stage, shared_dir
from tidewright.sources import combined, deliver


def dedup_report_counts(spark, sf):
    result = Stage(spark, "report").write(migrate.dedup_full(spark, sf), "result")
    return dedup_report.report(migrate._records(spark, sf), result, "rn")


def dedup_pairs_report(spark, sf):
    """The exact links with both names."""
    return dedup_report.pairs_with_values(migrate.dedup_veto(spark, sf), migrate._records(spark, sf), "rn", ["CUST_NAME"])


def dedup_children_report(spark, sf):
    stage = Stage(spark, "report")
    master = stage.write(migrate.dedup_golden(spark, sf), "master")
    return dedup_report.children_with_masters(master, migrate._records(spark, sf), "rn", "CUST_ID", ["CUST_ID", "CITY"]).select("id", "cluster_no", "CUST_ID", "CITY", "master_CUST_ID", "master_CITY")


def dedup_decisions(spark, sf):
    """Exact links after made-up reviews: every 5th smaller id must not be linked, every 10th record must be linked with the next."""
    edges = migrate.dedup_veto(spark, sf)
    cannot = edges.where("a % 5 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))
    must = migrate._records(spark, sf).where("rn % 10 = 0").select(F.col("rn").alias("a"), (F.col("rn") + 1).alias("b"))
    return dedup.decided(edges, must, cannot)


def error_combinations(spark, sf):
    return dedup_report.error_combinations(migrate._written(spark, sf), "_TRANSFORM_ERRORS")


def combined_source(spark, sf):
    """Lands a combined table, changes one of its inputs, and asks what changed."""
    tables = {t: read(spark, sf, t) for t in ("customer", "nation", "region")}
    out = f"{shared_dir(spark)}/combined-{uuid.uuid4().hex}"
    evidence = combined.land_combined(spark, LEFT, tables, out)
    changed = combined.changed_inputs(spark, tables | {"nation": tables["nation"].where("n_nationkey > 0")}, out)
    rows = spark.read.parquet(f"{out}/data").agg(F.count(F.lit(1)).alias("n_rows"), F.max("__rn").alias("last_row"))
    return rows.select("n_rows", F.coalesce("last_row", F.lit(0)).alias("last_row"), (F.col("n_rows") == evidence["rows"]).alias("as_landed"), F.lit(",".join(changed)).alias("changed"))


def delivery_plan(spark, sf):
    staged = migrate._staging(spark, sf)
    return deliver.plan(staged, ["BUT000_NAME_ORG1", "ADRC_COUNTRY"], "_SRC_PK", "run-7", ["SRC_TAX_ID"])


def combine_preview(spark, sf):
    """The first rows of a combination in the order of its base rows."""
    tables = {t: read(spark, sf, t) for t in ("customer", "nation", "region")}
    return combine.combine(LEFT, tables).orderBy("c_custkey").limit(25)


QUERIES = {f.__name__: f for f in (dedup_report_counts, dedup_pairs_report, dedup_children_report, dedup_decisions, error_combinations, combined_source, delivery_plan, combine_preview)}

_LABELS = [f"{r.target.table}.{r.target.column}" for r in migrate.FIELDS]
SQL = {
    "dedup_pairs_report": f"{migrate._DW} SELECT ve.*, x.CUST_NAME AS CUST_NAME_a, y.CUST_NAME AS CUST_NAME_b FROM ve JOIN lookalikes x ON x.rn = a JOIN lookalikes y ON y.rn = b",
    "dedup_children_report": f"""{migrate._DW}, {migrate._COMP}, {migrate._GOLD}
  SELECT g.id, g.cluster_no, c.CUST_ID, c.CITY, m.CUST_ID AS master_CUST_ID, m.CITY AS master_CITY FROM gd g JOIN lookalikes c ON c.rn = g.id JOIN gd h ON h.cluster_no = g.cluster_no AND NOT h.is_child JOIN lookalikes m ON m.rn = h.id WHERE g.is_child""",
    "dedup_decisions": f"""{migrate._DW}, e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, reason FROM ve UNION ALL SELECT rn, rn + 1, 'REVIEWED' FROM lookalikes WHERE rn % 10 = 0)
  SELECT * FROM e WHERE (a, b) NOT IN (SELECT (least(a, b), greatest(a, b)) FROM ve WHERE a % 5 = 0)""",
    "error_combinations": f"{migrate._WITH} SELECT combination, count(*) AS n FROM (SELECT array_to_string(list_sort([x FOR x IN ["
    + ", ".join(f"CASE WHEN e_{i} IS NOT NULL THEN '{x}' END" for i, x in enumerate(_LABELS))
    + "] IF x IS NOT NULL]), '+') AS combination FROM x3) WHERE combination <> '' GROUP BY 1 ORDER BY n DESC, combination LIMIT 5",
    "combined_source": "SELECT count(*) AS n_rows, count(*) AS last_row, true AS as_landed, 'nation' AS changed FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "delivery_plan": f"{migrate._WITH} SELECT BUT000_NAME_ORG1, ADRC_COUNTRY, left(_SRC_PK, 255) AS LEGACY_KEY, 'run-7' AS MIG_RUN_ID, replace(SRC_TAX_ID, chr(0), '␀') AS SRC_TAX_ID FROM st",
    "combine_preview": "SELECT c_custkey, c_name, n_name, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY c_custkey LIMIT 25",
}
