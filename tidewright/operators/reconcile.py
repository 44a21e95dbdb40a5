"""Proof that every source record is explained: counts from lineage, the accounting identity, samples and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.transform import PK


def load_facts(lineage: DataFrame) -> DataFrame:
    """One row from a lineage table: records, failed_records, loaded_records, cells, failed_cells."""
    per = lineage.groupBy(PK).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("loaded")).alias("bad"))
    return per.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("bad") > 0).alias("failed_records"),
        F.count_if(F.col("bad") == 0).alias("loaded_records"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("cells"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("failed_cells"),
    )


def accounting(counts: DataFrame) -> DataFrame:
    """counts: one row with extracted, excluded, duplicates, rejected, loaded, load_failed, not_attempted. Adds accounted, variance, balanced."""
    parts = ["excluded", "duplicates", "rejected", "loaded", "load_failed", "not_attempted"]
    accounted = sum((F.coalesce(F.col(c), F.lit(0)) for c in parts), F.lit(0))
    return counts.withColumn("accounted", accounted).withColumn("variance", F.col("extracted") - F.col("accounted")).withColumn("balanced", F.col("variance") == 0)


def drop_off(counts: DataFrame) -> DataFrame:
    """step, lost, remaining, remaining_share (percent, 2 digits) along the stages."""
    steps = ["excluded", "duplicates", "rejected", "not_attempted", "load_failed"]
    gone, cells = F.lit(0), [F.struct(F.lit(0).alias("step_no"), F.lit("extracted").alias("step"), F.lit(0).cast("bigint").alias("lost"), F.col("extracted").cast("bigint").alias("remaining"))]
    for i, s in enumerate(steps, 1):
        gone = gone + F.col(s)
        cells.append(F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"), F.col(s).cast("bigint").alias("lost"), (F.col("extracted") - gone).cast("bigint").alias("remaining")))
    share = F.round(F.when(F.col("extracted") > 0, 100 * F.col("c.remaining") / F.col("extracted")).otherwise(100.0), 2)
    return counts.select("extracted", F.explode(F.array(*cells)).alias("c")).select("c.step_no", "c.step", "c.lost", "c.remaining", share.alias("remaining_share"))


def checks(counts: DataFrame) -> DataFrame:
    """check_name, passed over the same row of counts; the certificate passes if all do."""
    tests = {
        "accounting_identity": F.col("balanced"),
        "no_negative_count": F.least(*[F.col(c) for c in ("extracted", "excluded", "duplicates", "rejected", "loaded", "load_failed", "not_attempted")]) >= 0,
        "something_loaded": F.col("loaded") > 0,
        "no_load_failures": F.col("load_failed") == 0,
        "everything_attempted": F.col("not_attempted") == 0,
    }
    return accounting(counts).select(F.inline(F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("passed")) for k, v in tests.items()])))


def error_histogram(lineage: DataFrame, top: int = 10) -> DataFrame:
    """The commonest kinds of error: the text before the first colon."""
    kind = F.substring_index("error", ":", 1)
    return lineage.where("error is not null").groupBy(kind.alias("kind"), "target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind", "target").limit(top)


def lineage_sample(lineage: DataFrame, expected_targets: int, known_rules: list[str], n: int = 20) -> DataFrame:
    """For n keys in the order of their md5: cells, targets, whether all is loaded, cells of unknown rules, and complete: every target
    is there once. The keys are sampled first, so that only their cells are gathered."""
    keys = lineage.select(PK).distinct().orderBy(F.md5(PK), PK).limit(n)
    foreign = F.count_if(~F.col("rule_id").isin(known_rules)) if known_rules else F.count(F.lit(1))
    agg = lineage.join(keys, PK, "left_semi").groupBy(PK).agg(
        F.count(F.lit(1)).alias("cells"), F.count_distinct("target").alias("targets"), F.bool_and("loaded").alias("all_loaded"), foreign.alias("foreign_rules"), F.max("error").alias("max_error")
    )
    return agg.withColumn("complete", (F.col("cells") == expected_targets) & (F.col("targets") == expected_targets))


def certificate(counts: DataFrame, title: str) -> str:
    """The certificate as Markdown, from one row of counts."""
    row = accounting(counts).first().asDict()
    lines = [f"# {title}", "", "| figure | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in row.items())]
    lines += ["", "| check | passed |", "| --- | --- |", *(f"| {r['check_name']} | {'yes' if r['passed'] else 'no'} |" for r in checks(counts).collect())]
    return "\n".join(lines) + "\n"
