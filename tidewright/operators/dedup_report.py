"""What entity resolution did: counts and warnings, pairs with both sides' values, the commonest combinations of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More of the eligible records merged away than this is more likely loose matching than real duplicates.
HIGH_MERGE_RATE = 0.25


def report(records: DataFrame, result: DataFrame, id_: str) -> DataFrame:
    """One row: records, clusters, children, largest_cluster, merge_rate (4 digits), high_merge_rate, and children by strength.

    result: the output of the resolution (id, cluster_no, is_child, match_strength).
    """
    sizes = result.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_cluster"))
    kinds = [F.count_if(F.col("is_child") & (F.col("match_strength") == k)).alias(f"children_{k.lower()}") for k in ("REVIEWED", "EXACT", "NAME_ADDRESS", "NAME_ONLY")]
    children = result.agg(F.count_if("is_child").alias("children"), *kinds)
    total = records.agg(F.count(id_).alias("records"))
    row = total.crossJoin(sizes).crossJoin(children)  # one row each
    rate = F.when(F.col("records") > 0, F.col("children") / F.col("records")).otherwise(0.0)
    return row.withColumns({"merge_rate": F.round(rate, 4), "high_merge_rate": rate > HIGH_MERGE_RATE})


def pairs_with_values(pairs: DataFrame, records: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """Each pair (a, b and what else it has) with the named columns of both records, as <column>_a and <column>_b."""
    side = lambda x: records.select(F.col(id_).alias(x), *[F.col(f"`{c}`").alias(f"{c}_{x}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def children_with_masters(result: DataFrame, records: DataFrame, id_: str, pk: str, columns: list[str]) -> DataFrame:
    """Each child beside its master's columns."""
    children = result.where("is_child").join(records.select(F.col(id_).alias("id"), *[F.col(f"`{c}`") for c in columns]), "id")
    heads = result.where("not is_child").select("cluster_no", F.col("id").alias("mid")).join(records.select(F.col(id_).alias("mid"), *[F.col(f"`{c}`").alias(f"master_{c}") for c in columns]), "mid").drop("mid")
    return children.join(heads, "cluster_no")


def error_combinations(staging: DataFrame, errors: str, top: int = 5) -> DataFrame:
    """The commonest combinations of failed targets: combination (targets in order, joined with +), n."""
    parts = F.transform(F.split(F.col(errors), "; "), lambda e: F.substring_index(e, ":", 1))
    combos = staging.where(F.col(errors).isNotNull()).select(F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda p: p.rlike(r"\A[A-Z0-9_]+\.[A-Z0-9_]+\z")))), "+").alias("combination"))
    return combos.groupBy("combination").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "combination").limit(top)
