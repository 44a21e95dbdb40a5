"""Nearest neighbours of a stated query set by cosine, exactly, in blocks.

The queries are cut into blocks that are known to fit (their number and width are bounded); each block is one matrix that the tasks
hold while the vectors stream past in Arrow batches. Every batch gives at most k candidates per query, so what is shuffled is k rows
per query and task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries per block: at 1024 dimensions 32 MB.
BLOCK = 4096


def nearest(vectors: DataFrame, queries: DataFrame, id_: str, vector: str, k: int) -> DataFrame:
    """query_id, id, rank, score (cosine): the k nearest other vectors of every query; ties to the smaller id.

    Null vectors, vectors of length 0 and such of another dimension than the query take no part.
    """
    spark = vectors.sparkSession
    width = queries.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, rank int, score double")
    own = queries.where(F.size(vector) == width["n"]).select(F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("v"))
    low, out = None, None
    while True:
        block = (own if low is None else own.where(F.col("id") > low)).orderBy("id").limit(BLOCK).collect()
        if not block:
            break
        low = block[-1]["id"]
        ids = np.array([r["id"] for r in block], dtype=np.int64)
        matrix = np.array([r["v"] for r in block], dtype=np.float64)
        sizes = np.linalg.norm(matrix, axis=1)
        ids, matrix = ids[sizes > 0], matrix[sizes > 0] / sizes[sizes > 0][:, None]
        if len(ids):
            part = _against(vectors, id_, vector, width["n"], spark.sparkContext.broadcast((ids, matrix)), k)
            out = part if out is None else out.unionByName(part)
        if len(block) < BLOCK:
            break
    if out is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, rank int, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def _against(vectors: DataFrame, id_: str, vector: str, width: int, block, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = block.value
        for b in batches:
            other = np.stack(b["v"].to_numpy()).astype(np.float64) if len(b) else np.zeros((0, width))
            size = np.linalg.norm(other, axis=1)
            keep = size > 0
            names, unit = b["id"].to_numpy()[keep], other[keep] / size[keep][:, None]
            if not len(names):
                continue
            scores = np.round(matrix @ unit.T, 12)
            scores[ids[:, None] == names[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(names, scores.shape), -scores), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(ids)), order.shape[1])
            out = pd.DataFrame({"query_id": ids[rows], "id": names[order.ravel()], "score": scores[rows, order.ravel()]})
            yield out[np.isfinite(out["score"])]

    usable = vectors.where(F.size(vector) == width).select(F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("v"))
    return usable.mapInPandas(run, "query_id bigint, id bigint, score double")


def interleave(rankings: DataFrame, k: int) -> DataFrame:
    """rankings (query_id, ranking, rank, target): one list per query that takes the rankings' first, then their second ... entries, each
    target once, k in all."""
    w = Window.partitionBy("query_id", "target").orderBy("rank", "ranking")
    once = rankings.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    order = Window.partitionBy("query_id").orderBy("rank", "ranking", "target")
    return once.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("query_id", "position", "target")
