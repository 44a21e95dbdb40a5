"""Evaluation texts leaking into training text.

Seeds are word five-grams of the items. One pass over the corpus finds every occurrence of any of them (hash join on 64-bit gram
hashes), and each document that holds one is a candidate for each item that has it. For runs of 12 words alone the rarest gram
of every window of 12 item words, counted over the whole corpus, is enough: a document that holds the window holds its rarest
gram. An edited copy may have lost just that one (beside a verbatim copy it always has), so for edited copies every gram is a
seed. Candidates are then aligned with the item (Smith-Waterman over words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import Stage

SEED = 5
RUN = 12
MATCH, MISMATCH, GAP = 2, -1, -1
#: Item grams up to this many rows (16 bytes each) are broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def words(c):
    """Longest runs of letters and digits, in lower case; null for null."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def _grams(w, n: int):
    """Hashes of the n-grams of an array of words, in order; none if it is shorter."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(
        F.array().cast("array<bigint>")
    )


def align(a: list, b: list) -> tuple[int, int]:
    """(longest common consecutive run, Smith-Waterman score) of two word lists; linear gaps. One vector step per word of b."""
    number: dict[str, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in a], dtype=np.int64)
    n = len(x)
    if not n or not len(b):
        return 0, 0
    run, score = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    slope = np.arange(n + 1) * -GAP
    longest = best = 0
    for w in b:
        same = x == number.get(w, -1)
        nxt = np.zeros(n + 1, dtype=np.int64)
        nxt[1:] = np.where(same, run[:-1] + 1, 0)
        run = nxt
        longest = max(longest, int(run.max()))
        new = np.zeros(n + 1, dtype=np.int64)
        new[1:] = np.maximum(0, np.maximum(score[:-1] + np.where(same, MATCH, MISMATCH), score[1:] + GAP))
        score = np.maximum.accumulate(new + slope) - slope  # gaps along a
        best = max(best, int(score.max()))
    return longest, best


def _aligned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for d, i in batches:
        yield pd.DataFrame([align(x, y) for x, y in zip(d, i)], columns=["run", "score"])


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, stage: Stage, runs_only: bool = False) -> DataFrame:
    """Columns doc_id, item_id, run (longest run of words consecutive in both), score, full (score of the item against itself).

    One row per pair that shares five words in a row; with runs_only at least every pair with a run of 12 words or more, from fewer
    candidates. Null, empty and wordless texts match nothing, nor do items shorter than 12 words (they have no window). Repeated
    rows of an id count once.
    """
    named = lambda df, i, t: df.select(F.col(i).alias("id"), words(F.col(t)).alias("w")).where("id is not null and size(w) > 0")
    own = stage.write(named(items, item_id, item_text).dropDuplicates(["id", "w"]), "items")
    windows = own.where(F.size("w") >= RUN).select("id", F.posexplode(_grams(F.col("w"), SEED)).alias("at", "gram"))
    grams = stage.write(windows.select("gram").distinct(), "grams")
    corpus = named(docs, doc_id, doc_text)
    side = F.broadcast(grams) if grams.count() <= BROADCAST_ROWS else grams
    hits = stage.write(corpus.select("id", F.explode(_grams(F.col("w"), SEED)).alias("gram")).join(side, "gram", "left_semi").distinct(), "hits")
    seeds = windows.select(F.col("id").alias("item"), "gram").distinct()
    if runs_only:
        counts = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        per = RUN - SEED + 1
        starts = windows.join(counts, "gram").select("id", "gram", "n", F.explode(F.sequence(F.col("at") - (per - 1), F.col("at"))).alias("start"))
        last = own.where(F.size("w") >= RUN).select("id", (F.size("w") - RUN).alias("last"))
        rarest = starts.join(last, "id").where("start between 0 and last").groupBy("id", "start").agg(F.min(F.struct("n", "gram")).alias("m"))
        seeds = rarest.select(F.col("id").alias("item"), F.col("m.gram").alias("gram")).distinct()
    pairs = stage.write(hits.join(seeds, "gram").select("id", "item").distinct(), "pairs")
    aligned = F.pandas_udf("run int, score int")(_aligned)
    made = (
        pairs.join(corpus, "id")
        .select(F.col("id").alias("doc"), "item", F.col("w").alias("dw"))
        .join(own.select(F.col("id").alias("item"), F.col("w").alias("iw")), "item")
        .select("doc", "item", (F.size("iw") * MATCH).alias("full"), aligned("dw", "iw").alias("r"))
    )
    return made.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("r.run").alias("run"), F.max("r.score").alias("score"), F.max("full").alias("full"))
