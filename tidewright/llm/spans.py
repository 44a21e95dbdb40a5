"""Long exact spans shared between records.

1. Equal texts are folded into one by a 128-bit digest, of which only the ids are grouped (a text that occurs under two ids is shared
   as a whole).
2. Anchors: of every 101 consecutive 180-character phrases the one with the least hash is kept, which depends on content alone,
   so a span of 300 characters has an anchor in its first 101 places and its copies have the same ones. Phrases kept in two
   documents are the recurring passages.
3. The passages are compiled into sharded Aho-Corasick automata (bounded nodes per shard). The stretches of text that hold them
   stream through the shards of their own passages, which locates every occurrence and compares it character by character.
4. Only windows of 300 characters around a located passage are candidates. Each is known by two independent 64-bit hashes and belongs
   to the first passage in it; windows that occur in two documents cover the shared positions.

No step pairs documents: a passage in a third of all documents is a minimum and a maximum per hash, taken with map-side partials,
and AQE splits the joins back. Nothing but texts' own stretches is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import Stage

PHRASE = 180
#: Letters of a passage in the automaton; the rest is compared where they occur.
HEAD = 50
#: Automaton nodes per shard: about 60 MB in a Python worker.
SHARD_NODES = 400_000
#: Characters of stretches that one task scans.
TASK_CHARS = 8_000_000
#: Characters of one text that are worked on at a time.
CHUNK = 1_000_000

_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        a[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(a)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(text: str, size: int, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of all windows of ``size`` code points, by position; another odd base gives an independent hash."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_mix(points + np.uint64(base)) * _powers(base, n), out=sums[1:])
    return _mix((sums[size:] - sums[:-size]) * _powers(pow(base, -1, 2**64), n - size + 1))


def _slide(a: np.ndarray, width: int, least) -> np.ndarray:
    """least of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        a = least(a[:-span], a[span:])
        span *= 2
    return least(a[: len(a) - (width - span)], a[width - span :]) if width > span else a


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least hash of some ``width`` consecutive ones (all of equal ones)."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64)
    least = np.pad(_slide(hashes, width, np.minimum), width - 1)
    return np.nonzero(_slide(least, width, np.maximum) == hashes)[0]


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def chunked_anchors(text: str, phrase: int, width: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the anchors; a long text goes in chunks that overlap by what a choice depends on, so memory is bounded."""
    hashes, places = [], []
    for start in range(0, max(len(text) - phrase + 1, 1), chunk):
        low = max(0, start - (width - 1))
        h = window_hashes(text[low : start + chunk + width + phrase - 2], phrase)
        at = anchors(h, width)
        at = at[(at >= start - low) & (at < start - low + chunk)]
        hashes.append(_signed(h[at]))
        places.append((at + low).astype(np.int32))
    return np.concatenate(hashes), np.concatenate(places)


def _find_anchors(phrase: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [chunked_anchors(x, phrase, width) for x in b["text"]]
            yield pd.DataFrame({"t": b["t"], "u": b["u"], "n": b["n"], "grams": [x for x, _ in out], "at": [x for _, x in out]})

    return run


def candidate_runs(piece: str, start: int, places: list[int], located: set[int], size: int, width: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first position, hashes, second hashes) of the windows whose first passage, of those at ``places`` (sorted), is a located one.
    piece begins at ``start`` of its text; a window is no candidate if its first passage is ``width`` or more behind its start."""
    runs, before = [], -1
    for at in places:
        low, high = max(before + 1, at - (width - 1), start), min(at, start + len(piece) - size)
        before = at
        if at in located and low <= high:
            runs.append((low, high))
    out = []
    for low, high in runs:
        part = piece[low - start : high - start + size]
        out.append((low, _signed(window_hashes(part, size)), _signed(window_hashes(part, size, _SECOND))))
    return out


def _scan(size: int, width: int, front: int):
    """Rows sorted by shard, the passages of a shard first (t null): builds its automaton, then streams the stretches through it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        shard, machine, ready, tails = None, None, False, {}
        for b in batches:
            out = {"t": [], "u": [], "run": [], "h1": [], "h2": []}
            for s, head, t, u, start, piece, own, places in zip(b["shard"], b["head"], b["t"], b["u"], b["start"], b["piece"], b["own"], b["places"]):
                if s != shard:
                    shard, machine, ready, tails = s, ahocorasick.Automaton(), False, {}
                if head:
                    known = tails.setdefault(piece[:front], [])
                    known.append(piece)
                    machine.add_word(piece[:front], known)
                    continue
                if not len(machine):
                    continue
                if not ready:
                    machine.make_automaton()
                    ready = True
                wanted, located = set(own), set()
                for end, known in machine.iter(piece):
                    at = end + 1 - front
                    if start + at in wanted and any(piece.startswith(x, at) for x in known):
                        located.add(start + at)
                for low, one, two in candidate_runs(piece, start, list(places), located, size, width):
                    for name, value in zip(out, (t, u, low, one, two)):
                        out[name].append(value)
            if out["t"]:
                yield pd.DataFrame(out)

    return run


def _chains(hits: DataFrame, size: int, phrase: int, width: int) -> DataFrame:
    """hits (t, u, n, at, ...) with the stretch [start, end) they carry, without hits that can't carry a span of ``size``."""
    order = Window.partitionBy("t", "u").orderBy("at")
    linked = hits.withColumn("new", (F.col("at") - F.coalesce(F.lag("at").over(order), F.lit(-(10**9))) > width).cast("int"))
    linked = linked.withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("t", "u", "chain")
    spread = linked.withColumns({"lo": F.min("at").over(whole), "hi": F.max("at").over(whole)})
    return (
        spread.withColumns({"start": F.greatest(F.lit(0), F.col("lo") - (width - 1)).cast("bigint"), "end": F.least("n", F.col("hi") + phrase + width - 1).cast("bigint")})
        .where(F.col("end") - F.col("start") >= size)
        .drop("new", "chain", "lo", "hi", "n")
    )


def shared_spans(docs: DataFrame, doc_id: str, text: str, stage: Stage, size: int = 300, phrase: int | None = None, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Columns doc_id, start_pos, end_pos: the longest stretches of positions (code points from 0) that lie in spans of at least
    ``size`` characters occurring in the text of another doc_id.

    Null, empty and shorter texts share nothing; repeats inside one text are no case; rows without an id are left out; repeated
    rows of one id and text count once; different texts of one id are looked at one by one. An empty table gives no rows.
    """
    width = size // 3 + 1
    phrase = phrase or max(1, PHRASE * size // 300)
    if phrase + width > size + 1:
        raise ValueError("the phrase is too long for this span")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("t"), F.col(text).alias("text")).where(F.col("t").isNotNull() & (F.length("text") >= size))
    rows = rows.select("t", F.xxhash64("text").alias("u"), F.length("text").alias("n"), F.md5("text").alias("key"), "text")
    ids = rows.select("t", "u", "key", "n")
    folded = ids.groupBy("key").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi").select("key", "lo")
    copies = stage.write(ids.join(folded, "key").distinct(), "copies")
    kept = rows.join(copies.where("t > lo").select("t", "u"), ["t", "u"], "left_anti")

    found = kept.select("t", "u", "n", "text").mapInPandas(_find_anchors(phrase, width), "t bigint, u bigint, n int, grams array<bigint>, at array<int>")
    marks = stage.write(found.select("t", "u", "n", F.explode(F.arrays_zip("grams", "at")).alias("m")).select("t", "u", "n", F.col("m.grams").alias("gram"), F.col("m.at").alias("at")), "anchors")
    recurring = marks.groupBy("gram").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min(F.struct("t", "u", "at")).alias("first")).where("a <> b").select("gram", "first")
    hits = _chains(marks.join(recurring, "gram").withColumn("head", F.struct("t", "u", "at") == F.col("first")).drop("first").distinct(), size, phrase, width)
    stretches = hits.groupBy("t", "u", "start", "end").agg(F.sort_array(F.collect_list(F.struct("at", "gram", "head"))).alias("marks"))
    pieces = stretches.join(kept.select("t", "u", "text"), ["t", "u"]).select("t", "u", "start", "marks", F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))").alias("piece"))
    pieces = stage.write(pieces, "pieces")

    passages = pieces.select("start", "piece", F.explode("marks").alias("m")).where("m.head").select(F.col("m.gram").alias("gram"), F.expr(f"substring(piece, cast(m.at - start + 1 as int), {phrase})").alias("piece"))
    sizes = pieces.agg(F.sum(F.aggregate("marks", F.lit(0), lambda n, m: n + m["head"].cast("int"))), F.sum(F.length("piece"))).first()
    shards = max(1, -(-int(sizes[0] or 0) * HEAD // shard_nodes))
    salts = max(1, -(-int(sizes[1] or 0) // (TASK_CHARS * shards)))
    nothing = F.array().cast("array<bigint>")
    heads = passages.select(F.pmod("gram", F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("head"), F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("u"), F.lit(0).cast("bigint").alias("start"), "piece", nothing.alias("own"), nothing.alias("places"))
    owners = pieces.withColumn("shard", F.explode(F.array_distinct(F.transform("marks", lambda m: F.pmod(m["gram"], F.lit(shards)).cast("int")))))
    routed = owners.select(
        "shard", F.pmod(F.xxhash64("t", "u"), F.lit(salts)).cast("int").alias("salt"), F.lit(False).alias("head"), "t", "u", "start", "piece",
        F.transform(F.filter("marks", lambda m: F.pmod(m["gram"], F.lit(shards)) == F.col("shard")), lambda m: m["at"].cast("bigint")).alias("own"),
        F.transform("marks", lambda m: m["at"].cast("bigint")).alias("places"),
    )
    ordered = heads.unionByName(routed).repartition(max(1, min(shards * salts, 4096)), "shard", "salt").sortWithinPartitions("shard", "salt", F.desc("head"))
    stream = ordered.select((F.col("shard") * salts + F.col("salt")).alias("shard"), "head", "t", "u", "start", "piece", "own", "places")
    runs = stage.write(stream.mapInPandas(_scan(size, width, min(HEAD, phrase)), "t bigint, u bigint, run bigint, h1 array<bigint>, h2 array<bigint>"), "runs")

    # a run has at most ``width`` < ``size`` windows, so what is shared of it is one stretch
    windows = runs.select("t", "u", "run", F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "h")).select("t", "u", "run", "i", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    common = windows.groupBy("h1", "h2").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("h1", "h2")
    shared = windows.join(common, ["h1", "h2"], "left_semi").groupBy("t", "u", "run").agg((F.col("run") + F.min("i")).alias("lo"), (F.col("run") + F.max("i")).alias("hi"))
    order = Window.partitionBy("t", "u").orderBy("lo")
    islands = shared.withColumn("new", (F.col("lo") - F.coalesce(F.lag("hi").over(order), F.lit(-(10**15))) > size).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("t", "u", "island").agg(F.min("lo").alias("start_pos"), (F.max("hi") + size).alias("end_pos"))
    whole = copies.select("t", F.lit(0).cast("bigint").alias("start_pos"), F.col("n").cast("bigint").alias("end_pos"))
    alone = spans.join(copies, ["t", "u"], "left_anti").select("t", "start_pos", "end_pos")
    return alone.unionByName(whole).withColumnRenamed("t", doc_id).distinct()


def brute_force(texts: dict[int, str], size: int) -> set[tuple[int, int, int]]:
    """The same by definition, for tests."""
    where: dict[str, set[int]] = {}
    for i, x in texts.items():
        for p in range(len(x) - size + 1):
            where.setdefault(x[p : p + size], set()).add(i)
    out = set()
    for i, x in texts.items():
        covered = np.zeros(len(x) + 2, dtype=bool)
        for p in range(len(x) - size + 1):
            if len(where[x[p : p + size]]) > 1:
                covered[p + 1 : p + 1 + size] = True
        edges = np.nonzero(np.diff(covered.astype(int)))[0]
        out |= {(i, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])}
    return out
