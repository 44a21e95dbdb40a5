"""Consolidating pairwise links into groups by low-diameter decomposition.

Per level every vertex draws an exponential shift d(v) = -ln(u(v)) / beta from a hash of its id. A cluster starts at its centre
at time -d and needs one unit of time per edge. Every vertex takes as its parent whatever reaches it first, itself or a
neighbour; following parents (pointer doubling over the vertex table, which is smaller than the edges) gives its centre. Edges
are then contracted to edges between centres, loops and repeats fall away, and the next level works on what is left. Since a
centre always lies in its vertex's component and contraction maps edges to edges, any such assignment keeps components apart
and whole. The number of vertices that still have edges falls geometrically. At the end the assignments of all levels are
composed from the last to the first.

Scale: no group is ever gathered. The only per-group operations are sums and minima with map-side partials; a vertex with a
third of all edges is one row of the vertex side of a join, whose edge side AQE splits (skew join). Ids are 64-bit hashes, so
that aggregates run on fixed-width buffers; ids are checked for collisions and drawn again under another seed if there are any.
Every level's tables are written to the shared folder, and superseded ones dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import Stage

BETA = 0.2
JUMPS = 2
MAX_LEVELS = 100


def _start(v, level: int):
    """Minus the exponential shift of vertex v at this level."""
    u = (F.shiftrightunsigned(F.xxhash64(v, F.lit(level)), 11).cast("double") + 0.5) / float(2**53)
    return F.log(u) / BETA


def assign(edges: DataFrame, stage: Stage) -> DataFrame:
    """edges: distinct (a, b) bigint, a <> b, staged. Gives (v, root) for every vertex: the same root just within a component."""
    levels: list[DataFrame] = []
    level = 0
    while not edges.isEmpty():
        if level >= MAX_LEVELS:
            raise RuntimeError("components: no end of levels")
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(
            F.col("e.a").alias("v"), F.col("e.b").alias("w")
        )
        near = both.groupBy("v").agg(F.min_by("w", _start(F.col("w"), level)).alias("w"))
        parent = F.when(_start(F.col("w"), level) + 1 < _start(F.col("v"), level), F.col("w")).otherwise(F.col("v"))
        label = stage.write(near.select("v", parent.alias("c")), f"parent{level}")
        for jump in range(JUMPS):
            up = label.where("v <> c").select(F.col("v").alias("c"), F.col("c").alias("cc"))
            new = stage.write(label.join(up, "c", "left").select("v", F.coalesce("cc", "c").alias("c")), f"label{level}-{jump}")
            stage.drop(label)
            label = new
        a, b = (label.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
        cut = edges.join(a, "a").join(b, "b").where("ca <> cb")
        contracted = stage.write(cut.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), f"edges{level}")
        stage.drop(edges)
        levels.append(label)
        edges = contracted
        level += 1
    if not levels:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    root = levels[-1].select("v", F.col("c").alias("root"))
    for k in range(len(levels) - 2, -1, -1):
        above = root.select(F.col("v").alias("c"), "root")
        root = levels[k].join(above, "c", "left").select("v", F.coalesce("root", "c").alias("root"))
        if 0 < k and k % 4 == 0:
            root = stage.write(root, f"root{k}")
    return root


def link_groups(records: DataFrame, key: str, links: DataFrame, hubs: DataFrame | None, stage: Stage) -> DataFrame:
    """Columns key, group_key (the smallest key of the group, as text) for every record linked to another.

    records has the column ``key``; links has a, b (keys); hubs has k, hub: records with the same hub are linked. Keys are compared
    without outer blanks; null and blank keys and hubs link nobody; a link counts if both keys are records; self-links and
    repeated or reversed links are harmless. Without links the result is empty.
    """
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    keys = records.select(text(key).alias("key")).where("key is not null").distinct()
    for seed in range(8):
        number = lambda c, kind="k": F.xxhash64(F.lit(f"{kind}{seed}"), c)  # noqa: B023, E731
        vertices = stage.write(keys.select(number(F.col("key")).alias("v"), "key"), "keys")
        if vertices.groupBy("v").count().where("count > 1").isEmpty():
            break
        stage.drop(vertices)
    else:
        raise RuntimeError("components: colliding ids under every seed")
    direct = links.select(number(text("a")).alias("a"), number(text("b")).alias("b"), text("a").isNotNull() & text("b").isNotNull()).toDF("a", "b", "ok")
    direct = direct.where("ok and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ids = vertices.select("v")
    direct = direct.join(ids.withColumnRenamed("v", "a"), "a", "left_semi").join(ids.withColumnRenamed("v", "b"), "b", "left_semi").select("a", "b")
    if hubs is not None:
        spokes = hubs.select(text("k").alias("k"), text("hub").alias("hub")).where("k is not null and hub is not null")
        direct = direct.unionByName(spokes.select(number(F.col("k")).alias("a"), number(F.col("hub"), "hub").alias("b")).distinct())
    root = assign(stage.write(direct, "links"), stage)
    members = stage.write(vertices.join(root, "v").select("key", "root"), "members")
    first = members.groupBy("root").agg(F.min("key").alias("group_key"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(first, "root").select("key", "group_key")


def latest_matches(pairs: DataFrame, a: str, b: str, decision: str, decided: str, order: str, match: str = "MATCH") -> DataFrame:
    """Columns a, b of the unordered key pairs whose latest decision is ``match``; of equal times the greatest ``order`` counts, no time is earliest."""
    x, y = (F.nullif(F.trim(F.col(c)), F.lit("")) for c in (a, b))
    return (
        pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.struct(decided, order, (F.col(decision) == match).alias("m")).alias("d"), (x.isNotNull() & y.isNotNull()).alias("ok"))
        .where("ok")
        .groupBy("a", "b")
        .agg(F.max("d").alias("d"))
        .where("d.m")
        .select("a", "b")
    )
