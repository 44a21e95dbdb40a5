"""What changed between full snapshots.

Every snapshot is unpivoted into signed cells (key, field, value): -1 for the earlier snapshot of a pair and +1 for the later,
with one key-presence cell per row. Cells that are the same on both sides cancel in the grouped sum; what is left names the
records that were added, removed or changed, and their changed fields.

The plan has one shuffle, on the key. Before it, repeated and corrected deliveries collapse on the map side to the row that
counts; after it, cells are built only for keys whose two rows differ at all (all other cells would cancel), and both grouped
sums reuse the partitioning by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Snapshots compared in one pass; longer histories are cut into passes that overlap by one snapshot.
SNAPSHOTS_PER_PASS = 64
PRESENCE = ""


def _blank_to_null(c):
    return F.nullif(F.trim(c), F.lit(""))


def snapshot_changes(
    df: DataFrame,
    snapshot: str,
    key: str,
    delivered: str,
    fields: list[str],
    per_pass: int = SNAPSHOTS_PER_PASS,
) -> DataFrame:
    """Columns snapshot, key, change (ADDED, REMOVED, CHANGED), changed_fields (sorted array; empty unless CHANGED).

    Consecutive means consecutive among the snapshot numbers present. Outer blanks of keys and fields don't count, blank is
    null; rows without a key or snapshot number are no records. If a key is delivered several times for one snapshot, the latest
    delivery counts (null is earliest; among equal times the greatest field values, so the result is fixed). Other columns are
    ignored. An empty table, or one snapshot only, gives no rows.
    """
    s, k, d = (F.col(f"`{x}`") for x in (snapshot, key, delivered))
    rows = df.select(
        s.alias("s"),
        _blank_to_null(k).alias("k"),
        d.alias("d"),
        *[_blank_to_null(F.col(f"`{f}`")).alias(f"f{i}") for i, f in enumerate(fields)],
    ).where("k is not null and s is not null")
    numbers = sorted(r[0] for r in df.select(s).where(s.isNotNull()).distinct().collect())
    kind = df.schema[snapshot].dataType
    passes = [numbers[i : i + per_pass + 1] for i in range(0, max(len(numbers) - 1, 1), per_pass)]
    out = None
    for chain in passes:
        part = _one_pass(rows, chain, fields, kind)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("s").alias(snapshot), F.col("k").alias(key), "change", "changed_fields")


def _one_pass(rows: DataFrame, chain: list, fields: list[str], kind) -> DataFrame:
    record = F.struct(*[F.col(f"f{i}") for i in range(len(fields))])
    version = F.struct(F.col("d"), record.alias("r"))
    if not chain:
        chain = [None]
    state = (
        rows.where(F.col("s").isin(chain))
        .groupBy("k")
        .agg(*[F.max(F.when(F.col("s") == F.lit(n), version)).alias(f"v{i}") for i, n in enumerate(chain)])
    )
    pairs = [
        F.struct(F.lit(n).cast(kind).alias("s"), F.col(f"v{i}.r").alias("old"), F.col(f"v{i + 1}.r").alias("new"))
        for i, n in enumerate(chain[1:])
    ] or [F.struct(F.lit(None).cast(kind).alias("s"), F.col("v0.r").alias("old"), F.col("v0.r").alias("new"))]
    differing = state.select("k", F.explode(F.filter(F.array(*pairs), lambda p: ~p["old"].eqNullSafe(p["new"]))).alias("p"))

    def cells(side: str, sign: int):
        r = F.col(f"p.{side}")
        made = [F.struct(F.lit(PRESENCE).alias("field"), F.lit("").alias("value"), F.lit(sign).alias("sign"))] + [
            F.struct(F.lit(f).alias("field"), r[f"f{i}"].alias("value"), F.lit(sign).alias("sign")) for i, f in enumerate(fields)
        ]
        return F.when(r.isNotNull(), F.filter(F.array(*made), lambda c: c["value"].isNotNull())).otherwise(F.array().cast(_CELLS))

    signed = differing.select("k", F.col("p.s").alias("s"), F.explode(F.concat(cells("old", -1), cells("new", 1))).alias("c"))
    left = (
        signed.groupBy("k", "s", F.col("c.field").alias("field"), F.col("c.value").alias("value"))
        .agg(F.sum("c.sign").alias("n"))
        .where("n <> 0")
    )
    presence = F.max(F.when(F.col("field") == PRESENCE, F.col("n")))
    return (
        left.groupBy("k", "s")
        .agg(presence.alias("p"), F.array_sort(F.collect_set(F.when(F.col("field") != PRESENCE, F.col("field")))).alias("f"))
        .select(
            "k",
            "s",
            F.when(F.col("p") > 0, "ADDED").when(F.col("p") < 0, "REMOVED").otherwise("CHANGED").alias("change"),
            F.when(F.col("p").isNull(), F.col("f")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        )
    )


_CELLS = "array<struct<field:string,value:string,sign:int>>"
