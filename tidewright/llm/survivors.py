"""Best representative of each duplicate group, and what the group's sources are worth.

``surviving_records`` builds one record per group by fixed preferences. ``source_quality`` is the latent two-sided model: every
(group, field, value) is a fact that is true or not; a source with a record in the group that names a value for the field claims
the values it names and denies the others. Expectation-maximisation gives each source a sensitivity and a specificity per field
and each fact a probability; several values of one field can be true.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import Stage

#: Fixed values of the task that stand for no value (in any case, outer blanks aside).
FILLERS = ["", "-", "n/a", "none", "unknown", "tbd"]
_OLDEST = 2**63 - 1


def _value(c):
    """Trimmed value, or null if it is lacking."""
    t = F.trim(F.col(c))
    return F.when(~F.lower(t).isin(FILLERS), t)


def _newest(c):
    """A long that is smaller the later the time; null last."""
    return F.coalesce(-F.unix_micros(F.col(c).cast("timestamp")), F.lit(_OLDEST))


def surviving_records(df: DataFrame, group: str, key: str, fields: list[str], trust: str, updated: str, status: str, failed: str = "FAILED") -> DataFrame:
    """Columns group, column_name, source_pk: one row named like ``key`` with the survivor, one per field it takes from another record.

    One aggregation with map-side partials; a group of any size is nine running minima. Survivor: fewest lacking fields, latest
    update (null oldest), smallest key. Supplier of a lacking field: smallest trust (null last), latest update, smallest key.
    Failed records take no part unless the whole group failed. Rows without a group or key are left out; repeated rows don't
    matter; a field nobody has gives no row.
    """
    have = [_value(f) for f in fields]
    lacking = sum((h.isNull().cast("int") for h in have), F.lit(0))
    mask = sum((F.when(h.isNull(), 1 << i).otherwise(0) for i, h in enumerate(have)), F.lit(0))
    rows = df.select(
        F.nullif(F.trim(F.col(group)), F.lit("")).alias("g"),
        F.nullif(F.trim(F.col(key)), F.lit("")).alias("k"),
        F.coalesce(F.col(status) == failed, F.lit(False)).cast("int").alias("f"),
        lacking.alias("lacking"),
        mask.alias("mask"),
        F.coalesce(F.col(trust), F.lit(2**31 - 1)).alias("t"),
        _newest(updated).alias("u"),
    ).where("g is not null and k is not null")
    best = rows.groupBy("g").agg(
        F.min(F.struct("f", "lacking", "u", "k", "mask")).alias("s"),
        *[F.min(F.when(F.col("mask").bitwiseAND(1 << i) == 0, F.struct("f", "t", "u", "k"))).alias(f"c{i}") for i in range(len(fields))],
    )
    parts = [F.struct(F.lit(key).alias("column_name"), F.col("s.k").alias("source_pk"))]
    for i, f in enumerate(fields):
        gives = (F.col("s.mask").bitwiseAND(1 << i) != 0) & (F.col(f"c{i}.f") == F.col("s.f")) & (F.col(f"c{i}.k") != F.col("s.k"))
        parts.append(F.when(gives, F.struct(F.lit(f).alias("column_name"), F.col(f"c{i}.k").alias("source_pk"))))
    return best.select(F.col("g").alias(group), F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("p")).select(group, "p.*")


def facts(df: DataFrame, group: str, source: str, fields: list[str]) -> DataFrame:
    """Columns g, field, value, claims: an array of (source, yes) over the sources that name any value for this group and field.

    Values are compared in upper case with single blanks. Hot groups: the distinct (group, field, value, source) rows are counted
    first, with map-side partials; the arrays hold each source once, so they are bounded by the number of sources.
    """
    cells = df.select(
        F.nullif(F.trim(F.col(group)), F.lit("")).alias("g"),
        F.trim(F.col(source)).alias("source"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.upper(F.regexp_replace(_value(f), r"\s+", " ")).alias("value")) for f in fields])).alias("c"),
    ).where("g is not null and source is not null and c.value is not null")
    distinct = cells.select("g", "source", "c.field", "c.value").distinct()
    by_value = distinct.groupBy("g", "field", "value").agg(F.array_sort(F.collect_set("source")).alias("yes"))
    by_field = distinct.groupBy("g", "field").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    claims = F.transform("sources", lambda s: F.struct(s.alias("source"), F.array_contains("yes", s).alias("yes")))
    return by_value.join(by_field, ["g", "field"]).select("g", "field", "value", claims.alias("claims"))


def _odds(q, field, claims):
    """Log odds that a fact is true; q: a map from 'field|source' to (log sensitivity ratio, log miss ratio), and from 'field' to the prior."""
    ratio = lambda c: F.when(c["yes"], q[F.concat_ws("|", field, c["source"])]["yes"]).otherwise(q[F.concat_ws("|", field, c["source"])]["no"])
    return q[field]["yes"] + F.aggregate(claims, F.lit(0.0), lambda a, c: a + ratio(c))


def source_quality(found: DataFrame, stage: Stage, iterations: int = 20, tolerance: float = 1e-4, max_parameters: int = 20_000):
    """(quality, probability): quality is [(field, source, sensitivity, specificity)], probability a function adding ``p`` to facts.

    EM runs on the distinct claim patterns with their counts, since a fact's probability depends on its pattern alone; each round is
    one scan and a sum per (field, source). What comes to the driver are those parameters, whose number is checked.
    """
    patterns = stage.write(found.groupBy("field", "claims").agg(F.count(F.lit(1)).alias("n")), "patterns")
    names = [tuple(r) for r in patterns.select("field", F.explode("claims.source")).distinct().limit(max_parameters + 1).collect()]
    if len(names) > max_parameters:
        raise ValueError(f"more than {max_parameters} (field, source) parameters")
    quality = {x: (0.9, 0.8) for x in names}
    prior = {f: 0.5 for f, _ in names}

    def table():
        rows = {f: (math.log(p / (1 - p)), 0.0) for f, p in prior.items()}
        rows |= {f"{f}|{s}": (math.log(a / (1 - b)), math.log((1 - a) / b)) for (f, s), (a, b) in quality.items()}
        body = [F.struct(F.lit(k).alias("key"), F.struct(F.lit(y).alias("yes"), F.lit(n).alias("no")).alias("value")) for k, (y, n) in sorted(rows.items())]
        return F.map_from_entries(F.array(*body))

    def with_p(df: DataFrame) -> DataFrame:
        return df.withColumn("p", 1 / (1 + F.exp(-_odds(table(), F.col("field"), F.col("claims"))))) if names else df.withColumn("p", F.lit(0.0))

    for _ in range(iterations if names else 0):
        sums = (
            with_p(patterns)
            .select("field", "n", "p", F.explode("claims").alias("c"))
            .groupBy("field", "c.source")
            .agg(*[F.sum(F.expr(f"n * {w} * if({x}, 1, 0)")).alias(a) for w, x, a in (("p", "c.yes", "tp"), ("p", "true", "t"), ("(1 - p)", "not c.yes", "tn"), ("(1 - p)", "true", "f"))])
            .collect()
        )
        new = {(r["field"], r["source"]): ((r["tp"] + 4.5) / (r["t"] + 5), (r["tn"] + 4) / (r["f"] + 5)) for r in sums}
        share: dict[str, list[float]] = {}
        for r in sums:
            x = share.setdefault(r["field"], [0.0, 0.0])
            x[0] += r["t"]
            x[1] += r["f"]
        prior = {f: min(max((t + 1) / (t + u + 2), 0.01), 0.99) for f, (t, u) in share.items()}
        moved = max(abs(a - b) for k in new for a, b in zip(new[k], quality[k]))
        quality = new
        if moved < tolerance:
            break
    return [(f, s, a, b) for (f, s), (a, b) in sorted(quality.items())], with_p


def merged_fields(judged: DataFrame) -> DataFrame:
    """judged: facts with p. Columns g, field, value, p, n_true: of each group and field the value most likely true (ties: the smaller
    one), and how many values are judged true (p of 0.5 and more); a field none of whose values is judged true still gives its best.

    One aggregation with map-side partials; nothing is gathered, however many values a group has.
    """
    best = judged.groupBy("g", "field").agg(F.min(F.struct((-F.col("p")).alias("q"), "value")).alias("b"), F.sum((F.col("p") >= 0.5).cast("bigint")).alias("n_true"))
    return best.select("g", "field", F.col("b.value").alias("value"), (-F.col("b.q")).alias("p"), "n_true")
