"""Entity resolution: exact keys, blocked fuzzy pairs, vetoes, constrained clusters, golden records and survivorship.

Record ids are 64-bit numbers (the row numbers of landing). Exact keys link as stars, with one aggregation per key. Blocking is a
self-join on block keys with cheap native filters before any similarity is computed; a block over the limit is dealt into parts,
and every part is compared with every other. Similarity runs in Arrow batches on what is left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import address_norm, key_part, name_norm, trim_to_null
from tidewright.operators.rows import number_rows
from tidewright.session import Stage

MERGE, REVIEW, NAME_WEIGHT = 0.88, 0.80, 0.65
MAX_KEY_GROUP, MAX_BLOCK, COMMON_NAME, STREET_AGREEMENT = 25, 2000, 5, 60.0
PRIORITY = {"REVIEWED": 0, "TAX": 1, "EXACT": 2, "NAME_ADDRESS": 3, "NAME_ONLY": 4}


@dataclass(frozen=True)
class ExactKey:
    name: str
    columns: tuple[tuple[str, str], ...]  # (column, kind of normal form)
    vetoes: bool = False


def key_value(key: ExactKey) -> Column:
    """The composite of the normal forms; null if a part can't identify anybody."""
    parts = [key_part(F.col(f"`{c}`").cast("string"), kind) for c, kind in key.columns]
    whole = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(whole, F.concat_ws("|", *parts))


def key_cells(df: DataFrame, id_: str, keys: list[ExactKey]) -> DataFrame:
    """id, key_name, value: one row per usable key of a record."""
    cells = F.array(*[F.struct(F.lit(k.name).alias("key_name"), key_value(k).alias("value")) for k in keys])
    return df.select(F.col(id_).alias("id"), F.inline(cells)).where("value is not null")


def key_groups(cells: DataFrame) -> DataFrame:
    return cells.groupBy("key_name", "value").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))


def exact_edges(cells: DataFrame, limit: int = MAX_KEY_GROUP) -> DataFrame:
    """a (smallest id of the group), b, reason: stars over groups of 2 to 25 records; larger groups link nobody. The groups are small
    by definition, so the join back has no hot key."""
    groups = key_groups(cells).where(F.col("n").between(2, limit))
    return cells.join(groups, ["key_name", "value"]).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.concat(F.lit("EXACT:"), F.col("key_name")).alias("reason"))


def ignored_keys(cells: DataFrame, limit: int = MAX_KEY_GROUP) -> DataFrame:
    """key_name, groups, records: values shared by too many records to mean anything."""
    groups = key_groups(cells).where(F.col("n") > limit)
    return groups.groupBy("key_name").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("records"))


def veto(edges: DataFrame, codes: DataFrame, keep: Column | None = None) -> DataFrame:
    """Edges without those between two different codes. codes: id, code; keep: edges that are never dropped."""
    a, b = codes.toDF("a", "code_a"), codes.toDF("b", "code_b")
    conflict = F.col("code_a").isNotNull() & F.col("code_b").isNotNull() & (F.col("code_a") != F.col("code_b"))
    if keep is not None:
        conflict = conflict & ~keep
    return edges.join(a, "a", "left").join(b, "b", "left").where(~conflict).drop("code_a", "code_b")


def normal_forms(df: DataFrame, id_: str, name: str, address: list[str], strong: list[str]) -> DataFrame:
    """id, nn (name), na (address), street (first address column), digits of both, strong (any of ``strong`` is filled)."""
    na = address_norm(*[F.col(f"`{c}`").cast("string") for c in address])
    filled = reduce(lambda a, b: a | b, [trim_to_null(F.col(f"`{c}`").cast("string")).isNotNull() for c in strong])
    out = df.select(F.col(id_).alias("id"), name_norm(F.col(f"`{name}`").cast("string")).alias("nn"), na.alias("na"), address_norm(F.col(f"`{address[0]}`").cast("string")).alias("street"), filled.alias("strong"))
    numbers = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"\d+"), 0))
    return out.where("nn is not null and nn <> ''").withColumns({"dn": numbers("nn"), "da": numbers("na")})


def _letters(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Which characters a name has: of 32 classes a bit each for the first four times, in two numbers. Two names differ by at least as
    many insertions and deletions as bits."""
    for s in batches:
        out = []
        for name in s:
            bits = [0, 0]
            for ch, n in Counter(ord(ch) % 32 for ch in name.replace(" ", "")).items():
                for i in range(min(n, 4)):
                    bits[i // 2] |= 1 << 32 * (i % 2) + ch
            out.append([b - (1 << 64) if b >> 63 else b for b in bits])
        yield pd.DataFrame(out, columns=["x", "y"])


def block_keys(forms: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """id, nn, pass, block: the first 3 characters of the name's sorted words, the first 6 of the address, and its numbers (two groups,
    or one of 4 digits); f: what the cheap filters on pairs need, k: the numbers of the name."""
    words = F.array_join(F.array_sort(F.split("nn", " ")), "")
    numbers = F.filter(F.split("na", " "), lambda w: w.rlike(r"\A\d+\z"))
    long = F.exists(numbers, lambda w: F.length(w) >= 4)
    keys = F.array(
        F.struct(F.lit(1).alias("pass"), F.left(words, F.lit(3)).alias("block")),
        F.struct(F.lit(2).alias("pass"), F.when(F.length("na") >= 6, F.left("na", F.lit(6))).alias("block")),
        F.struct(F.lit(3).alias("pass"), F.when((F.size(numbers) >= 2) | long, F.array_join(F.array_sort(numbers), "-")).alias("block")),
    )
    coded = forms.withColumn("code", F.lit(None).cast("string")) if codes is None else forms.join(codes, "id", "left")
    letters = F.pandas_udf("x bigint, y bigint")(_letters)
    facts = F.struct(F.length("nn").alias("size"), "da", "strong", "code", "letters")
    return coded.withColumn("letters", letters("nn")).select("id", "nn", facts.alias("f"), F.array_join("dn", "-").alias("k"), F.inline(keys)).where("block is not null and block <> ''")


def plausible(x: Column, y: Column) -> Column:
    """What two records of one block must fulfil before their names are compared: no two codes, no other numbers in two strong
    addresses, lengths within the bound that the review threshold sets (a little wider, for names written in one word), nor more
    letters that only one name has than that threshold allows (blanks aside, so for names written in one word too)."""
    two_codes = x["code"].isNotNull() & y["code"].isNotNull() & (x["code"] != y["code"])
    two_places = x["strong"] & y["strong"] & (F.size(x["da"]) == F.size(y["da"])) & (x["da"] != y["da"])
    other = sum(F.bit_count(x["letters"][c].bitwiseXOR(y["letters"][c])) for c in "xy")
    return ~two_codes & ~two_places & (other <= (1 - REVIEW) * (x["size"] + y["size"]) + 1e-6) & (2 * F.least(x["size"], y["size"]) / (x["size"] + y["size"]) >= REVIEW - 0.05)


def candidates(blocks: DataFrame, limit: int = MAX_BLOCK, ahead: int | None = None, filtered: bool = False) -> DataFrame:
    """a, b (a < b), pass (the first that found the pair): all pairs of every block. A block over the limit is dealt into parts of about
    that size, and a task compares two parts, so that no hot block ends in one task; the work still grows with the block's square.

    ahead: in blocks over the limit each record meets only the next ``ahead`` in the order of the names instead, by joining runs of
    ranks with themselves and the next. filtered: only pairs with the same numbers in their names that are plausible; the filters run
    within the join, before pairs are shuffled.
    """
    sizes = blocks.groupBy("pass", "block").agg(F.count(F.lit(1)).alias("n"))
    sized = blocks.join(sizes, ["pass", "block"])
    if not filtered:
        sized = sized.withColumn("k", F.lit("")).withColumn("f", F.lit(0))
    keep = plausible(F.col("f"), F.col("g")) if filtered else F.lit(True)
    small = sized.where(F.col("n").between(2, limit)).select("pass", "block", "k", "id", "f")
    pairs = small.withColumnRenamed("id", "a").join(small.toDF("pass", "block", "k", "b", "g"), ["pass", "block", "k"]).where("a < b").where(keep).select("a", "b", "pass")
    large = sized.where(F.col("n") > limit)
    if ahead is None:
        parts = F.ceil(F.col("n") / limit).cast("int")
        dealt = large.select("pass", "block", "k", "id", "f", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
        left = dealt.select("pass", "block", "k", "id", "f", F.col("part").alias("p"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("q"))
        right = dealt.select("pass", "block", "k", F.col("id").alias("id2"), F.col("f").alias("g"), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("p"), F.col("part").alias("q"))
        near = left.join(right, ["pass", "block", "k", "p", "q"]).where("p < q or id < id2").where(keep)
    else:
        ranked = large.withColumn("rn", F.row_number().over(Window.partitionBy("pass", "block").orderBy("nn", "id")) - 1)
        left = ranked.select("pass", "block", "k", "id", "f", "rn", F.explode(F.array(F.floor(F.col("rn") / ahead), F.floor(F.col("rn") / ahead) + 1)).alias("run"))
        right = ranked.select("pass", "block", "k", F.col("id").alias("id2"), F.col("f").alias("g"), F.col("rn").alias("rn2"), F.floor(F.col("rn") / ahead).alias("run"))
        near = left.join(right, ["pass", "block", "k", "run"]).where((F.col("rn2") > F.col("rn")) & (F.col("rn2") <= F.col("rn") + ahead)).where(keep)
    near = near.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), "pass")
    return pairs.unionByName(near).groupBy("a", "b").agg(F.min("pass").alias("pass"))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity of 0 to 100 by insertions and deletions; two empty texts are the same."""
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """100 if the words of one are all in the other, else the best of the common words against each side and the sides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    if common and (x <= y or y <= x):
        return 100.0
    p, q = (f"{common} {' '.join(sorted(s - (x & y)))}".strip() for s in (x, y))
    return max(ratio(p, q), ratio(common, p) if common else 0.0, ratio(common, q) if common else 0.0)


def _address_score(a: str, b: str, da: list[str], db: list[str]) -> float | None:
    """None when each side has a number the other lacks: two places."""
    if da == db:
        return token_sort_ratio(a, b)
    x, y = Counter(da), Counter(db)
    return None if x - y and y - x else token_set_ratio(a, b)


def _scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for pass_, na, nb, aa, ab, da, db, both, sa, sb in batches:
        out = []
        for p, n1, n2, a1, a2, d1, d2, strong, s1, s2 in zip(pass_, na, nb, aa, ab, da, db, both, sa, sb):
            name = token_sort_ratio(n1, n2)
            if p == 3:
                name = max(name, ratio(n1.replace(" ", ""), n2.replace(" ", "")))
            score, street = name / 100, None
            if strong and name >= 100 * REVIEW:
                address = _address_score(a1, a2, list(d1), list(d2))
                score = None if address is None else NAME_WEIGHT * name / 100 + (1 - NAME_WEIGHT) * address / 100
                street = token_sort_ratio(s1, s2) if s1 and s2 else None
            out.append((name / 100, score, street))
        yield pd.DataFrame(out, columns=["name_score", "score", "street_score"])


def fuzzy_pairs(forms: DataFrame, pairs: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """a, b, score, decision (MERGE, REVIEW), reason (NAME_ADDRESS, NAME_ONLY). Native filters first: veto codes, numbers of the
    names, numbers of strong addresses, the bound that the lengths set on the name's similarity."""
    if codes is not None:
        pairs = veto(pairs, codes)
    side = lambda x: forms.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "nn", "na", "street", "strong", "dn", "da")]).withColumnRenamed(f"id_{x}", x)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    la, lb = F.length("nn_a"), F.length("nn_b")
    strong = F.col("strong_a") & F.col("strong_b")
    other_numbers = strong & (F.size("da_a") == F.size("da_b")) & (F.col("da_a") != F.col("da_b"))
    near = both.where((F.col("dn_a") == F.col("dn_b")) & ~other_numbers & (2 * F.least(la, lb) / (la + lb) >= REVIEW - 0.05))
    score = F.pandas_udf("name_score double, score double, street_score double")(_scored)
    judged = near.withColumn("s", score(F.col("pass"), "nn_a", "nn_b", "na_a", "na_b", "da_a", "da_b", strong, "street_a", "street_b")).where((F.col("s.name_score") >= REVIEW) & (F.col("s.score") >= REVIEW))
    common = forms.groupBy("nn").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_NAME).select(F.col("nn").alias("nn_a"), F.lit(True).alias("common"))
    judged = judged.join(common, "nn_a", "left")
    alone = ~strong
    review = (F.col("s.score") < MERGE) | (alone & F.coalesce("common", F.lit(False))) | (F.coalesce(F.col("s.street_score"), F.lit(100.0)) < STREET_AGREEMENT)
    return judged.select("a", "b", F.round("s.score", 4).alias("score"), F.when(review, "REVIEW").otherwise("MERGE").alias("decision"), F.when(alone, "NAME_ONLY").otherwise("NAME_ADDRESS").alias("reason"))


def decided(edges: DataFrame, must: DataFrame | None, cannot: DataFrame | None) -> DataFrame:
    """Human decisions: a pair that must not be linked loses every edge, and wins over one that must, which adds a REVIEWED edge."""
    order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "reason")
    if must is not None:
        out = out.unionByName(order(must).withColumn("reason", F.lit("REVIEWED")))
    return out if cannot is None else out.join(order(cannot), ["a", "b"], "left_anti")


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """id, root (the smallest id of the component), by alternating star operations: every vertex links its larger neighbours, then its
    smaller ones, to the least id it knows of. Each round is two aggregations and joins back over the edges; rounds grow with the logarithm
    of the longest chain. Aggregates have map-side partials, and AQE splits a vertex with very many edges."""

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a")
        if large:
            return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    current = stage.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    for _ in range(64):
        new = stage.write(star(star(current, True), False), "links")
        sums = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        stage.drop(current)
        current = new
        if sums == mark:
            break
        mark = sums
    else:
        raise RuntimeError("components: no end of rounds")
    return current.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def conflicting_groups(groups: DataFrame, codes: DataFrame) -> DataFrame:
    """root, codes: components that hold two different veto codes."""
    return groups.join(codes, "id").groupBy("root").agg(F.count_distinct("code").alias("codes")).where("codes > 1")


def split_conflicts(edges: DataFrame, groups: DataFrame, codes: DataFrame, max_edges: int = 1_000_000) -> DataFrame:
    """id, root with the conflicting components built again edge by edge in the order of priority (reviewed, tax, other exact,
    address-backed, name-only; then a, b), refusing links that would join two codes; reviewed links are never refused.

    The order makes this sequential within a component, so a component over ``max_edges`` edges is an error that names it.
    """
    bad = conflicting_groups(groups, codes).select("root")
    inside = edges.join(groups.withColumnRenamed("id", "a"), "a").join(bad, "root")
    large = inside.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_edges).limit(1).collect()
    if large:
        raise ValueError(f"component {large[0]['root']} has {large[0]['n']} links and two codes")
    rank = F.when(F.col("reason") == "REVIEWED", 0).when(F.col("reason").startswith("EXACT:tax"), 1).when(F.col("reason").startswith("EXACT"), 2).when(F.col("reason") == "NAME_ADDRESS", 3).otherwise(4)
    coded = inside.join(codes.toDF("a", "code_a"), "a", "left").join(codes.toDF("b", "code_b"), "b", "left").select("root", "a", "b", rank.alias("rank"), "code_a", "code_b")

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}
        code: dict[int, set] = {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for col, c in (("a", "code_a"), ("b", "code_b")):
            for x, y in zip(pdf[col], pdf[c]):
                parent.setdefault(x, x)
                code.setdefault(x, set())
                if isinstance(y, str):
                    code[x].add(y)
        for e in pdf.sort_values(["rank", "a", "b"]).itertuples():
            x, y = find(e.a), find(e.b)
            if x != y and (e.rank == 0 or len(code[x] | code[y]) <= 1):
                x, y = min(x, y), max(x, y)
                parent[y] = x
                code[x] |= code[y]
        return pd.DataFrame({"id": list(parent), "root": [find(x) for x in parent]})

    fixed = coded.groupBy("root").applyInPandas(again, "id bigint, root bigint")
    return groups.join(bad, "root", "left_anti").select("id", "root").unionByName(fixed)


def golden(records: DataFrame, groups: DataFrame, id_: str, pk: str, complete: list[str], failed: Column, stage: Stage) -> DataFrame:
    """id, cluster_no, master_pk, is_child: per group the most complete record that did not fail, ties to the smallest key, is master.
    Clusters are numbered by their smallest id. Groups of one are left out."""
    score = sum((trim_to_null(F.col(f"`{c}`").cast("string")).isNotNull().cast("int") for c in complete), F.lit(0)) - F.when(failed, 100000).otherwise(0)
    rows = records.select(F.col(id_).alias("id"), F.col(pk).alias("pk"), score.alias("score")).join(groups, "id")
    best = rows.groupBy("root").agg(F.min(F.struct(-F.col("score"), "pk", "id")).alias("m"), F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    numbered = number_rows(best, stage, "cluster_no", ["first"])
    return rows.join(numbered, "root").select("id", "cluster_no", F.col("m.pk").alias("master_pk"), (F.col("id") != F.col("m.id")).alias("is_child"))


def survivorship(records: DataFrame, master: DataFrame, id_: str, pk: str, fill: list[str], complete: list[str], failed: Column) -> DataFrame:
    """pk, column_name, value, source_pk: each blank field of a master and the value of its best child that has one (not failed, most
    complete, smallest key), by one running minimum per field."""
    score = sum((trim_to_null(F.col(f"`{c}`").cast("string")).isNotNull().cast("int") for c in complete), F.lit(0))
    rows = records.select(F.col(id_).alias("id"), F.col(pk).alias("pk"), score.alias("score"), failed.cast("int").alias("f"), *[trim_to_null(F.col(f"`{c}`").cast("string")).alias(c) for c in fill]).join(master, "id")
    aggs = []
    for c in fill:
        aggs.append(F.max(F.when(~F.col("is_child"), F.coalesce(F.col(c), F.lit("")))).alias(f"own_{c}"))
        aggs.append(F.min(F.when(F.col("is_child") & F.col(c).isNotNull(), F.struct("f", -F.col("score"), "pk", F.col(c).alias("value")))).alias(f"best_{c}"))
    wide = rows.groupBy("cluster_no", "master_pk").agg(*aggs)
    cells = [F.when((F.col(f"own_{c}") == "") & F.col(f"best_{c}").isNotNull(), F.struct(F.lit(c).alias("column_name"), F.col(f"best_{c}.value").alias("value"), F.col(f"best_{c}.pk").alias("source_pk"))) for c in fill]
    return wide.select(F.col("master_pk").alias("pk"), F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("c")).select("pk", "c.*")


def deduplicate(records: DataFrame, id_: str, pk: str, keys: list[ExactKey], name: str, address: list[str], strong: list[str], complete: list[str], failed: Column, stage: Stage) -> DataFrame:
    """The whole operator: id, cluster_no, master_pk, is_child, match_type (sorted reasons joined with +), match_strength."""
    cells = stage.write(key_cells(records, id_, keys), "keys")
    vetoing = [k.name for k in keys if k.vetoes]
    codes = stage.write(cells.where(F.col("key_name").isin(vetoing)).groupBy("id").agg(F.min("value").alias("code")), "codes")
    forms = stage.write(normal_forms(records, id_, name, address, strong), "forms")
    exact = veto(exact_edges(cells), codes, F.col("reason").isin([f"EXACT:{k}" for k in vetoing]))
    fuzzy = fuzzy_pairs(forms, candidates(block_keys(forms, codes), filtered=True)).where("decision = 'MERGE'").select("a", "b", "reason")
    edges = stage.write(exact.unionByName(fuzzy), "edges")
    groups = split_conflicts(edges, stage.write(components(edges, stage), "groups"), codes)
    groups = stage.write(groups, "final")
    master = golden(records, groups, id_, pk, complete, failed, stage)
    touch = edges.select(F.col("a").alias("id"), "reason").unionByName(edges.select(F.col("b").alias("id"), "reason")).distinct()
    level = F.when(F.col("reason") == "REVIEWED", 4).when(F.col("reason").startswith("EXACT"), 3).when(F.col("reason") == "NAME_ADDRESS", 2).otherwise(1)
    why = touch.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("match_type"), F.max(level).alias("level"))
    strength = F.create_map(*[x for k, v in {4: "REVIEWED", 3: "EXACT", 2: "NAME_ADDRESS", 1: "NAME_ONLY"}.items() for x in (F.lit(k), F.lit(v))])
    return master.join(why, "id", "left").select("id", "cluster_no", "master_pk", "is_child", "match_type", strength[F.col("level")].alias("match_strength"))
