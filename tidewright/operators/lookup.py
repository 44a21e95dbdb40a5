"""Value lookups: translating, resolving and drafting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import fold, trim_to_null


def lookup_table(df: DataFrame, source: str, target: str) -> DataFrame:
    """(k folded key, v value): one row per key; of several values the smallest counts, blank keys don't."""
    rows = df.select(fold(F.col(f"`{source}`").cast("string")).alias("k"), F.col(f"`{target}`").cast("string").alias("v"))
    return rows.where("k <> ''").groupBy("k").agg(F.min("v").alias("v"))


def translate(df: DataFrame, column: str, table: DataFrame, fallback: str = "FLAG_FAILED", default: str | None = None) -> DataFrame:
    """Adds translated and lookup_error. Blank values stay null without an error."""
    value = trim_to_null(F.col(f"`{column}`").cast("string"))
    joined = df.join(table.withColumnRenamed("k", "__k").withColumnRenamed("v", "__v"), fold(value) == F.col("__k"), "left")
    missing = value.isNotNull() & F.col("__k").isNull()
    out = {"PASS_THROUGH": value, "USE_DEFAULT": F.lit(default), "FLAG_FAILED": F.lit(None).cast("string")}[fallback]
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(missing, out).otherwise(F.col("__v")).alias("translated"),
        F.when(missing & F.lit(fallback == "FLAG_FAILED"), F.concat(F.lit("LOOKUP_FAILED: no mapping for '"), value, F.lit("'"))).alias("lookup_error"),
    )


def resolve(values: DataFrame, column: str, table: DataFrame, domain: list[str]) -> DataFrame:
    """Per value its status: EMPTY, MAPPED (a lookup entry whose target is allowed), MAPPED_INVALID (it is not), ALREADY_VALID (no
    entry, but the value itself is allowed), UNMAPPED."""
    value = trim_to_null(F.col(f"`{column}`").cast("string"))
    joined = values.join(table, fold(value) == F.col("k"), "left")
    status = (
        F.when(value.isNull(), "EMPTY")
        .when(F.col("k").isNotNull() & F.col("v").isin(domain), "MAPPED")
        .when(F.col("k").isNotNull(), "MAPPED_INVALID")
        .when(value.isin(domain), "ALREADY_VALID")
        .otherwise("UNMAPPED")
    )
    return joined.select(*[F.col(f"`{c}`") for c in values.columns], F.col("v").alias("mapped_to"), status.alias("status"))


def unmatched(df: DataFrame, column: str, table: DataFrame, top: int = 8) -> DataFrame:
    """The commonest values without an entry."""
    value = trim_to_null(F.col(f"`{column}`").cast("string"))
    counts = df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(table, fold(F.col("value")) == F.col("k"), "left_anti").orderBy(F.desc("n"), "value").limit(top)


def draft_groups(df: DataFrame, column: str, domain: list[str], synonyms: dict[str, str]) -> DataFrame:
    """Different values folded to one key each: key, spelling (the commonest, ties by text), spellings, n and the proposed target with
    its origin (VALID_KEY, SYNONYM, UNKNOWN)."""
    value = trim_to_null(F.col(f"`{column}`").cast("string"))
    counts = df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(fold(F.col("value")).alias("key")).agg(F.min(F.struct(-F.col("n"), "value")).alias("m"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"))
    known = F.create_map(*[x for k, v in sorted(synonyms.items()) for x in (F.lit(k), F.lit(v))]) if synonyms else F.create_map(F.lit(""), F.lit(""))
    target = F.when(F.col("key").isin(domain), F.col("key")).otherwise(known[F.col("key")])
    origin = F.when(F.col("key").isin(domain), "VALID_KEY").when(known[F.col("key")].isNotNull(), "SYNONYM").otherwise("UNKNOWN")
    return groups.select("key", F.col("m.value").alias("spelling"), "spellings", "n", target.alias("target"), origin.alias("origin"))


def evidence(df: DataFrame, column: str, length: int, domain: list[str]) -> DataFrame:
    """One row about a column as the source of a lookup: rows, filled, distinct, longest, share that fits the length, share in the
    domain (4 digits; 0 without values)."""
    value = trim_to_null(F.col(f"`{column}`").cast("string"))
    counts = df.select(value.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    has = F.col("v").isNotNull()
    share = lambda cond: F.round(F.coalesce(F.sum(F.when(has & cond, F.col("n")).otherwise(0)) / F.nullif(F.sum(F.when(has, F.col("n")).otherwise(0)), F.lit(0)), F.lit(0.0)), 4)
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("filled"),
        F.count("v").alias("distincts"),
        F.max(F.length("v")).alias("longest"),
        share(F.length("v") <= length).alias("fits"),
        share(F.col("v").isin(domain)).alias("in_domain"),
    )
