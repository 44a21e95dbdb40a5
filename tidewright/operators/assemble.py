"""Nested target records out of wide staging rows, and back into one table per segment with referential checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import alpha_input, trim_to_null


@dataclass(frozen=True)
class Segment:
    name: str
    fields: tuple[str, ...]
    required: tuple[str, ...] = ()  # the segment exists only with these; some of its fields without them are an issue


def assemble(staging: DataFrame, key: str, header: tuple[str, ...], segments: tuple[Segment, ...], roles: str | None, allowed_roles: tuple[str, ...]) -> DataFrame:
    """record_key (numbers padded to 10), header struct, one struct per segment or null, roles array, issues array (what stops the
    record) and warnings array (what is left out)."""
    value = lambda c: trim_to_null(F.col(f"`{c}`").cast("string"))
    out, issues, warnings = [], [F.when(value(key).isNull(), "NO_KEY")], []
    for s in segments:
        some = reduce(lambda a, b: a | b, [value(c).isNotNull() for c in s.fields])
        all_ = reduce(lambda a, b: a & b, [value(c).isNotNull() for c in s.required], F.lit(True))
        out.append(F.when(some & all_, F.struct(*[value(c).alias(c) for c in s.fields])).alias(s.name))
        warnings.append(F.when(some & ~all_, f"{s.name}_INCOMPLETE"))
    parsed = F.array_distinct(F.filter(F.split(F.upper(F.coalesce(value(roles), F.lit(""))), r"[,\s;]+"), lambda r: r != "")) if roles else F.array().cast("array<string>")
    good = F.filter(parsed, lambda r: r.isin(list(allowed_roles)))
    issues.append(F.when(F.size(good) == 0, "NO_ROLE"))
    warnings.append(F.when(F.size(good) < F.size(parsed), "UNKNOWN_ROLE"))
    clean = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return staging.select(
        alpha_input(F.col(f"`{key}`").cast("string")).alias("record_key"),
        F.struct(*[value(c).alias(c) for c in header]).alias("header"),
        *out,
        F.array_sort(good).alias("roles"),
        clean(issues).alias("issues"),
        clean(warnings).alias("warnings"),
    )


def sheets(records: DataFrame, segments: tuple[Segment, ...]) -> dict[str, DataFrame]:
    """One flat table for the header, each segment and the roles; records with issues are left out."""
    good = records.where(F.size("issues") == 0)
    out = {"header": good.select("record_key", "header.*"), "roles": good.select("record_key", F.explode("roles").alias("role"))}
    for s in segments:
        out[s.name] = good.where(F.col(s.name).isNotNull()).select("record_key", f"{s.name}.*")
    return out


def sheet_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """sheet, check_name, n: header keys that are empty or repeated, children without a header, headers without a role."""
    header = tables["header"].select("record_key")
    groups = header.groupBy("record_key").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        groups.where("record_key is null or trim(record_key) = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("header").alias("sheet"), F.lit("empty_key").alias("check_name"), "n"),
        groups.where("n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("header").alias("sheet"), F.lit("repeated_key").alias("check_name"), "n"),
        header.distinct().join(tables["roles"], "record_key", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("roles").alias("sheet"), F.lit("no_role").alias("check_name"), "n"),
    ]
    for name, df in tables.items():
        if name != "header":
            orphans = df.join(header.distinct(), "record_key", "left_anti").agg(F.count(F.lit(1)).alias("n"))
            parts.append(orphans.select(F.lit(name).alias("sheet"), F.lit("no_header").alias("check_name"), "n"))
    return reduce(DataFrame.unionByName, parts)


def simulate_load(records: DataFrame, stage) -> DataFrame:
    """A target that numbers what it accepts: record_key, accepted, messages, number (consecutive over the accepted, in key order)."""
    from tidewright.operators.rows import number_rows

    messages = F.filter(
        F.array(
            F.when(F.col("record_key").isNull() | (F.trim("record_key") == ""), "KEY_MISSING"),
            F.when(F.length("record_key") > 20, "KEY_TOO_LONG"),
            F.when(F.size("issues") > 0, "RECORD_INCOMPLETE"),
            F.when(F.size("roles") == 0, "ROLE_MISSING"),
        ),
        lambda m: m.isNotNull(),
    )
    judged = records.select("record_key", messages.alias("m"))
    good = number_rows(judged.where(F.size("m") == 0).select("record_key"), stage, "number", ["record_key"]).select("record_key", F.lit(True).alias("accepted"), F.lit("").alias("messages"), "number")
    return good.unionByName(judged.where(F.size("m") > 0).select("record_key", F.lit(False).alias("accepted"), F.array_join("m", ",").alias("messages"), F.lit(None).cast("bigint").alias("number")))


def key_statistics(df: DataFrame, key: str, limit: int = 1500) -> DataFrame:
    """rows, empty, too_long (bytes in UTF-8 with / written as %2F), with_slash, duplicates: what a document store says to these ids."""
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    groups = df.select(k.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.trim("k") == "", F.col("n"))), F.lit(0)).alias("empty"),
        F.coalesce(F.sum(F.when(F.octet_length(F.replace(F.col("k"), F.lit("/"), F.lit("%2F"))) > limit, F.col("n"))), F.lit(0)).alias("too_long"),
        F.coalesce(F.sum(F.when(F.col("k").contains("/"), F.col("n"))), F.lit(0)).alias("with_slash"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def document_id(c):
    """A key as a document id: / and % escaped, reserved names set off."""
    out = F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return F.when(out.isin(".", "..") | out.rlike(r"\A__.*__\z"), F.concat(F.lit("%"), out)).otherwise(out)
