"""Declarative table combiner: base table, up to five joins, filters, picked columns; and what the joins do to the rows.

Keys never match on blank. The plan is one lazy DataFrame, so Catalyst prunes columns, pushes filters and picks the join strategy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_JOINS, MAX_CONDITIONS, MAX_FILTERS, MAX_COLUMNS = 5, 4, 12, 300
MATCHES = ("exact", "trim", "trim_ci")
OPERATORS = ("equals", "not_equals", "in", "contains", "starts_with", "regex", "is_blank", "not_blank")


@dataclass(frozen=True)
class Join:
    table: str
    alias: str
    on: tuple[tuple[str, str], ...]  # (alias.column of what is there, column of the new table)
    how: str = "left"
    match: str = "trim"


@dataclass(frozen=True)
class Filter:
    column: str  # alias.column
    op: str
    values: tuple[str, ...] = ()
    ignore_case: bool = False


@dataclass(frozen=True)
class Spec:
    base: str
    alias: str
    joins: tuple[Join, ...] = ()
    filters: tuple[Filter, ...] = ()
    columns: tuple[str, ...] = ()  # alias.column or alias.column=name; none: all


def check(spec: Spec) -> None:
    if len(spec.joins) > MAX_JOINS or len(spec.filters) > MAX_FILTERS or any(not 1 <= len(j.on) <= MAX_CONDITIONS for j in spec.joins):
        raise ValueError("too many joins, join conditions or filters")
    aliases = [spec.alias, *(j.alias for j in spec.joins)]
    if len(set(aliases)) < len(aliases):
        raise ValueError("an alias is used twice")
    for j in spec.joins:
        if j.how not in ("inner", "left") or j.match not in MATCHES:
            raise ValueError(f"unknown kind of join: {j.how}, {j.match}")
    for f in spec.filters:
        if f.op not in OPERATORS:
            raise ValueError(f"unknown filter: {f.op}")
        if f.op in ("is_blank", "not_blank") and f.values or f.op not in ("is_blank", "not_blank") and not f.values:
            raise ValueError(f"{f.op} has the wrong number of values")
        if f.op == "regex":
            safe_pattern(f.values[0])


def safe_pattern(pattern: str) -> str:
    """Refuses what would not run in linear time everywhere: references back, looks around."""
    import re

    if re.search(r"\\[1-9]|\(\?(=|!|<=|<!|P=)", pattern):
        raise ValueError("a pattern may not refer back or look around")
    re.compile(pattern)
    return pattern


def _norm(c: Column, match: str) -> Column:
    c = c.cast("string")
    return c if match == "exact" else F.trim(c) if match == "trim" else F.upper(F.trim(c))


def predicate(c: Column, op: str, values: tuple[str, ...], ignore_case: bool = False, *, null_matches: bool = True) -> Column:
    """A filter on a column. null_matches: null counts as blank text (the combiner's way), else null never matches (row exclusion)."""
    text = c.cast("string")
    if op == "is_blank":
        return text.isNull() | (F.trim(text) == "")
    if op == "not_blank":
        return text.isNotNull() & (F.trim(text) != "")
    if op == "regex":
        value = F.coalesce(text, F.lit("")) if null_matches else text
        return value.rlike(("(?i)" if ignore_case else "") + safe_pattern(values[0]))
    value = F.trim(F.coalesce(text, F.lit("")) if null_matches else text)
    wanted = [v.strip() for v in values]
    if ignore_case:
        value, wanted = F.lower(value), [v.lower() for v in wanted]
    if op == "equals":
        return value == wanted[0]
    if op == "not_equals":
        return value != wanted[0]
    if op == "in":
        return value.isin(wanted)
    return value.contains(wanted[0]) if op == "contains" else value.startswith(wanted[0])


def _prefixed(df: DataFrame, alias: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{alias}.{c}") for c in df.columns])


def _on(join: Join) -> Column:
    cond = F.lit(True)
    for left, right in join.on:
        a, b = _norm(F.col(f"`{left}`"), join.match), _norm(F.col(f"`{join.alias}.{right}`"), join.match)
        cond = cond & (a == b) & (F.trim(F.col(f"`{left}`").cast("string")) != "")
    return cond


def joined(spec: Spec, tables: dict[str, DataFrame], joins: int | None = None) -> DataFrame:
    """All columns as alias.column after the first ``joins`` joins, before filters."""
    check(spec)
    df = _prefixed(tables[spec.base], spec.alias)
    for j in spec.joins[:joins]:
        df = df.join(_prefixed(tables[j.table], j.alias), _on(j), j.how)
    return df


def combine(spec: Spec, tables: dict[str, DataFrame]) -> DataFrame:
    """The combined table. A picked column keeps its name unless two tables have it, then it is alias_column; a name that is still
    used twice, or more than 300 columns, is an error."""
    df = joined(spec, tables)
    for f in spec.filters:
        df = df.where(predicate(F.col(f"`{f.column}`"), f.op, f.values, f.ignore_case))
    picked = [p.partition("=") for p in spec.columns] or [(c, "", "") for c in df.columns if not c.rpartition(".")[2].startswith("__")]
    plain = [c.partition(".")[2].lower() for c, _, _ in picked]
    names = [n or (c.partition(".")[2] if plain.count(c.partition(".")[2].lower()) == 1 else c.replace(".", "_", 1)) for c, _, n in picked]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("two columns of the result have one name")
    if len(names) > MAX_COLUMNS:
        raise ValueError("too many columns")
    return df.select(*[F.col(f"`{c}`").alias(n) for (c, _, _), n in zip(picked, names)])


def join_stats(spec: Spec, tables: dict[str, DataFrame], row_id: str) -> DataFrame:
    """Per join: left rows without a match, with several, and the most matches of one row. row_id: unique in the base table.

    Matches are counted per distinct key of the new table before joining, so a key with very many rows doesn't multiply them.
    """
    out = None
    for i, j in enumerate(spec.joins):
        left = joined(spec, tables, i)
        right = _prefixed(tables[j.table], j.alias)
        keys = [_norm(F.col(f"`{j.alias}.{r}`"), j.match).alias(f"k{n}") for n, (_, r) in enumerate(j.on)]
        counts = right.select(*keys).groupBy(*[f"k{n}" for n in range(len(keys))]).agg(F.count(F.lit(1)).alias("__m"))
        cond = F.lit(True)
        for n, (a, _) in enumerate(j.on):
            cond = cond & (_norm(F.col(f"`{a}`"), j.match) == F.col(f"k{n}")) & (F.trim(F.col(f"`{a}`").cast("string")) != "")
        per_row = left.join(counts, cond, "left").groupBy(f"{spec.alias}.{row_id}" if "." not in f"{spec.alias}.{row_id}" else F.col(f"`{spec.alias}.{row_id}`").alias("__id"))
        m = per_row.agg(F.sum(F.coalesce("__m", F.lit(0))).alias("m"))
        part = m.agg(
            F.count(F.lit(1)).alias("left_rows"), F.count_if(F.col("m") == 0).alias("unmatched"), F.count_if(F.col("m") > 1).alias("several"), F.coalesce(F.max("m"), F.lit(0)).alias("most")
        ).select(F.lit(j.alias).alias("join_alias"), "left_rows", "unmatched", "several", "most")
        out = part if out is None else out.unionByName(part)
    return out


def fan_out(spec: Spec, tables: dict[str, DataFrame], row_id: str) -> DataFrame:
    """rows_before, rows_after, base_rows (different base rows that are left), surplus: a surplus above 0 means that joins multiplied rows."""
    before = tables[spec.base].agg(F.count(F.lit(1)).alias("rows_before"))
    per_row = joined(spec, tables).groupBy(F.col(f"`{spec.alias}.{row_id}`").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    after = per_row.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_after"), F.count(F.lit(1)).alias("base_rows"))
    return before.crossJoin(after).withColumn("surplus", F.col("rows_after") - F.col("base_rows"))  # one row each


def search(df: DataFrame, column: str, op: str, value: str = "", limit: int = 20) -> DataFrame:
    """Record search without case: equals, contains, is_blank, not_blank; 1 to 20 records in the order of their columns."""
    if op not in ("equals", "contains", "is_blank", "not_blank"):
        raise ValueError(f"unknown search: {op}")
    cond = predicate(F.col(f"`{column}`"), op, (value,), True)
    return df.where(cond).orderBy(*[F.col(f"`{c}`") for c in df.columns]).limit(max(1, min(limit, 20)))
