"""Assessment of a table by the quality rules, and its score.

All row rules of all columns are conditional counts of one scan, cut into batches of columns so that the generated code stays
small; the single wide row is then unpivoted. Uniqueness counts groups of normal forms with map-side partials.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import alnum, full_match, trim_to_null
from tidewright.plans.quality_rules import DIMENSION, HINTS, MIXED_CHECKS, SEVERITY, SHARED_CHECKS, VALUE_CHECKS, WEIGHTS, checks_of, iso_country, role_by_name

#: Columns whose rules share one scan.
BATCH = 12
ROLE_SAMPLE = 200
_RESULT = "column_name string, rule_id string, checked bigint, violations bigint"


def column_roles(df: DataFrame, keys: list[str] = ()) -> dict[str, str]:
    """Role per column: declared key, by name, else e-mail if at least 5 sampled values are there and 60% look like one, else any."""
    lower = {k.lower() for k in keys}
    roles = {c: "key" if c.lower() in lower else role_by_name(c) for c in df.columns}
    open_ = [c for c, r in roles.items() if r is None]
    if open_:
        sample = df.orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in open_]).limit(ROLE_SAMPLE).collect()
        for c in open_:
            values = [r[c].strip() for r in sample if r[c] and r[c].strip()]
            mails = sum("@" in v and "." in v.rpartition("@")[2] and " " not in v for v in values)
            roles[c] = "email" if len(values) >= 5 and mails >= 0.6 * len(values) else "any"
    return roles


def row_results(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """column_name, rule_id, checked (values that aren't null), violations, for every row rule that applies."""
    country_columns = [c for c, r in roles.items() if r == "country"]
    country = iso_country(F.col(f"`{country_columns[0]}`")) if country_columns else None
    parts = []
    names = list(roles)
    for i in range(0, len(names), BATCH):
        aggs, cells = [], []
        for c in names[i : i + BATCH]:
            value = F.col(f"`{c}`").cast("string")
            for rule in checks_of(roles[c]):
                if rule in VALUE_CHECKS and (cond := VALUE_CHECKS[rule](value, country)) is not None:
                    n = len(aggs)
                    aggs += [F.count(value).alias(f"c{n}"), F.count_if(value.isNotNull() & F.coalesce(cond, F.lit(False))).alias(f"v{n}")]
                    cells.append(F.struct(F.lit(c).alias("column_name"), F.lit(rule).alias("rule_id"), F.col(f"c{n}").alias("checked"), F.col(f"v{n}").alias("violations")))
        if aggs:
            parts.append(df.agg(*aggs).select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def unique_form(value, role: str):
    """Normal form in which values of this role are compared."""
    if role == "tax":
        return F.nullif(alnum(value), F.lit(""))
    return trim_to_null(F.lower(value)) if role == "email" else trim_to_null(value)


def unique_results(df: DataFrame, roles: dict[str, str]) -> DataFrame | None:
    """The same for uniqueness: checked are the rows with a normal form, violations those that share it."""
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule_id"), unique_form(F.col(f"`{c}`").cast("string"), role).alias("norm"))
        for c, role in roles.items()
        for r in checks_of(role)
        if r in SHARED_CHECKS
    ]
    if not cells:
        return None
    groups = df.select(F.inline(F.array(*cells))).groupBy("column_name", "rule_id", "norm").agg(F.count(F.lit(1)).alias("n"))
    has = F.col("norm").isNotNull()
    return groups.groupBy("column_name", "rule_id").agg(F.sum(F.when(has, F.col("n")).otherwise(0)).alias("checked"), F.sum(F.when(has & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("violations"))


def mixture_results(df: DataFrame, roles: dict[str, str]) -> DataFrame | None:
    """The same for mixtures: rows that some variant reads but not the dominant one (most rows, ties by order), if there are at
    least 2 of them and 1% of the checked rows. One scan counts every variant and, for each possible lead, the others."""
    out = []
    for c, role in roles.items():
        for rule in checks_of(role):
            if rule not in MIXED_CHECKS:
                continue
            value = F.col(f"`{c}`").cast("string")
            tests = [F.coalesce(t(value), F.lit(False)) for t in MIXED_CHECKS[rule].values()]
            some = reduce(lambda a, b: a | b, tests)
            row = df.agg(F.count(value).alias("checked"), *[F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests)], *[F.count_if(some & ~t).alias(f"o{i}") for i, t in enumerate(tests)])
            k = range(len(tests))
            top = F.greatest(*[F.col(f"n{i}") for i in k])
            other = F.coalesce(*[F.when(F.col(f"n{i}") == top, F.col(f"o{i}")) for i in k])
            used = sum((F.when(F.col(f"n{i}") > 0, 1).otherwise(0) for i in k), F.lit(0))
            real = (used > 1) & (other >= F.greatest(F.lit(2.0), 0.01 * F.col("checked")))
            out.append(row.select(F.lit(c).alias("column_name"), F.lit(rule).alias("rule_id"), "checked", F.when(real, other).otherwise(0).cast("bigint").alias("violations")))
    return reduce(DataFrame.unionByName, out) if out else None


def assess(df: DataFrame, keys: list[str] = (), roles: dict[str, str] | None = None) -> DataFrame:
    """column_name, role, rule_id, dimension, severity, checked, violations, rate (4 digits) of every rule that applies.

    A table without rows has 0 checked and rate 0 everywhere.
    """
    roles = roles or column_roles(df, keys)
    parts = [row_results(df, roles), unique_results(df, roles), mixture_results(df, roles)]
    results = reduce(DataFrame.unionByName, [p for p in parts if p is not None])
    entry = lambda table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    rule = F.col("rule_id")
    return results.select(
        "column_name",
        entry(roles)[F.col("column_name")].alias("role"),
        "rule_id",
        entry(DIMENSION)[rule].alias("dimension"),
        entry(SEVERITY)[rule].alias("severity"),
        "checked",
        "violations",
        F.round(F.when(F.col("checked") > 0, F.col("violations") / F.col("checked")).otherwise(0.0), 4).alias("rate"),
    )


def _score(rate: str = "rate"):
    weight = F.when(F.col("severity") == "HIGH", WEIGHTS["HIGH"]).when(F.col("severity") == "MEDIUM", WEIGHTS["MEDIUM"]).otherwise(WEIGHTS["LOW"])
    weight = F.when(F.col("checked") > 0, weight).otherwise(0.0)
    return F.round(F.when(F.sum(weight) > 0, 100 * (1 - F.sum(weight * F.col(rate)) / F.sum(weight))).otherwise(100.0), 1)


def scores(results: DataFrame) -> DataFrame:
    """level (column, dimension, table), name, score: weighted by severity over the checked rules; the table's is the columns' mean."""
    columns = results.groupBy(F.col("column_name").alias("name")).agg(_score().alias("score"))
    dims = results.groupBy(F.col("dimension").alias("name")).agg(_score().alias("score"))
    table = columns.agg(F.round(F.avg("score"), 1).alias("score")).select(F.lit("all").alias("name"), "score")
    return reduce(DataFrame.unionByName, [x.select(F.lit(level).alias("level"), "name", "score") for level, x in (("column", columns), ("dimension", dims), ("table", table))])


def history_change(history: DataFrame, table: str, number: str, score: str) -> DataFrame:
    """Adds previous_score and change against the assessment before, per table."""
    w = Window.partitionBy(table).orderBy(number)
    return history.withColumn("previous_score", F.lag(score).over(w)).withColumn("change", F.round(F.col(score) - F.col("previous_score"), 1))


def flag_rows(df: DataFrame, column: str, rule_id: str, country: str | None = None) -> DataFrame:
    """The rows that break a row rule, for drilling down; works on streams too."""
    value = F.col(f"`{column}`").cast("string")
    cond = VALUE_CHECKS[rule_id](value, iso_country(F.col(f"`{country}`")) if country else None)
    return df.where(value.isNotNull() & F.coalesce(cond, F.lit(False)))


def looks_like_email(c):
    return full_match(F.trim(c), r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}")


def samples(df: DataFrame, roles: dict[str, str], column: str, rule_id: str, n: int = 5, width: int = 40, mask: bool = True) -> DataFrame:
    """value, hint: up to n different values that break a row check, by a hash so that they are the same every time; cut to ``width``
    characters and masked (letters and digits but the first two become *) unless told otherwise."""
    country = next((c for c, r in roles.items() if r == "country"), None)
    found = flag_rows(df, column, rule_id, country).select(F.col(f"`{column}`").cast("string").alias("value")).distinct()
    chosen = found.orderBy(F.xxhash64("value"), "value").limit(n)
    shown = F.left("value", F.lit(width))
    if mask:
        shown = F.concat(F.left("value", F.lit(2)), F.regexp_replace(F.substring("value", 3, width - 2), r"[\p{L}\p{N}]", "*"))
    return chosen.select(shown.alias("value"), F.lit(HINTS[DIMENSION[rule_id]]).alias("hint"))
