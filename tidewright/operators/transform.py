"""Rule compiler: declarative field rules to a typed staging table with an error per cell, and its lineage.

Two projections of one lazy plan: first key, raw value and rule value per target, then the value in the target's type and its
error. Lookups are joined as tables (small ones Spark broadcasts by their size). Lineage and error breakdowns are unpivots of
the same plan, not one scan per rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import blank_to_null, fold, full_match, shown, to_date, to_long, trim_to_null
from tidewright.operators.rows import RN, number_rows
from tidewright.plans.expression import compile_rule
from tidewright.session import Stage

STATUS, ERRORS, PK = "_TRANSFORM_STATUS", "_TRANSFORM_ERRORS", "_SRC_PK"
FALLBACKS = ("PASS_THROUGH", "FLAG_FAILED", "USE_DEFAULT")
KINDS = {
    "string": "CHAR VARCHAR VARCHAR2 NVARCHAR STRING SSTRING LANG CUKY CLNT UNIT LCHR TEXT DATS TIMS", "numc": "NUMC", "int": "INT INT1 INT2 INT4 INT8 INTEGER SMALLINT BIGINT",
    "decimal": "DEC CURR QUAN NUMBER NUMERIC DECIMAL FLTP FLOAT DOUBLE", "date": "DATE", "timestamp": "TIMESTAMP DATETIME",
}
_KIND = {name: kind for kind, names in KINDS.items() for name in names.split()}


@dataclass(frozen=True)
class Target:
    table: str
    column: str
    type: str = "CHAR"
    length: int | None = None
    mandatory: bool = False
    precision: int | None = None
    scale: int = 0
    check_values: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.table}_{self.column}"

    @property
    def kind(self) -> str:
        return _KIND.get(self.type.upper(), "string")


@dataclass(frozen=True)
class FieldRule:
    target: Target
    kind: str  # COPY, STATIC, EXPRESSION, LOOKUP
    source: str | None = None
    logic: str | None = None
    lookup: str | None = None  # name of the lookup table
    rule_id: str = ""


@dataclass(frozen=True)
class Mapping:
    rules: tuple[FieldRule, ...]
    source_pk: tuple[str, ...] = ()
    passthrough: tuple[str, ...] = ()
    fallback: str = "FLAG_FAILED"
    default: str | None = None
    status: str = "APPROVED"
    conditional: dict = field(default_factory=dict)  # target name -> condition over staged columns under which it is mandatory

    def check(self, columns: list[str]) -> None:
        """What can't run is refused: rejected mappings, code snippets, unknown columns, two rules for one target."""
        if self.status == "REJECTED":
            raise ValueError("a rejected mapping does not run")
        if self.fallback not in FALLBACKS:
            raise ValueError(f"unknown fallback {self.fallback}")
        lower = {c.lower() for c in columns}
        names = [r.target.name for r in self.rules]
        if len(set(names)) < len(names):
            raise ValueError("two rules for one target column")
        for r in self.rules:
            if r.kind not in ("COPY", "STATIC", "EXPRESSION", "LOOKUP"):
                raise ValueError(f"rules of kind {r.kind} do not run")
            if r.kind in ("COPY", "LOOKUP") and not r.source or r.kind in ("STATIC", "EXPRESSION") and not r.logic:
                raise ValueError(f"the rule for {r.target.name} is incomplete")
            if r.source and r.source.lower() not in lower:
                raise ValueError(f"the source has no column {r.source}")
        for c in (*self.source_pk, *self.passthrough):
            if c.lower() not in lower:
                raise ValueError(f"the source has no column {c}")


def row_numbers(df: DataFrame) -> DataFrame:
    """Adds __rn from 1 in the order of the partitions where landing has not done so."""
    return df if RN in df.columns else number_rows(df, Stage(df.sparkSession, "rows"))


def source_key(columns: list[str] | tuple[str, ...]) -> Column:
    """Trimmed parts joined with |; the row number where a part is missing or no key is given."""
    rn = F.concat(F.lit("ROW:"), F.col(RN).cast("string"))
    if not columns:
        return rn
    parts = [trim_to_null(F.col(f"`{c}`").cast("string")) for c in columns]
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    return F.when(whole, F.concat_ws("|", *parts)).otherwise(rn)


def _convert(v: Column, t: Target) -> tuple[Column, Column]:
    """(value in the target's type, error of the conversion or null)."""
    long = F.length(v) > t.length if t.length else F.lit(False)
    size = F.concat(F.lit("LENGTH_EXCEEDED: value has "), F.length(v).cast("string"), F.lit(f" chars, {t.type}({t.length}) allows {t.length}"))
    failed = F.concat(F.lit("CONVERSION_FAILED: '"), shown(v), F.lit(f"' is no {t.type}"))
    if t.kind == "string":
        control = v.rlike(r"[\x{0}-\x{1f}\x{7f}-\x{9f}\x{202A}-\x{202E}\x{2066}-\x{2069}]")
        return F.when(~control & ~long, v), F.when(control, F.concat(F.lit("CONVERSION_FAILED: control character in '"), shown(v), F.lit("'"))).when(long, size)
    if t.kind == "numc":
        ok = full_match(v, "[0-9]+")
        return F.when(ok & ~long, v), F.when(~ok, failed).when(long, size)
    if t.kind == "int":
        out = to_long(v)
    elif t.kind == "decimal":
        number = F.when(full_match(F.trim(v), r"[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]{1,2})?"), F.trim(v))
        out = number.try_cast(f"decimal({t.precision},{t.scale})" if t.precision else "double")
    elif t.kind == "date":
        out = to_date(v)
    else:
        out = F.when(full_match(F.trim(v), r"\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?"), F.trim(v)).try_cast("timestamp_ntz")
    return out, F.when(v.isNotNull() & out.isNull(), failed)


def cells(mapping: Mapping, source: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """__rn, _SRC_PK, and per rule r_i (raw), v_i (value), t_i (typed value), e_i (error). Lookups: (k folded key, v value), one row per key."""
    mapping.check(source.columns)
    df = row_numbers(source)
    for i, r in enumerate(mapping.rules):
        if r.kind == "LOOKUP":
            table = lookups[r.lookup].select(F.col("k").alias(f"__k{i}"), F.col("v").alias(f"__v{i}")).where(F.col(f"__k{i}") != "")
            df = df.join(table, fold(F.col(f"`{r.source}`").cast("string")) == F.col(f"__k{i}"), "left")
    known = {c.lower(): blank_to_null(F.col(f"`{c}`").cast("string")) for c in source.columns if c != RN}
    first = [F.col(RN), source_key(mapping.source_pk).alias(PK)]
    for i, r in enumerate(mapping.rules):
        raw = known[r.source.lower()] if r.source else F.lit(None).cast("string")
        lost = F.lit(None).cast("string")
        if r.kind == "COPY":
            value = trim_to_null(raw)
        elif r.kind == "LOOKUP":
            found, asked = F.col(f"__v{i}"), trim_to_null(raw)
            missing = asked.isNotNull() & F.col(f"__k{i}").isNull()
            if mapping.fallback == "PASS_THROUGH":
                value = F.when(missing, asked).otherwise(found)
            elif mapping.fallback == "USE_DEFAULT":
                value = F.when(missing, F.lit(mapping.default)).otherwise(found)
            else:
                value = found
                lost = F.when(missing, F.concat(F.lit("LOOKUP_FAILED: no mapping for '"), shown(asked), F.lit("'")))
        else:
            value = compile_rule(r.logic, known, r.source)
        first += [raw.alias(f"r_{i}"), value.alias(f"v_{i}"), lost.alias(f"l_{i}")]
    kept = [trim_to_null(F.col(f"`{c}`").cast("string")).alias(f"SRC_{c}") for c in mapping.passthrough]
    one = df.select(*first, *kept)
    second = []
    for i, r in enumerate(mapping.rules):
        typed, bad = _convert(F.col(f"v_{i}"), r.target)
        second += [typed.alias(f"t_{i}"), F.when(F.col(f"v_{i}").isNotNull(), bad).alias(f"c_{i}")]
    two = one.select("*", *second)
    names = {r.target.name: f"v_{i}" for i, r in enumerate(mapping.rules)}
    errors = []
    for i, r in enumerate(mapping.rules):
        needed = F.lit(r.target.mandatory)
        if r.target.name in mapping.conditional:
            other, values, equal = mapping.conditional[r.target.name]
            hit = F.col(names[other]).isin(list(values))
            needed = F.coalesce(hit, F.lit(False)) if equal else ~F.coalesce(hit, F.lit(False))
        empty = F.when(needed & F.col(f"t_{i}").isNull(), F.lit(f"MANDATORY_EMPTY: {r.target.table}.{r.target.column} is mandatory"))
        errors.append(F.coalesce(f"l_{i}", f"c_{i}", empty).alias(f"e_{i}"))
    return two.select("*", *errors)


def staging(mapping: Mapping, source: DataFrame, lookups: dict[str, DataFrame] | None = None) -> DataFrame:
    """__rn, _SRC_PK, one column per target, SRC_ columns, status (OK, FAILED) and the errors as 'T.C: error' joined with '; '."""
    df = cells(mapping, source, lookups or {})
    errors = [F.when(F.col(f"e_{i}").isNotNull(), F.concat(F.lit(f"{r.target.table}.{r.target.column}: "), F.col(f"e_{i}"))) for i, r in enumerate(mapping.rules)]
    text = F.concat_ws("; ", *errors)
    return df.select(
        RN,
        PK,
        *[F.col(f"t_{i}").alias(r.target.name) for i, r in enumerate(mapping.rules)],
        *[f"SRC_{c}" for c in mapping.passthrough],
        F.when(text == "", "OK").otherwise("FAILED").alias(STATUS),
        F.nullif(text, F.lit("")).alias(ERRORS),
    )


def lineage(mapping: Mapping, source: DataFrame, lookups: dict[str, DataFrame] | None = None, mode: str = "EXCEPTIONS", audited: list[str] | None = None) -> DataFrame:
    """One row per cell: _SRC_PK, target, rule_id, raw_value, transformed_value, loaded, error. EXCEPTIONS keeps the cells whose value
    changed or failed, NONE no row; audited: only these targets."""
    if mode not in ("ALL", "EXCEPTIONS", "NONE"):
        raise ValueError(f"unknown mode {mode}")
    df = cells(mapping, source, lookups or {})
    out = [
        F.struct(
            F.lit(f"{r.target.table}.{r.target.column}").alias("target"),
            F.lit(r.rule_id).alias("rule_id"),
            F.col(f"r_{i}").alias("raw_value"),
            F.col(f"t_{i}").cast("string").alias("transformed_value"),
            F.col(f"e_{i}").alias("error"),
        )
        for i, r in enumerate(mapping.rules)
        if audited is None or r.target.name in audited
    ]
    long = df.select(PK, F.inline(F.array(*out))).withColumn("loaded", F.col("error").isNull())
    if mode == "NONE":
        return long.limit(0)
    return long if mode == "ALL" else long.where(F.col("error").isNotNull() | ~F.col("raw_value").eqNullSafe(F.col("transformed_value")))


def rule_summary(mapping: Mapping, source: DataFrame, lookups: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per target: rows, values, errors, in one aggregation."""
    df = cells(mapping, source, lookups or {})
    aggs = [x for i in range(len(mapping.rules)) for x in (F.count(f"t_{i}").alias(f"n{i}"), F.count(f"e_{i}").alias(f"x{i}"))]
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    out = [F.struct(F.lit(r.target.name).alias("target"), F.col("n_rows"), F.col(f"n{i}").alias("filled"), F.col(f"x{i}").alias("errors")) for i, r in enumerate(mapping.rules)]
    return row.select(F.inline(F.array(*out)))
