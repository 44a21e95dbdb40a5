"""Queries over the migration steps: rule compiler, validation, construction, reconciliation, delta, merge, entity resolution, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.text import address_norm, name_norm
from tidewright.operators import assemble, construct, dedup, delta, exclude, reconcile, transform, validate
from tidewright.operators.transform import FieldRule, Mapping, Target
from tidewright.queries import read
from tidewright.queries.assess import RULES as EXCLUSIONS
from tidewright.queries.assess import _country_lookup
from tidewright.queries.sql import UP, fold, lit, trimmed
from tidewright.session import Stage

CODES = tuple("DE FR GB US IN CA NL BE CH AT ES PT IT PL SE DK NO FI IE CZ HU TR BR MX JP".split())
TERMS = ("N007", "N014", "N021", "N030", "N045", "N060", "N090")
SOURCE = ["CUST_ID", "CUST_NAME", "TAX_ID", "EMAIL", "PHONE", "ADDR_STREET", "CITY", "COUNTRY", "POSTAL_CODE", "PAYMENT_TERMS"]
FIELDS = (
    FieldRule(Target("BUT000", "BP_EXT", "CHAR", 20), "EXPRESSION", "CUST_ID", "'L' || LPAD(TRIM(source_col), 9, '0')", rule_id="F01"),
    FieldRule(Target("BUT000", "NAME_ORG1", "CHAR", 40, True), "COPY", "CUST_NAME", rule_id="F02"),
    FieldRule(Target("BUT000", "BU_SORT1", "CHAR", 20), "EXPRESSION", None, "UPPER(SUBSTRING(TRIM(CUST_NAME), 1, 18))", rule_id="F03"),
    FieldRule(Target("BUT000", "BU_GROUP", "CHAR", 4, True), "STATIC", None, "'0001'", rule_id="F04"),
    FieldRule(Target("ADRC", "COUNTRY", "CHAR", 3, True, check_values=CODES), "LOOKUP", "COUNTRY", lookup="country", rule_id="F05"),
    FieldRule(Target("ADRC", "CITY1", "CHAR", 40, True), "COPY", "CITY", rule_id="F06"),
    FieldRule(Target("ADRC", "POST_CODE1", "CHAR", 8), "COPY", "POSTAL_CODE", rule_id="F07"),
    FieldRule(Target("ADRC", "STREET", "CHAR", 30), "COPY", "ADDR_STREET", rule_id="F08"),
    FieldRule(Target("KNB1", "ZTERM", "CHAR", 60, check_values=TERMS), "EXPRESSION", None, "CASE WHEN UPPER(PAYMENT_TERMS) LIKE 'N0%' THEN UPPER(TRIM(PAYMENT_TERMS)) ELSE COALESCE(PAYMENT_TERMS, 'N030') END", rule_id="F09"),
    FieldRule(Target("DFKKBPTAXNUM", "TAXNUM", "NUMC", 20), "EXPRESSION", "TAX_ID", "REPLACE(TRIM(source_col), 'DE', '')", rule_id="F10"),
    FieldRule(Target("KNA1", "SCORE", "INT"), "EXPRESSION", "POSTAL_CODE", "CASE WHEN LENGTH(source_col) = 5 THEN source_col END", rule_id="F11"),
)
MAPPING = Mapping(FIELDS, ("CUST_ID",), ("TAX_ID",))
NAMES = [r.target.name for r in FIELDS]


def _source(spark, sf):
    return read(spark, sf, "lookalikes").select(F.col("rn").alias("__rn"), *SOURCE)


def _lookups(spark, sf):
    return {"country": _country_lookup(spark, sf)}


def _staging(spark, sf):
    return transform.staging(MAPPING, _source(spark, sf), _lookups(spark, sf))


def _written(spark, sf):
    """The staging table as the later steps find it: written."""
    return Stage(spark, "staging").write(_staging(spark, sf), "staging")


def transform_staging(spark, sf):
    return _staging(spark, sf).withColumn("KNA1_SCORE", F.col("KNA1_SCORE").cast("string"))


def transform_errors(spark, sf):
    return _written(spark, sf).where("_TRANSFORM_STATUS = 'FAILED'").select("__rn", "_SRC_PK", "_TRANSFORM_ERRORS")


def transform_rule_summary(spark, sf):
    return transform.rule_summary(MAPPING, _source(spark, sf), _lookups(spark, sf))


def _lineage(spark, sf, mode):
    return transform.lineage(MAPPING, _source(spark, sf), _lookups(spark, sf), mode)


def lineage_all(spark, sf):
    return _lineage(spark, sf, "ALL")


def lineage_exceptions(spark, sf):
    return _lineage(spark, sf, "EXCEPTIONS")


def _with_child(spark, sf):
    return _written(spark, sf).withColumn("is_duplicate_child", F.col("__rn") % 9 == 0)


def validate_kinds(spark, sf):
    return validate.failures(_with_child(spark, sf), FIELDS, "is_duplicate_child")


def validate_breakdown(spark, sf):
    return validate.breakdown(_with_child(spark, sf), FIELDS, "is_duplicate_child")


def validate_split(spark, sf):
    parts = validate.split(_with_child(spark, sf), FIELDS, "is_duplicate_child")
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("part"), "__rn", "_SRC_PK")
        out = part if out is None else out.unionByName(part)
    return out


def validate_score(spark, sf):
    return validate.counts(_with_child(spark, sf), FIELDS, "is_duplicate_child")


def construct_needs(spark, sf):
    return construct.needs(_written(spark, sf), FIELDS)


def _patches(staged):
    """Made-up answers to what is needed: right, wrong, for another key, or none."""
    n = F.col("__rn")
    value = F.when(n % 7 == 0, "QX").when(n % 5 == 0, "").when(F.col("target") == "ADRC_COUNTRY", "DE").otherwise("Neustadt")
    return construct.needs(staged, FIELDS).select(n.alias("row_ref"), F.when(n % 11 == 0, "somebody").otherwise(F.col("_SRC_PK")).alias("pk"), "target", value.alias("value"))


def construct_judged(spark, sf):
    s = _written(spark, sf)
    return construct.judge(_patches(s), s, FIELDS)


def construct_apply(spark, sf):
    s = _written(spark, sf)
    return construct.apply(s, construct.judge(_patches(s), s, FIELDS), FIELDS).select("__rn", "ADRC_COUNTRY", "ADRC_CITY1", "_TRANSFORM_STATUS", "_TRANSFORM_ERRORS")


def construct_lineage(spark, sf):
    s = _written(spark, sf)
    return construct.patch_lineage(construct.judge(_patches(s), s, FIELDS), s, FIELDS)


def recon_load_facts(spark, sf):
    return reconcile.load_facts(_lineage(spark, sf, "ALL"))


def recon_error_histogram(spark, sf):
    return reconcile.error_histogram(_lineage(spark, sf, "EXCEPTIONS"))


def recon_lineage_sample(spark, sf):
    return reconcile.lineage_sample(_lineage(spark, sf, "ALL"), len(FIELDS), [r.rule_id for r in FIELDS[:9]])


def _counts(spark, sf):
    source = _source(spark, sf)
    kept = exclude.tag(source, EXCLUSIONS).where("_EXCLUDED_BY is null").drop("_EXCLUDED_BY", "_EXCLUDED_REASON")
    staged = Stage(spark, "staging").write(transform.staging(MAPPING, kept, _lookups(spark, sf)), "staging").withColumn("is_duplicate_child", F.col("__rn") % 9 == 0)
    got = validate.counts(staged, FIELDS, "is_duplicate_child")
    zero = F.lit(0).cast("bigint")
    total = source.agg(F.count(F.lit(1)).alias("extracted"))
    out = total.crossJoin(got)  # one row each
    return out.select("extracted", (F.col("extracted") - F.col("evaluated") - F.col("duplicates")).alias("excluded"), "duplicates", "rejected", F.col("valid").alias("loaded"), zero.alias("load_failed"), zero.alias("not_attempted"))


def recon_accounting(spark, sf):
    return reconcile.accounting(_counts(spark, sf))


def recon_drop_off(spark, sf):
    return reconcile.drop_off(_counts(spark, sf))


def recon_checks(spark, sf):
    return reconcile.checks(_counts(spark, sf))


# ---------------------------------------------------------------- delta and merge
POPULATION = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _current(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("c_acctbal"), "c_mktsegment")


def _baseline(spark, sf):
    k = F.col("c_custkey")
    old = _current(spark, sf).where(k % 50 != 0).withColumn("c_mktsegment", F.when(k % 30 == 0, "OLD").otherwise(F.col("c_mktsegment")))
    gone = _current(spark, sf).where(k % 70 == 0).withColumn("c_custkey", k + 10_000_000)
    return old.unionByName(gone)


def delta_kinds(spark, sf):
    return delta.kinds(_current(spark, sf), _baseline(spark, sf), "c_custkey", POPULATION)


def delta_payload(spark, sf):
    return delta.payload(_current(spark, sf), _baseline(spark, sf), "c_custkey", POPULATION)


def delta_removed_why(spark, sf):
    base = _baseline(spark, sf).where("c_custkey >= 10000000")
    rejected, duplicates = base.where("c_custkey % 4 = 0").select("c_custkey"), base.where("c_custkey % 3 = 0").select("c_custkey")
    return delta.removed_why(_current(spark, sf), _baseline(spark, sf), "c_custkey", POPULATION, rejected, duplicates)


def fingerprint_table(spark, sf):
    return delta.fingerprint(_current(spark, sf), "c_custkey", POPULATION)


def fingerprint_diff(spark, sf):
    changed = _current(spark, sf).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 30 == 0, "OLD").otherwise(F.col("c_mktsegment")))
    return delta.fingerprint_diff(_current(spark, sf), changed, "c_custkey", POPULATION)


def _merge(spark, sf):
    target = _baseline(spark, sf).withColumn("run_id", F.lit("r1"))
    changes = delta.payload(_current(spark, sf), _baseline(spark, sf), "c_custkey", POPULATION).drop("_DELTA_KIND")
    deletes = delta.removed_why(_current(spark, sf), _baseline(spark, sf), "c_custkey", POPULATION).select("c_custkey")
    return target, changes, deletes


def merge_apply(spark, sf):
    target, changes, deletes = _merge(spark, sf)
    return delta.merge(target, changes, "c_custkey", "run_id", "r2", deletes)["after"]


def merge_before_image(spark, sf):
    target, changes, deletes = _merge(spark, sf)
    return delta.merge(target, changes, "c_custkey", "run_id", "r2", deletes)["before_image"]


def merge_rollback(spark, sf):
    target, changes, deletes = _merge(spark, sf)
    done = delta.merge(target, changes, "c_custkey", "run_id", "r2", deletes)
    return delta.roll_back_merge(done["after"], done["before_image"], "run_id", "r2")


def merge_counts(spark, sf):
    target, changes, deletes = _merge(spark, sf)
    return delta.merge_counts(target, changes, "c_custkey", deletes)


# ---------------------------------------------------------------- entity resolution
KEYS = [dedup.ExactKey("tax", (("TAX_ID", "alnum"),), True), dedup.ExactKey("phone", (("PHONE", "digits"),)), dedup.ExactKey("email", (("EMAIL", "email"),))]
ADDRESS = ["ADDR_STREET", "CITY", "POSTAL_CODE"]


def _records(spark, sf):
    return read(spark, sf, "lookalikes").select("rn", *SOURCE)


def _key_cells(spark, sf):
    return dedup.key_cells(_records(spark, sf), "rn", KEYS)


def _codes(spark, sf):
    return _key_cells(spark, sf).where("key_name = 'tax'").select("id", F.col("value").alias("code"))


def _forms(spark, sf):
    return dedup.normal_forms(_records(spark, sf), "rn", "CUST_NAME", ADDRESS, ["ADDR_STREET", "POSTAL_CODE"])


def dedup_exact_edges(spark, sf):
    return dedup.exact_edges(_key_cells(spark, sf))


def dedup_ignored_keys(spark, sf):
    return dedup.ignored_keys(_key_cells(spark, sf))


def dedup_veto(spark, sf):
    return dedup.veto(dedup.exact_edges(_key_cells(spark, sf)), _codes(spark, sf), F.col("reason") == "EXACT:tax")


def dedup_name_norm(spark, sf):
    return _records(spark, sf).select("rn", name_norm(F.col("CUST_NAME")).alias("nn"))


def dedup_address_norm(spark, sf):
    return _records(spark, sf).select("rn", address_norm(*[F.col(c) for c in ADDRESS]).alias("na"))


def dedup_blocks(spark, sf):
    return dedup.block_keys(_forms(spark, sf)).groupBy("pass", "block").agg(F.count(F.lit(1)).alias("n"))


def _candidates(spark, sf):
    return dedup.candidates(dedup.block_keys(_forms(spark, sf)), 200, 50)


def dedup_candidates(spark, sf):
    """Pairs per pass: how many pairs blocking leaves to compare, with a small limit so that the windowed way is used too."""
    return _candidates(spark, sf).groupBy("pass").agg(F.count(F.lit(1)).alias("pairs"))


def dedup_fuzzy_pairs(spark, sf):
    forms, codes = _forms(spark, sf), _codes(spark, sf).groupBy("id").agg(F.min("code").alias("code"))
    return dedup.fuzzy_pairs(forms, dedup.candidates(dedup.block_keys(forms, codes), filtered=True))


def dedup_possible_pairs(spark, sf):
    return dedup_fuzzy_pairs(spark, sf).where("decision = 'REVIEW'")


def _groups(spark, sf, stage):
    return stage.write(dedup.components(stage.write(dedup_veto(spark, sf).select("a", "b"), "edges"), stage), "groups")


def dedup_components(spark, sf):
    return _groups(spark, sf, Stage(spark, "dedup"))


def dedup_conflicting_groups(spark, sf):
    return dedup.conflicting_groups(_groups(spark, sf, Stage(spark, "dedup")), _codes(spark, sf))


def _failed():
    return F.col("rn") % 13 == 0


def dedup_golden(spark, sf):
    stage = Stage(spark, "dedup")
    return dedup.golden(_records(spark, sf), _groups(spark, sf, stage), "rn", "CUST_ID", SOURCE, _failed(), stage)


def dedup_survivorship(spark, sf):
    stage = Stage(spark, "dedup")
    master = dedup.golden(_records(spark, sf), _groups(spark, sf, stage), "rn", "CUST_ID", SOURCE, _failed(), stage)
    return dedup.survivorship(_records(spark, sf), master, "rn", "CUST_ID", ["EMAIL", "PHONE", "CITY", "POSTAL_CODE"], SOURCE, _failed())


def dedup_full(spark, sf):
    """The whole operator: exact keys, fuzzy pairs, constrained clusters, masters."""
    return dedup.deduplicate(_records(spark, sf), "rn", "CUST_ID", KEYS, "CUST_NAME", ADDRESS, ["ADDR_STREET", "POSTAL_CODE"], SOURCE, _failed(), Stage(spark, "dedup"))


# ---------------------------------------------------------------- assembly
SEGMENTS = (assemble.Segment("address", ("CITY", "POSTAL_CODE", "ADDR_STREET"), ("CITY",)), assemble.Segment("mail", ("EMAIL",), ("EMAIL",)), assemble.Segment("tax", ("TAX_ID", "COUNTRY"), ("TAX_ID",)))
ALLOWED = ("FLCU00", "FLCU01", "FLVN00", "FLVN01")


def _assembled(spark, sf):
    n = F.col("rn") % 5
    roles = F.when(n == 0, "FLCU00, FLCU01").when(n == 1, "flvn00").when(n == 2, "FLCU00;BOSS").when(n == 3, "").otherwise("FLCU01 FLCU01")
    return assemble.assemble(_records(spark, sf).withColumn("ROLES", roles), "CUST_ID", ("CUST_NAME",), SEGMENTS, "ROLES", ALLOWED)


def assemble_records(spark, sf):
    j = lambda c: F.array_join(c, ",").alias(c)
    return _assembled(spark, sf).select("record_key", F.col("header.CUST_NAME").alias("name"), F.col("address.CITY").alias("city"), F.col("tax.TAX_ID").alias("tax_id"), j("roles"), j("issues"), j("warnings"))


def assemble_roles_explode(spark, sf):
    return assemble.sheets(_assembled(spark, sf), SEGMENTS)["roles"].groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def sheet_checks(spark, sf):
    return assemble.sheet_checks(assemble.sheets(_assembled(spark, sf), SEGMENTS))


def simulate_load(spark, sf):
    one = _assembled(spark, sf).groupBy("record_key").agg(F.min(F.struct("roles", "issues")).alias("m")).select("record_key", "m.roles", "m.issues")
    return assemble.simulate_load(one, Stage(spark, "simulate")).fillna(0, ["number"])


def key_statistics(spark, sf):
    return assemble.key_statistics(_records(spark, sf).select(F.concat("TAX_ID", F.lit("/"), "COUNTRY").alias("k")), "k")


QUERIES = {
    f.__name__: f
    for f in (
        transform_staging, transform_errors, transform_rule_summary, lineage_all, lineage_exceptions, validate_kinds, validate_breakdown, validate_split, validate_score,
        construct_needs, construct_judged, construct_apply, construct_lineage, recon_load_facts, recon_error_histogram, recon_lineage_sample, recon_accounting, recon_drop_off,
        recon_checks, delta_kinds, delta_payload, delta_removed_why, fingerprint_table, fingerprint_diff, merge_apply, merge_before_image, merge_rollback, merge_counts,
        dedup_exact_edges, dedup_ignored_keys, dedup_veto, dedup_name_norm, dedup_address_norm, dedup_blocks, dedup_candidates, dedup_fuzzy_pairs, dedup_possible_pairs,
        dedup_components, dedup_conflicting_groups, dedup_golden, dedup_survivorship, dedup_full, assemble_records, assemble_roles_explode, sheet_checks, simulate_load,
        key_statistics,
    )
}

# ---------------------------------------------------------------- SQL
_B = lambda c: f"(CASE WHEN trim({c}, ' ') <> '' THEN {c} END)"
_CONTROL = r"[\x00-\x1f\x7f-\x9f\x{202A}-\x{202E}\x{2066}-\x{2069}]"
_SHOWN = lambda c: f"left(regexp_replace({c}, '\\p{{Cc}}', '?', 'g'), 60)"
_LOOK = f"(SELECT {fold('s')} AS k, min(code) AS v FROM (SELECT unnest([code, alt_code, name]) AS s, code FROM ref_values WHERE domain = 'COUNTRY') WHERE s IS NOT NULL GROUP BY 1 HAVING {fold('s')} <> '')"
_RAW = {"F01": "CUST_ID", "F02": "CUST_NAME", "F05": "COUNTRY", "F06": "CITY", "F07": "POSTAL_CODE", "F08": "ADDR_STREET", "F10": "TAX_ID", "F11": "POSTAL_CODE"}
_VAL = {
    "F01": f"'L' || lpad(trim({_B('CUST_ID')}, ' '), 9, '0')",
    "F02": trimmed("CUST_NAME"),
    "F03": UP(f"substring(trim({_B('CUST_NAME')}, ' '), 1, 18)"),
    "F04": "'0001'",
    "F05": "lv",
    "F06": trimmed("CITY"),
    "F07": trimmed("POSTAL_CODE"),
    "F08": trimmed("ADDR_STREET"),
    "F09": f"CASE WHEN {UP(_B('PAYMENT_TERMS'))} LIKE 'N0%' THEN {UP(f'trim({_B('PAYMENT_TERMS')}, chr(32))')} ELSE coalesce({_B('PAYMENT_TERMS')}, 'N030') END",
    "F10": f"replace(trim({_B('TAX_ID')}, ' '), 'DE', '')",
    "F11": f"CASE WHEN length({_B('POSTAL_CODE')}) = 5 THEN {_B('POSTAL_CODE')} END",
}
_CTE = [
    f"x0 AS (SELECT l.rn AS __rn, coalesce({trimmed('CUST_ID')}, 'ROW:' || l.rn) AS _SRC_PK, l.*, t.k AS lk, t.v AS lv FROM lookalikes l LEFT JOIN {_LOOK} t ON {fold('COUNTRY')} = t.k)",
    "x1 AS (SELECT __rn, _SRC_PK, "
    + ", ".join(f"{_B(_RAW[r.rule_id]) if r.rule_id in _RAW else 'CAST(NULL AS VARCHAR)'} AS r_{i}, {_VAL[r.rule_id]} AS v_{i}" for i, r in enumerate(FIELDS))
    + f", {trimmed('TAX_ID')} AS SRC_TAX_ID, CASE WHEN {trimmed('COUNTRY')} IS NOT NULL AND lk IS NULL THEN 'LOOKUP_FAILED: no mapping for ''' || {_SHOWN(trimmed('COUNTRY'))} || '''' END AS l_4 FROM x0)",
]


def _typed(i, t):
    v = f"v_{i}"
    if t.kind == "string":
        return f"CASE WHEN NOT regexp_matches({v}, '{_CONTROL}') AND length({v}) <= {t.length} THEN {v} END"
    if t.kind == "numc":
        return f"CASE WHEN regexp_full_match({v}, '[0-9]+') AND length({v}) <= {t.length} THEN {v} END"
    return f"CASE WHEN regexp_full_match(trim({v}, ' '), '[-+]?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]{{1,2}})?') THEN try_cast(trim({v}, ' ') AS BIGINT) END"


def _error(i, t):
    v, label = f"v_{i}", f"{t.table}.{t.column}"
    failed = f"'CONVERSION_FAILED: ''' || {_SHOWN(v)} || ''' is no {t.type}'"
    long = f"WHEN length({v}) > {t.length} THEN 'LENGTH_EXCEEDED: value has ' || length({v}) || ' chars, {t.type}({t.length}) allows {t.length}'" if t.length else ""
    if t.kind == "string":
        conv = f"CASE WHEN regexp_matches({v}, '{_CONTROL}') THEN 'CONVERSION_FAILED: control character in ''' || {_SHOWN(v)} || '''' {long} END"
    elif t.kind == "numc":
        conv = f"CASE WHEN NOT regexp_full_match({v}, '[0-9]+') THEN {failed} {long} END"
    else:
        conv = f"CASE WHEN {v} IS NOT NULL AND t_{i} IS NULL THEN {failed} END"
    parts = ["l_4"] if i == 4 else []
    parts.append(conv)
    if t.mandatory:
        parts.append(f"CASE WHEN t_{i} IS NULL THEN 'MANDATORY_EMPTY: {label} is mandatory' END")
    return f"coalesce({', '.join(parts)}, NULL)"


_CTE += [
    "x2 AS (SELECT *, " + ", ".join(f"{_typed(i, r.target)} AS t_{i}" for i, r in enumerate(FIELDS)) + " FROM x1)",
    "x3 AS (SELECT *, " + ", ".join(f"{_error(i, r.target)} AS e_{i}" for i, r in enumerate(FIELDS)) + " FROM x2)",
    "st AS (SELECT __rn, _SRC_PK, "
    + ", ".join(f"t_{i} AS {n}" for i, n in enumerate(NAMES))
    + ", SRC_TAX_ID, CASE WHEN e = '' THEN 'OK' ELSE 'FAILED' END AS _TRANSFORM_STATUS, nullif(e, '') AS _TRANSFORM_ERRORS FROM (SELECT *, concat_ws('; ', "
    + ", ".join(f"CASE WHEN e_{i} IS NOT NULL THEN '{r.target.table}.{r.target.column}: ' || e_{i} END" for i, r in enumerate(FIELDS))
    + ") AS e FROM x3))",
]
_WITH = "WITH " + ",\n".join(_CTE)
_LINEAGE = " UNION ALL ".join(
    f"SELECT _SRC_PK, '{r.target.table}.{r.target.column}' AS target, '{r.rule_id}' AS rule_id, r_{i} AS raw_value, CAST(t_{i} AS VARCHAR) AS transformed_value, e_{i} AS error, e_{i} IS NULL AS loaded FROM x3"
    for i, r in enumerate(FIELDS)
)


def _kind(r):
    t = r.target
    tag = lambda x: f"coalesce(contains('; ' || _TRANSFORM_ERRORS, '; {t.table}.{t.column}: {x}'), false)"
    v = f"CAST({t.name} AS VARCHAR)"
    out = f"CASE WHEN {tag('LOOKUP_FAILED')} THEN 'LOOKUP_FAILED' WHEN {tag('LENGTH_EXCEEDED')} THEN 'LENGTH' WHEN {tag('CONVERSION_FAILED')} THEN 'CONVERSION'"
    if t.mandatory:
        out += f" WHEN {trimmed(v)} IS NULL THEN 'MANDATORY'"
    if t.check_values:
        out += f" WHEN {trimmed(v)} IS NOT NULL AND {v} NOT IN ({', '.join(lit(x) for x in t.check_values)}) THEN 'CHECKTABLE'"
    return out + " END"


_FAILS = lambda where: " UNION ALL ".join(f"SELECT __rn, _SRC_PK, '{r.target.name}' AS target, k AS kind FROM (SELECT *, {_kind(r)} AS k FROM st {where}) WHERE k IS NOT NULL" for r in FIELDS)
_ANY = "(" + " OR ".join(f"({_kind(r)}) IS NOT NULL" for r in FIELDS) + ")"
_SEV = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in validate.KINDS.items()) + " END"
_SHORT = "CASE target " + " ".join(f"WHEN '{r.target.name}' THEN '{r.target.column}'" for r in FIELDS) + " END"
_NEEDS = f"SELECT * FROM ({_FAILS('')}) WHERE kind IN ('MANDATORY', 'LOOKUP_FAILED')"
_PATCH = f"""(SELECT __rn AS row_ref, CASE WHEN __rn % 11 = 0 THEN 'somebody' ELSE _SRC_PK END AS pk, target,
  nullif(CASE WHEN __rn % 7 = 0 THEN 'QX' WHEN __rn % 5 = 0 THEN '' WHEN target = 'ADRC_COUNTRY' THEN 'DE' ELSE 'Neustadt' END, '') AS value FROM ({_NEEDS}))"""
_WHY = f"""CASE WHEN value IS NULL THEN NULL WHEN pk <> _SRC_PK THEN 'OTHER_KEY' WHEN target = 'ADRC_COUNTRY' AND value NOT IN ({', '.join(lit(x) for x in CODES)}) THEN 'CHECKTABLE' END"""
_JUDGED = f"SELECT row_ref, pk, target, value, CASE WHEN value IS NULL THEN 'IGNORED' WHEN why IS NOT NULL THEN 'REJECTED' ELSE 'APPLIED' END AS outcome, why FROM (SELECT p.*, {_WHY} AS why FROM {_PATCH} p JOIN (SELECT __rn, _SRC_PK FROM st) s ON s.__rn = p.row_ref)"
_CUR = "(SELECT c_custkey, c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer)"
_BASE = f"(SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 30 = 0 THEN 'OLD' ELSE c_mktsegment END AS c_mktsegment FROM {_CUR} WHERE c_custkey % 50 <> 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {_CUR} WHERE c_custkey % 70 = 0)"
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in POPULATION)
_KINDS = f"SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'NEW' WHEN a.c_custkey IS NULL THEN 'REMOVED' WHEN {_SAME} THEN 'UNCHANGED' ELSE 'CHANGED' END AS kind FROM {_CUR} a FULL JOIN {_BASE} b ON a.c_custkey = b.c_custkey"
_PRINT = lambda src: " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, CAST(sum(('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || chr(31) || '{c}' || chr(31) || coalesce(CAST({c} AS VARCHAR), '')), 1, 15))::BIGINT::HUGEINT) AS VARCHAR) AS total FROM {src}" for c in POPULATION
)
_TOUCHED = f"(SELECT c_custkey FROM ({_KINDS}) WHERE kind <> 'UNCHANGED')"
_COLS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
_KEYV = {
    "tax": "CASE WHEN length(v) >= 5 AND v <> repeat(left(v, 1), length(v)) AND v NOT IN ('NONE', 'NULL', 'NA', 'NOTAPPLICABLE', 'UNKNOWN', 'TBD', 'PENDING', 'APPLIEDFOR', 'TEST', 'DUMMY') THEN v END FROM (SELECT rn, upper(regexp_replace(TAX_ID, '[^A-Za-z0-9]', '', 'g')) AS v FROM lookalikes)",
    "phone": "CASE WHEN length(v) >= 6 AND v <> repeat(left(v, 1), length(v)) THEN v END FROM (SELECT rn, regexp_replace(PHONE, '[^0-9]', '', 'g') AS v FROM lookalikes)",
    "email": r"CASE WHEN regexp_full_match(v, '[^@\s]+@[^@\s]+\.[a-z]{2,}') THEN v END FROM (SELECT rn, lower(trim(EMAIL, ' ')) AS v FROM lookalikes)",
}
_KC = "kc AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT rn AS id, '{k}' AS key_name, {e.replace(' END FROM', ' END AS value FROM', 1)}" for k, e in _KEYV.items()) + ") WHERE value IS NOT NULL)"
_KG = "kg AS (SELECT key_name, value, min(id) AS f, count(*) AS n FROM kc GROUP BY 1, 2)"
_EDGES = "ed AS (SELECT f AS a, id AS b, 'EXACT:' || key_name AS reason FROM kc JOIN kg USING (key_name, value) WHERE n BETWEEN 2 AND 25 AND id <> f)"
_VETO = "ve AS (SELECT ed.* FROM ed LEFT JOIN (SELECT id, value FROM kc WHERE key_name = 'tax') x ON x.id = a LEFT JOIN (SELECT id, value FROM kc WHERE key_name = 'tax') y ON y.id = b WHERE reason = 'EXACT:tax' OR x.value IS NULL OR y.value IS NULL OR x.value = y.value)"
_DW = f"WITH RECURSIVE {_KC}, {_KG}, {_EDGES}, {_VETO}"
_COMP = "sy AS (SELECT a, b FROM ve UNION SELECT b, a FROM ve), wk(id, r) AS (SELECT DISTINCT a, a FROM sy UNION SELECT sy.b, wk.r FROM wk JOIN sy ON sy.a = wk.id), co AS (SELECT id, min(r) AS root FROM wk GROUP BY 1)"
_FOLDG = lambda c: f"strip_accents(replace(replace(replace(replace({UP(c)}, 'Ä', 'AE'), 'Ö', 'OE'), 'Ü', 'UE'), 'ẞ', 'SS'))"
from tidewright.functions.text import ADDRESS_WORDS, LEGAL_SUFFIXES  # noqa: E402

_BASEN = f"trim(regexp_replace(regexp_replace(regexp_replace({_FOLDG('CUST_NAME')}, '\\.', '', 'g'), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
_BAREN = f"trim(regexp_replace(regexp_replace(bn, '\\b({'|'.join(LEGAL_SUFFIXES)})\\b', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
_NN = f"(SELECT *, CASE WHEN bare = '' THEN bn ELSE bare END AS nn FROM (SELECT *, {_BAREN} AS bare FROM (SELECT *, {_BASEN} AS bn FROM lookalikes)))"
_NA = f"regexp_replace({_FOLDG('concat_ws(chr(32), ' + ', '.join(f'coalesce({c}, chr(0))' for c in ADDRESS).replace('chr(0)', repr('')) + ')')}, '[^\\p{{L}}\\p{{N}} ]', ' ', 'g')"
for _w, _s in ADDRESS_WORDS.items():
    _NA = f"regexp_replace({_NA}, '\\b{_w}\\b', '{_s}', 'g')"
_NA = f"trim(regexp_replace({_NA}, '\\s+', ' ', 'g'), ' ')"
_FORMS = f"fo AS (SELECT rn AS id, nn, na, string_split(na, ' ') AS w FROM (SELECT *, {_NA} AS na FROM {_NN}) WHERE nn <> '')"
_BLOCKS = """bk AS (SELECT * FROM (SELECT id, nn, 1 AS pass, left(array_to_string(list_sort(string_split(nn, ' ')), ''), 3) AS block FROM fo
  UNION ALL SELECT id, nn, 2, CASE WHEN length(na) >= 6 THEN left(na, 6) END FROM fo
  UNION ALL SELECT id, nn, 3, CASE WHEN len(d) >= 2 OR len([x FOR x IN d IF length(x) >= 4]) > 0 THEN array_to_string(list_sort(d), '-') END FROM (SELECT *, [x FOR x IN w IF regexp_full_match(x, '\\d+')] AS d FROM fo)) WHERE block <> '')"""
_CAND = """sz AS (SELECT *, count(*) OVER (PARTITION BY pass, block) AS n, row_number() OVER (PARTITION BY pass, block ORDER BY nn, id) AS rk FROM bk),
pa AS (SELECT x.id AS a, y.id AS b, x.pass FROM sz x JOIN sz y ON x.pass = y.pass AND x.block = y.block AND x.id < y.id WHERE x.n BETWEEN 2 AND 200
  UNION ALL SELECT least(x.id, y.id), greatest(x.id, y.id), x.pass FROM sz x JOIN sz y ON x.pass = y.pass AND x.block = y.block AND y.rk > x.rk AND y.rk <= x.rk + 50 WHERE x.n > 200)"""
_COMPLETE = " + ".join(f"(CASE WHEN {trimmed(c)} IS NULL THEN 0 ELSE 1 END)" for c in SOURCE)
_GOLD = f"""gr AS (SELECT co.root, l.*, {_COMPLETE} AS sc0, {_COMPLETE} - CASE WHEN rn % 13 = 0 THEN 100000 ELSE 0 END AS sc FROM co JOIN lookalikes l ON l.rn = co.id),
gm AS (SELECT root, min(rn) AS first, count(*) AS n FROM gr GROUP BY 1 HAVING count(*) > 1),
gb AS (SELECT root, CUST_ID AS master_pk, rn AS master_rn FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY sc DESC, CUST_ID, rn) AS rk FROM gr) WHERE rk = 1),
gd AS (SELECT gr.rn AS id, CAST(dense_rank() OVER (ORDER BY gm.first) AS BIGINT) AS cluster_no, gb.master_pk, gr.rn <> gb.master_rn AS is_child FROM gr JOIN gm USING (root) JOIN gb USING (root))"""
_SURV = " UNION ALL ".join(
    f"""SELECT m.master_pk AS pk, '{c}' AS column_name, x.v AS value, x.CUST_ID AS source_pk FROM (SELECT DISTINCT cluster_no, master_pk FROM gd) m
  JOIN (SELECT cluster_no, {trimmed(c)} AS v, CUST_ID, row_number() OVER (PARTITION BY cluster_no ORDER BY CASE WHEN l.rn % 13 = 0 THEN 1 ELSE 0 END, {_COMPLETE} DESC, CUST_ID, {trimmed(c)}) AS rk FROM gd JOIN lookalikes l ON l.rn = gd.id WHERE is_child AND {trimmed(c)} IS NOT NULL) x ON x.cluster_no = m.cluster_no AND x.rk = 1
  WHERE EXISTS (SELECT 1 FROM gd JOIN lookalikes l ON l.rn = gd.id WHERE gd.cluster_no = m.cluster_no AND NOT is_child AND {trimmed(c)} IS NULL)"""
    for c in ("EMAIL", "PHONE", "CITY", "POSTAL_CODE")
)
_PAD = "CASE WHEN regexp_full_match(trim(CUST_ID, ' '), '[0-9]+') AND length(trim(CUST_ID, ' ')) < 10 THEN lpad(trim(CUST_ID, ' '), 10, '0') ELSE trim(CUST_ID, ' ') END"
_ASM = f"""(SELECT *, {_PAD} AS record_key, CASE rn % 5 WHEN 0 THEN 'FLCU00,FLCU01' WHEN 1 THEN 'FLVN00' WHEN 2 THEN 'FLCU00' WHEN 3 THEN '' ELSE 'FLCU01' END AS roles,
  concat_ws(',', CASE WHEN {trimmed('CUST_ID')} IS NULL THEN 'NO_KEY' END, CASE WHEN rn % 5 = 3 THEN 'NO_ROLE' END) AS issues,
  concat_ws(',', CASE WHEN {trimmed('CITY')} IS NULL AND ({trimmed('POSTAL_CODE')} IS NOT NULL OR {trimmed('ADDR_STREET')} IS NOT NULL) THEN 'address_INCOMPLETE' END,
    CASE WHEN {trimmed('TAX_ID')} IS NULL AND {trimmed('COUNTRY')} IS NOT NULL THEN 'tax_INCOMPLETE' END, CASE WHEN rn % 5 = 2 THEN 'UNKNOWN_ROLE' END) AS warnings FROM lookalikes)"""
_COUNTS = f"""{_WITH.replace('FROM lookalikes l', f"FROM (SELECT * FROM lookalikes WHERE coalesce(({{EX}}) IS NULL, true)) l")},
vc AS (SELECT count(*) FILTER (WHERE __rn % 9 <> 0) AS evaluated, count(*) FILTER (WHERE __rn % 9 <> 0 AND NOT {_ANY}) AS loaded, count(*) FILTER (WHERE __rn % 9 <> 0 AND {_ANY}) AS rejected, count(*) FILTER (WHERE __rn % 9 = 0) AS duplicates FROM st),
cc AS (SELECT (SELECT count(*) FROM lookalikes) AS extracted, (SELECT count(*) FROM lookalikes) - evaluated - duplicates AS excluded, duplicates, rejected, loaded, 0::BIGINT AS load_failed, 0::BIGINT AS not_attempted FROM vc)"""
from tidewright.queries.assess import _TAG  # noqa: E402

_COUNTS = _COUNTS.replace("{EX}", _TAG)
_STEPS = ["excluded", "duplicates", "rejected", "not_attempted", "load_failed"]
SQL = {
    "transform_staging": f"{_WITH} SELECT * REPLACE (CAST(KNA1_SCORE AS VARCHAR) AS KNA1_SCORE) FROM st",
    "transform_errors": f"{_WITH} SELECT __rn, _SRC_PK, _TRANSFORM_ERRORS FROM st WHERE _TRANSFORM_STATUS = 'FAILED'",
    "transform_rule_summary": f"{_WITH} " + " UNION ALL ".join(f"SELECT '{n}' AS target, count(*) AS n_rows, count(t_{i}) AS filled, count(e_{i}) AS errors FROM x3" for i, n in enumerate(NAMES)),
    "lineage_all": f"{_WITH} {_LINEAGE}",
    "lineage_exceptions": f"{_WITH} SELECT * FROM ({_LINEAGE}) WHERE error IS NOT NULL OR raw_value IS DISTINCT FROM transformed_value",
    "validate_kinds": f"{_WITH} {_FAILS('WHERE __rn % 9 <> 0')}",
    "validate_breakdown": f"{_WITH}, f AS ({_FAILS('WHERE __rn % 9 <> 0')}), g AS (SELECT *, row_number() OVER (PARTITION BY target, kind ORDER BY __rn) AS rk FROM f) SELECT 'ERR_' || kind || '_' || {_SHORT} AS signature, target, kind, {_SEV} AS severity, count(*) AS n, string_agg(_SRC_PK, ',' ORDER BY rk) FILTER (WHERE rk <= 5) AS sample_keys FROM g GROUP BY ALL",
    "validate_split": f"{_WITH} SELECT CASE WHEN __rn % 9 = 0 THEN 'duplicates' WHEN {_ANY} THEN 'rejected' ELSE 'valid' END AS part, __rn, _SRC_PK FROM st",
    "validate_score": f"{_WITH} SELECT evaluated, evaluated - rejected AS valid, rejected, duplicates, round(100 * (evaluated - rejected) / evaluated, 2) AS score FROM (SELECT count(*) FILTER (WHERE __rn % 9 <> 0) AS evaluated, count(*) FILTER (WHERE __rn % 9 <> 0 AND {_ANY}) AS rejected, count(*) FILTER (WHERE __rn % 9 = 0) AS duplicates FROM st)",
    "construct_needs": f"{_WITH} {_NEEDS}",
    "construct_judged": f"{_WITH} {_JUDGED}",
    "construct_lineage": f"{_WITH} SELECT j.pk AS _SRC_PK, j.target, CASE WHEN j.target = 'ADRC_COUNTRY' THEN s.ADRC_COUNTRY WHEN j.target = 'ADRC_CITY1' THEN s.ADRC_CITY1 ELSE s.BUT000_NAME_ORG1 END AS old_value, j.value AS new_value FROM ({_JUDGED}) j JOIN st s ON s.__rn = j.row_ref WHERE outcome = 'APPLIED'",
    "construct_apply": f"""{_WITH}, ap AS (SELECT row_ref, max(value) FILTER (WHERE target = 'ADRC_COUNTRY') AS co, max(value) FILTER (WHERE target = 'ADRC_CITY1') AS ci, max(value) FILTER (WHERE target = 'BUT000_NAME_ORG1') AS na FROM ({_JUDGED}) WHERE outcome = 'APPLIED' GROUP BY 1),
  er AS (SELECT s.__rn, coalesce(co, ADRC_COUNTRY) AS ADRC_COUNTRY, coalesce(ci, ADRC_CITY1) AS ADRC_CITY1, nullif(array_to_string([e FOR e IN string_split(coalesce(_TRANSFORM_ERRORS, ''), '; ')
    IF NOT (co IS NOT NULL AND starts_with(e, 'ADRC.COUNTRY: ')) AND NOT (ci IS NOT NULL AND starts_with(e, 'ADRC.CITY1: ')) AND NOT (na IS NOT NULL AND starts_with(e, 'BUT000.NAME_ORG1: ')) AND e <> ''], '; '), '') AS e FROM st s LEFT JOIN ap ON ap.row_ref = s.__rn)
  SELECT __rn, ADRC_COUNTRY, ADRC_CITY1, CASE WHEN e IS NULL THEN 'OK' ELSE 'FAILED' END AS _TRANSFORM_STATUS, e AS _TRANSFORM_ERRORS FROM er""",
    "recon_load_facts": f"{_WITH}, p AS (SELECT _SRC_PK, count(*) AS n, count(*) FILTER (WHERE NOT loaded) AS bad FROM ({_LINEAGE}) GROUP BY 1) SELECT count(*) AS records, count(*) FILTER (WHERE bad > 0) AS failed_records, count(*) FILTER (WHERE bad = 0) AS loaded_records, CAST(sum(n) AS BIGINT) AS cells, CAST(sum(bad) AS BIGINT) AS failed_cells FROM p",
    "recon_error_histogram": f"{_WITH} SELECT string_split(error, ':')[1] AS kind, target, count(*) AS n FROM ({_LINEAGE}) WHERE error IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, kind, target LIMIT 10",
    "recon_lineage_sample": f"""{_WITH}, li AS ({_LINEAGE}), ke AS (SELECT DISTINCT _SRC_PK FROM li ORDER BY md5(_SRC_PK), _SRC_PK LIMIT 20)
  SELECT _SRC_PK, count(*) AS cells, count(DISTINCT target) AS targets, bool_and(loaded) AS all_loaded, count(*) FILTER (WHERE rule_id NOT IN ('F01','F02','F03','F04','F05','F06','F07','F08','F09')) AS foreign_rules, max(error) AS max_error, count(*) = {len(FIELDS)} AND count(DISTINCT target) = {len(FIELDS)} AS complete FROM li WHERE _SRC_PK IN (FROM ke) GROUP BY 1""",
    "recon_accounting": f"{_COUNTS} SELECT *, excluded + duplicates + rejected + loaded AS accounted, extracted - (excluded + duplicates + rejected + loaded) AS variance, extracted = excluded + duplicates + rejected + loaded AS balanced FROM cc",
    "recon_drop_off": f"{_COUNTS} SELECT 0 AS step_no, 'extracted' AS step, 0::BIGINT AS lost, extracted AS remaining, 100.0::DOUBLE AS remaining_share FROM cc "
    + " ".join(f"UNION ALL SELECT {i}, '{s}', {s}, extracted - ({' + '.join(_STEPS[:i])}), round(100 * (extracted - ({' + '.join(_STEPS[:i])})) / extracted, 2) FROM cc" for i, s in enumerate(_STEPS, 1)),
    "recon_checks": f"{_COUNTS} SELECT unnest(['accounting_identity', 'no_negative_count', 'something_loaded', 'no_load_failures', 'everything_attempted']) AS check_name, unnest([extracted = excluded + duplicates + rejected + loaded, least(excluded, duplicates, rejected, loaded) >= 0, loaded > 0, load_failed = 0, not_attempted = 0]) AS passed FROM cc",
    "delta_kinds": _KINDS,
    "delta_payload": f"SELECT c.*, k.kind AS _DELTA_KIND FROM {_CUR} c JOIN ({_KINDS}) k USING (c_custkey) WHERE kind IN ('NEW', 'CHANGED')",
    "delta_removed_why": f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NOW_DUPLICATE' WHEN c_custkey % 4 = 0 THEN 'NOW_REJECTED' ELSE 'NOT_IN_CURRENT_VALID' END AS _WHY FROM ({_KINDS}) WHERE kind = 'REMOVED'",
    "fingerprint_table": _PRINT(_CUR),
    "fingerprint_diff": "SELECT 'c_mktsegment' AS column_name",
    "merge_apply": f"SELECT {_COLS}, 'r1' AS run_id FROM {_BASE} WHERE c_custkey NOT IN {_TOUCHED} UNION ALL SELECT {_COLS}, 'r2' FROM {_CUR} JOIN ({_KINDS}) USING (c_custkey) WHERE kind IN ('NEW', 'CHANGED')",
    "merge_before_image": f"SELECT {_COLS}, 'r1' AS run_id FROM {_BASE} WHERE c_custkey IN {_TOUCHED}",
    "merge_rollback": f"SELECT {_COLS}, 'r1' AS run_id FROM {_BASE}",
    "merge_counts": f"SELECT count(*) FILTER (WHERE kind <> 'NEW') AS before, count(*) FILTER (WHERE kind = 'NEW') AS inserted, count(*) FILTER (WHERE kind = 'CHANGED') AS replaced, count(*) FILTER (WHERE kind = 'REMOVED') AS deleted, count(*) FILTER (WHERE kind <> 'REMOVED') AS after, true AS balanced FROM ({_KINDS})",
    "dedup_exact_edges": f"{_DW} SELECT * FROM ed",
    "dedup_ignored_keys": f"{_DW} SELECT key_name, count(*) AS groups, CAST(sum(n) AS BIGINT) AS records FROM kg WHERE n > 25 GROUP BY 1",
    "dedup_veto": f"{_DW} SELECT * FROM ve",
    "dedup_name_norm": f"SELECT rn, nn FROM {_NN}",
    "dedup_address_norm": f"SELECT rn, {_NA} AS na FROM lookalikes",
    "dedup_blocks": f"WITH {_FORMS}, {_BLOCKS} SELECT CAST(pass AS INTEGER) AS pass, block, count(*) AS n FROM bk GROUP BY 1, 2",
    "dedup_candidates": f"WITH {_FORMS}, {_BLOCKS}, {_CAND} SELECT CAST(pass AS INTEGER) AS pass, count(*) AS pairs FROM (SELECT a, b, min(pass) AS pass FROM pa GROUP BY 1, 2) GROUP BY 1",
    "dedup_components": f"{_DW}, {_COMP} SELECT * FROM co",
    "dedup_conflicting_groups": f"{_DW}, {_COMP} SELECT root, count(DISTINCT value) AS codes FROM co JOIN kc USING (id) WHERE key_name = 'tax' GROUP BY 1 HAVING count(DISTINCT value) > 1",
    "dedup_golden": f"{_DW}, {_COMP}, {_GOLD} SELECT * FROM gd",
    "dedup_survivorship": f"{_DW}, {_COMP}, {_GOLD} {_SURV}",
    "assemble_records": f"SELECT record_key, {trimmed('CUST_NAME')} AS name, {trimmed('CITY')} AS city, {trimmed('TAX_ID')} AS tax_id, roles, issues, warnings FROM {_ASM}",
    "assemble_roles_explode": f"SELECT role, count(*) AS n FROM (SELECT unnest(string_split(roles, ',')) AS role FROM {_ASM} WHERE issues = '') GROUP BY 1",
    "sheet_checks": f"""WITH h AS (SELECT record_key, count(*) AS n FROM {_ASM} WHERE issues = '' GROUP BY 1)
  SELECT 'header' AS sheet, 'empty_key' AS check_name, 0::BIGINT AS n UNION ALL SELECT 'header', 'repeated_key', (SELECT count(*) FROM h WHERE n > 1) UNION ALL SELECT 'roles', 'no_role', 0
  UNION ALL SELECT unnest(['roles', 'address', 'mail', 'tax']), 'no_header', 0""",
    "simulate_load": f"""WITH o AS (SELECT record_key, min(roles) AS roles FROM {_ASM} GROUP BY 1)
  SELECT record_key, roles <> '' AS accepted, CASE WHEN roles <> '' THEN '' ELSE 'RECORD_INCOMPLETE,ROLE_MISSING' END AS messages, CASE WHEN roles <> '' THEN row_number() OVER (PARTITION BY roles <> '' ORDER BY record_key) ELSE 0 END AS number FROM o""",
    "key_statistics": """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE trim(k, ' ') = ''), 0) AS BIGINT) AS empty, CAST(coalesce(sum(n) FILTER (WHERE strlen(replace(k, '/', '%2F')) > 1500), 0) AS BIGINT) AS too_long,
  CAST(coalesce(sum(n) FILTER (WHERE contains(k, '/')), 0) AS BIGINT) AS with_slash, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT coalesce(TAX_ID || '/' || COUNTRY, '') AS k, count(*) AS n FROM lookalikes GROUP BY 1)""",
}
