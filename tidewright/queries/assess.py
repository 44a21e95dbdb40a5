"""Queries over the customer extract: profile, types, personal data, quality, combining, exclusion, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.text import luhn, shape_mask, trim_to_null
from tidewright.operators import combine, exclude, lookup, pii, profile, quality, rows
from tidewright.plans import quality_rules as qr
from tidewright.queries import read
from tidewright.queries.sql import UP, cells, fold, lit, lits, trimmed
from tidewright.session import Stage

COLUMNS = ["CUST_ID", "CUST_NAME", "TAX_ID", "EMAIL", "PHONE", "ADDR_STREET", "CITY", "COUNTRY", "POSTAL_CODE", "PAYMENT_TERMS"]
ROLES = dict(zip(COLUMNS, ["key", "name", "tax", "email", "phone", "any", "any", "country", "postal", "any"]))


def _extract(spark, sf):
    return read(spark, sf, "lookalikes").select("rn", "load_no", *COLUMNS)


def _counts(spark, sf):
    return profile.value_counts(_extract(spark, sf), COLUMNS)


def profile_columns(spark, sf):
    return profile.profile_columns(_counts(spark, sf))


def profile_top_values(spark, sf):
    return profile.top_values(_counts(spark, sf))


def profile_samples(spark, sf):
    return profile.sample_values(_counts(spark, sf))


def profile_pattern_conformity(spark, sf):
    return profile.pattern_conformity(_counts(spark, sf))


def profile_health(spark, sf):
    counts = _counts(spark, sf)
    return profile.health(profile.profile_columns(counts), profile.pattern_conformity(counts))


def profile_full_row_duplicates(spark, sf):
    return profile.full_row_duplicates(_extract(spark, sf).select(*COLUMNS))


def profile_key_duplicates(spark, sf):
    return profile.key_duplicates(_extract(spark, sf), ["CUST_ID"])


def profile_candidate_keys(spark, sf):
    return profile.candidate_keys(profile.profile_columns(profile.value_counts(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))))


def key_problems(spark, sf):
    return profile.key_problems(_extract(spark, sf), ["TAX_ID", "COUNTRY"])


def _event_text(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", F.col("ts").cast("string").alias("ts"), "user_id", "event_type", F.col("value").cast("decimal(18,4)").alias("value"), "props", (F.col("event_id") % 2 == 0).alias("even"))


def infer_types(spark, sf):
    return profile.infer_types(profile.value_counts(_event_text(spark, sf)))


def shape_masks(spark, sf):
    """Shapes of the tax numbers, most frequent first, ties by shape."""
    shapes = _extract(spark, sf).select(shape_mask(trim_to_null(F.col("TAX_ID"))).alias("shape")).where("shape is not null")
    return shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


def luhn_check(spark, sf):
    number = F.lpad((F.col("c_custkey") * 7919).cast("string"), 16, "4")
    return read(spark, sf, "customer").select("c_custkey", number.alias("number"), luhn(number).alias("valid"))


def pii_value_shares(spark, sf):
    return pii.value_shares(_counts(spark, sf))


def pii_classes(spark, sf):
    return pii.classify(pii.value_shares(_counts(spark, sf)), COLUMNS)


def _results(spark, sf):
    return quality.assess(_extract(spark, sf).select(*COLUMNS), roles=ROLES)


def quality_row_rules(spark, sf):
    return quality.row_results(_extract(spark, sf), ROLES)


def quality_unique_rules(spark, sf):
    return quality.unique_results(_extract(spark, sf), ROLES)


def _dated(spark, sf):
    e = read(spark, sf, "events")
    n = F.col("event_id") % 4
    text = (
        F.when(F.col("event_id") % 43 == 0, "soon")
        .when(n == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(n == 1, F.date_format("ts", "dd.MM.yyyy"))
        .when(n == 2, F.date_format("ts", "dd/MM/yyyy"))
        .otherwise(F.date_format("ts", "MMM dd, yyyy"))
    )
    amount = F.col("value").cast("decimal(18,2)").cast("string")
    amount = F.when(F.col("event_id") % 47 == 0, "about 10").when(F.col("event_id") % 19 == 0, F.replace(amount, F.lit("."), F.lit(","))).otherwise(amount)
    return e.select(text.alias("EVENT_DATE"), amount.alias("AMOUNT"))


def quality_mixture(spark, sf):
    return quality.mixture_results(_dated(spark, sf), {"EVENT_DATE": "date", "AMOUNT": "amount"})


def quality_date_and_amount_rules(spark, sf):
    return quality.row_results(_dated(spark, sf), {"EVENT_DATE": "date", "AMOUNT": "amount"})


def quality_results(spark, sf):
    return _results(spark, sf)


def quality_scores(spark, sf):
    return quality.scores(Stage(spark, "quality").write(_results(spark, sf), "results"))


def quality_history_change(spark, sf):
    """Share of filled postal codes per load, and its change."""
    filled = F.round(100 * F.avg(trim_to_null(F.col("POSTAL_CODE")).isNotNull().cast("int")), 1)
    history = _extract(spark, sf).groupBy("load_no").agg(filled.alias("score")).withColumn("table_name", F.lit("lookalikes"))
    return quality.history_change(history, "table_name", "load_no", "score")


def _tables(spark, sf):
    return {t: read(spark, sf, t) for t in ("customer", "nation", "region", "orders")}


LEFT = combine.Spec(
    "customer", "c", (combine.Join("nation", "n", (("c.c_nationkey", "n_nationkey"),)), combine.Join("region", "r", (("n.n_regionkey", "r_regionkey"),), "inner", "exact")),
    columns=("c.c_custkey", "c.c_name", "n.n_name", "r.r_name=region"),
)
FILTERED = combine.Spec(
    "customer", "c", (combine.Join("orders", "o", (("c.c_custkey", "o_custkey"),), "inner", "trim_ci"),),
    (combine.Filter("c.c_mktsegment", "in", ("building", "AUTOMOBILE"), True), combine.Filter("o.o_orderpriority", "starts_with", ("1",)), combine.Filter("c.c_name", "regex", ("[02468]$",)), combine.Filter("o.o_orderstatus", "not_equals", ("P",))),
    ("c.c_custkey", "c.c_mktsegment", "o.o_orderkey", "o.o_orderpriority", "o.o_orderstatus"),
)
FANNED = combine.Spec("customer", "c", (combine.Join("orders", "o", (("c.c_custkey", "o_custkey"),)), combine.Join("nation", "n", (("c.c_nationkey", "n_nationkey"),))))


def combine_left(spark, sf):
    return combine.combine(LEFT, _tables(spark, sf))


def combine_filters(spark, sf):
    return combine.combine(FILTERED, _tables(spark, sf))


def combine_join_stats(spark, sf):
    return combine.join_stats(FANNED, _tables(spark, sf), "c_custkey")


def combine_fan_out(spark, sf):
    return combine.fan_out(FANNED, _tables(spark, sf), "c_custkey")


def record_search(spark, sf):
    return combine.search(_extract(spark, sf).select("rn", "CUST_NAME", "CITY"), "CUST_NAME", "contains", "papier")


RULES = [
    exclude.Exclusion("X1", "CUST_NAME", "regex", ("(^|[^a-z])(test|holz|dummy)([^a-z]|$)",), True, "test customers"),
    exclude.Exclusion("X2", "COUNTRY", "in", ("IN", "peru"), True, "countries out of scope"),
    exclude.Exclusion("X3", "PAYMENT_TERMS", "is_blank", (), True, "no terms"),
    exclude.Exclusion("X4", "CITY", "starts_with", ("Kle",), False, "town"),
]


def exclude_split(spark, sf):
    return exclude.split(_extract(spark, sf), RULES)[1].select("rn", F.col("_EXCLUDED_BY").alias("excluded_by"), F.col("_EXCLUDED_REASON").alias("reason"))


def exclude_counts(spark, sf):
    return exclude.counts(_extract(spark, sf), RULES)


def exclude_suggest(spark, sf):
    c = read(spark, sf, "lookalikes").withColumn("DEL_FLAG", F.when(F.col("rn") % 17 == 0, "X").when(F.col("rn") % 5 == 0, "")).withColumn("NOTE", F.when(F.col("rn") % 11 == 0, "Test account"))
    return exclude.suggest(c.select("DEL_FLAG", "NOTE"), ["DEL_FLAG"], ["NOTE"])


def _country_lookup(spark, sf):
    ref = read(spark, sf, "ref_values").where("domain = 'COUNTRY'")
    named = ref.select(F.explode(F.array("code", "alt_code", "name")).alias("s"), "code")
    return lookup.lookup_table(named.where("s is not null"), "s", "code")


def _codes(spark, sf):
    return [r[0] for r in read(spark, sf, "ref_values").where("domain = 'COUNTRY'").select("code").orderBy("code").limit(1000).collect()]


def _translated(mode):
    def run(spark, sf):
        return lookup.translate(_extract(spark, sf).select("rn", "COUNTRY"), "COUNTRY", _country_lookup(spark, sf), mode, "ZZ")

    return run


def lookup_status(spark, sf):
    out = lookup.resolve(_extract(spark, sf).select("COUNTRY"), "COUNTRY", _country_lookup(spark, sf), _codes(spark, sf)[:15])
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def lookup_unmatched(spark, sf):
    return lookup.unmatched(_extract(spark, sf), "COUNTRY", _country_lookup(spark, sf))


def lookup_draft_groups(spark, sf):
    return lookup.draft_groups(_extract(spark, sf), "COUNTRY", qr.country_codes(), qr.COUNTRY_NAMES)


def lookup_evidence(spark, sf):
    return lookup.evidence(_extract(spark, sf), "COUNTRY", 3, _codes(spark, sf))


def sample_by_hash(spark, sf):
    return rows.hash_sample(_extract(spark, sf).select("rn", "CUST_ID", "CUST_NAME"), "rn", 100)


def paging(spark, sf):
    return rows.page_with_totals(_extract(spark, sf).select("rn", "CUST_ID"), ["rn"], 40, 20)


QUERIES = {
    f.__name__: f
    for f in (
        profile_columns, profile_top_values, profile_samples, profile_pattern_conformity, profile_health, profile_full_row_duplicates, profile_key_duplicates, profile_candidate_keys,
        key_problems, infer_types, shape_masks, luhn_check, pii_value_shares, pii_classes, quality_row_rules, quality_unique_rules, quality_mixture,
        quality_date_and_amount_rules, quality_results, quality_scores, quality_history_change, combine_left, combine_filters, combine_join_stats, combine_fan_out, record_search,
        exclude_split, exclude_counts, exclude_suggest, lookup_status, lookup_unmatched, lookup_draft_groups, lookup_evidence, sample_by_hash, paging,
    )
}
QUERIES |= {"lookup_translate_flag": _translated("FLAG_FAILED"), "lookup_translate_pass": _translated("PASS_THROUGH"), "lookup_translate_default": _translated("USE_DEFAULT")}

# ---------------------------------------------------------------- SQL
_CELLS = cells("lookalikes", COLUMNS)
_PROFILE = f"""SELECT column_name, count(*) AS total_rows, count(*) - count(v) AS null_count, count(DISTINCT v) AS distinct_count,
  CAST(min(length(v)) AS INTEGER) AS min_length, CAST(max(length(v)) AS INTEGER) AS max_length,
  CAST(count(*) FILTER (WHERE regexp_full_match(v, '0[0-9]+')) AS BIGINT) AS leading_zero_matches,
  round((count(*) - count(v)) / count(*), 4) AS null_ratio, coalesce(round(count(DISTINCT v) / nullif(count(v), 0), 4), 0) AS distinct_ratio FROM ({_CELLS}) GROUP BY 1"""
_CONFORMITY = " UNION ALL ".join(
    f"SELECT column_name, '{n}' AS pattern, CAST(count(*) FILTER (WHERE regexp_full_match(v, {lit(p)})) AS BIGINT) AS matches, count(v) AS checked, "
    f"round(count(*) FILTER (WHERE regexp_full_match(v, {lit(p)})) / count(v), 4) AS ratio FROM ({_CELLS}) WHERE v IS NOT NULL GROUP BY 1"
    for n, p in profile.PATTERNS.items()
)
_HINTED = " OR ".join(f"(pattern = '{n}' AND regexp_matches(upper(column_name), {lit(h)}))" for n, h in profile.HINTS.items())
_CONTROL = r"[\x00-\x1f\x7f-\x9f\x{202A}-\x{202E}\x{2066}-\x{2069}]"
#: The ISO 3166 two-letter codes, by first letter.
_ISO_SHAPE = (
    "A[DEFGILMOQRSTUWXZ]|B[ABDEFGHIJLMNOQRSTVWYZ]|C[ACDFGHIKLMNORUVWXYZ]|D[EJKMOZ]|E[CEGHRST]|F[IJKMOR]|G[ABDEFGHILMNPQRSTUWY]|H[KMNRTU]|I[DELMNOQRST]|"
    "J[EMOP]|K[EGHIMNPRWYZ]|L[ABCIKRSTUVY]|M[ACDEFGHKLMNOPQRSTUVWXYZ]|N[ACEFGILOPRUZ]|OM|P[AEFGHKLMNRSTWY]|QA|R[EOSUW]|S[ABCDEGHIJKLMNORSTVXYZ]|"
    "T[CDFGHJKLMNORTVWZ]|U[AGMSYZ]|V[ACEGINU]|W[FS]|Y[ET]|Z[AMW]"
)
_IS_CODE = f"regexp_full_match({{}}, '{_ISO_SHAPE}')".format
_ISO = f"CASE WHEN {_IS_CODE('k')} THEN k " + " ".join(f"WHEN k = {lit(n)} THEN {lit(c)}" for n, c in qr.COUNTRY_NAMES.items()) + " END"


def _alnum(c):
    return f"upper(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"


def _by_country(column, shapes):
    """A table of shapes per country, looked up with the row's country."""
    pairs = ", ".join(f"({lit(code)}, {lit(shape)})" for code, shape in shapes.items())
    return f"EXISTS (SELECT 1 FROM (VALUES {pairs}) AS shapes(code, shape) WHERE code = iso AND NOT regexp_full_match({column}, shape))"


_STRP = {"yyyy-M-d": "%Y-%m-%d", "d.M.yyyy": "%d.%m.%Y", "d/M/yyyy": "%d/%m/%Y", "M/d/yyyy": "%m/%d/%Y", "yyyyMMdd": "%Y%m%d", "d-MMM-yyyy": "%d-%b-%Y", "MMM d, yyyy": "%b %d, %Y", "yyyy/M/d": "%Y/%m/%d"}


def _date(value, label):
    shape, form = qr.DATE_FORMATS[label]
    return f"CASE WHEN regexp_full_match({value}, {lit(shape)}) THEN try_strptime({value}, '{_STRP[form]}') END"


#: Of a value: v itself, t without outer blanks, up in capitals, d its digits, a its letters and digits in capitals, iso the row's country.
_FACES = "{c} AS v, trim({c}, ' ') AS t, {up} AS up, regexp_replace({c}, '[^0-9]', '', 'g') AS d, upper(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g')) AS a, {iso} AS iso"
_BROKEN = {
    "G01": "v LIKE ' %' OR v LIKE '% '",
    "G02": "length(v) > 0 AND replace(v, ' ', '') = '' OR v = ''",
    "G03": rf"regexp_matches(v, '{_CONTROL}')",
    "G04": "list_contains(string_split('n/a|na|null|none|unknown|tbd|?|??|???|-|--|---|xxx|test|dummy|not applicable|missing|undefined|nan|n.a.|tba', '|'), lower(t))",
    "G05": "length(t) >= 4 AND replace(t, t[1], '') = ''",
    "G06": r"regexp_matches(v, 'Ã.') OR contains(v, 'â€') OR regexp_matches(v, 'Â[\x{00A0}-\x{00BF}]') OR contains(v, chr(65533))",
    "G07": "regexp_matches(v, '<[A-Za-z/][^>]*>') OR regexp_matches(v, '&[A-Za-z]{2,6};') OR regexp_matches(v, '&#[0-9]+;')",
    "G08": "position('  ' IN v) > 0",
    "G09": "length(v) >= 256",
    "E01": r"NOT regexp_full_match(t, '[^@\s,;]+@[^@\s,;]+\.[A-Za-z]{2,}')",
    "E02": r"regexp_matches(v, ';|,') OR regexp_matches(v, '\sand\s') OR regexp_matches(v, '\s/\s')",
    "P01": "length(d) <= 5 OR length(d) >= 16",
    "P02": "regexp_matches(v, '[A-Za-z][A-Za-z][A-Za-z]')",
    "P03": "length(d) >= 6 AND replace(d, d[1], '') = ''",
    "T01": "length(a) IN (0, 1, 2, 3, 4)",
    "T02": _by_country("a", qr.TAX_PATTERNS),
    "Z01": _by_country("upper(t)", qr.POSTAL_PATTERNS),
    "Z02": r"NOT regexp_full_match(upper(t), '[A-Z0-9][A-Z0-9 \-]{1,9}')",
    "C01": f"NOT {_IS_CODE('up')} AND up NOT IN ({lits(sorted(qr.COUNTRY_NAMES))})",
    "C02": f"NOT {_IS_CODE('up')} AND up IN ({lits(sorted(qr.COUNTRY_NAMES))})",
    "N01": "length(t) IN (0, 1)",
    "N02": r"t <> '' AND regexp_replace(t, '[0-9 .,/\-]', '', 'g') = ''",
    "N03": "strpos(v, '@') > 0",
    "N04": "regexp_matches(' ' || lower(v) || ' ', '[^a-z](test|dummy|do not use|delete me|xxx)[^a-z]')",
    "N05": f"{UP('v')} = v AND regexp_matches(v, '[A-Z]{{4}}')",
    "D01": "coalesce(" + ", ".join(_date("t", label) for label in qr.DATE_FORMATS) + ") IS NULL",
    "D02": f"({_date('t', 'dd/mm/yyyy')}) <> ({_date('t', 'mm/dd/yyyy')})",
    "A01": "NOT (regexp_full_match(t, '[-+]?[0-9]{1,3}([., ][0-9]{3})*([.,][0-9]+)?') OR regexp_full_match(t, '[-+]?[0-9]+([.,][0-9]+)?'))",
    "K02": "replace(v, ' ', '') = ''",
}
_READS = {label: lambda c, label=label: f"({_date(f"trim({c}, ' ')", label)}) IS NOT NULL" for label in qr.DATE_FORMATS}


def _row_sql(source, roles, iso="CAST(NULL AS VARCHAR)"):
    parts = []
    for c, role in roles.items():
        faces = f"(SELECT {_FACES.format(c=c, up=fold(c), iso=iso)} FROM {source} WHERE {c} IS NOT NULL)"
        parts += [f"SELECT '{c}' AS column_name, '{r}' AS rule_id, count(*) AS checked, count_if(coalesce({_BROKEN[r]}, false))::BIGINT AS violations FROM {faces}" for r in qr.checks_of(role) if r in _BROKEN and (iso == "iso" or r not in ("T02", "Z01"))]
    return " UNION ALL ".join(parts)


_UNIQUE = {"T03": ("TAX_ID", f"nullif({_alnum('TAX_ID')}, '')"), "E03": ("EMAIL", "nullif(trim(lower(EMAIL), ' '), '')"), "K01": ("CUST_ID", "nullif(trim(CUST_ID, ' '), '')")}
_UNIQUE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{r}' AS rule_id, count(norm) AS checked, CAST(count(*) FILTER (WHERE norm IS NOT NULL AND n > 1) AS BIGINT) AS violations FROM (SELECT norm, count(*) OVER (PARTITION BY norm) AS n FROM (SELECT {e} AS norm FROM lookalikes))"
    for r, (c, e) in _UNIQUE.items()
)
_JUDGED = f"(SELECT *, {_ISO} AS iso FROM (SELECT *, nullif({fold('COUNTRY')}, '') AS k FROM lookalikes))"
_DATED = """(SELECT CASE WHEN event_id % 43 = 0 THEN 'soon' WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 4 = 1 THEN strftime(ts, '%d.%m.%Y')
  WHEN event_id % 4 = 2 THEN strftime(ts, '%d/%m/%Y') ELSE strftime(ts, '%b %d, %Y') END AS EVENT_DATE,
  CASE WHEN event_id % 47 = 0 THEN 'about 10' WHEN event_id % 19 = 0 THEN replace(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '.', ',') ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS AMOUNT FROM events)"""


def _mixture_sql(column, rule, tests):
    counts = " UNION ALL ".join(f"SELECT {i} AS i, count(*) FILTER (WHERE {t}) AS n, count(*) FILTER (WHERE NOT ({t}) AND ({' OR '.join(tests)})) AS o FROM {_DATED} WHERE {column} IS NOT NULL" for i, t in enumerate(tests))
    return f"""SELECT '{column}' AS column_name, '{rule}' AS rule_id, checked, CAST(CASE WHEN used > 1 AND o >= greatest(2, 0.01 * checked) THEN o ELSE 0 END AS BIGINT) AS violations FROM
      (SELECT o FROM ({counts}) ORDER BY n DESC, i LIMIT 1), (SELECT count(*) FILTER (WHERE n > 0) AS used FROM ({counts})), (SELECT count({column}) AS checked FROM {_DATED})"""


_META = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{d}'" for r, d in qr.DIMENSION.items()) + " END"
_SEVERITY = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in qr.SEVERITY.items()) + " END"
_ROLE = "CASE column_name " + " ".join(f"WHEN '{c}' THEN '{r}'" for c, r in ROLES.items()) + " END"
_RESULTS = f"""SELECT column_name, {_ROLE} AS role, rule_id, {_META} AS dimension, {_SEVERITY} AS severity, checked, violations,
  CASE WHEN checked > 0 THEN round(violations / checked, 4) ELSE 0 END AS rate FROM ({_row_sql(_JUDGED, ROLES, "iso")} UNION ALL {_UNIQUE_SQL})"""
_WEIGHT = "CASE WHEN checked = 0 THEN 0.0 WHEN severity = 'HIGH' THEN 3.0 WHEN severity = 'MEDIUM' THEN 2.0 ELSE 1.0 END::DOUBLE"
_SCORE = f"round(CASE WHEN sum({_WEIGHT}) > 0 THEN 100 * (1 - sum({_WEIGHT} * rate) / sum({_WEIGHT})) ELSE 100 END, 1)"
_LOOKUP = f"(SELECT {fold('s')} AS k, min(code) AS v FROM (SELECT unnest([code, alt_code, name]) AS s, code FROM ref_values WHERE domain = 'COUNTRY') WHERE s IS NOT NULL GROUP BY 1 HAVING {fold('s')} <> '')"
_VALUE = trimmed("COUNTRY")


def _translate_sql(fallback):
    other = {"FLAG_FAILED": "NULL", "PASS_THROUGH": "x", "USE_DEFAULT": "'ZZ'"}[fallback]
    error = "CASE WHEN x IS NOT NULL AND k IS NULL THEN 'LOOKUP_FAILED: no mapping for ''' || x || '''' END" if fallback == "FLAG_FAILED" else "CAST(NULL AS VARCHAR)"
    return f"SELECT rn, COUNTRY, CASE WHEN x IS NOT NULL AND k IS NULL THEN {other} ELSE v END AS translated, {error} AS lookup_error FROM (SELECT *, {_VALUE} AS x FROM lookalikes) l LEFT JOIN {_LOOKUP} t ON {fold('x')} = t.k"


_CODES15 = "(SELECT code FROM ref_values WHERE domain = 'COUNTRY' ORDER BY code LIMIT 15)"
_X = {
    "X1": "regexp_matches(CUST_NAME, '(?i)(^|[^a-z])(test|holz|dummy)([^a-z]|$)')",
    "X2": "lower(trim(COUNTRY, ' ')) IN ('in', 'peru')",
    "X3": "PAYMENT_TERMS IS NULL OR trim(PAYMENT_TERMS, ' ') = ''",
    "X4": "starts_with(trim(CITY, ' '), 'Kle')",
}
_TAG = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in _X.items()) + " END"
_EXVAL = "CASE ex WHEN 'X1' THEN CUST_NAME WHEN 'X2' THEN COUNTRY WHEN 'X3' THEN PAYMENT_TERMS ELSE CITY END"
_COMPACT = "regexp_replace(v, '[ -]', '', 'g')"
_LUHN = "list_sum([CASE WHEN d > 9 THEN d - 9 ELSE d END FOR d IN [CAST(substr({0}, i::INT, 1) AS INTEGER) * (1 + (length({0}) - i) % 2) FOR i IN range(1, length({0}) + 1)]]) % 10 = 0"
_PII = {
    "email": r"regexp_full_match(v, '[^@\s]+@[^@\s]+\.[A-Za-z]{2,}')",
    "iban": f"regexp_full_match(upper({_COMPACT}), '[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{11,30}}')",
    "card": f"CASE WHEN regexp_full_match({_COMPACT}, '\\d{{13,19}}') THEN {_LUHN.format(_COMPACT)} ELSE false END",
    "national_id": r"regexp_full_match(v, '\d{3}-\d{2}-\d{4}')",
    "phone": r"regexp_full_match(v, '\+?\d[\d \-./()]{6,18}\d') AND length(regexp_replace(v, '\D', '', 'g')) >= 7 AND regexp_matches(v, '[+ \-/(]')",
}
_SHARES = f"SELECT column_name, count(*) AS n_values, {', '.join(f'round(count(*) FILTER (WHERE {t}) / count(*), 4) AS {k}' for k, t in _PII.items())} FROM ({_CELLS}) WHERE v IS NOT NULL GROUP BY 1"
_KEYED = "SELECT trim(CUST_ID, ' ') AS k, count(*) AS n FROM lookalikes WHERE trim(CUST_ID, ' ') <> '' GROUP BY 1 HAVING count(*) > 1"
_TEXT_EVENTS = "(SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,4)) AS value, props, event_id % 2 = 0 AS even FROM events)"
_SHAPED = "translate(regexp_replace(regexp_replace(regexp_replace(v, '\\p{Lu}', chr(1), 'g'), '\\p{L}', chr(2), 'g'), '\\p{Nd}', '9', 'g'), chr(1) || chr(2), 'Aa')"
SQL = {
    "profile_columns": _PROFILE,
    "profile_top_values": f"SELECT column_name, CAST(rank AS INTEGER) AS rank, v AS value, n FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS rank FROM (SELECT column_name, v, count(*) AS n FROM ({_CELLS}) WHERE v IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 5",
    "profile_samples": f"SELECT column_name, CAST(rank AS INTEGER) AS rank, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY md5(v), v) AS rank FROM (SELECT DISTINCT column_name, v FROM ({_CELLS}) WHERE v IS NOT NULL)) WHERE rank <= 5",
    "profile_pattern_conformity": _CONFORMITY,
    "profile_health": f"""SELECT p.column_name, round(greatest(100 * (1 - null_ratio) - CASE WHEN leading_zero_matches > 0 THEN 10 ELSE 0 END - CASE WHEN distinct_count = 1 AND total_rows > 1 THEN 5 ELSE 0 END - coalesce(gap, 0), 0), 2) AS score,
  concat_ws(',', CASE WHEN null_ratio > 0.2 THEN 'HIGH_NULLS' END, CASE WHEN distinct_count = 1 AND total_rows > 1 THEN 'CONSTANT' END, CASE WHEN distinct_ratio >= 0.95 THEN 'NEAR_UNIQUE_KEY' END) AS flags
  FROM ({_PROFILE}) p LEFT JOIN (SELECT column_name, sum(20 * (1 - ratio)) AS gap FROM ({_CONFORMITY}) WHERE ({_HINTED}) AND ratio >= 0.2 AND ratio < 1 GROUP BY 1) g ON g.column_name = p.column_name""",
    "profile_full_row_duplicates": f"SELECT total_rows, distinct_rows, total_rows - distinct_rows AS duplicate_rows FROM (SELECT (SELECT count(*) FROM lookalikes) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(f'{trimmed(c)} AS {c}' for c in COLUMNS)} FROM lookalikes)) AS distinct_rows)",
    "profile_key_duplicates": f"SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows, coalesce((SELECT string_agg(k, ',' ORDER BY n DESC, k) FROM (SELECT * FROM ({_KEYED}) ORDER BY n DESC, k LIMIT 5)), '') AS sample_keys FROM ({_KEYED})",
    "profile_candidate_keys": "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(count(DISTINCT {c}) / count({c}), 4) AS distinct_ratio FROM orders HAVING count(*) = count({c}) AND round(count(DISTINCT {c}) / count({c}), 4) >= 0.95" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    + ") ORDER BY column_name LIMIT 5",
    "key_problems": f"""WITH k AS (SELECT CASE WHEN {trimmed('TAX_ID')} IS NOT NULL AND {trimmed('COUNTRY')} IS NOT NULL THEN {trimmed('TAX_ID')} || '|' || {trimmed('COUNTRY')} END AS k FROM lookalikes),
  g AS (SELECT k, count(*) AS n FROM k WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
  SELECT (SELECT count(*) FROM k) AS n_rows, (SELECT count(*) FROM k WHERE k IS NULL) AS blank_rows, (SELECT count(*) FROM g) AS repeated_keys, CAST((SELECT coalesce(sum(n), 0) FROM g) AS BIGINT) AS repeated_rows""",
    "infer_types": f"""SELECT column_name, CASE WHEN f = 0 THEN 'VARCHAR' WHEN i = f THEN 'BIGINT' WHEN i + d = f THEN 'DOUBLE' WHEN dt = f THEN 'DATE' WHEN dt + ts = f THEN 'TIMESTAMP' WHEN b = f THEN 'BOOLEAN' ELSE 'VARCHAR' END AS inferred_type
  FROM (SELECT column_name, count(v) AS f, count(*) FILTER (WHERE regexp_full_match(v, '{profile.INTEGER}')) AS i, count(*) FILTER (WHERE regexp_full_match(v, '{profile.DECIMAL}')) AS d,
    count(*) FILTER (WHERE regexp_full_match(v, '{profile.DATE}') AND try_cast(v AS DATE) IS NOT NULL) AS dt, count(*) FILTER (WHERE regexp_full_match(v, '{profile.TIME}') AND try_cast(v AS TIMESTAMP) IS NOT NULL) AS ts,
    count(*) FILTER (WHERE lower(v) IN ('true', 'false')) AS b FROM ({cells(_TEXT_EVENTS, ['event_id', 'ts', 'user_id', 'event_type', 'value', 'props', 'even'])}) GROUP BY 1)""",
    "shape_masks": f"SELECT {_SHAPED} AS shape, count(*) AS n FROM (SELECT {trimmed('TAX_ID')} AS v FROM lookalikes) WHERE v IS NOT NULL GROUP BY 1",
    "luhn_check": f"SELECT c_custkey, number, {_LUHN.format('number')} AS valid FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 16, '4') AS number FROM customer)",
    "pii_value_shares": _SHARES,
    "pii_classes": "SELECT column_name, CASE WHEN named = 'RESTRICTED_PII' OR telling THEN 'RESTRICTED_PII' ELSE named END AS classification FROM (SELECT n.*, coalesce(n_values >= 3 AND greatest(email, iban, card, national_id, phone) >= 0.6, false) AS telling FROM (VALUES "
    + ", ".join(f"('{c}', '{pii.by_name(c)}')" for c in COLUMNS)
    + f") n(column_name, named) LEFT JOIN ({_SHARES}) s ON s.column_name = n.column_name)",
    "quality_row_rules": _row_sql(_JUDGED, ROLES, "iso"),
    "quality_unique_rules": _UNIQUE_SQL,
    "quality_mixture": _mixture_sql("EVENT_DATE", "D03", [f("EVENT_DATE") for f in _READS.values()])
    + " UNION ALL "
    + _mixture_sql("AMOUNT", "A02", ["regexp_matches(trim(AMOUNT, ' '), '[0-9],[0-9]{1,2}$')", "regexp_matches(trim(AMOUNT, ' '), '[0-9]\\.[0-9]{1,2}$')"]),
    "quality_date_and_amount_rules": _row_sql(_DATED, {"EVENT_DATE": "date", "AMOUNT": "amount"}),
    "quality_results": _RESULTS,
    "quality_scores": f"""WITH r AS ({_RESULTS}), c AS (SELECT column_name, {_SCORE} AS score FROM r GROUP BY 1)
  SELECT 'column' AS level, column_name AS name, score FROM c UNION ALL SELECT 'dimension', dimension, {_SCORE} FROM r GROUP BY 2 UNION ALL SELECT 'table', 'all', round(avg(score), 1) FROM c""",
    "quality_history_change": f"""SELECT load_no, score, 'lookalikes' AS table_name, lag(score) OVER (ORDER BY load_no) AS previous_score, round(score - lag(score) OVER (ORDER BY load_no), 1) AS change
  FROM (SELECT load_no, round(100 * avg(CASE WHEN {trimmed('POSTAL_CODE')} IS NOT NULL THEN 1 ELSE 0 END), 1) AS score FROM lookalikes GROUP BY 1)""",
    "combine_left": "SELECT c_custkey, c_name, n_name, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "combine_filters": "SELECT c_custkey, c_mktsegment, o_orderkey, o_orderpriority, o_orderstatus FROM customer JOIN orders ON c_custkey = o_custkey WHERE lower(trim(c_mktsegment)) IN ('building', 'automobile') AND starts_with(trim(o_orderpriority), '1') AND regexp_matches(c_name, '[02468]$') AND coalesce(trim(o_orderstatus), '') <> 'P'",
    "combine_join_stats": """WITH o AS (SELECT c_custkey, count(o_orderkey) AS m FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1),
  n AS (SELECT c_custkey, CAST(sum(CASE WHEN n_nationkey IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS m FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
  SELECT 'o' AS join_alias, count(*) AS left_rows, count(*) FILTER (WHERE m = 0) AS unmatched, count(*) FILTER (WHERE m > 1) AS several, coalesce(max(m), 0) AS most FROM o
  UNION ALL SELECT 'n', count(*), count(*) FILTER (WHERE m = 0), count(*) FILTER (WHERE m > 1), coalesce(max(m), 0) FROM n""",
    "combine_fan_out": "SELECT (SELECT count(*) FROM customer) AS rows_before, count(*) AS rows_after, count(DISTINCT c_custkey) AS base_rows, count(*) - count(DISTINCT c_custkey) AS surplus FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "record_search": "SELECT rn, CUST_NAME, CITY FROM lookalikes WHERE contains(lower(trim(CUST_NAME, ' ')), 'papier') ORDER BY rn LIMIT 20",
    "exclude_split": f"SELECT rn, ex AS excluded_by, CASE ex WHEN 'X1' THEN 'test customers' WHEN 'X2' THEN 'countries out of scope' WHEN 'X3' THEN 'no terms' ELSE 'town' END AS reason FROM (SELECT rn, {_TAG} AS ex FROM lookalikes) WHERE ex IS NOT NULL",
    "exclude_counts": f"""WITH t AS (SELECT ex AS rule_id, {_EXVAL} AS v FROM (SELECT *, {_TAG} AS ex FROM lookalikes) WHERE ex IS NOT NULL),
  d AS (SELECT rule_id, v, row_number() OVER (PARTITION BY rule_id ORDER BY v NULLS LAST) AS rk FROM (SELECT DISTINCT rule_id, v FROM t))
  SELECT t.rule_id, count(*) AS excluded, coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM d WHERE d.rule_id = t.rule_id AND rk <= 3), '') AS examples FROM t GROUP BY 1""",
    "exclude_suggest": "SELECT 'DEL_FLAG' AS column_name, 'flag' AS kind, 'X' AS value, count(*) AS n FROM lookalikes WHERE rn % 17 = 0 UNION ALL SELECT 'NOTE', 'test_name', NULL, count(*) FROM lookalikes WHERE rn % 11 = 0",
    "lookup_translate_flag": _translate_sql("FLAG_FAILED"),
    "lookup_translate_pass": _translate_sql("PASS_THROUGH"),
    "lookup_translate_default": _translate_sql("USE_DEFAULT"),
    "lookup_status": f"SELECT CASE WHEN x IS NULL THEN 'EMPTY' WHEN k IS NOT NULL AND v IN {_CODES15} THEN 'MAPPED' WHEN k IS NOT NULL THEN 'MAPPED_INVALID' WHEN x IN {_CODES15} THEN 'ALREADY_VALID' ELSE 'UNMAPPED' END AS status, count(*) AS n FROM (SELECT {_VALUE} AS x FROM lookalikes) l LEFT JOIN {_LOOKUP} t ON {fold('x')} = t.k GROUP BY 1",
    "lookup_unmatched": f"SELECT x AS value, count(*) AS n FROM (SELECT {_VALUE} AS x FROM lookalikes) l LEFT JOIN {_LOOKUP} t ON {fold('x')} = t.k WHERE x IS NOT NULL AND t.k IS NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 8",
    "lookup_draft_groups": f"""WITH c AS (SELECT {_VALUE} AS x, count(*) AS n FROM lookalikes GROUP BY 1), g AS (SELECT {fold('x')} AS key, arg_min(x, (-n, x)) AS spelling, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS n FROM c WHERE x IS NOT NULL GROUP BY 1)
  SELECT key, spelling, spellings, n, CASE WHEN {_IS_CODE('key')} THEN key ELSE name_target END AS target, CASE WHEN {_IS_CODE('key')} THEN 'VALID_KEY' WHEN name_target IS NOT NULL THEN 'SYNONYM' ELSE 'UNKNOWN' END AS origin
  FROM (SELECT *, CASE {' '.join(f'WHEN key = {lit(k)} THEN {lit(v)}' for k, v in qr.COUNTRY_NAMES.items())} END AS name_target FROM g)""",
    "lookup_evidence": f"SELECT count(*) AS n_rows, count(x) AS filled, count(DISTINCT x) AS distincts, CAST(max(length(x)) AS INTEGER) AS longest, round(count(*) FILTER (WHERE length(x) <= 3) / nullif(count(x), 0), 4) AS fits, round(count(*) FILTER (WHERE x IN (SELECT code FROM ref_values WHERE domain = 'COUNTRY')) / nullif(count(x), 0), 4) AS in_domain FROM (SELECT {_VALUE} AS x FROM lookalikes)",
    "sample_by_hash": "SELECT rn, CUST_ID, CUST_NAME FROM lookalikes ORDER BY md5(CAST(rn AS VARCHAR)), CAST(rn AS VARCHAR) LIMIT 100",
    "paging": "SELECT rn, CUST_ID, (SELECT count(*) FROM lookalikes) AS total FROM lookalikes ORDER BY rn LIMIT 20 OFFSET 40",
}
