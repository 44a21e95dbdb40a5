"""Queries p1_ (changes between full snapshots) and p6_ (column profile and drift)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import drift, snapshot_diff
from tidewright.queries import read

TARGET_FIELDS = [
    "BUT000_BP_EXT", "BUT000_NAME_ORG1", "BUT000_BU_SORT1", "BUT000_BU_GROUP", "BUT000_TYPE", "ADRC_COUNTRY",
    "ADRC_CITY1", "ADRC_POST_CODE1", "ADRC_STREET", "KNB1_KUNNR", "KNB1_BUKRS", "KNB1_ZTERM",
]
PROFILED = ["CUST_ID", "CUST_NAME", "TAX_ID", "EMAIL", "PHONE", "ADDR_STREET", "CITY", "COUNTRY", "POSTAL_CODE", "PAYMENT_TERMS"]
WATCHED = ["POSTAL_CODE", "CITY", "TAX_ID"]
#: Fixed patterns of the task, for whole values.
PATTERNS = {
    "POSTAL_CODE": "(?=.{4,10}\\z)[0-9A-Z]+([ -][0-9A-Z]+)?",
    "CITY": "[^0-9@#?*_/]{2,}",
    "TAX_ID": "[A-Z]{2}[0-9A-Z]{8,12}",
}


def _changes(spark, sf):
    return snapshot_diff.snapshot_changes(read(spark, sf, "valid"), "snapshot_no", "_SRC_PK", "delivered_at", TARGET_FIELDS)


def p1_found(spark, sf):
    return _changes(spark, sf).select(F.col("snapshot_no").cast("int"), F.col("_SRC_PK").alias("src_pk"), "change")


def p1_changed_fields(spark, sf):
    """How many records changed in each field, per snapshot."""
    return (
        _changes(spark, sf)
        .select("snapshot_no", F.explode("changed_fields").alias("field_name"))
        .groupBy("snapshot_no", "field_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def p6_found(spark, sf):
    shapes = drift.shape_counts(read(spark, sf, "lookalikes"), "load_no", WATCHED, PATTERNS)
    return drift.drift_findings(drift.load_drift(shapes)).select(F.col("load").cast("int").alias("load_no"), "column_name", "finding")


def p6_profile(spark, sf):
    shapes = drift.shape_counts(read(spark, sf, "lookalikes"), "load_no", PROFILED, PATTERNS)
    return drift.load_profile(shapes).withColumnRenamed("load", "load_no")


def p6_drift(spark, sf):
    shapes = drift.shape_counts(read(spark, sf, "lookalikes"), "load_no", WATCHED, PATTERNS)
    tv = (F.col("moved") / 2 / (F.col("n_rows").cast("double") * F.col("prev_n_rows"))).cast("double")
    return drift.load_drift(shapes).select(
        F.col("load").alias("load_no"), "column_name", F.round(tv, 4).alias("distance"), F.round("psi", 4).alias("psi"), F.round("chi2", 1).alias("chi2")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_changed_fields, p6_found, p6_profile, p6_drift)}

_ROWS = f"""
snap AS (SELECT n, lead(n) OVER (ORDER BY n) AS nx FROM (SELECT DISTINCT snapshot_no AS n FROM valid WHERE snapshot_no IS NOT NULL)),
r AS (SELECT * EXCLUDE (rk) FROM (
    SELECT snapshot_no AS n, trim(_SRC_PK, ' ') AS k, {", ".join(f"nullif(trim({f}, ' '), '') AS {f}" for f in TARGET_FIELDS)},
      row_number() OVER (PARTITION BY snapshot_no, trim(_SRC_PK, ' ') ORDER BY delivered_at DESC NULLS LAST,
        {", ".join(f"nullif(trim({f}, ' '), '') DESC NULLS LAST" for f in TARGET_FIELDS)}) AS rk
    FROM valid WHERE trim(_SRC_PK, ' ') <> '' AND snapshot_no IS NOT NULL) WHERE rk = 1)
"""
_SAME = " AND ".join(f"a.{f} IS NOT DISTINCT FROM b.{f}" for f in TARGET_FIELDS)
SQL = {
    "p1_found": f"""
WITH {_ROWS}
SELECT CAST(s.nx AS INTEGER) AS snapshot_no, a.k AS src_pk, CASE WHEN b.k IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change
FROM r a JOIN snap s ON a.n = s.n AND s.nx IS NOT NULL LEFT JOIN r b ON b.n = s.nx AND b.k = a.k
WHERE b.k IS NULL OR NOT ({_SAME})
UNION ALL
SELECT CAST(s.nx AS INTEGER), b.k, 'ADDED' FROM r b JOIN snap s ON b.n = s.nx LEFT JOIN r a ON a.n = s.n AND a.k = b.k WHERE a.k IS NULL
""",
    "p1_changed_fields": f"WITH {_ROWS} "
    + " UNION ALL ".join(
        f"SELECT s.nx AS snapshot_no, '{f}' AS field_name, count(*) AS n FROM r a JOIN snap s ON a.n = s.n JOIN r b ON b.n = s.nx AND b.k = a.k "
        f"WHERE a.{f} IS DISTINCT FROM b.{f} GROUP BY 1"
        for f in TARGET_FIELDS
    ),
}


def _breaks(c: str) -> str:
    if c == "POSTAL_CODE":
        return "NOT (regexp_full_match(v, '[0-9A-Z]+([ -][0-9A-Z]+)?') AND length(v) BETWEEN 4 AND 10)"
    return f"NOT regexp_full_match(v, '{PATTERNS[c]}')" if c in PATTERNS else "false"


def _profile_sql(columns: list[str]) -> str:
    cells = " UNION ALL ".join(f"SELECT load_no, '{c}' AS column_name, nullif(trim({c}, ' '), '') AS v FROM lookalikes" for c in columns)
    breaks = "CASE column_name " + " ".join(f"WHEN '{c}' THEN {_breaks(c)}" for c in columns) + " END"
    shape = "coalesce(regexp_replace(regexp_replace(regexp_replace(v, '[0-9]+', '9', 'g'), '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), '')"
    return f"""
cells AS (SELECT *, {shape} AS shape FROM ({cells})),
prof AS (SELECT load_no, column_name, count(*) AS n_rows, count(*) - count(v) AS nulls, count(DISTINCT v) AS distincts,
  CAST(min(length(v)) AS INTEGER) AS min_len, CAST(max(length(v)) AS INTEGER) AS max_len,
  count(*) FILTER (WHERE v IS NOT NULL AND {breaks}) AS violations, count(DISTINCT shape) AS shapes FROM cells GROUP BY 1, 2)
"""


_STEPS = (
    _profile_sql(WATCHED)
    + """,
st AS (SELECT * FROM (SELECT *, lag(load_no) OVER w AS pl, lag(n_rows) OVER w AS pn, lag(nulls) OVER w AS pz, lag(distincts) OVER w AS pd,
  lag(min_len) OVER w AS pmin, lag(max_len) OVER w AS pmax, lag(violations) OVER w AS pv
  FROM prof WHERE load_no IS NOT NULL WINDOW w AS (PARTITION BY column_name ORDER BY load_no)) WHERE pl IS NOT NULL),
sh AS (SELECT load_no, column_name, shape, count(*) AS n FROM cells GROUP BY 1, 2, 3),
di AS (SELECT st.column_name, st.load_no, u.shape, st.n_rows, st.pn,
    coalesce((SELECT n FROM sh a WHERE a.load_no = st.load_no AND a.column_name = st.column_name AND a.shape = u.shape), 0) AS c,
    coalesce((SELECT n FROM sh a WHERE a.load_no = st.pl AND a.column_name = st.column_name AND a.shape = u.shape), 0) AS p
  FROM st JOIN (SELECT DISTINCT column_name, shape FROM sh) u ON u.column_name = st.column_name)
"""
)
SQL |= {
    "p6_profile": f"WITH {_profile_sql(PROFILED)} SELECT * FROM prof",
    "p6_drift": f"""WITH {_STEPS}
SELECT load_no, column_name, round(sum(abs(c * pn - p * n_rows)) / 2 / (first(n_rows)::DOUBLE * first(pn)), 4) AS distance,
  round(sum((greatest(c / n_rows, 1e-6) - greatest(p / pn, 1e-6)) * ln(greatest(c / n_rows, 1e-6) / greatest(p / pn, 1e-6))), 4) AS psi,
  round(sum(power(c * sqrt(pn / n_rows) - p / sqrt(pn / n_rows), 2) / (c + p)), 1) AS chi2
FROM di WHERE c + p > 0 GROUP BY 1, 2""",
    "p6_found": f"""WITH {_STEPS}
SELECT CAST(load_no AS INTEGER) AS load_no, column_name, 'null_rate' AS finding FROM st WHERE abs(nulls * pn - pz * n_rows) * 10 > n_rows * pn
UNION ALL SELECT load_no, column_name, 'distinct' FROM st WHERE abs(distincts * pn - pd * n_rows) * 10 > n_rows * pn
UNION ALL SELECT load_no, column_name, 'range' FROM st WHERE abs(min_len - pmin) > 3 OR abs(max_len - pmax) > 3 OR (min_len IS NULL) <> (pmin IS NULL)
UNION ALL SELECT load_no, column_name, 'pattern' FROM st WHERE abs(violations * pn - pv * n_rows) * 10 > n_rows * pn
UNION ALL SELECT load_no, column_name, 'distribution' FROM di GROUP BY 1, 2 HAVING sum(abs(c * pn - p * n_rows)) * 2 > first(n_rows) * first(pn)""",
}
