"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.llm import canon, components, leakage, mojibake, places, spans, survivors, tokens
from tidewright.queries import read
from tidewright.session import Stage

RUN1_FIELDS = ["NAME", "STREET", "HOUSE_NUM1", "CITY1", "POST_CODE1", "SRC_TAX", "SRC_PHONE", "SRC_EMAIL"]


PLACE = ["town", "name", "kind", "number"]


def _places(spark, sf):
    stage = Stage(spark, "p2")
    rows = read(spark, sf, "lookalikes")
    repaired = mojibake.damaged_values(rows.select("ADDR_STREET"), "ADDR_STREET", stage)
    return places.normal_addresses(rows, "CUST_ID", "ADDR_STREET", "CITY", "POSTAL_CODE", stage, repaired)


def p2_found(spark, sf):
    return places.pairs_of_places(_places(spark, sf), "CUST_ID", PLACE).toDF("cust_id_a", "cust_id_b")


def p2_places(spark, sf):
    """Every customer's place in its normal form."""
    return _places(spark, sf).withColumnRenamed("CUST_ID", "cust_id")


def p3_found(spark, sf):
    stage = Stage(spark, "p3")
    records = read(spark, sf, "deduplicated").where("run_no = 2")
    matches = components.latest_matches(read(spark, sf, "match_pairs"), "pk_a", "pk_b", "decision", "decided_at", "pair_no")
    masters = records.where("surviving_master_pk is not null").select(F.col("_SRC_PK").alias("a"), F.col("surviving_master_pk").alias("b"))
    hubs = records.where("dedup_cluster_id is not null").select(F.col("_SRC_PK").alias("k"), F.col("dedup_cluster_id").alias("hub"))
    groups = components.link_groups(records, "_SRC_PK", matches.unionByName(masters), hubs, stage)
    return groups.toDF("src_pk", "group_pk")


def _typed(spark, sf, columns):
    """(cust_id, column_name, value) of the named columns of lookalikes, without null."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])
    rows = read(spark, sf, "lookalikes").select(F.col("CUST_ID").alias("cust_id"), F.inline(cells))
    return rows.where("cust_id is not null and value is not null")


def _mapped(spark, sf):
    cells = _typed(spark, sf, ["COUNTRY", "PAYMENT_TERMS"])
    values = cells.select(F.col("column_name").alias("domain"), "value")
    mapped = canon.map_values(values, read(spark, sf, "ref_values"), Stage(spark, "p4")).withColumnRenamed("domain", "column_name")
    return cells, mapped


def p4_found(spark, sf):
    cells, mapped = _mapped(spark, sf)
    return cells.join(mapped, ["column_name", "value"]).select("cust_id", "column_name", "ref_code").distinct()


def p4_unmatched(spark, sf):
    """The values that stand for no entry, with the number of rows that have them."""
    cells, mapped = _mapped(spark, sf)
    counts = cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(mapped.where(F.col("ref_code") == canon.UNMATCHED), ["column_name", "value"]).select("column_name", "value", "n", F.round("score", 4).alias("score"))


def p4_values(spark, sf):
    """Every different value with its code and score."""
    return _mapped(spark, sf)[1]


def _damaged(spark, sf):
    cells = _typed(spark, sf, ["CUST_NAME", "ADDR_STREET"])
    return cells.join(mojibake.damaged_values(cells, "value", Stage(spark, "p5")), "value")


def p5_found(spark, sf):
    return _damaged(spark, sf).select("cust_id", "column_name", "outcome").distinct()


def p5_restored(spark, sf):
    """The damaged values with their original text, as far as it follows, and what speaks for it."""
    return _damaged(spark, sf).select("cust_id", "column_name", "value", "restored", "outcome", "basis").distinct()


def _run1(spark, sf):
    return read(spark, sf, "deduplicated").where("run_no = 1")


def p7_found(spark, sf):
    return survivors.surviving_records(_run1(spark, sf), "dedup_cluster_id", "_SRC_PK", RUN1_FIELDS, "src_trust", "updated_at", "_TRANSFORM_STATUS")


def p7_source_quality(spark, sf):
    """Sensitivity and specificity of each source per field, by expectation-maximisation."""
    found = survivors.facts(_run1(spark, sf), "dedup_cluster_id", "src_system", RUN1_FIELDS)
    quality, _ = survivors.source_quality(found, Stage(spark, "p7"))
    return spark.createDataFrame(quality, "field string, source string, sensitivity double, specificity double")


def p7_true_values(spark, sf):
    """Every value of a group's field that is more likely true than not; a field can keep several."""
    stage = Stage(spark, "p7")
    found = stage.write(survivors.facts(_run1(spark, sf), "dedup_cluster_id", "src_system", RUN1_FIELDS), "facts")
    _, with_p = survivors.source_quality(found, stage)
    return with_p(found).where("p >= 0.5").select(F.col("g").alias("dedup_cluster_id"), F.col("field").alias("column_name"), "value", F.round("p", 4).alias("p"))


def p7_merged(spark, sf):
    """The merged record of each group, field by field: the value the two-sided model holds most likely, and how many it holds true."""
    stage = Stage(spark, "p7")
    found = stage.write(survivors.facts(_run1(spark, sf), "dedup_cluster_id", "src_system", RUN1_FIELDS), "facts")
    _, with_p = survivors.source_quality(found, stage)
    return survivors.merged_fields(with_p(found)).select(F.col("g").alias("dedup_cluster_id"), F.col("field").alias("column_name"), "value", F.round("p", 4).alias("p"), "n_true")


def p8_ids(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", tokens.encode(docs, "text").alias("ids"))


def p8_round_trip(spark, sf):
    """Documents whose ids don't decode to the text again: none."""
    docs = read(spark, sf, "documents")
    coded = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), tokens.encode(docs, "text").alias("ids"))
    return coded.select("doc_id", "text", tokens.decode(coded, "ids").alias("back")).where("text <> back").select("doc_id")


def _leaks(spark, sf, **options):
    return leakage.leaks(read(spark, sf, "documents"), "doc_id", "text", read(spark, sf, "eval_items"), "item_id", "text", Stage(spark, "p9"), **options)


def p9_found(spark, sf):
    return _leaks(spark, sf, runs_only=True).where(F.col("run") >= leakage.RUN).select("doc_id", "item_id")


def p9_alignments(spark, sf):
    """All candidates that align with at least half of an item, copied, cut or edited."""
    return _leaks(spark, sf).where("score * 2 >= full").select("doc_id", "item_id", "run", "score", F.round(F.col("score") / F.col("full"), 4).alias("share"))


def _spans(spark, sf):
    return spans.shared_spans(read(spark, sf, "documents"), "doc_id", "text", Stage(spark, "p10"))


def p10_found(spark, sf):
    return _spans(spark, sf)


def p10_shared_amount(spark, sf):
    """Per document: its length and how many of its characters are shared."""
    amount = _spans(spark, sf).groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    return read(spark, sf, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).join(amount, "doc_id", "left").fillna(0, ["shared_chars"])


QUERIES = {f.__name__: f for f in (p2_found, p2_places, p3_found, p4_found, p4_unmatched, p4_values, p5_found, p5_restored, p7_found, p7_source_quality, p7_true_values, p7_merged, p8_ids, p8_round_trip, p9_found, p9_alignments, p10_found, p10_shared_amount)}

_LACK = "(trim({c}, ' ') IS NULL OR lower(trim({c}, ' ')) IN ('', '-', 'n/a', 'none', 'unknown', 'tbd'))"
_P7 = [
    f"""SELECT s.g AS dedup_cluster_id, '{c}' AS column_name, x.k AS source_pk FROM s JOIN (
      SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY src_trust NULLS LAST, updated_at DESC NULLS LAST, k) AS rk
      FROM part WHERE NOT {_LACK.format(c=c)}) x ON x.g = s.g AND x.rk = 1 WHERE {_LACK.format(c="s." + c)} AND x.k <> s.k"""
    for c in RUN1_FIELDS
]
SQL = {
    "p3_found": """
WITH RECURSIVE rec AS (SELECT DISTINCT trim(_SRC_PK, ' ') AS k FROM deduplicated WHERE run_no = 2 AND trim(_SRC_PK, ' ') <> ''),
m AS (SELECT least(trim(pk_a, ' '), trim(pk_b, ' ')) AS a, greatest(trim(pk_a, ' '), trim(pk_b, ' ')) AS b, decision,
    row_number() OVER (PARTITION BY least(trim(pk_a, ' '), trim(pk_b, ' ')), greatest(trim(pk_a, ' '), trim(pk_b, ' ')) ORDER BY decided_at DESC NULLS LAST, pair_no DESC) AS rk
  FROM match_pairs WHERE trim(pk_a, ' ') <> '' AND trim(pk_b, ' ') <> ''),
c AS (SELECT DISTINCT trim(_SRC_PK, ' ') AS k, trim(dedup_cluster_id, ' ') AS g FROM deduplicated WHERE run_no = 2 AND trim(dedup_cluster_id, ' ') <> ''),
l AS (SELECT a, b FROM m WHERE rk = 1 AND decision = 'MATCH'
  UNION SELECT trim(_SRC_PK, ' '), trim(surviving_master_pk, ' ') FROM deduplicated WHERE run_no = 2 AND trim(surviving_master_pk, ' ') <> ''
  UNION SELECT k, first_value(k) OVER (PARTITION BY g ORDER BY k) FROM c),
e AS (SELECT a, b FROM l WHERE a <> b AND a IN (FROM rec) AND b IN (FROM rec) UNION SELECT b, a FROM l WHERE a <> b AND a IN (FROM rec) AND b IN (FROM rec)),
w(k, r) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, w.r FROM w JOIN e ON e.a = w.k WHERE w.r < e.b OR w.r >= e.b)
SELECT k AS src_pk, min(r) AS group_pk FROM w GROUP BY 1
""",
    "p7_found": f"""
WITH part AS (SELECT * FROM (SELECT *, trim(dedup_cluster_id, ' ') AS g, trim(_SRC_PK, ' ') AS k, coalesce(_TRANSFORM_STATUS = 'FAILED', false) AS f,
    {" + ".join(f"{_LACK.format(c=c)}::INT" for c in RUN1_FIELDS)} AS lack,
    bool_and(coalesce(_TRANSFORM_STATUS = 'FAILED', false)) OVER (PARTITION BY trim(dedup_cluster_id, ' ')) AS allf
  FROM deduplicated WHERE run_no = 1 AND trim(dedup_cluster_id, ' ') <> '' AND trim(_SRC_PK, ' ') <> '') WHERE NOT f OR allf),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY lack, updated_at DESC NULLS LAST, k) AS rk FROM part) WHERE rk = 1)
SELECT g AS dedup_cluster_id, '_SRC_PK' AS column_name, k AS source_pk FROM s
UNION ALL {" UNION ALL ".join(_P7)}
""",
    "p9_found": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[s:s + {leakage.RUN - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {leakage.RUN - 2})) AS s FROM d)),
ig AS (SELECT item_id, array_to_string(w[s:s + {leakage.RUN - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - {leakage.RUN - 2})) AS s FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
    "p8_round_trip": "SELECT doc_id FROM documents WHERE false",
}
