"""Queries over runs, defects, tasks and suggestions; nested documents; nearest vectors; streams; landing and delivery round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewright.operators import insight, pii, profile, rows, similar, transform
from tidewright.operators.transform import FieldRule, Mapping, Target
from tidewright.queries import read
from tidewright.queries.assess import COLUMNS
from tidewright.queries.assess import RULES as EXCLUSIONS
from tidewright.queries.assess import _TAG
from tidewright.queries.sql import trimmed
from tidewright.session import Stage, shared_dir
from tidewright.sources import deliver, documents, land
from tidewright.streaming import rules as streams


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _defects(spark, sf, parity):
    """Defects of one of two cycles, made up from the events: per type and hour."""
    e = read(spark, sf, "events").where(F.col("event_id") % 3 != parity)
    return e.groupBy(F.col("event_type").alias("rule_id"), F.concat(F.lit("ERR_"), F.hour("ts").cast("string")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def _signatures(spark, sf, parity):
    d = _defects(spark, sf, parity).withColumn("signature", F.concat_ws(":", "rule_id", "signature"))
    return d.where(F.col("n") % 5 != parity).select("signature", "n")


def defect_upsert(spark, sf):
    old = _defects(spark, sf, 0).where("n % 4 <> 0").withColumn("ticket", F.when(F.col("n") % 2 == 0, F.concat(F.lit("T-"), F.col("n").cast("string"))))
    return insight.defect_upsert(old, _defects(spark, sf, 1).where("n % 4 <> 1"))


def _runs(spark, sf):
    """A run per order: wave by customer, score from its price."""
    o = read(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        (F.col("o_custkey") % 20).alias("wave"),
        F.round(F.col("o_totalprice") % 100, 2).alias("score"),
        F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("FAILED").alias("run_status"),
        F.when(F.col("o_orderkey") % 7 == 0, "DRAFT").otherwise("APPROVED").alias("mapping_status"),
        (F.col("o_orderkey") % 5 != 0).alias("validated"),
        F.col("o_orderdate").cast("date").alias("ended"),
    )


def gate_state(spark, sf):
    lines = read(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "R", "CRITICAL").otherwise("LOW").alias("severity"), F.lit(1).alias("n"))
    return insight.gate(_runs(spark, sf), lines)


def cycle_compare(spark, sf):
    return insight.cycle_compare(_signatures(spark, sf, 0), _signatures(spark, sf, 1))


def wave_trend(spark, sf):
    return insight.wave_trend(_runs(spark, sf)).fillna(-1.0, ["previous_score"])


def dashboard(spark, sf):
    return insight.dashboard(_runs(spark, sf).withColumnRenamed("run_status", "status"))


def _tasks(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("owner"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("status"), F.col("o_orderdate").cast("date").alias("due"), (F.col("o_custkey") % 100).cast("string").alias("signature"), "o_orderkey")


def task_summary(spark, sf):
    return insight.task_summary(_tasks(spark, sf), "1998-01-01")


def task_auto_close(spark, sf):
    still = read(spark, sf, "customer").where("c_acctbal > 0").select((F.col("c_custkey") % 100).cast("string").alias("signature")).where("cast(signature as int) % 3 = 0")
    return insight.auto_close(_tasks(spark, sf), still).select("o_orderkey", "signature")


def retention_due(spark, sf):
    holds = read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("run_id"))
    return insight.retention_due(_runs(spark, sf), holds, "1998-08-01", 365).select("run_id", F.col("ended").cast("string").alias("ended"))


def audit_breaks(spark, sf):
    """A chain per customer segment whose hashes are right but for every 97th entry."""
    c = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("chain"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("payload"))
    hashed = c.withColumn("hash", F.sha2(F.concat(F.lit("x"), "payload"), 256))
    w = "lag(hash) over (partition by chain order by seq)"
    good = hashed.withColumn("right", F.sha2(F.concat(F.coalesce(F.expr(w), F.lit("")), F.col("payload")), 256))
    return insight.audit_breaks(good.withColumn("hash", F.when(F.col("seq") % 97 == 0, F.col("right")).otherwise(F.col("hash"))))


def vote_tally(spark, sf):
    e = read(spark, sf, "events").select((F.col("user_id") % 50).alias("question"), F.col("event_type").alias("answer"), F.round("value", 2).cast("decimal(18,2)").alias("confidence"))
    return insight.vote(e, "question", "answer", "confidence")


def target_conflicts(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_brand").alias("target"), F.col("p_partkey").alias("source"), F.col("p_size").alias("confidence"))
    return insight.target_conflicts(p, "target", "source", "confidence")


def partner_sides(spark, sf):
    n = F.col("n_nationkey") % 4
    t = read(spark, sf, "nation").withColumn("t", F.when(n == 0, "CUST_SALES").when(n == 1, "LFB1_VENDOR").when(n == 2, "CUST_VEND").otherwise(F.col("n_name")))
    names = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("Lieferant"), F.lit("lifnr"), F.col("n_name"))).otherwise(F.array(F.col("n_name")))
    return insight.partner_side(t.withColumn("names", names), "t", "names").select("n_nationkey", "side")


def identifier_words(spark, sf):
    n = F.col("n_nationkey")
    name = F.when(n % 3 == 0, F.concat(F.lit("custNm_"), F.col("n_name"))).when(n % 3 == 1, F.concat(F.lit("TEL-NO "), F.col("n_name"))).otherwise(F.col("n_name"))
    return read(spark, sf, "nation").select("n_nationkey", insight.expand_identifier(name).alias("words"))


def preflight_verdicts(spark, sf):
    rules = (
        FieldRule(Target("T", "NAME", "CHAR", 20, True), "COPY", "CUST_NAME"),
        FieldRule(Target("T", "CITY", "CHAR", 40, True), "COPY", "CITY"),
        FieldRule(Target("T", "CODE", "NUMC", 10), "COPY", "POSTAL_CODE"),
        FieldRule(Target("T", "FLAG", "CHAR", 1), "STATIC", None, "NULL"),
    )
    sample = rows.hash_sample(read(spark, sf, "lookalikes").select(F.col("rn").alias("__rn"), "CUST_NAME", "CITY", "POSTAL_CODE"), "__rn", 2000)
    return insight.preflight(transform.rule_summary(Mapping(rules), sample))


def personal_data_record(spark, sf):
    shares = pii.value_shares(profile.value_counts(read(spark, sf, "lookalikes").select(*COLUMNS)))
    return insight.personal_data_record(pii.classify(shares, COLUMNS))


def embedding_top_k(spark, sf):
    """For every vector whose id is divisible by 50, the 5 nearest of all others."""
    e = read(spark, sf, "embeddings")
    top = similar.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    return top.select("query_id", "rank", "id", F.round("score", 5).alias("score"))


def embedding_interleaved(spark, sf):
    """The rankings of two query sets' neighbours by label taken in turns."""
    e = read(spark, sf, "embeddings")
    top = similar.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 6)
    ranked = top.select("query_id", (F.col("id") % 2).cast("string").alias("ranking"), "rank", F.col("id").alias("target"))
    return similar.interleave(ranked, 4)


def flatten_json(spark, sf):
    flat = documents.from_json_text(read(spark, sf, "events"), "props", ["event_id"])
    return flat.select("event_id", *sorted(c for c in flat.columns if c != "event_id"))


def json_union_columns(spark, sf):
    return documents.json_keys(read(spark, sf, "events"), "props")


def number_rows(spark, sf):
    """Customers numbered by balance and key, without a single task that holds them all."""
    numbered = rows.number_rows(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), Stage(spark, "rows"), "n", [F.desc("c_acctbal"), "c_custkey"])
    return numbered.select("c_custkey", "n")


def stream_exclusions(spark, sf):
    """The exclusion rules over the landed extract as a stream that ends (AvailableNow)."""
    source = read(spark, sf, "lookalikes")
    folder = _folder(spark, "stream-in")
    source.select("rn", *COLUMNS).write.parquet(folder)
    stream = streams.exclusions(streams.read_landed(spark, folder, spark.read.parquet(folder).schema), EXCLUSIONS).where("_EXCLUDED_BY is not null")
    out = _folder(spark, "stream-out")
    streams.run_once(stream.select("rn", F.col("_EXCLUDED_BY").alias("excluded_by")), out, _folder(spark, "stream-state"))
    return spark.read.schema("rn bigint, excluded_by string").parquet(out)


def stream_violations(spark, sf):
    folder = _folder(spark, "stream-in")
    read(spark, sf, "lookalikes").select("rn", "POSTAL_CODE").write.parquet(folder)
    stream = streams.violations(streams.read_landed(spark, folder, "rn bigint, POSTAL_CODE string"), "POSTAL_CODE", "Z02")
    out = _folder(spark, "stream-out")
    streams.run_once(stream, out, _folder(spark, "stream-state"))
    return spark.read.schema("rn bigint, POSTAL_CODE string").parquet(out)


def stream_first_deliveries(spark, sf):
    """Keys of the events' stream, each once within the lateness."""
    folder = _folder(spark, "stream-in")
    read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(folder)
    stream = streams.first_deliveries(streams.read_landed(spark, folder, "user_id bigint, ts timestamp"), "user_id", "ts", "3650 days").select("user_id")
    out = _folder(spark, "stream-out")
    streams.run_once(stream, out, _folder(spark, "stream-state"))
    return spark.read.schema("user_id bigint").parquet(out)


def delivery_round_trip(spark, sf):
    """Delivers the nations, replaces them, takes the replacement back and verifies: what is left is what was first delivered."""
    base = read(spark, sf, "nation").select(*[F.col(c).cast("string").alias(c) for c in ("n_nationkey", "n_name", "n_regionkey")])
    table = deliver.Table(spark, _folder(spark, "delivered"), "n_nationkey")
    table.deliver(base, "r1")
    table.deliver(base.withColumn("n_name", F.lower("n_name")), "r2", "replace")
    differing = table.verify(base)
    table.roll_back("r2")
    same = not table.verify(base)
    return table.read().select("*", F.lit(",".join(differing)).alias("differed"), F.lit(same).alias("restored"))


def landing_round_trip(spark, sf):
    """The customers written as CSV with every quirk of the format and landed again."""
    out = _folder(spark, "csv")
    c = read(spark, sf, "customer").select("c_custkey", F.concat(F.lit('a "quoted", '), "c_name").alias("c_name"), "c_mktsegment")
    c.coalesce(1).write.option("header", True).option("escape", '"').csv(out)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(f"{out}/part-*"))
    name = files[0].getPath().toUri().getPath()
    landed = _folder(spark, "landed")
    land.land(spark, name, landed)
    return spark.read.parquet(landed).select("c_custkey", "c_name", "c_mktsegment")


QUERIES = {
    f.__name__: f
    for f in (
        defect_upsert, gate_state, cycle_compare, wave_trend, dashboard, task_summary, task_auto_close, retention_due, audit_breaks, vote_tally, target_conflicts, partner_sides,
        identifier_words, preflight_verdicts, personal_data_record, embedding_top_k, embedding_interleaved, flatten_json, json_union_columns, number_rows, stream_exclusions,
        stream_violations, stream_first_deliveries, delivery_round_trip, landing_round_trip,
    )
}

# ---------------------------------------------------------------- SQL
_DEF = lambda p: f"(SELECT event_type AS rule_id, 'ERR_' || hour(ts) AS signature, count(*) AS n FROM events WHERE event_id % 3 <> {p} GROUP BY 1, 2)"
_SIG = lambda p: f"(SELECT rule_id || ':' || signature AS signature, n FROM {_DEF(p)} WHERE n % 5 <> {p})"
_RUNS = """(SELECT o_orderkey AS run_id, o_custkey % 20 AS wave, round(o_totalprice % 100, 2) AS score, CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END AS run_status,
  CASE WHEN o_orderkey % 7 = 0 THEN 'DRAFT' ELSE 'APPROVED' END AS mapping_status, o_orderkey % 5 <> 0 AS validated, CAST(o_orderdate AS DATE) AS ended FROM orders)"""
_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_TOP = lambda k: f"(SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_DOT} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 12) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= {k})"
_PF = [("T_NAME", "CUST_NAME", "length(v) > 20 OR v IS NULL"), ("T_CITY", "CITY", "length(v) > 40 OR v IS NULL"), ("T_CODE", "POSTAL_CODE", "v IS NOT NULL AND (NOT regexp_full_match(v, '[0-9]+') OR length(v) > 10)"), ("T_FLAG", "NULL", "false")]
_CTRL = "regexp_matches(v, '[\\x00-\\x1f\\x7f-\\x9f]')"
SQL = {
    "defect_upsert": f"""SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.signature, b.signature) AS signature, coalesce(b.n, 0) AS n, CASE WHEN a.n % 2 = 0 THEN 'T-' || a.n END AS ticket,
  CASE WHEN a.n IS NULL THEN 'NEW' WHEN b.n IS NULL THEN 'RESOLVED' ELSE 'OPEN' END AS state FROM (SELECT * FROM {_DEF(0)} WHERE n % 4 <> 0) a FULL JOIN (SELECT * FROM {_DEF(1)} WHERE n % 4 <> 1) b ON a.rule_id = b.rule_id AND a.signature = b.signature""",
    "gate_state": f"""SELECT r.run_id, coalesce(c, 0) AS critical, CASE WHEN mapping_status <> 'APPROVED' THEN 'MAPPING_NOT_APPROVED' WHEN run_status <> 'SUCCEEDED' THEN 'RUN_NOT_SUCCEEDED' WHEN NOT validated THEN 'NOT_VALIDATED' WHEN coalesce(c, 0) > 0 THEN 'CRITICAL_DEFECTS' ELSE 'READY' END AS gate
  FROM {_RUNS} r LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' GROUP BY 1) d ON d.l_orderkey = r.run_id""",
    "cycle_compare": f"""SELECT signature, n_before, n_after, CASE WHEN n_after = 0 AND n_before > 0 THEN 'RESOLVED' WHEN n_before = 0 AND n_after > 0 THEN 'NEW' WHEN n_after < n_before THEN 'IMPROVED' WHEN n_after > n_before THEN 'WORSENED' ELSE 'UNCHANGED' END AS verdict
  FROM (SELECT coalesce(a.signature, b.signature) AS signature, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after FROM {_SIG(0)} a FULL JOIN {_SIG(1)} b ON a.signature = b.signature)""",
    "wave_trend": f"SELECT wave, run_id, score, coalesce(lag(score) OVER w, -1) AS previous_score, coalesce(score < lag(score) OVER w, false) AS fell, round(avg(score) OVER (PARTITION BY wave ORDER BY run_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean_of_3 FROM {_RUNS} WINDOW w AS (PARTITION BY wave ORDER BY run_id)",
    "dashboard": f"SELECT wave, count(*) AS runs, count(*) FILTER (WHERE run_status = 'SUCCEEDED') AS succeeded, max(run_id) AS latest_run, arg_max(score, run_id) AS latest_score FROM {_RUNS} GROUP BY 1",
    "task_summary": "SELECT o_orderpriority AS owner, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) < DATE '1998-01-01') AS overdue, count(*) FILTER (WHERE o_orderstatus <> 'O') AS closed FROM orders GROUP BY 1",
    "task_auto_close": "SELECT o_orderkey, CAST(o_custkey % 100 AS VARCHAR) AS signature FROM orders WHERE o_orderstatus = 'O' AND CAST(o_custkey % 100 AS VARCHAR) NOT IN (SELECT CAST(c_custkey % 100 AS VARCHAR) FROM customer WHERE c_acctbal > 0 AND (c_custkey % 100) % 3 = 0)",
    "retention_due": f"SELECT run_id, CAST(ended AS VARCHAR) AS ended FROM {_RUNS} WHERE ended < DATE '1998-08-01' - INTERVAL 365 DAY AND run_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "audit_breaks": """WITH c AS (SELECT c_mktsegment AS chain, c_custkey AS seq, c_name AS payload, sha256('x' || c_name) AS h0 FROM customer),
  r AS (SELECT *, CASE WHEN seq % 97 = 0 THEN sha256(coalesce(lag(h0) OVER (PARTITION BY chain ORDER BY seq), '') || payload) ELSE h0 END AS hash FROM c)
  SELECT chain, seq FROM (SELECT *, sha256(coalesce(lag(hash) OVER (PARTITION BY chain ORDER BY seq), '') || payload) AS want FROM r) WHERE hash <> want""",
    "vote_tally": """WITH g AS (SELECT user_id % 50 AS question, event_type AS answer, count(*) AS votes, sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS w FROM events GROUP BY 1, 2)
  SELECT question, answer, votes, answers FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY votes DESC, w DESC, answer) AS rk, CAST(sum(votes) OVER (PARTITION BY question) AS BIGINT) AS answers FROM g) WHERE rk = 1""",
    "target_conflicts": "SELECT target, source, confidence FROM (SELECT p_brand AS target, p_partkey AS source, p_size AS confidence, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rk FROM part) WHERE rk = 1",
    # k % 4: CUST 2 | VEND 2 | CUST 2, VEND 2 | none; k % 3 = 0: two more for the supplier
    "partner_sides": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN ['both', 'supplier', 'both', 'supplier'][n_nationkey % 4 + 1] ELSE ['customer', 'supplier', 'both', 'customer'][n_nationkey % 4 + 1] END AS side FROM nation",
    "identifier_words": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'cust nm ' || w || ' customer name' WHEN 1 THEN 'tel no ' || w || ' telephone number' ELSE w END AS words FROM (SELECT n_nationkey, lower(regexp_replace(n_name, '[_\\s\\-]+', ' ', 'g')) AS w FROM nation)",
    "preflight_verdicts": "WITH s AS (SELECT CUST_NAME, CITY, POSTAL_CODE FROM lookalikes ORDER BY md5(CAST(rn AS VARCHAR)), CAST(rn AS VARCHAR) LIMIT 2000), r AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS target, count(*) AS n_rows, count(*) FILTER (WHERE {e} OR coalesce({_CTRL}, false)) AS errors, count(*) FILTER (WHERE v IS NOT NULL AND NOT ({e}) AND NOT {_CTRL}) AS filled FROM (SELECT {trimmed(c) if c != 'NULL' else 'CAST(NULL AS VARCHAR)'} AS v FROM s)" for t, c, e in _PF)
    + ") SELECT target, n_rows, errors, round(errors / n_rows, 4) AS rate, CASE WHEN errors / n_rows >= 0.5 THEN 'BLOCKER' WHEN errors / n_rows >= 0.05 THEN 'WARNING' WHEN filled = 0 THEN 'LOW_YIELD' ELSE 'OK' END AS verdict FROM r",
    "embedding_top_k": f"SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 5) AS score FROM {_TOP(5)}",
    "embedding_interleaved": f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, id % 2, id) AS INTEGER) AS position, id AS target FROM {_TOP(6)} QUALIFY position <= 4",
    "flatten_json": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "json_union_columns": "SELECT field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS field FROM events) GROUP BY 1",
    "number_rows": "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer",
    "stream_exclusions": f"SELECT rn, ex AS excluded_by FROM (SELECT rn, {_TAG} AS ex FROM lookalikes) WHERE ex IS NOT NULL",
    "stream_violations": "SELECT rn, POSTAL_CODE FROM lookalikes WHERE NOT regexp_full_match(upper(trim(POSTAL_CODE, ' ')), '[A-Z0-9][A-Z0-9 \\-]{1,9}')",
    "stream_first_deliveries": "SELECT DISTINCT user_id FROM events",
    "delivery_round_trip": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, 'n_name' AS differed, true AS restored FROM nation",
    "landing_round_trip": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'a \"quoted\", ' || c_name AS c_name, c_mktsegment FROM customer",
}
