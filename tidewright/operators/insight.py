"""What runs say over time: defects, gates, comparisons, trends, tasks, retention, audit; and rankings of suggestions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def defect_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (rule_id, signature, n, ticket), new (rule_id, signature, n): counts are updated, what is gone stays with 0, tickets are kept.
    Adds state NEW, OPEN or RESOLVED."""
    a, b = old.withColumnRenamed("n", "old_n"), new.withColumnRenamed("n", "new_n")
    both = a.join(b, ["rule_id", "signature"], "full_outer")
    state = F.when(F.col("old_n").isNull(), "NEW").when(F.col("new_n").isNull(), "RESOLVED").otherwise("OPEN")
    return both.select("rule_id", "signature", F.coalesce("new_n", F.lit(0)).cast("bigint").alias("n"), "ticket", state.alias("state"))


def gate(runs: DataFrame, defects: DataFrame) -> DataFrame:
    """runs (run_id, mapping_status, run_status, validated); defects (run_id, severity, n). READY only if approved, succeeded, validated
    and without an open critical defect; else the first reason."""
    critical = defects.where("severity = 'CRITICAL' and n > 0").groupBy("run_id").agg(F.sum("n").alias("critical"))
    state = (
        F.when(F.col("mapping_status") != "APPROVED", "MAPPING_NOT_APPROVED")
        .when(F.col("run_status") != "SUCCEEDED", "RUN_NOT_SUCCEEDED")
        .when(~F.col("validated"), "NOT_VALIDATED")
        .when(F.coalesce("critical", F.lit(0)) > 0, "CRITICAL_DEFECTS")
        .otherwise("READY")
    )
    return runs.join(critical, "run_id", "left").select("run_id", F.coalesce("critical", F.lit(0)).cast("bigint").alias("critical"), state.alias("gate"))


def cycle_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """signature, n_before, n_after, verdict: RESOLVED, NEW, IMPROVED, WORSENED, UNCHANGED."""
    both = before.select("signature", F.col("n").alias("n_before")).join(after.select("signature", F.col("n").alias("n_after")), "signature", "full_outer").fillna(0, ["n_before", "n_after"])
    verdict = (
        F.when((F.col("n_after") == 0) & (F.col("n_before") > 0), "RESOLVED")
        .when((F.col("n_before") == 0) & (F.col("n_after") > 0), "NEW")
        .when(F.col("n_after") < F.col("n_before"), "IMPROVED")
        .when(F.col("n_after") > F.col("n_before"), "WORSENED")
        .otherwise("UNCHANGED")
    )
    return both.withColumn("verdict", verdict)


def wave_trend(runs: DataFrame) -> DataFrame:
    """runs (wave, run_id, score): adds previous_score, fell, and the mean of the last three runs (explicit frame)."""
    w = Window.partitionBy("wave").orderBy("run_id")
    return runs.select(
        "wave",
        "run_id",
        "score",
        F.lag("score").over(w).alias("previous_score"),
        F.coalesce(F.col("score") < F.lag("score").over(w), F.lit(False)).alias("fell"),
        F.round(F.avg("score").over(w.rowsBetween(-2, 0)), 4).alias("mean_of_3"),
    )


def dashboard(runs: DataFrame) -> DataFrame:
    """wave, runs, succeeded, latest_run, latest_score per wave."""
    return runs.groupBy("wave").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"), F.max("run_id").alias("latest_run"), F.max_by("score", "run_id").alias("latest_score")
    )


def task_summary(tasks: DataFrame, today: str) -> DataFrame:
    """tasks (owner, status, due date): per owner open, overdue and closed ones."""
    is_open = F.col("status") == "OPEN"
    return tasks.groupBy("owner").agg(
        F.count_if(is_open).alias("open"), F.count_if(is_open & (F.col("due") < F.lit(today).cast("date"))).alias("overdue"), F.count_if(F.col("status") == "CLOSED").alias("closed")
    )


def auto_close(tasks: DataFrame, open_signatures: DataFrame) -> DataFrame:
    """The open tasks whose defect is gone."""
    return tasks.where("status = 'OPEN'").join(open_signatures.select("signature").distinct(), "signature", "left_anti")


def retention_due(runs: DataFrame, holds: DataFrame, today: str, days: int) -> DataFrame:
    """Runs that ended more than ``days`` before today and are not on hold."""
    return runs.where(F.col("ended") < F.date_sub(F.lit(today).cast("date"), days)).join(holds.select("run_id").distinct(), "run_id", "left_anti")


def audit_breaks(log: DataFrame) -> DataFrame:
    """log (seq, payload, hash): entries whose hash isn't the sha256 of the hash before and the payload. A window over one chain, so
    the log has to be one chain, as audit logs are; several chains go by their column ``chain``."""
    w = Window.partitionBy("chain").orderBy("seq")
    expected = F.sha2(F.concat(F.coalesce(F.lag("hash").over(w), F.lit("")), F.col("payload")), 256)
    return log.withColumn("expected", expected).where("hash <> expected").select("chain", "seq")


def audit_chain(log: list[tuple[int, str]]) -> list[tuple[int, str, str]]:
    """(seq, payload, hash) of a chain, for writing."""
    import hashlib

    out, last = [], ""
    for seq, payload in log:
        last = hashlib.sha256((last + payload).encode()).hexdigest()
        out.append((seq, payload, last))
    return out


def vote(answers: DataFrame, key: str, answer: str, confidence: str) -> DataFrame:
    """The answer with most votes per key, ties to the higher summed confidence, then by text."""
    groups = answers.groupBy(key, answer).agg(F.count(F.lit(1)).alias("votes"), F.sum(confidence).alias("weight"))
    best = groups.groupBy(key).agg(F.min(F.struct(-F.col("votes"), -F.col("weight"), F.col(answer).alias("a"))).alias("m"), F.sum("votes").alias("answers"))
    return best.select(key, F.col("m.a").alias(answer), (-F.col("m.col1")).alias("votes"), "answers")


def target_conflicts(suggestions: DataFrame, target: str, source: str, confidence: str) -> DataFrame:
    """One source per target: highest confidence, ties to the earliest source."""
    w = Window.partitionBy(target).orderBy(F.desc(confidence), source)
    return suggestions.withColumn("__rk", F.row_number().over(w)).where("__rk = 1").drop("__rk")


def preflight(summary: DataFrame, lookup_sizes: dict[str, int] | None = None, block: float = 0.5, warn: float = 0.05) -> DataFrame:
    """Verdict per target of a trial run on a sample: BLOCKER at half of the rows failing, WARNING at 5%, LOW_YIELD without a value."""
    rate = F.when(F.col("n_rows") > 0, F.col("errors") / F.col("n_rows")).otherwise(0.0)
    verdict = F.when(rate >= block, "BLOCKER").when(rate >= warn, "WARNING").when((F.col("filled") == 0) & (F.col("n_rows") > 0), "LOW_YIELD").otherwise("OK")
    return summary.select("target", "n_rows", "errors", F.round(rate, 4).alias("rate"), verdict.alias("verdict"))


def personal_data_record(columns: DataFrame) -> DataFrame:
    """classification, n, columns (sorted, joined with commas) of a classified catalog."""
    return columns.groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("columns"))


#: Parts of names that put a table on one side of a business.
SIDE_WORDS = {
    "customer": ["CUST", "KUNNR", "KUNDE", "CLIENT", "DEBITOR", "DEBTOR", "RECEIVABLE", "BUYER", "AR_"],
    "supplier": ["VEND", "LIFNR", "SUPPLIER", "LIEFERANT", "KREDITOR", "CREDITOR", "PAYABLE", "SELLER", "AP_"],
}


def partner_side(df: DataFrame, table: str, columns: str | None = None) -> DataFrame:
    """Adds side: customer, supplier or both (the weaker score is at least half of the stronger). Every word counts two in the table's
    name and one in each of the names of ``columns`` (an array); without any, or with a null name, it is customer."""
    names = F.coalesce(F.col(columns), F.array()) if columns else F.array().cast("array<string>")

    def score(words: list[str]):
        hits = lambda text: sum((F.contains(F.upper(text), F.lit(w)).cast("int") for w in words), F.lit(0))
        return F.coalesce(2 * hits(F.col(table)), F.lit(0)) + F.aggregate(names, F.lit(0), lambda n, c: n + F.coalesce(hits(c), F.lit(0)))

    a, b = score(SIDE_WORDS["customer"]), score(SIDE_WORDS["supplier"])
    weaker, stronger = F.least(a, b), F.greatest(a, b)
    return df.withColumn("side", F.when((weaker > 0) & (2 * weaker >= stronger), "both").when(b > a, "supplier").otherwise("customer"))


#: Short forms in column names and the words behind them.
NAME_WORDS = {
    "cust": "customer", "custno": "customer number", "kd": "customer", "kunde": "customer", "no": "number", "nr": "number", "num": "number", "nbr": "number", "id": "identifier number",
    "addr": "address", "adr": "address", "strasse": "street", "str": "street", "strt": "street", "tel": "telephone", "phn": "phone", "ph": "phone", "mob": "mobile phone",
    "ctry": "country", "cntry": "country", "cty": "city", "zip": "postal code", "pstl": "postal", "plz": "postal code", "nm": "name", "nme": "name", "curr": "currency", "ccy": "currency",
    "pmt": "payment", "pay": "payment", "trm": "terms", "lang": "language", "lng": "language", "eml": "e-mail", "acct": "account", "acc": "account", "grp": "group", "cd": "code",
    "typ": "type", "vend": "vendor supplier", "sup": "supplier", "vat": "tax number vat", "tin": "tax number", "ein": "tax number", "dt": "date", "desc": "description",
    "firmenname": "company name organization name", "firma": "company organization name", "kundenname": "customer name organization name", "name1": "organization name 1",
    "zusatz": "second name line additional name", "namenszusatz": "second name line additional name", "name2": "organization name 2 second name line",
    "ust": "vat tax number", "idnr": "identification number", "ustid": "vat tax number", "ustidnr": "vat identification number tax number", "steuernummer": "tax number",
    "steuer": "tax", "kundennummer": "customer number", "debitor": "customer", "hausnr": "house number", "hausnummer": "house number", "ort": "city", "stadt": "city",
    "land": "country", "postleitzahl": "postal code", "mail": "e-mail address", "telefon": "telephone number", "sprache": "language", "waehrung": "currency",
    "zahlungsbed": "payment terms", "zahlungsbedingung": "payment terms", "zahlungsbedingungen": "payment terms",
}


def identifier_words(c):
    """A column name as lower-case words: split before capitals and at underscores, dashes, dots and blanks."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.\s]+", " ")))


def expand_identifier(c):
    """The words of a column name, and behind them once each what its short forms stand for."""
    words = identifier_words(c)
    known = F.create_map(*[x for k, v in NAME_WORDS.items() for x in (F.lit(k), F.lit(v))])
    extra = F.array_distinct(F.filter(F.transform(F.split(words, " "), lambda w: known[w]), lambda x: x.isNotNull()))
    return F.array_join(F.concat(F.array(words), extra), " ")


def stale_columns(old: list[str], new: list[str]) -> list[str]:
    """Columns of a table that a new landing no longer has, whatever their case."""
    have = {c.lower() for c in new}
    return [c for c in old if c.lower() not in have]


def grounded(answer: str, facts: list[float], tolerance: float = 0.005) -> list[str]:
    """The numbers of an answer that no fact has."""
    found = [(x, float(x.replace(",", ""))) for x in re.findall(r"\d[\d,]*(?:\.\d+)?", answer)]
    return [x for x, v in found if not any(abs(v - f) <= tolerance * max(1.0, abs(f)) for f in facts)]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
