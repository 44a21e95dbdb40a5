"""Which columns hold personal data: by name, and by the share of values with a telling shape. A class is only ever raised."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import full_match, luhn, trim_to_null

ORDER = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED_PII"]
MIN_VALUES, SHARE = 3, 0.6
#: Column names that say what they hold.
RESTRICTED_NAME = (
    r"(^|_)(E_?MAIL|SMTP|MAIL|PHONE|TEL|TELF\d?|TELEFON|TELEPHONE|MOBILE|HANDY|FAX|TAX|VAT|STCD\d?|STCEG|USTID|GSTIN|EIN|TIN|SSN|SIN|NIF|CNPJ|CPF|PASSPORT|"
    r"NATIONAL_?ID|ID_?NUMBER|SOCIAL|IBAN|BIC|SWIFT|BANK|BANKN|BANKL|KONTO|ACCOUNT_?(NO|NUM|NUMBER)|CARD|CC_?NUM|DOB|BIRTH\w*|GEBURT\w*|GEBDAT|GENDER|SEX|RELIGION|"
    r"ETHNIC\w*|HEALTH|STREET|STRAS|STRASSE|ADDR|ADDRESS|HOUSE\w*|POSTAL|POST_?CODE|PSTLZ|ZIP|CITY|ORT\d*|TOWN|LAT|LON|LONGITUDE|LATITUDE|IP_?ADDR\w*)(_|\d|$)"
)
CONFIDENTIAL_NAME = (
    r"(^|_)(NAME\d?|FIRST\w*|LAST\w*|SURNAME|FULL_?NAME|CUST_?NAME|CONTACT\w*|ATTN|SALUTATION|SORTL|SEARCH|NOTES?|COMMENTS?|REMARKS?|DESCRIPTION|TEXT|MEMO|CREDIT\w*|"
    r"KLIMK|SALARY|INCOME)(_|\d|$)"
)


def by_name(column: str) -> str:
    if re.search(RESTRICTED_NAME, column or "", re.IGNORECASE):
        return "RESTRICTED_PII"
    return "CONFIDENTIAL" if re.search(CONFIDENTIAL_NAME, column or "", re.IGNORECASE) else "INTERNAL"


def stricter(*classes: str | None) -> str:
    return max((c for c in classes if c), key=ORDER.index)


def value_shares(counts: DataFrame) -> DataFrame:
    """From value counts: per column the number of values and the shares (4 digits) that look like an e-mail address, IBAN, card
    number, national id or phone number. One pass, weighted by the counts."""
    v, n = F.col("value"), F.col("n")
    compact = F.regexp_replace(v, "[ -]", "")
    tests = {
        "email": full_match(v, r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}"),
        "iban": full_match(F.upper(compact), r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"),
        "card": F.when(full_match(compact, r"\d{13,19}"), luhn(compact)).otherwise(False),
        "national_id": full_match(v, r"\d{3}-\d{2}-\d{4}"),
        "phone": full_match(v, r"\+?\d[\d \-./()]{6,18}\d") & (F.length(F.regexp_replace(v, r"\D", "")) >= 7) & v.rlike(r"[+ \-/(]"),
    }
    sums = counts.where("value is not null").groupBy("column_name").agg(F.sum("n").alias("n_values"), *[F.sum(F.when(t, n).otherwise(0)).alias(k) for k, t in tests.items()])
    return sums.select("column_name", "n_values", *[F.round(F.col(k) / F.col("n_values"), 4).alias(k) for k in tests])


def classify(shares: DataFrame, columns: list[str], current: dict[str, str] | None = None) -> DataFrame:
    """column_name, classification: the strictest of what a column has, what its name says and what most of its values look like."""
    named = {c: stricter((current or {}).get(c), by_name(c)) for c in columns}
    known = F.create_map(*[x for c, k in named.items() for x in (F.lit(c), F.lit(k))])
    rank = F.create_map(*[x for i, k in enumerate(ORDER) for x in (F.lit(k), F.lit(i))])
    telling = F.greatest(*[F.col(c) for c in ("email", "iban", "card", "national_id", "phone")]) >= SHARE
    found = F.when((F.col("n_values") >= MIN_VALUES) & telling, "RESTRICTED_PII").otherwise("PUBLIC")
    names = shares.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    joined = names.join(shares, "column_name", "left").select("column_name", known[F.col("column_name")].alias("a"), F.coalesce(found, F.lit("PUBLIC")).alias("b"))
    return joined.select("column_name", F.when(rank[F.col("a")] >= rank[F.col("b")], F.col("a")).otherwise(F.col("b")).alias("classification"))


def text_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[trim_to_null(F.col(f"`{c}`").cast("string")).alias(c) for c in columns])
