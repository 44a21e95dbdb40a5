"""Text functions with fixed semantics, all native expressions.

Blank means null everywhere: null, empty and only-blank (U+0020) text are the same missing value.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms that don't count in a company name.
LEGAL_SUFFIXES = [
    "INC", "INCORPORATED", "LLC", "LLP", "LP", "LTD", "LIMITED", "CORP", "CORPORATION", "CO", "COMPANY", "GMBH", "AG", "KG", "SA", "SAS", "SARL",
    "BV", "NV", "PLC", "PTE", "PVT", "PRIVATE", "OY", "AB", "SPA", "SRL", "KK", "SL",
]
#: Address words and the abbreviation that stands for them.
ADDRESS_WORDS = {
    "STREET": "ST", "STRASSE": "ST", "STR": "ST", "AVENUE": "AVE", "ROAD": "RD", "DRIVE": "DR", "BOULEVARD": "BLVD", "SUITE": "STE", "FLOOR": "FL",
}
#: What stands in an id field instead of an id.
PLACEHOLDER_IDS = ["NONE", "NULL", "NA", "NOTAPPLICABLE", "UNKNOWN", "TBD", "PENDING", "APPLIEDFOR", "TEST", "DUMMY"]


def full_match(c, pattern: str) -> Column:
    """Whole value matches; unlike ^...$ a trailing line break is no match."""
    return c.rlike(r"\A(?:" + pattern + r")\z")


def blank_to_null(c) -> Column:
    """Null for blank text; other values stay as they are, outer blanks included."""
    return F.when(F.trim(c) != "", c)


def trim_to_null(c) -> Column:
    """The trimmed value, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def fold(c) -> Column:
    """Key for comparing without case: trimmed, upper case, sharp s as SS."""
    return F.replace(F.upper(F.trim(c)), F.lit("ẞ"), F.lit("SS"))


def _folding() -> tuple[str, str]:
    """Letters that decompose into a base letter and marks, and those base letters: Latin, Greek, Cyrillic."""
    source, target = [], []
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isalpha() and all(unicodedata.combining(ch) for ch in base[1:]):
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _folding()


def strip_accents(c) -> Column:
    """Latin letters without their marks; letters that don't decompose (as L with stroke) stay."""
    return F.translate(c, _ACCENTED, _PLAIN)


def fold_latin(c) -> Column:
    """Lower case, without marks; letters that don't decompose become their nearest ASCII letters."""
    out = strip_accents(F.lower(c))
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ð", "d"), ("þ", "th"), ("ı", "i")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold_german(c) -> Column:
    """Upper case, German letters written out, other marks dropped."""
    out = F.upper(c)
    for a, b in (("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE"), ("ẞ", "SS")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return strip_accents(out)


def _words(names: list[str]) -> str:
    """A whole word out of a list; word characters are ASCII, as in the engines' common subset."""
    return "(?<![A-Za-z0-9_])(" + "|".join(names) + ")(?![A-Za-z0-9_])"


def name_norm(c) -> Column:
    """Normal form of a company name: folded, without dots, signs and legal forms (which stay if nothing else is left)."""
    base = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(fold_german(c), r"\.", ""), r"[^\p{L}\p{N} ]", " "), r"\s+", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(base, _words(LEGAL_SUFFIXES), " "), r"\s+", " "))
    return F.when(bare == "", base).otherwise(bare)


def address_norm(*columns) -> Column:
    """Normal form of an address: parts joined, folded, signs as blanks, usual words abbreviated."""
    out = F.regexp_replace(fold_german(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])), r"[^\p{L}\p{N} ]", " ")
    for word, short in ADDRESS_WORDS.items():
        out = F.regexp_replace(out, _words([word]), short)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def digits(c) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def alnum(c) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def one_character(c) -> Column:
    """The same character throughout."""
    return c == F.repeat(F.left(c, F.lit(1)), F.length(c))


def key_part(c, kind: str) -> Column:
    """Normal form of a value that can identify somebody, else null.

    alnum: at least 5 letters or digits, not one repeated, no placeholder. email: an address. digits: at least 6, not one
    repeated. text: blanks collapsed, upper case.
    """
    if kind == "alnum":
        v = alnum(c)
        out = F.when((F.length(v) >= 5) & ~one_character(v) & ~v.isin(PLACEHOLDER_IDS), v)
    elif kind == "email":
        v = F.lower(F.trim(c))
        out = F.when(full_match(v, r"[^@\s]+@[^@\s]+\.[a-z]{2,}"), v)
    elif kind == "digits":
        v = digits(c)
        out = F.when((F.length(v) >= 6) & ~one_character(v), v)
    elif kind == "text":
        out = F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))
    else:
        raise ValueError(f"unknown kind of key: {kind}")
    return F.nullif(out, F.lit(""))


def shape_mask(c) -> Column:
    """Digits as 9, capitals as A, other letters as a; what is neither stays."""
    s = F.regexp_replace(c, r"\p{Lu}", "\u0001")
    s = F.regexp_replace(F.regexp_replace(s, r"\p{L}", "\u0002"), r"\p{Nd}", "9")
    return F.translate(s, "\u0001\u0002", "Aa")


def printable(c, size: int = 100) -> Column:
    """Control characters as blanks, cut to ``size`` characters."""
    return F.left(F.regexp_replace(c, r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]", " "), F.lit(size))


def luhn(c) -> Column:
    """Whether a string of digits passes the Luhn check; null for other strings."""
    n = F.length(c)
    value = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(1)).cast("int") * (F.lit(1) + (n - i) % 2))
    total = F.aggregate(value, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.when(full_match(c, "[0-9]+"), total % 10 == 0)


def alpha_input(c, size: int = 10) -> Column:
    """Numbers padded with leading zeros to ``size``; other values, and longer ones, stay."""
    t = F.trim(c)
    return F.when(full_match(t, "[0-9]+") & (F.length(t) < size), F.lpad(t, size, "0")).otherwise(t)


def portable_hash(c) -> Column:
    """60-bit hash that other engines reproduce: the first 15 hexadecimal digits of md5."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")


def to_long(c) -> Column:
    """Whole number of a text, rounded half up; null if it is no plain number."""
    number = F.when(full_match(F.trim(c), r"[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]{1,2})?"), F.trim(c))
    return F.round(number.try_cast("decimal(38,10)")).try_cast("bigint")


def to_date(c) -> Column:
    """ISO date of a text; null unless year, month and day are all there."""
    return F.when(full_match(F.trim(c), r"\d{4}-\d{1,2}-\d{1,2}"), F.trim(c)).try_cast("date")


def shown(c, size: int = 60) -> Column:
    """A value as it appears in messages: control characters as question marks, cut."""
    return F.left(F.regexp_replace(c, r"\p{Cc}", "?"), F.lit(size))
