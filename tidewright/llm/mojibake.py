"""Text decoded with the wrong character encoding: finding it and restoring what can be restored.

Everything happens per distinct token. Every clean corpus word with a letter outside ASCII is put through all encoding chains
(UTF-8 read in a one-byte code page, once or twice; one code page read as another; characters replaced by a question mark), and
the corpus tokens are hash-joined with that table of garbled forms. A token whose word never occurs clean elsewhere is put
together from the garbled forms of single characters instead: byte sequences that are valid UTF-8 in a code page, or one code page
for the whole token, accepted only if the result consists of letters of the code pages for Latin script.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code pages that UTF-8 bytes may have been read in.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250")
#: (written in, read as) pairs of one-byte code pages; the last three only by way of known words.
CODE_PAGES = (("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp850", "latin-1"), ("cp437", "latin-1"), ("cp1250", "cp1252"), ("mac_roman", "cp1252"), ("cp850", "cp1252"))
GUESSED = CODE_PAGES[:5]
#: Signs that can stand beside letters in sound text.
SOUND_SIGNS = frozenset("°ºª™®©²³§½¼¾«»€£’‘“”–—…·¡¿&%")
LOST = "�"
#: A token that ends in a question mark is sound if it occurs in this many different values.
SOUND_COUNT = 3
#: A token under 4 characters that looks sound is taken for a garbled word only if that word is in so many times its values: short
#: sound words are often garbled forms of each other (Zé and ZÚ).
SHORT_FACTOR = 20


def _chars(page: str) -> list[str]:
    """The 256 characters of a code page; unassigned bytes stand for themselves."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_TABLE = {p: _chars(p) for p in {*READ_AS, *(x for pair in CODE_PAGES for x in pair)}}
_BYTE = {p: {ch: b for b, ch in reversed(list(enumerate(t)))} for p, t in _TABLE.items()}
_SOUND = frozenset(ch for p in ("cp1252", "cp1250") for ch in _TABLE[p] if ord(ch) > 160 and unicodedata.category(ch) != "Cc")
_LETTERS = frozenset(ch for ch in _SOUND if unicodedata.category(ch) in ("Ll", "Lu") and ch not in "ƒµ")


def _encode(text: str, page: str) -> bytes | None:
    try:
        return bytes(_BYTE[page][ch] for ch in text)
    except KeyError:
        return None


def _sequences(page: str) -> re.Pattern:
    group = lambda a, b: "[" + "".join(re.escape(_TABLE[page][i]) for i in range(a, b + 1)) + "]"
    more = group(0x80, 0xBF)
    return re.compile(f"{group(0xC2, 0xDF)}{more}|{group(0xE0, 0xEF)}{more}{{2}}|{group(0xF0, 0xF4)}{more}{{3}}")


_UTF8 = {p: _sequences(p) for p in READ_AS}
_FIRST = _TABLE["cp1252"]


def _unread(token: str, page: str) -> str:
    """UTF-8 sequences read in this page put right, where they give a character that the Latin code pages have."""

    def put(m: re.Match) -> str:
        try:
            ch = _encode(m[0], page).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        return ch if ch in _SOUND or ch in _FIRST[128:160] or 128 <= ord(ch) < 160 else m[0]

    return _UTF8[page].sub(put, token)


def _odd(token: str) -> bool:
    """Holds a character that sound words don't hold at that place."""
    for i, ch in enumerate(token):
        if ord(ch) < 128:
            continue
        before, after = token[i - 1 : i] if i else "", token[i + 1 : i + 2]
        if ch in _LETTERS:
            if ch.isupper() and before.islower():
                return True
        elif ch in SOUND_SIGNS:
            if before.isalpha() and after.isalpha() and ch not in "’‘–—·&ºª°":
                return True
            if before.isalpha() and (ch in "§½¼¾£€¡¿" or ch in "²³" and i > 2):  # m³ is sound, a longer word's end is not
                return True
        elif before.isalpha() or after.isalpha() or unicodedata.category(ch) == "Cc":
            return True
    return False


def _wordlike(token: str) -> bool:
    return not _odd(token) and all(ord(ch) < 128 or ch in _LETTERS or ch in "º°" for ch in token)


def repair_token(token: str) -> str | None:
    """The token as it was, None if it is sound or can't be put right by its characters alone."""
    if token.isascii() or LOST in token:
        return None
    found = []
    for page in READ_AS:
        now = token
        for _ in range(3):
            new = _unread(now, page)
            if page in ("cp1252", "latin-1"):
                new = _unread(new, "latin-1" if page == "cp1252" else "cp1252")
            if new == now:
                break
            now = new
        if now != token and not any(128 <= ord(ch) < 160 for ch in now) and not _odd(now):
            found.append(now)
    if found:  # of several code pages the first that keeps the word's case
        plain = re.sub("[^A-Za-z]", "", token)
        return next((x for x in found if x.isupper() or len(plain) < 2 or not plain.isupper()), found[0])
    if _odd(token):
        for written, read in GUESSED:
            raw = _encode(token, read)
            if raw is not None:
                new = "".join(_TABLE[written][b] for b in raw)
                if new != token and _wordlike(new):
                    return new
    return None


def garble(word: str) -> list[str]:
    """All garbled forms of a word that still hold its characters."""
    out = set()
    raw = word.encode("utf-8")
    for page in READ_AS:
        once = "".join(_TABLE[page][b] for b in raw)
        out |= {once, "".join(_TABLE[page][b] for b in once.encode("utf-8"))}
    for written, read in CODE_PAGES:
        one = _encode(word, written)
        if one is not None:
            out.add("".join(_TABLE[read][b] for b in one))
    return sorted(out - {word})


def lossy(word: str) -> str:
    """The word with a question mark for each character outside ASCII."""
    return "".join(ch if ord(ch) < 128 else "?" for ch in word)


def _judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        fixed = [repair_token(x) for x in s]
        clean = [f is None and not _odd(x) and LOST not in x and "?" not in x and any(ch in _SOUND for ch in x) for x, f in zip(s, fixed)]
        yield pd.DataFrame({"fixed": pd.Series(fixed, dtype=object), "clean": clean}, index=s.index)


def _forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([garble(x) for x in s], index=s.index, dtype=object)


def _pairs(c):
    """Letters outside ASCII with the one before and the one behind them."""
    padded = F.concat(F.lit("^"), F.lower(c), F.lit("$"))
    return F.array_distinct(F.concat(F.regexp_extract_all(padded, F.lit(r"(?=(.[^\x00-\x7F])).")), F.regexp_extract_all(padded, F.lit(r"(?=([^\x00-\x7F].))."))))


def token_repairs(tokens: DataFrame, stage) -> DataFrame:
    """tokens: (token, n), n the number of different values that hold it. Gives (token, restored, outcome, basis) for damaged tokens.

    basis: ``word`` if the restored word occurs clean in the corpus (the hash join with the garbled forms), ``pairs`` if it doesn't but
    each of its letters outside ASCII does, with both its neighbours, in clean words, ``letters`` if only the character rule speaks for it.
    """
    judge, forms = F.pandas_udf("fixed string, clean boolean")(_judge), F.pandas_udf("array<string>")(_forms)
    questions = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    judged = stage.write(tokens.select("token", "n", judge("token").alias("j")).select("token", "n", "j.fixed", "j.clean"), "judged")
    clean = judged.where("clean").select(F.col("token").alias("word"), F.col("n").alias("words"))
    table = clean.select("word", "words", F.explode(forms("word")).alias("token")).groupBy("token").agg(F.max(F.struct("words", "word")).alias("w"))
    by_word = judged.join(table, "token").where(f"w.words > if(length(token) < 4, {SHORT_FACTOR}, 1) * n or not clean").select("token", F.col("w.word").alias("known"))
    restored = judged.where("fixed is not null").select("token", "fixed").join(by_word, "token", "full_outer")
    asked = judged.where("instr(token, '?') > 0").select("token", "n")
    lost_forms = clean.select(questions("word").alias("token")).distinct().withColumn("form", F.lit(True))
    sound = asked.where(r"token rlike '^[^?]+[?]+\\W*$'").where(F.col("n") >= SOUND_COUNT).join(lost_forms, "token", "left_anti").select(F.lower("token").alias("near")).distinct()
    letters = F.lower("token")
    at = F.sequence(F.lit(1), F.length("token"))
    cut = F.transform(at, lambda i: F.concat(F.substring(letters, F.lit(1), i - 1), F.substring(letters, i + 1, F.length(letters))))
    swapped = F.transform(
        at, lambda i: F.concat(F.substring(letters, F.lit(1), i - 1), F.substring(letters, i + 1, F.lit(1)), F.substring(letters, i, F.lit(1)), F.substring(letters, i + 2, F.length(letters)))
    )
    near = asked.select("token", F.explode(F.array_distinct(F.concat(F.array(letters), cut, swapped))).alias("near")).join(sound, "near", "left_semi").select("token").distinct()
    gone = (
        asked.join(lost_forms, "token", "left")
        .where(F.col("form").isNotNull() | F.col("token").rlike(r"\?+[\p{L}]|[\p{L}]\?"))
        .join(near, "token", "left_anti")
        .select("token")
        .unionByName(judged.where(F.instr("token", LOST) > 0).select("token"))
    )
    sound_pairs = clean.select(F.explode(_pairs(F.col("word"))).alias("pair")).distinct()
    guessed = restored.where("known is null")
    strange = guessed.select("token", F.explode(_pairs(F.col("fixed"))).alias("pair")).join(sound_pairs, "pair", "left_anti").select("token").distinct().withColumn("strange", F.lit(True))
    basis = F.when(F.col("known").isNotNull(), "word").when(F.col("strange").isNull(), "pairs").otherwise("letters")
    return (
        restored.join(strange, "token", "left")
        .select("token", F.coalesce("known", "fixed").alias("restored"), F.lit("restored").alias("outcome"), basis.alias("basis"))
        .join(gone, "token", "left_anti")
        .unionByName(gone.distinct().select("token", F.lit(None).cast("string").alias("restored"), F.lit("lost").alias("outcome"), F.lit(None).cast("string").alias("basis")))
    )


def damaged_values(values: DataFrame, value: str, stage) -> DataFrame:
    """Columns value, restored, outcome, basis (the weakest of its tokens, see ``token_repairs``) for each different damaged value: ``restored`` with the original text, or ``lost`` (with what
    could be put right) if a token's original no longer follows from its characters.

    Only values with a character outside ASCII or a question mark are looked at; no other can be damaged. Null, empty and blank
    values are sound. A token in a third of all values is counted once per value with map-side partials.
    """
    texts = values.select(F.col(value).alias("value")).where(F.col(value).rlike(r"[^\x00-\x7F]|[?]")).distinct()
    texts = stage.write(texts, "values")
    parts = texts.select("value", F.posexplode(F.split("value", " ")).alias("at", "token"))
    counted = parts.where(F.col("token").rlike(r"[^\x00-\x7F]|[?]")).select("value", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    repairs = stage.write(token_repairs(counted, stage), "repairs")
    bad = parts.join(repairs, "token")
    hit = bad.groupBy("value").agg(F.max(F.when(F.col("outcome") == "lost", 1).otherwise(0)).alias("lost"), F.min("basis").alias("basis"), F.map_from_entries(F.collect_list(F.struct("at", F.coalesce("restored", "token").alias("t")))).alias("new"))
    pieces = F.transform(F.split("value", " "), lambda t, i: F.coalesce(F.element_at("new", i), t))
    return hit.select("value", F.array_join(pieces, " ").alias("restored"), F.when(F.col("lost") == 1, "lost").otherwise("restored").alias("outcome"), "basis")
