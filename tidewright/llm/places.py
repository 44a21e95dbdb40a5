"""The same postal address written differently.

Addresses are taken apart into town, postal code, house number, street name and street kind. What differs only by habit of writing
is learned from addresses that agree elsewhere:

* kinds of street: words in front or behind that go with many names, beside a list of usual ones; an abbreviation stands for a kind
  if the two meet under the same town and name more often than by chance (likelihood ratio);
* spellings: towns under one postal code, towns at large, and street names of one town and kind that are a few edits apart. A pair
  is a rewrite only on evidence: the commoner word dominates significantly, or so few unrelated words are near each other in this
  table that chance hardly explains the pair (see ``spelling_rewrites``).

Addresses are normalised with what was found, missing kinds and towns filled in, and everything is mined again on the normalised
names until a round finds no new rewrite. Addresses with the same normal form are one place.

Mining runs on dictionaries: (town, code), (town, street words), (scope, name), each with its count, so a place with a third of all
customers is one entry. Near words meet through deletion neighbourhoods, as hashes. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.canon import edits

#: Full words for kinds of street (folded); those of the second line are also written in one word with the name. More
#: kinds are mined.
KINDS = (
    "street road lane avenue boulevard drive court place rue chemin avenida calle plaza rua alameda travessa corso via piazza ulice namesti ulica plac aleja square terrace quai viale".split()
)
JOINED = "strasse weg platz ring allee gasse gatan vagen straat laan kade".split()
ALL_KINDS = frozenset(KINDS + JOINED)
#: Words for what lies inside a place (folded).
DETAILS = frozenset("floor og eg ug unit dock hinterhaus vorderhaus rear entrance lager building bat batiment suite apt apartment etage stock piso hall halle gate room warehouse ramp tor box block hof hinterhof".split())
#: Words that set off parts of a town.
PARTS = frozenset("nord sud ost west zentrum centre center centro north south east mitte".split())
MIN_SUPPORT = 3
#: A word goes with so many different names before it counts as a kind of street, and leads in so large a share of its pairs.
KIND_NAMES, KIND_SHARE = 20, 0.9
#: Chi-square with one degree of freedom at 0.001.
SIGNIFICANT = 10.83
#: Expected number of unrelated near words up to which a near word is taken for a slip.
CHANCE = 0.05
#: A word with more than this share of the two is no slip of the other (if significant).
SLIP_SHARE = 0.15
#: Rounds after which something must be wrong: each one removes words, so the mining ends long before.
MAX_ROUNDS = 50
#: Near pairs of one scope up to which a task settles the scope in its memory; larger ones are settled as tables, round by round.
SCOPE_PAIRS = 200_000
#: A postal code in front of a town: a word with a digit, perhaps in two parts.
_CODE = re.compile(r"((?:[a-z]{1,3}-)?(?=[a-z]{0,2}\d)[a-z0-9]{1,7}(?:-\d{2,4}(?![a-z0-9]))?(?:\s(?:(?=[a-z]{0,2}\d)[a-z0-9]{2,4}|[a-z]{2})(?=\s))?)\s+(?=[a-z�?])")
_LEADING_CODE = re.compile(r"\s*" + _CODE.pattern)
_GONE = "[�?]"
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")
_LETTERS = str.maketrans({"º": "°", "ß": "ss", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d"})
_NUMBER_SIGN = re.compile(r"\b(?:no|nr|n°|n\?|n�)\.?\s*(?=\d)|\bn\s*[░║]\s*(?=\d)")
_NUMBER = re.compile(r"(\d+)(?:\s?([a-z])\s*$|([a-z])(?![a-z.]))?")
_INNER_DOT, _DIGITS, _NO_WORD, _WORDS = re.compile(r"(?<=[a-z])\.(?=[a-z])"), re.compile(r"\d+"), re.compile(r"[^a-z�?.]+"), re.compile("[a-z]+")


def fold(text: str | None) -> str:
    if not text:
        return ""
    low = text.lower()
    if low.isascii():
        return low
    return _MARKS.sub("", unicodedata.normalize("NFD", re.sub("��+", "�", low.translate(_LETTERS))))


def _wild(token: str, words) -> str | None:
    """The word (the first in order) that a token with lost characters can be."""
    form = re.compile("".join(".{1,2}" if ch in "�?" else re.escape(ch) for ch in token))
    return next((w for w in sorted(words) if form.fullmatch(w)), None)


def spelled(word: str) -> str:
    """Key of a word: without blanks and signs, vowels written in two letters as one."""
    w = re.sub(r"[^a-z0-9�?]", "", word)
    return w.replace("ae", "a").replace("oe", "o").replace("ue", "u")


@functools.lru_cache(100_000)
def postal(text: str | None) -> str:
    """Letters and digits of a code, without country prefix, spreadsheet decimals and leading zeros; '' if it has no digit."""
    t = re.sub(r"\.0+$", "", fold(text).strip())
    t = re.sub(r"^[a-z]{1,3}-(?=[a-z0-9])", "", t)
    t = re.sub(r"[^a-z0-9]", "", t)
    return t.lstrip("0") if re.search(r"\d", t) else ""


@functools.lru_cache(100_000)
def town(text: str | None) -> tuple[str, str]:
    """(folded town, postal code in front of it); parts of towns and district numbers are left out."""
    t = re.sub(r"\(.*?\)|/.*$", " ", fold(text))
    code = ""
    m = _LEADING_CODE.match(t)
    if m and re.search(r"[a-z�]{3}", t[m.end() :]):
        code, t = postal(m[1]), t[m.end() :]
    words = [w for w in re.split(r"[^a-z�?]+", t) if w]
    while len(words) > 1 and words[-1] in PARTS:
        words.pop()
    return " ".join(words), code


def _detail(segment: str) -> bool:
    return any(w in DETAILS for w in _WORDS.findall(segment)) or segment.startswith("c/o")


def take_apart(text: str | None) -> tuple[str, str, str, str] | None:
    """(number with letter, tokens joined by blanks, town, postal code) of a street line; None without number or name."""
    segments = [s.strip() for s in fold(text).split(",")]
    place, code, main = "", "", []
    for i, s in enumerate(segments):
        if not s or len(segments) > 1 and _detail(s):
            continue
        m = _CODE.match(s) if i else None
        if m and re.search(r"[a-z�?]{3}", s[m.end() :]) and not re.fullmatch(r"\d{1,3}[a-z]?", m[1]):
            place, code = town(s)
            continue
        main.append(_INNER_DOT.sub("", s) if "." in s else s)
    number, rest = "", []
    for s in main:
        if "n" in s:
            s = _NUMBER_SIGN.sub(" ", s)
        m = None if number else _NUMBER.search(s)
        if m:
            number = m[1].lstrip("0") + (m[2] or m[3] or "")
            s = s[: m.start()] + " " + s[m.end() :]
        rest.append(_DIGITS.sub(" ", s))
    tokens = [w for w in _NO_WORD.split(" ".join(rest)) if w.strip(".")]
    return (number, " ".join(tokens), place, code) if tokens and number else None


def subsequence(short: str, full: str) -> bool:
    """An abbreviation: same first letter, its letters in this order in the full word."""
    it = iter(full)
    return short[:1] == full[:1] and len(short) < len(full) and all(ch in it for ch in short)


def splits(tokens: list[str], known: frozenset[str] | set[str]) -> list[tuple[str, str]]:
    """Ways to read tokens as (name, kind): a token on its own, or the end of the only token (one letter only before a dot)."""
    out = []
    bare = [t.strip(".") for t in tokens]
    if len(tokens) > 1:
        for i, t in enumerate(bare):
            if t in known or len(t) <= 4:
                out.append((spelled("".join(bare[:i] + bare[i + 1 :])), t))
    else:
        t, least = bare[0], 1 if tokens[0].endswith(".") else 2
        out += [(spelled(t[:n]), t[n:]) for n in range(4, len(t)) if t[n:] in known or least <= len(t) - n <= 4]
    return [(n, k) for n, k in out if len(n) >= 3]


def read_street(tokens: list[str], kinds: set[str] | frozenset[str], short: dict[str, list[str]], common: dict[str, float]) -> tuple[str, str]:
    """(name, kind) of a street. kinds and short: which of its words and endings are kinds, or abbreviations of which; common: how
    usual each kind is in the town. kind is '' if none is found."""
    known = kinds | ALL_KINDS

    def expand(t: str) -> str:
        if t in short:
            return max([*short[t], *([t] if t in ALL_KINDS else [])], key=lambda k: (common.get(k, 0.0), k))
        return t if t in known else ""

    dotted = tokens[-1].endswith(".")
    tokens = [t.strip(".") for t in tokens]
    if any(ch in t for t in tokens for ch in "�?"):
        usual = ALL_KINDS | set(common)
        tokens = [_wild(t, usual) or t if re.search(_GONE, t) else t for t in tokens]
        known = known | usual
    if len(tokens) > 1:
        whole = [i for i, t in enumerate(tokens) if t in known and t not in short] or [i for i, t in enumerate(tokens) if t in known] or [i for i, t in enumerate(tokens) if t in short]
        near = {}
        if not whole:
            near = {i: [k for k in sorted(common) if len(k) >= 3 and abs(len(t) - len(k)) <= 1 and _close(t, k)] for i, t in enumerate(tokens) if len(t) >= 4}
            whole = [i for i, ks in near.items() if ks]
        if whole:
            i = whole[-1] if tokens[whole[-1]] in JOINED else whole[0]
            kind = max(near[i], key=lambda k: (common[k], k)) if near.get(i) else expand(tokens[i])
            return spelled("".join(x for j, x in enumerate(tokens) if j != i)), kind
    t = "".join(tokens)
    for n in range(3, len(t)):
        if t[n:] in JOINED:
            return spelled(t[:n]), t[n:]
    for n in range(4, len(t)):
        tail = t[n:]
        if len(tail) > 2 and re.search(_GONE, tail) and (k := _wild(tail, JOINED)):
            return spelled(t[:n]), k
        ends = [k for k in short.get(tail, []) if k in JOINED]
        if ends and (len(tail) > 1 or dotted):
            return spelled(t[:n]), max(ends, key=lambda k: (common.get(k, 0.0), k))
        if len(tail) >= 4 and (ends := [k for k in JOINED if common.get(k) and abs(len(tail) - len(k)) <= 1 and _close(tail, k)]):
            return spelled(t[:n]), max(ends, key=lambda k: (common[k], k))
    return spelled(t), ""


def _close(a: str, b: str) -> bool:
    return edits(a, b) == 1


def _parsed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for streets, cities, codes in batches:
        out = []
        for s, c, p in zip(streets, cities, codes):
            t = take_apart(s)
            place, code = town(c)
            number, tokens, inner, inner_code = t or ("", "", "", "")
            out.append((number, tokens, place if len(place) > 2 else inner, postal(p) or code or inner_code))
        yield pd.DataFrame(out, columns=["number", "tokens", "town", "code"])


def _split_with(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for tokens, kinds in batches:
        yield pd.Series([[{"name": n, "kind": k} for n, k in splits(x.split(" "), ALL_KINDS.union(ks if ks is not None else ()))] for x, ks in zip(tokens, kinds)], index=tokens.index, dtype=object)


def _read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for tokens, kinds, short, common in batches:
        out = []
        for t, ks, pairs, usual in zip(tokens, kinds, short, common):
            table: dict[str, list[str]] = {}
            for p in pairs if pairs is not None else ():
                table.setdefault(p["short"], []).append(p["kind"])
            out.append(read_street(t.split(" "), set(ks) if ks is not None else set(), table, dict(usual) if usual is not None else {}))
        yield pd.DataFrame(out, columns=["name", "kind"])


def _apart(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edits between two words; a lost character is no edit if just that character is missing."""
    for a, b in batches:
        yield pd.Series([0 if re.search(_GONE, x) and _wild(x, [y]) else edits(x, y) for x, y in zip(a, b)], index=a.index, dtype="int32")


def _abbreviates(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([len(x.split()) == len(y.split()) and all(v == w or subsequence(v, w) for v, w in zip(x.split(), y.split())) for x, y in zip(a, b)], index=a.index)


def _spelled(c):
    out = F.regexp_replace(c, "[^a-z0-9�?]", "")
    for pair in ("ae", "oe", "ue"):
        out = F.replace(out, F.lit(pair), F.lit(pair[0]))
    return out


# ---- near words


def _limit(c):
    return F.when(F.length(c) < 4, 0).when(F.length(c) < 9, 1).otherwise(2)


_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(256)
def _shortened(n: int, two: bool) -> np.ndarray:
    """Which letters of a word of n letters are kept, as a row of places for each form (-1: none), less up to one or two letters."""
    cuts = [()] + [(i,) for i in range(n)] + ([(i, j) for i in range(n) for j in range(i + 1, n)] if two else [])
    return np.array([[k for k in range(n) if k not in c] + [-1] * len(c) for c in cuts], dtype=np.int64)


def _neighbours(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Hashes of (scope, word less some letters), distinct; all words of one length of a batch are worked on at once."""
    for scopes, words, twos in batches:
        out = [None] * len(words)
        groups: dict[tuple[int, bool], list[int]] = {}
        for i, (w, t) in enumerate(zip(words, twos)):
            groups.setdefault((len(w), bool(t)), []).append(i)
        for (n, two), rows in groups.items():
            keep = _shortened(n, two)
            powers = np.multiply.accumulate(np.full(n, _BASE, dtype=np.uint64)) if n else np.zeros(0, dtype=np.uint64)
            scope = scopes.to_numpy()[rows].astype(np.int64).view(np.uint64)
            step = max(1, 2_000_000 // max(1, keep.size))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                codes = np.frombuffer("".join(words.iloc[i] for i in part).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64).reshape(len(part), n)
                codes = np.concatenate([codes + np.uint64(1), np.zeros((len(part), 1), dtype=np.uint64)], axis=1)
                h = (codes[:, keep] * powers).sum(axis=2, dtype=np.uint64) + scope[k : k + step, None]
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                for i, row in zip(part, h.view(np.int64)):
                    out[i] = np.unique(row)
        yield pd.Series(out, index=words.index, dtype=object)


def near_words(words: DataFrame, leads: DataFrame) -> DataFrame:
    """words, leads (id, scope, word, n): pairs (scope, word, lead, n, m, d) of different words of one scope, d at most the edits that
    the lead's length allows (none under 4 letters, one under 9, else two). Complete: words so near share a form less d letters each.
    """
    hashes = F.pandas_udf("array<bigint>")(_neighbours)
    length = F.length("word")
    scope = F.xxhash64("scope")
    # a word meets leads of lengths it can be a slip of only
    reach = leads.where(length >= 4).groupBy("scope").agg(F.collect_set(F.least(length, F.lit(60))).alias("lengths"))
    near_length = lambda a, b: F.exists("lengths", lambda x: x.between(F.greatest(F.least(length, F.lit(60)) - b, F.lit(a)), F.least(length, F.lit(60)) + b))
    able = words.where(length >= 3).join(reach, "scope").select("id", "scope", "word", near_length(4, 1).alias("one"), near_length(9, 2).alias("two")).where("one or two")
    given = able.select("id", F.explode(hashes(scope, "word", "two")).alias("h"))
    asked = leads.where(length >= 4).select(F.col("id").alias("lead_id"), F.explode(hashes(scope, "word", length >= 9)).alias("h"))
    # merged: the planner takes the many hashes for as small as the words, and would collect them in the driver to broadcast them
    ids = given.hint("merge").join(asked, "h").where("id <> lead_id").select("id", "lead_id").distinct()
    met = ids.join(words.select("id", "scope", "word", "n"), "id").join(leads.select(F.col("id").alias("lead_id"), F.col("word").alias("lead"), F.col("n").alias("m"), F.col("scope").alias("s")), "lead_id")
    met = met.where("word <> lead and scope = s").withColumn("rough", F.levenshtein("word", "lead"))
    gone = F.col("word").rlike(_GONE)
    sure = ~gone & (F.col("rough") <= 1)
    exact = F.pandas_udf("int")(_apart)  # a swap is two edits for levenshtein, one here
    met = met.where(gone | (F.col("rough") <= 2 * _limit(F.col("lead"))))
    both = met.where(sure).withColumn("d", F.col("rough")).unionByName(met.where(~sure).withColumn("d", exact("word", "lead")))
    return both.where(F.col("d") <= _limit(F.col("lead"))).select("scope", "word", "lead", "n", "m", "d")


def near_pairs(forms: DataFrame, stage) -> DataFrame:
    """forms (id, scope, word, n, words and leads boolean: which may be rewritten, and which be leads): near pairs, in two parts so that
    the many slips of a common word aren't paired with each other: every word with every established lead (MIN_SUPPORT and more), then
    the words near none of those with each other. A word with an established lead never needs a rarer one."""
    first = stage.write(near_words(forms.where("words"), forms.where("leads").where(F.col("n") >= MIN_SUPPORT)), "near")
    rest = stage.write(forms.join(first.select("scope", "word").distinct(), ["scope", "word"], "left_anti").where(F.col("n") < MIN_SUPPORT), "rest")
    single = near_words(rest.where("words"), rest.where("leads"))
    return stage.write(first.unionByName(single), "pairs")


def _length_class(c):
    return F.when(F.length(c) < 6, 0).when(F.length(c) < 9, 1).otherwise(2)


def _stands(n, m):
    """Whether a word with n of n + m occurrences is more than the other's slip."""
    total = n + m
    excess = F.greatest(n - total * SLIP_SHARE, F.lit(0.0))
    return excess * excess / (total * SLIP_SHARE * (1 - SLIP_SHARE)) >= SIGNIFICANT


def chances(forms: DataFrame, near: DataFrame) -> tuple[DataFrame, dict[int, float], int]:
    """How many leads each scope has, and established ones (scope, all, some); by class of length of the lead the share of near
    ones that both stand among all pairs of an established word with an established lead, one more counted than was seen; and the
    number of near pairs of the scope that has the most."""
    frequent, size_class = F.col("n") >= MIN_SUPPORT, _length_class(F.col("word"))
    some = lambda c: F.sum(c.cast("bigint"))
    sizes = forms.groupBy("scope").agg(some(F.col("leads")).alias("all"), some(F.col("leads") & frequent).alias("some"), some(F.col("words") & frequent).alias("own"), *[some(F.col("leads") & frequent & (size_class == c)).alias(f"k{c}") for c in (0, 1, 2)])
    tried = sizes.agg(*[F.sum(F.col(f"k{c}") * F.greatest(F.col("own") - 1, F.lit(0)) / 2) for c in (0, 1, 2)]).first()
    stand = frequent & (F.col("m") >= F.col("n")) & _stands(F.col("n"), F.col("m"))
    pairs = near.groupBy("scope").agg(F.count(F.lit(1)).alias("pairs"), *[some(stand & (_length_class(F.col("lead")) == c)).alias(f"m{c}") for c in (0, 1, 2)])
    met = pairs.agg(*[F.sum(f"m{c}") for c in (0, 1, 2)], F.max("pairs")).first()
    return sizes.select("scope", "all", "some"), {c: min(1.0, ((met[c] or 0) + 1) / (float(tried[c] or 0) + 1)) for c in (0, 1, 2)}, met[3] or 0


def spelling_rewrites(near: DataFrame, rates: dict[int, float]) -> DataFrame:
    """near (scope, word, lead, d, n, m, all, some): rewrites (scope, word, n, next) to the nearest, then commonest, then smallest word.

    A rewrite needs evidence. (a) The lead is commoner (of ties the smaller word), and the word is not too frequent to be its slip.
    (b) Either the lead dominates: the likelihood ratio of the two counts against equal shares is significant. Or chance does not
    explain the pair: the rate at which established names stand near each other in this table, times the number of possible leads in
    the scope, gives at most CHANCE unrelated words near this one. So two words that occur once each stay apart in a table that has
    not shown near names to be slips.
    """
    rate = F.lit(1.0)
    for c in (0, 1, 2):
        rate = F.when(_length_class(F.col("lead")) == c, F.lit(rates[c])).otherwise(rate)
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    ratio = 2 * (m * F.log(2 * m / (n + m)) + n * F.log(2 * n / (n + m)))
    leads = F.when(F.col("m") >= MIN_SUPPORT, F.col("some")).otherwise(F.col("all"))
    good = near.where("m > n or (m = n and lead < word)").where(~_stands(F.col("n"), F.col("m"))).where((ratio > SIGNIFICANT) | (leads * rate <= CHANCE))
    return good.groupBy("scope", "word").agg(F.first("n").alias("n"), F.min(F.struct("d", -F.col("m"), "lead")).alias("b")).select("scope", "word", "n", F.col("b.lead").alias("next"))


def settle(forms: DataFrame, stage, near: DataFrame | None = None) -> DataFrame:
    """Mines and applies spelling rewrites until no new one appears; gives (scope, word, lead) for every rewritten word of forms
    (scope, word, n, perhaps words and leads: whether it may be rewritten, and be a lead).

    Which words are near each other is found once (or given); each round weighs those that are left by the counts after the rewrites
    so far. Every round removes at least one word, so it ends. Scopes don't concern each other: all rounds of a scope run in one task,
    those of a scope with more than SCOPE_PAIRS pairs over tables.
    """
    for c in ("words", "leads"):
        if c not in forms.columns:
            forms = forms.withColumn(c, F.lit(True))
    if near is None:
        forms = stage.write(forms.select(F.monotonically_increasing_id().alias("id"), "scope", "word", "n", "words", "leads"), "forms")
        near = near_pairs(forms, stage)
    sizes, rates, most = chances(forms, near)
    near, large = near.join(sizes, "scope"), None
    if most > SCOPE_PAIRS:
        wide = stage.write(near.groupBy("scope").agg(F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") > SCOPE_PAIRS).select("scope"), "wide")
        large = settle_large(near.join(wide, "scope", "left_semi"), rates, stage)
        near = near.join(wide, "scope", "left_anti")
    rows = near.select("scope", "word", "lead", "d", "n", "m", "all", "some").repartition("scope").sortWithinPartitions("scope")
    small = stage.write(rows.mapInPandas(_settler(rates), "scope string, word string, lead string"), "settled")
    return small if large is None else small.unionByName(large)


def settled(pairs: list[tuple], rates: dict[int, float]) -> dict[str, str]:
    """pairs (scope, word, lead, d, n, m, all, some) of one scope: the lead at the end of each rewritten word, as ``settle_large``."""
    near: dict[str, list[tuple[int, str]]] = {}
    count: dict[str, int] = {}
    for _, word, lead, d, n, m, every, some in pairs:
        near.setdefault(word, []).append((d, lead))
        count[word], count[lead] = n, m

    def good(word: str, lead: str) -> bool:
        n, m = count[word], count[lead]
        if n > m or n == m and lead > word:
            return False
        excess = max(n - (n + m) * SLIP_SHARE, 0.0)
        if excess * excess / ((n + m) * SLIP_SHARE * (1 - SLIP_SHARE)) >= SIGNIFICANT:
            return False
        rate = rates[0 if len(lead) < 6 else 1 if len(lead) < 9 else 2]
        return (some if m >= MIN_SUPPORT else every) * rate <= CHANCE or 2 * (m * math.log(2 * m / (n + m)) + n * math.log(2 * n / (n + m))) > SIGNIFICANT

    mapping: dict[str, str] = {}
    while True:
        found = {}
        for word, leads in near.items():
            if ranked := [(d, -count[lead], lead) for d, lead in leads if good(word, lead)]:
                found[word] = min(ranked)[2]
        if not found:
            break
        won: dict[str, int] = {}
        for word, lead in found.items():
            for _ in range(2):  # a lead that is rewritten in the same round
                lead = found.get(lead, lead)
            mapping[word] = lead
            won[lead] = won.get(lead, 0) + count[word]
        for lead, n in won.items():
            count[lead] += n
        near = {word: left for word, leads in near.items() if word not in found and (left := [x for x in leads if x[1] not in found])}
    for word, lead in mapping.items():
        while lead in mapping:
            lead = mapping[lead]
        mapping[word] = lead
    return mapping


def _settler(rates: dict[int, float]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def settle_scopes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(*(b[c] for c in b.columns)))
        out: list[tuple[str, str, str]] = []
        for scope, pairs in itertools.groupby(rows, operator.itemgetter(0)):
            out += [(scope, word, lead) for word, lead in settled(list(pairs), rates).items()]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["scope", "word", "lead"])
                out = []
        yield pd.DataFrame(out, columns=["scope", "word", "lead"])

    return settle_scopes


def settle_large(near: DataFrame, rates: dict[int, float], stage) -> DataFrame:
    """near (scope, word, lead, d, n, m, all, some): the rounds of ``settle`` over tables."""
    mapping = None
    for _ in range(MAX_ROUNDS):
        found = stage.write(spelling_rewrites(near, rates), "rewrites")
        if found.isEmpty():
            return _followed(mapping, stage) if mapping is not None else found.select("scope", "word", F.col("next").alias("lead"))
        onto = found.select("scope", F.col("word").alias("next"), F.col("next").alias("beyond"))
        ends = found
        for _ in range(2):  # a lead that is rewritten in the same round
            ends = ends.join(onto, ["scope", "next"], "left").select("scope", "word", "n", F.coalesce("beyond", "next").alias("next"))
        found = stage.write(ends, "ends")
        step = found.select("scope", "word", F.col("next").alias("lead"))
        if mapping is not None:
            onward = found.select("scope", F.col("word").alias("lead"), "next")
            step = mapping.join(onward, ["scope", "lead"], "left").select("scope", "word", F.coalesce("next", "lead").alias("lead")).unionByName(step)
        mapping = stage.write(step, "settled")
        # pairs of words that are left, with what their words have won
        won = found.groupBy("scope", "next").agg(F.sum("n").alias("won"))
        gone = found.select("scope", "word")
        left = near.join(gone, ["scope", "word"], "left_anti").join(gone.withColumnRenamed("word", "lead"), ["scope", "lead"], "left_anti")
        for side, count in (("word", "n"), ("lead", "m")):
            left = left.join(won.withColumnRenamed("next", side), ["scope", side], "left").withColumn(count, F.col(count) + F.coalesce("won", F.lit(0))).drop("won")
        near = stage.write(left, "left")
    raise RuntimeError(f"spellings still change after {MAX_ROUNDS} rounds")


def _followed(mapping: DataFrame, stage) -> DataFrame:
    """mapping (scope, word, lead) with every lead that is a rewritten word itself followed to its end."""
    while True:
        onto = mapping.select("scope", F.col("word").alias("lead"), F.col("lead").alias("beyond"))
        if mapping.join(onto, ["scope", "lead"], "left_semi").isEmpty():
            return mapping
        mapping = stage.write(mapping.join(onto, ["scope", "lead"], "left").select("scope", "word", F.coalesce("beyond", "lead").alias("lead")), "followed")


# ---- towns


def town_rewrites(towns: DataFrame) -> DataFrame:
    """towns (town, n): rewrites (town, lead) of towns of several words to the commonest commoner one with the same last word and the
    same initials, of which the other words are abbreviated."""
    short = F.pandas_udf("boolean")(_abbreviates)
    words = F.split("town", " ")
    group = F.array_join(F.transform(words, lambda w, i: F.when(i < F.size(words) - 1, F.left(w, F.lit(1))).otherwise(w)), " ")
    parts = towns.where("instr(town, ' ') > 0").select("town", "n", group.alias("g"))
    pairs = parts.join(parts.select("g", F.col("town").alias("lead"), F.col("n").alias("m")), "g").where("length(town) < length(lead) and m >= n").where(short("town", "lead"))
    return pairs.groupBy("town").agg(F.max(F.struct("m", "lead")).alias("b")).select("town", F.col("b.lead").alias("lead"))


def place_of_towns(towns: DataFrame, stage) -> DataFrame:
    """towns (town, code, n), either may be '': the place (town, code, place) each stands for; '' if nothing says.

    Abbreviated words, spelling within a postal code, spelling at large, then the code's town if it has none."""
    long = town_rewrites(towns.where("town <> ''").groupBy("town").agg(F.sum("n").alias("n")))
    at = stage.write(towns.join(long, "town", "left").withColumn("word", _spelled(F.coalesce("lead", "town"))).drop("lead"), "long")
    named = at.where("word <> ''")
    # near words are found among all towns; those of a postal code are the ones of them that both occur under it
    wide = named.groupBy(F.lit("").alias("scope"), "word").agg(F.sum("n").alias("n")).withColumns({"words": F.lit(True), "leads": F.lit(True)})
    wide = stage.write(wide.select(F.monotonically_increasing_id().alias("id"), "scope", "word", "n", "words", "leads"), "forms")
    near = near_pairs(wide, stage)
    local = named.where("code <> ''").groupBy(F.concat(F.lit("c"), "code").alias("scope"), "word").agg(F.sum("n").alias("n"))
    local = stage.write(local.withColumns({"words": F.lit(True), "leads": F.lit(True)}), "by_code")
    by_code = local.join(near.select("word", "lead", "d"), "word").join(local.select("scope", F.col("word").alias("lead"), F.col("n").alias("m")), ["scope", "lead"])
    near = stage.write(near.unionByName(by_code.select("scope", "word", "lead", "n", "m", "d")), "near")
    found = settle(wide.drop("id").unionByName(local), stage, near)
    for scope in (F.concat(F.lit("c"), "code"), F.lit("")):
        at = at.withColumn("scope", scope).join(found, ["scope", "word"], "left").withColumn("word", F.coalesce("lead", "word")).drop("scope", "lead")
    at = stage.write(at, "spelled")
    shares = at.where("word <> '' and code <> ''").groupBy("code", "word").agg(F.sum("n").alias("n"))
    of_code = shares.groupBy("code").agg(F.max(F.struct("n", "word")).alias("m"), F.sum("n").alias("t")).where("m.n >= 0.6 * t").select("code", F.col("m.word").alias("home"))
    at = at.join(of_code, "code", "left")
    return stage.write(at.select("town", "code", F.when(F.col("word") != "", F.col("word")).otherwise(F.coalesce("home", F.lit(""))).alias("place")), "places")


# ---- kinds of street


def mined_kinds(streets: DataFrame) -> DataFrame:
    """streets (tokens): words (kind) in front of or behind KIND_NAMES and more different names, that go with more names than the name
    goes with words in KIND_SHARE of these pairs."""
    words = F.split(F.replace("tokens", F.lit("."), F.lit("")), " ")
    many = streets.select(words.alias("w")).where("size(w) > 1").distinct()
    ends = many.select(F.inline(F.array(F.struct(F.element_at("w", -1).alias("word"), F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), "").alias("name")), F.struct(F.element_at("w", 1).alias("word"), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), "").alias("name"))))).distinct()
    rich = ends.groupBy("word").agg(F.count(F.lit(1)).alias("names"))
    often = ends.join(rich.where(F.col("names") >= KIND_NAMES), "word").join(rich.select(F.col("word").alias("name"), F.col("names").alias("own")), "name", "left")
    share = F.avg((F.col("names") > F.coalesce("own", F.lit(0))).cast("double"))
    return often.where("length(word) >= 3").groupBy(F.col("word").alias("kind")).agg(share.alias("s")).where(F.col("s") >= KIND_SHARE).select("kind")


def kind_rewrites(seen: DataFrame, kinds: DataFrame, same_number: float, stage) -> DataFrame:
    """seen (town, number, name, kind), kinds (kind): abbreviations (short, kind) of kinds, mined from addresses that agree in town,
    number and name.

    In MIN_SUPPORT contexts and more, and significant by a likelihood ratio: either the two meet in one context more often than the
    abbreviation meets any kind; or streets of one name agree in house numbers more often than by chance (same_number: that two
    lines have the same number). A context is a set of kinds, however many addresses it has.
    """
    flagged = seen.join(kinds.withColumn("full", F.lit(True)), "kind", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    able = (F.length("kind") <= 4) & ~F.col("kind").isin(sorted(ALL_KINDS))
    cell = F.struct("kind", "full", able.alias("able"))
    contexts = flagged.groupBy("town", "name", "number").agg(F.collect_set(cell).alias("ks"))
    shorts, fulls = F.filter("ks", lambda k: k["able"]), F.filter("ks", lambda k: k["full"])
    both = F.flatten(F.transform(shorts, lambda a: F.transform(fulls, lambda b: F.struct(a["kind"].alias("short"), b["kind"].alias("kind")))))
    alone = F.when(F.size(fulls) > 0, F.transform(shorts, lambda a: F.struct(a["kind"].alias("short"), F.lit("").alias("kind")))).otherwise(F.array().cast("array<struct<short:string,kind:string>>"))
    total = F.transform(fulls, lambda b: F.struct(F.lit("").alias("short"), b["kind"].alias("kind")))
    counted = contexts.select(F.inline(F.concat(both, alone, total))).where("short <> kind").groupBy("short", "kind").agg(F.count(F.lit(1)).alias("n"))
    streets = flagged.groupBy("town", "name", "kind", "full").agg(F.count(F.lit(1)).alias("x"))
    streets = streets.groupBy("town", "name").agg(F.collect_list(F.struct("kind", "full", able.alias("able"), "x")).alias("ks")).where(F.exists("ks", lambda k: k["able"]) & F.exists("ks", lambda k: k["full"]))
    met = F.flatten(F.transform(shorts, lambda a: F.transform(fulls, lambda b: F.struct(a["kind"].alias("short"), b["kind"].alias("kind"), (a["x"] * b["x"]).alias("xy")))))
    chance = streets.select(F.inline(met)).groupBy("short", "kind").agg(F.sum("xy").alias("xy"))
    counted = stage.write(counted, "counted")
    all_ = float(counted.where("short = ''").agg(F.sum("n")).first()[0] or 1)
    abbreviated = F.pandas_udf("boolean")(_subsequences)
    pairs = counted.where((F.col("short") != "") & (F.col("kind") != "") & (F.col("n") >= MIN_SUPPORT)).where(abbreviated("short", "kind"))
    judged = pairs.join(counted.where("kind = ''").select("short", F.col("n").alias("a")), "short").join(counted.where("short = ''").select("kind", F.col("n").alias("b")), "kind").join(chance, ["short", "kind"])
    n = F.col("n")

    def beyond(expected):
        return (n > expected) & (2 * (n * F.log(n / expected) - (n - expected)) > SIGNIFICANT)

    return judged.where(beyond(F.col("a") * F.col("b") / F.lit(all_)) | beyond(F.col("xy") * F.lit(same_number))).select("short", "kind")


def _subsequences(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([subsequence(x, y) for x, y in zip(a, b)], index=a.index, dtype=bool)


def _pieces(tokens):
    """Words of a street and endings of the words written as one, without dots."""
    bare = F.replace(tokens, F.lit("."), F.lit(""))
    joined = F.replace(bare, F.lit(" "), F.lit(""))
    ends = F.transform(F.sequence(F.lit(4), F.greatest(F.length(joined), F.lit(4))), lambda i: F.substring(joined, i, F.length(joined)))
    return F.array_distinct(F.concat(F.split(bare, " "), ends))


def read_streets(streets: DataFrame, kinds: DataFrame, short: DataFrame, usual: DataFrame) -> DataFrame:
    """streets (place, tokens, n) with name and kind. The kinds and abbreviations that concern a street are joined to it, so their
    number is not limited."""
    pieces = streets.select("tokens").distinct().select("tokens", F.explode(_pieces(F.col("tokens"))).alias("short"))
    table = kinds.select(F.col("kind").alias("short"), F.lit(None).cast("string").alias("kind")).unionByName(short)
    found = pieces.join(table, "short").groupBy("tokens").agg(F.collect_set(F.when(F.col("kind").isNull(), F.col("short"))).alias("kinds"), F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("short", "kind"))).alias("short"))
    read = F.pandas_udf("name string, kind string")(_read)
    rows = streets.join(found, "tokens", "left").join(usual, "place", "left")
    return rows.withColumn("s", read("tokens", "kinds", "short", "common")).select("place", "tokens", "n", "s.name", "s.kind")


# ---- all together


def _fill_kind(streets: DataFrame) -> DataFrame:
    """A missing kind follows if the town has the name with one kind."""
    single = streets.where("kind <> '' and place <> ''").groupBy("place", "name").agg(F.min("kind").alias("only"), F.max("kind").alias("x")).where("only = x").select("place", "name", "only")
    return streets.join(single, ["place", "name"], "left").withColumn("kind", F.when(F.col("kind") != "", F.col("kind")).otherwise(F.coalesce("only", F.lit("")))).drop("only")


def _fill_town(streets: DataFrame) -> DataFrame:
    """at: the town, or if it is missing the only one that has the street."""
    home = streets.where("place <> ''").groupBy("name", "kind").agg(F.min("place").alias("home"), F.max("place").alias("x")).where("home = x").select("name", "kind", "home")
    return streets.join(home, ["name", "kind"], "left").withColumn("at", F.when(F.col("place") != "", F.col("place")).otherwise(F.coalesce("home", F.lit("")))).drop("home")


def _spell(streets: DataFrame, stage) -> DataFrame:
    """streets with their names settled within town and kind, after names without a kind were compared with all of the town, and names
    without a town with all of the kind; missing kinds and towns filled."""
    inside, of_town, of_kind = F.concat(F.lit("i"), "place", F.lit("|"), "kind"), F.concat(F.lit("p"), "place"), F.concat(F.lit("k"), "kind")
    place, kind = F.col("place") != "", F.col("kind") != ""

    def entry(scope, words: bool, leads: bool):
        return F.struct(scope.alias("scope"), F.lit(words).alias("words"), F.lit(leads).alias("leads"))

    # names of full streets are leads for those without a kind or town; a name that is a full street's there isn't rewritten
    entries = F.when(place & kind, F.array(entry(inside, True, True), entry(of_town, False, True), entry(of_kind, False, True)))
    entries = entries.when(place & ~kind, F.array(entry(of_town, True, True))).when(~place & kind, F.array(entry(of_kind, True, False)))
    full = F.bool_or(~F.col("words"))
    forms = streets.select(F.col("name").alias("word"), "n", F.inline(entries)).groupBy("scope", "word")
    forms = forms.agg(F.when(full, F.sum(F.when(~F.col("words"), F.col("n")))).otherwise(F.sum("n")).alias("n"), F.bool_or("words").alias("asks"), (~full).alias("words"), F.bool_or("leads").alias("leads"))
    forms = forms.join(forms.where("asks").select("scope").distinct(), "scope", "left_semi").drop("asks")
    found = settle(forms, stage).withColumnRenamed("word", "name").withColumnRenamed("scope", "_scope")

    def apply(rows: DataFrame, scope) -> DataFrame:
        return rows.withColumn("_scope", scope).join(found, ["_scope", "name"], "left").withColumn("name", F.coalesce("lead", "name")).drop("_scope", "lead")

    poor = apply(streets, F.when(place & ~kind, of_town).when(~place & kind, of_kind))
    filled = stage.write(_fill_town(_fill_kind(poor)), "filled")
    spelled_ = apply(filled, F.when((F.col("at") != "") & kind, F.concat(F.lit("i"), "at", F.lit("|"), "kind"))).drop("at")
    return stage.write(_fill_town(_fill_kind(spelled_)), "spelled")


def _tidy(spark) -> bool:
    """Many small jobs leave broadcasts and shuffle files that Spark drops only once the driver's JVM has collected their handles, and
    freed native memory that the C library keeps for each of the JVM's many threads; that goes back to the system. False if this JVM
    can't give it back (before 17.0.9, or not on Linux)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:
        # by reflection: the server's own class isn't open to py4j
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        arguments = gateway.new_array(jvm.Object, 4)
        arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JError:
        return False
    return True


def normal_addresses(rows: DataFrame, key: str, street: str, city: str, code: str, stage, repaired: DataFrame | None = None) -> DataFrame:
    """Columns key, town, name, kind, number: the normal form of each record's address; records without key, number, name or town are
    left out; repeated rows count once.

    repaired (value, restored): street lines whose encoding was put right. A town that is missing follows from the postal code,
    or from the street if only one town has it.
    """
    text = rows.select(F.col(key).alias("key"), F.col(street).alias("street"), F.col(city).alias("city"), F.col(code).alias("code")).where("key is not null and street is not null")
    if repaired is not None:
        text = text.join(repaired.select(F.col("value").alias("street"), "restored"), "street", "left").select("key", F.coalesce("restored", "street").alias("street"), "city", "code")
    parse = F.pandas_udf("number string, tokens string, town string, code string")(_parsed)
    # the number stands out of the words, so what is left of the many lines are few (town, words)
    parsed = stage.write(text.withColumn("p", parse("street", "city", "code")).select("key", "p.*").distinct(), "parsed")
    spark = rows.sparkSession
    _tidy(spark)
    towns = stage.write(parsed.groupBy("town", "code").agg(F.count(F.lit(1)).alias("n")), "towns")
    places = place_of_towns(towns, stage)
    lines = parsed.where("tokens <> ''").join(places, ["town", "code"]).groupBy("place", "tokens", "number").agg(F.count(F.lit(1)).alias("n"))
    lines = stage.write(lines, "lines")
    streets = stage.write(lines.groupBy("place", "tokens").agg(F.sum("n").alias("n")), "streets")

    _tidy(spark)
    seeds = spark.createDataFrame([(k,) for k in sorted(ALL_KINDS)], "kind string")
    kinds = stage.write(seeds.unionByName(mined_kinds(streets)).distinct(), "kinds")
    split = F.pandas_udf("array<struct<name:string,kind:string>>")(_split_with)
    own = streets.select("tokens").distinct().select("tokens", F.explode(_pieces(F.col("tokens"))).alias("kind")).join(kinds, "kind").groupBy("tokens").agg(F.collect_set("kind").alias("kinds"))
    ways = streets.where("place <> ''").select("tokens").distinct().join(own, "tokens", "left").select("tokens", F.explode(split("tokens", "kinds")).alias("s")).select("tokens", "s.name", "s.kind")
    ways = stage.write(ways.join(kinds.withColumn("full", F.lit(True)), "kind", "left").where(F.col("full") | (F.length("kind") <= 4)), "ways")
    usual = streets.where("place <> ''").join(ways.where("full"), "tokens").groupBy("place", "kind").agg(F.sum("n").cast("double").alias("n"))
    usual = stage.write(usual.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("common")), "usual")

    seen = stage.write(lines.where("place <> ''").join(ways, "tokens").select(F.col("place").alias("town"), "number", "name", "kind").distinct(), "seen")
    numbers = lines.groupBy("number").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.col("k") * F.col("k")), F.sum("k")).first()
    same_number = float(numbers[0]) / float(numbers[1]) ** 2 if numbers[1] else 1.0
    short = stage.write(kind_rewrites(seen, kinds, same_number, stage), "short")
    for _ in range(MAX_ROUNDS):
        _tidy(spark)
        read = stage.write(read_streets(streets, kinds, short, usual), "read")
        done = _spell(read, stage)
        _tidy(spark)
        # mined again, on the normalised names
        same = done.where("place <> ''").join(read.select("place", "tokens", F.col("name").alias("was")), ["place", "tokens"]).where("name <> was")
        names = same.groupBy(F.col("place").alias("town"), F.col("was").alias("name")).agg(F.min("name").alias("now"))
        again = seen.join(names, ["town", "name"], "left").select("town", "number", F.coalesce("now", "name").alias("name"), "kind").distinct()
        new = stage.write(kind_rewrites(again, kinds, same_number, stage).unionByName(short).distinct(), "short")
        if new.join(short, ["short", "kind"], "left_anti").isEmpty():
            break
        short = new
    else:
        raise RuntimeError(f"abbreviations still change after {MAX_ROUNDS} rounds")
    normal = parsed.where("tokens <> '' and number <> ''").join(places, ["town", "code"]).join(done.select("place", "tokens", "at", "name", "kind"), ["place", "tokens"]).where("at <> '' and name <> ''")
    return stage.write(normal.select(F.col("key").alias(key), F.col("at").alias("town"), "name", "kind", "number").distinct(), "normal")


def pairs_of_places(normal: DataFrame, key: str, place: list[str]) -> DataFrame:
    """All pairs (a, b), a < b, of keys at one place. The pairs are the result asked for; AQE splits places with very many keys."""
    one = normal.select(F.col(key).alias("a"), *place)
    two = normal.select(F.col(key).alias("b"), *place)
    return one.join(two, place).where("a < b").select("a", "b").distinct()
