"""Mapping freely typed values to a canonical list.

Each distinct token of the distinct values is joined to the reference vocabulary by edit distance (through deletion
neighbourhoods, so it is an equi-join), prefix or initials; the corrected tokens of a value are then compared with every complete
reference form by soft TF-IDF, and the best form above a threshold gives the code. Values are compared with entries whose numbers
are the same only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import fold_latin

UNMATCHED = "UNMATCHED"
THRESHOLD = 0.6
#: The reference list is held by every task; it may have this many rows.
MAX_REFERENCE = 20_000
#: Words that weigh little in a form.
LIGHT = {"of", "on", "in", "per", "within", "by", "zum", "the", "if", "plus", "and", "upon", "days", "tage", "d", "t"}
LIGHT_WEIGHT = 0.3
DAYS = {"days", "tage"}
#: Usual ways to write words of the lists that no edit, prefix or initials explain.
ALIASES = {
    "PAYMENT_TERMS": {
        "n": "net", "nett": "net", "netto": "net", "jours": "days", "day": "days", "tagen": "tage", "d": "days", "t": "tage", "j": "days", "mth": "month", "pct": "",
        "skonto": "", "zahlbar": "net", "once": "immediately", "at": "", "payable": "due", "prepayment": "payment advance", "prepaid": "payment advance",
        "pre": "advance", "vorkasse": "vorauskasse", "sepa": "", "if": "", "within": "", "cheque": "", "prox": "month",
    },
    "COUNTRY": {"utd": "united", "un": "united", "rep": "republique", "uk": "united kingdom"},
}
#: Values of these domains can name an entry twice, in parts set off by a sign.
PARTED = {"COUNTRY"}


def _norm(c):
    return F.regexp_replace(fold_latin(F.regexp_replace(c, r"[_\s\p{Z}]+", " ")), r"[^a-z0-9 /()\-.,%+]", " ")


def _fold(text: str) -> str:
    import unicodedata

    low = "".join(ch for ch in unicodedata.normalize("NFD", text.lower().replace("ß", "ss")) if not unicodedata.combining(ch))
    return low.replace("ł", "l").replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ı", "i")


def words_of(text: str) -> tuple[list[str], tuple[int, ...]]:
    """The runs of letters and the numbers of a folded text."""
    return re.findall(r"[a-z]+", text), tuple(sorted({int(x) for x in re.findall(r"[0-9]+", text)}))


def limit(length: int) -> int:
    """Edits allowed to a reference word of this length."""
    return 0 if length < 4 else 1 if length < 9 else 2


def edits(a: str, b: str) -> int:
    """Edit distance in which swapping two neighbours, with or without an edit between them, counts as such (Damerau)."""
    most = len(a) + len(b)
    d = [[most] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        last = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), last
            if x == y:
                last = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return d[-1][-1]


def deletions(word: str, most: int) -> list[str]:
    out = {word}
    for n in range(1, most + 1):
        out |= {"".join(ch for i, ch in enumerate(word) if i not in cut) for cut in map(set, combinations(range(len(word)), n))}
    return sorted(out)


class Reference:
    """The canonical list, taken apart: forms, vocabulary, weights."""

    def __init__(self, rows: list[tuple[str, str, str | None, str | None, str | None]]):
        self.codes: dict[tuple[str, str], str] = {}
        self.forms: dict[str, list[tuple[str, list[str], tuple[int, ...], str]]] = {}
        self.words: dict[str, dict[str, float]] = {}
        self.initials: dict[str, dict[str, set[tuple[str, ...]]]] = {}
        for domain, code, alt, *names in rows:
            for c in (code, alt):
                if c and c.strip():
                    self.codes.setdefault((domain, re.sub(r"[^a-z0-9]", "", _fold(c))), code)
            for name in names:
                if name and name.strip():
                    w, numbers = words_of(_fold(name))
                    self.forms.setdefault(domain, []).append((code, [self._alias(domain, x)[0] if len(self._alias(domain, x)) == 1 else x for x in w], numbers, "".join(w)))
        for domain, forms in self.forms.items():
            seen: dict[str, set[str]] = {}
            for code, w, _, _ in forms:
                for x in w:
                    seen.setdefault(x, set()).add(code)
            n = len({f[0] for f in forms})
            self.words[domain] = {x: LIGHT_WEIGHT if x in LIGHT else math.log(1 + n / len(s)) for x, s in seen.items()}
            short = self.initials.setdefault(domain, {})
            for _, w, _, _ in forms:
                for i, j in combinations(range(len(w) + 1), 2):
                    for part in (w[i:j], [x for x in w[i:j] if x not in LIGHT]):
                        if len(part) > 1:
                            short.setdefault("".join(x[0] for x in part), set()).add(tuple(part))

    @staticmethod
    def _alias(domain: str, word: str) -> list[str]:
        return ALIASES.get(domain, {}).get(word, word).split() if word in ALIASES.get(domain, {}) else [word]

    def vocabulary(self) -> list[tuple[str, str, str]]:
        """(domain, word, kind): single words, and whole forms without blanks."""
        out = {(d, w, "word") for d, ws in self.words.items() for w in ws}
        out |= {(d, f[3], "whole") for d, fs in self.forms.items() for f in fs if len(f[3]) > 3}
        return sorted(out)

    def rank(self, domain: str, text: str, known: dict[str, list[tuple[str, float]]]) -> tuple[str, float]:
        """(code or UNMATCHED, score) of a folded value; known: for each of its tokens the reference words it may be."""
        compact = re.sub(r"[^a-z0-9]", "", text)
        if not compact:
            return UNMATCHED, 0.0
        if (domain, compact) in self.codes:
            return self.codes[domain, compact], 1.0
        if domain in PARTED:
            parts = [p for p in re.split(r"[/()\-,]", text) if re.search(r"[a-z0-9]", p)]
            if len(parts) > 1:
                got = [self.rank(domain, p, known) for p in parts]
                matched = {c for c, _ in got if c != UNMATCHED}
                if len(matched) == 1:
                    return matched.pop(), max(s for _, s in got)
        first, _, rest = text.strip(" .,;()-/").partition(" ")
        if rest and (domain, first) in self.codes:
            code, numbers = self.codes[domain, first], words_of(rest)[1]
            if any(c == code and n == numbers for c, _, n, _ in self.forms[domain]):
                return code, 1.0
        return self._soft(domain, text, known)

    def _soft(self, domain: str, text: str, known) -> tuple[str, float]:
        raw, numbers = words_of(text)
        whole = "".join(raw)
        weights = self.words.get(domain, {})
        heavy = max(weights.values(), default=1.0)
        short = self.initials.get(domain, {})
        tokens: list[list[tuple[str, float]]] = []
        for t in raw if whole not in short or len(raw) == 1 else [whole]:
            if t in short and t not in weights and len(t) > 1 and t not in ALIASES.get(domain, {}):
                tokens += [[(w, 1.0)] for w in max(short[t], key=lambda p: (sum(weights.get(w, 0) for w in p), p))]
                continue
            for a in self._alias(domain, t):
                if a in weights or a not in LIGHT:
                    tokens.append([(a, 1.0)] if a in weights else known.get(a, []))
        flat = [w for choice in tokens for w, _ in choice[:1]]
        if domain == "PAYMENT_TERMS" and numbers and DAYS & set(flat) and all(w in LIGHT or w == "due" for w in flat) and all(tokens):
            tokens = [[("days", 1.0)], [("net", 1.0)]]  # a bare number of days
        best = (UNMATCHED, 0.0)
        for code, form, need, joined in self.forms.get(domain, []):
            if need != numbers:
                continue
            dot = square = 0.0
            used: set[str] = set()
            for choice in tokens:
                hit = max(((s, w) for w, s in choice if w in form and w not in used), default=None)
                w = weights[hit[1]] if hit else max((weights[w] for w, _ in choice if w in weights), default=heavy)
                square += w * w
                if hit:
                    used.add(hit[1])
                    dot += w * w * hit[0]
            size = sum(weights[w] ** 2 for w in set(form))
            score = dot / math.sqrt(square * size) if square and size else 0.0
            score = max([score, *(s for w, s in known.get(whole, []) if w == joined)])
            if score > best[1] + 1e-9 or abs(score - best[1]) <= 1e-9 and score > 0 and code < best[0]:
                best = (code, score)
        return best if best[1] >= THRESHOLD else (UNMATCHED, best[1])


def _variants(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for words, most in batches:
        yield pd.Series([deletions(w, m) for w, m in zip(words, most)], index=words.index, dtype=object)


def _distances(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([edits(x, y) for x, y in zip(a, b)], index=a.index, dtype="int32")


def repair_tokens(tokens: DataFrame, vocabulary: DataFrame, longest: int) -> DataFrame:
    """tokens (domain, token), vocabulary (domain, word, kind), its longest word; gives (domain, token, word, sim) of all words a token
    may stand for. A token more than two letters longer than every word is near none."""
    variants, distance = F.pandas_udf("array<string>")(_variants), F.pandas_udf("int")(_distances)
    allowed = lambda c: F.when(F.length(c) < 4, 0).when(F.length(c) < 9, 1).otherwise(2)
    spread = lambda df, c: df.select("*", F.explode(variants(F.col(c), F.least(allowed(F.col(c)) + F.when(F.length(c) < 9, 1).otherwise(0), F.lit(2)))).alias("v"))
    near = spread(tokens.where(F.length("token").between(3, longest + 2)), "token").join(spread(vocabulary, "word"), ["domain", "v"]).select("domain", "token", "word").distinct()
    near = near.withColumn("d", distance("token", "word")).where(F.col("d") <= allowed(F.col("word"))).select("domain", "token", "word", (1 - F.col("d") / F.length("word")).alias("sim"))
    heads = vocabulary.where("kind = 'word'").select("domain", "word", F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.length("word") - 1, F.lit(3))), lambda n: F.substring("word", F.lit(1), n))).alias("token"))
    prefix = tokens.join(heads.where("token <> word"), ["domain", "token"]).select("domain", "token", "word", F.lit(0.9).alias("sim"))
    return near.unionByName(prefix).groupBy("domain", "token", "word").agg(F.max("sim").alias("sim"))


def map_values(values: DataFrame, reference: DataFrame, stage) -> DataFrame:
    """values (domain, value); reference (domain, code, alt_code, name, name_local). Gives (domain, value, ref_code, score), one row
    per different value that is neither null nor blank nor a code as it stands; ref_code is UNMATCHED if it stands for no entry.

    Ties go to the smaller code. An empty list leaves every value UNMATCHED.
    """
    found = [tuple(r) for r in reference.select("domain", "code", "alt_code", "name", "name_local").limit(MAX_REFERENCE + 1).collect()]
    if len(found) > MAX_REFERENCE:
        raise ValueError(f"the reference list has more than {MAX_REFERENCE} rows")
    ref = Reference(found)
    codes = reference.select("domain", F.col("code").alias("value")).distinct()
    typed = values.where(F.regexp_replace("value", r"[\s\p{Z}]+", "") != "").distinct().join(codes, ["domain", "value"], "left_anti").withColumn("text", _norm(F.col("value")))
    typed = stage.write(typed, "typed")
    texts = typed.select("domain", "text").distinct()
    parts = F.when(F.col("domain").isin(sorted(PARTED)), F.split("text", r"[/()\-,]")).otherwise(F.array("text"))
    cut = texts.select("domain", "text", F.explode(F.array_distinct(F.concat(parts, F.array("text")))).alias("part"))
    letters = F.regexp_extract_all("part", F.lit("[a-z]+"), 0)
    tokens = stage.write(cut.select("domain", "text", F.explode(F.array_distinct(F.concat(letters, F.array(F.array_join(letters, ""))))).alias("token")).distinct(), "tokens")
    words = ref.vocabulary()
    vocabulary = values.sparkSession.createDataFrame(words, "domain string, word string, kind string")
    repaired = repair_tokens(tokens.select("domain", "token").distinct(), vocabulary, max((len(w) for _, w, _ in words), default=0))
    known = tokens.join(repaired, ["domain", "token"]).groupBy("domain", "text").agg(F.collect_list(F.struct("token", "word", "sim")).alias("known"))

    def ranked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for domains, words, knowns in batches:
            out = []
            for d, x, k in zip(domains, words, knowns):
                table: dict[str, list[tuple[str, float]]] = {}
                for e in k if k is not None else ():
                    table.setdefault(e["token"], []).append((e["word"], e["sim"]))
                out.append(ref.rank(d, x, table))
            yield pd.DataFrame(out, columns=["code", "score"])

    rank = F.pandas_udf("code string, score double")(ranked)
    judged = texts.join(known, ["domain", "text"], "left").withColumn("r", rank("domain", "text", "known")).select("domain", "text", F.col("r.code").alias("ref_code"), F.col("r.score").alias("score"))
    return typed.join(judged, ["domain", "text"]).select("domain", "value", "ref_code", "score")
