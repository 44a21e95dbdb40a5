"""Tokenising, leakage, shared spans and encoding repair against the definition."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import leakage, mojibake, spans, tokens
from tidewright.session import Stage

ENC = tokens.tokenizer(tokens.RANKS)


# ---------------------------------------------------------------- tokens
@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), st.integers(1, 12))
def test_pieces_have_the_ids_of_the_whole(text, size):
    parts = list(tokens.pieces(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in ENC.encode_ordinary(p)] == ENC.encode_ordinary(text)


def test_long_text_equals_another_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rng = random.Random(5)
    text = "".join(rng.choice(["Wort ", "12,5 ", "\n\n", "  ", "été ", "<|endoftext|>", "x" * 30, "漢字 ", "'s "]) for _ in range(60_000))
    assert len(text) > 2 * tokens.PIECE
    assert tokens.encode_text(text, ENC) == other.encode(text, add_special_tokens=False).ids


def test_encode_column(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|>"), (2, ""), (3, None), (4, " "), (5, "€" * 5), (6, "a" * 250_000)], "doc_id bigint, text string")
    coded = df.select("doc_id", "text", tokens.encode(df, "text").alias("ids"))
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert got[1] == ENC.encode_ordinary("a <|endoftext|>") and 50256 not in got[1]
    assert got[2] == got[3] == [] and got[4] == ENC.encode_ordinary(" ")
    back = {r["doc_id"]: r["t"] for r in coded.select("doc_id", tokens.decode(coded, "ids").alias("t")).collect()}
    assert back == {1: "a <|endoftext|>", 2: "", 3: "", 4: " ", 5: "€" * 5, 6: "a" * 250_000}
    empty = df.limit(0)
    assert empty.select(tokens.encode(empty, "text")).collect() == []


# ---------------------------------------------------------------- leakage
def runs(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (leakage.MATCH if a[i - 1] == b[j - 1] else leakage.MISMATCH), h[i - 1][j] + leakage.GAP, h[i][j - 1] + leakage.GAP)
            best = max(best, h[i][j])
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=10))
def test_align(a, b):
    assert leakage.align(a, b) == (runs(a, b), smith_waterman(a, b))


def split(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def leaks(spark, docs, items):
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id bigint, text string, w string, id int")
    i = spark.createDataFrame([(*r, "clash") for r in items], "item_id bigint, text string, gram string")
    return {(r["doc_id"], r["item_id"]): r["run"] for r in leakage.leaks(d, "doc_id", "text", i, "item_id", "text", Stage(spark, "l")).collect()}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 13, 30])))) for i in range(25)]
    docs = []
    for d in range(120):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 40]))]
        if d % 2:
            w = split(rng.choice(items)[1])
            s = rng.randrange(len(w))
            words[5:5] = [x.upper() for x in w[s : s + rng.choice([11, 12, 13, 40])]]
        docs.append((d, rng.choice([" ", " - ", ",\n", "_"]).join(words)))
    docs += [(900, None), (901, ""), (902, "  "), (903, "?!"), (1, docs[1][1]), (904, docs[1][1])]
    items += [(90, None), (91, ""), (92, "one two"), (3, items[3][1])]
    got = {k for k, n in leaks(spark, docs, items).items() if n >= leakage.RUN}
    want = {(d, i) for d, t in docs for i, x in items if runs(split(t), split(x)) >= leakage.RUN}
    assert want and got == want


def test_edited_copy_beside_verbatim_copies(spark):
    words = [f"w{i}" for i in range(40)]
    edited = [f"x{i}" if i % 8 == 7 else w for i, w in enumerate(words)]
    item = [(1, " ".join(words))]
    for n in (0, 1, 3):
        docs = [(i, " ".join(words)) for i in range(n)] + [(9, " ".join(edited))]
        assert leaks(spark, docs, item) == {(i, 1): 40 for i in range(n)} | {(9, 1): 7}
    tables = [spark.createDataFrame(rows, "id bigint, text string") for rows in (docs, item)]
    copies = leakage.leaks(tables[0], "id", "text", tables[1].withColumnRenamed("id", "item"), "item", "text", Stage(spark, "l"), runs_only=True).where("run >= 12")
    assert sorted(r["id"] for r in copies.collect()) == [0, 1, 2]


def test_leaks_of_nothing(spark):
    assert leaks(spark, [], []) == {} and leaks(spark, [(1, "a b")], []) == {} and leaks(spark, [], [(1, "a " * 20)]) == {}


# ---------------------------------------------------------------- spans
def shared(spark, texts, size, **options):
    df = spark.createDataFrame([(*r, "clash", 7) for r in texts], "doc_id bigint, text string, lo string, n int")
    return {tuple(r) for r in spans.shared_spans(df, "doc_id", "text", Stage(spark, "s"), size, **options).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_spans_equal_the_definition(spark, seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh éß漢") for _ in range(n))
    pool = [noise(rng.choice([29, 30, 31, 60, 90])) for _ in range(6)] + ["ab" * 40, "x" * 50]
    texts = []
    for i in range(60):
        parts = [noise(rng.choice([0, 1, 5, 40])) for _ in range(4)]
        for k in (1, 2, 3):
            if rng.random() < 0.5:
                p = rng.choice(pool)
                s = rng.randrange(0, 20)
                parts.insert(k, p[s:] if rng.random() < 0.5 else p)
        texts.append((i, "".join(parts)))
    texts += [(100, texts[0][1]), (101, texts[0][1]), (102, noise(25) * 3)]
    assert shared(spark, texts, 30, phrase=10, shard_nodes=200) == spans.brute_force(dict(texts), 30)


def test_spans_of_odd_texts(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    texts = [(1, None), (2, ""), (3, "short"), (4, long), (5, "z" + long[1000:1400] + "q"), (6, long[:299]), (7, "y" * 700), (8, "y" * 400), (None, long), (4, long), (9, long[2000:2300])]
    got = shared(spark, texts, 300)
    assert got == {(4, 1000, 1400), (5, 1, 401), (7, 0, 700), (8, 0, 400), (4, 2000, 2300), (9, 0, 300)}
    assert shared(spark, [], 300) == set()


@pytest.mark.parametrize("chunk", [1, 7, 40, 1000])
def test_anchors_of_chunks_are_those_of_the_text(chunk):
    rng = random.Random(chunk)
    for n in (0, 9, 10, 30, 31, 200, 333):
        text = "".join(rng.choice("abc") for _ in range(n))
        whole = spans.chunked_anchors(text, 10, 11, 10**6)
        parts = spans.chunked_anchors(text, 10, 11, chunk)
        assert [list(x) for x in whole] == [list(x) for x in parts]


# ---------------------------------------------------------------- mojibake
def damage(text, written, read):
    return "".join(mojibake._TABLE[read][b] for b in text.encode(written))


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"])
@pytest.mark.parametrize("word", ["Großhandel", "Möbel", "Průmysl", "Spółka", "Générale", "Irmãos", "nº", "ŘEŽNÍK"])
def test_utf8_read_in_a_code_page(word, read):
    assert mojibake.repair_token(damage(word, "utf-8", read)) == word


def test_twice_and_code_pages():
    twice = damage(damage("Bäckerei", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert mojibake.repair_token(twice) == "Bäckerei"
    assert mojibake.repair_token("Stuckzõ³") == "Stuckzäü" and mojibake.repair_token("cm³") is None
    assert mojibake.repair_token("R³veirt³r") == "Rüveirtür" and mojibake.repair_token("Getr‰nke") == "Getränke" and mojibake.repair_token("R\x84xean") == "Räxean"


@pytest.mark.parametrize("word", ["SÃO", "Ångström", "Kęstau™", "m³", "«Nord»", "nº", "§7", "Þór", "CONSTRUÇÃO", "O’Brien", "25°", "½", "KLÃRPI", "DECKBIÄ", "Œuvres", "Bâtiment"])
def test_sound_words_stay(word):
    assert mojibake.repair_token(word) is None


def test_damaged_values(spark):
    clean = ["Bręnwelkań 1", "Bręnwelkań 2", "Bręnwelkań 3", "Società uno", "Società due", "Wo? Reisen a", "Wo? Reisen b", "Wo? Reisen c", "SÃO Paulo", "plain ascii"]
    bad = {"Brênwelkañ 4": "restored", "MÃ¶bel 5": "restored", "M?bel 6": "lost", "M�bel 7": "lost", "Societ? tre": "lost", "MÃ¶bel � 8": "lost", "24 B├⌐r": "restored"}
    sound = ["Wo?a Reisen d", None, "", "  "]
    df = spark.createDataFrame([(v, "clash") for v in [*clean, *bad, *sound, *clean]], "v string, token string")
    got = {r["value"]: (r["outcome"], r["restored"]) for r in mojibake.damaged_values(df, "v", Stage(spark, "m")).collect()}
    assert {k: o for k, (o, _) in got.items()} == bad
    assert got["Brênwelkañ 4"][1] == "Bręnwelkań 4" and got["MÃ¶bel 5"][1] == "Möbel 5" and got["MÃ¶bel � 8"][1] == "Möbel � 8"
    assert mojibake.damaged_values(df.limit(0), "v", Stage(spark, "m")).collect() == []


def test_garbled_forms_repair_to_the_word():
    for word in ("Großhandel", "Průmysl"):
        for form in mojibake.garble(word):
            assert form != word
    assert mojibake.lossy("Müß") == "M??"


def test_short_words_are_known_words_too(spark):
    values = [f"São {i}" for i in range(25)] + [f"nº {i}" for i in range(9)] + [f"Zé {c}" for c in "AB"] + [f"ZÚ {c}" for c in "CDEFG"] + ["SÒo Z", "n§ 57"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r["value"]: (r["restored"], r["outcome"]) for r in mojibake.damaged_values(df, "value", Stage(spark, "m")).collect()}
    assert got == {"SÒo Z": ("São Z", "restored"), "n§ 57": ("nº 57", "restored")}


def test_spans_come_from_located_passages(spark, monkeypatch):
    """Without the automata's occurrences there is no window to compare."""
    base = "".join(random.Random(5).choice("abcdefgh ") for _ in range(400))
    texts = [(1, "x" + base), (2, base + "y")]
    assert shared(spark, texts, 300) == {(1, 1, 401), (2, 0, 400)}
    monkeypatch.setattr(spans, "_scan", lambda *a: lambda batches: (b.iloc[:0][["t", "u"]].assign(run=0, h1=None, h2=None) for b in batches))
    assert shared(spark, texts, 300) == set()
