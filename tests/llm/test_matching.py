"""Canonical values and places on small tables, and accuracy on planted variants."""

import random
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import canon, places
from tidewright.session import Stage

REF = [
    ("COUNTRY", "DE", "DEU", "Germany", "Deutschland"), ("COUNTRY", "GB", "GBR", "United Kingdom", "Great Britain"), ("COUNTRY", "US", "USA", "United States", "United States of America"),
    ("COUNTRY", "AT", "AUT", "Austria", "Österreich"), ("PAYMENT_TERMS", "N030", "NET30", "30 days net", "30 Tage netto"), ("PAYMENT_TERMS", "D214", "2/14/30", "2 % within 14 days, 30 days net", "14 Tage 2 % Skonto, 30 Tage netto"),
    ("PAYMENT_TERMS", "EM00", None, "End of month", "Monatsende"), ("PAYMENT_TERMS", "EM15", None, "End of month plus 15 days", "Monatsende plus 15 Tage"), ("PAYMENT_TERMS", "BX30", None, "Bill of exchange 30 days", "Wechsel 30 Tage"),
    ("PAYMENT_TERMS", "IMM0", None, "Due immediately", "Sofort fällig"),
]
COUNTRIES = {
    "de": "DE", " DE": "DE", "D.E.U.": "DE", "Deutshcland": "DE", "deutslcand": "DE", "GERMANY (DE)": "DE", "DEU/Germany": "DE", "Deutschland / Germany": "DE", "Deuts.": "DE", "untie dstates": "US", "United_States": "US",
    "u.s.a": "US", "Great.": "GB", "Utd. Kingdom": "GB", "oesterreich": "AT", "Australia": "UNMATCHED", "Kenya": "UNMATCHED", "XX": "UNMATCHED", "-": "UNMATCHED", "net 30": "UNMATCHED", "tbd": "UNMATCHED", "?" * 500: "UNMATCHED",
}
TERMS = {
    "n030": "N030", "030 days net": "N030", "30days": "N030", "due in 30 days": "N030", "N/30": "N030", "net 30": "N030", "within 30 dyas net": "N030", "net 31": "UNMATCHED", "2/14 net 30": "D214", "30 net, 2% if 14 days": "D214", "eom": "EM00",
    "e.o.m.": "EM00", "EOM 15": "EM15", "month end": "EM00", "Endo f month": "EM00", "BoE 30": "BX30", "b/e 30": "BX30", "wechsel 30 t": "BX30", "imm.": "IMM0", "sofort": "IMM0", "due at once": "IMM0", "Germany": "UNMATCHED", "net": "UNMATCHED", "days": "UNMATCHED", "30": "UNMATCHED",
}


def mapped(spark, values, ref=REF):
    table = spark.createDataFrame(ref, "domain string, code string, alt_code string, name string, name_local string")
    df = spark.createDataFrame(values, "domain string, value string")
    return {(r["domain"], r["value"]): r["ref_code"] for r in canon.map_values(df, table, Stage(spark, "c")).collect()}


def test_values(spark):
    want = {("COUNTRY", v): c for v, c in COUNTRIES.items()} | {("PAYMENT_TERMS", v): c for v, c in TERMS.items()}
    extra = [("COUNTRY", None), ("COUNTRY", ""), ("COUNTRY", "  "), ("COUNTRY", "DE"), ("PAYMENT_TERMS", "N030")]
    got = mapped(spark, [*want, *extra, *want])
    assert {k: (got.get(k), c) for k, c in want.items() if got.get(k) != c} == {} and set(got) == set(want)


def test_empty_values_and_empty_list(spark):
    assert mapped(spark, []) == {}
    assert mapped(spark, [("COUNTRY", "Germany")], []) == {("COUNTRY", "Germany"): "UNMATCHED"}


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edit_distance_bounds(a, b):
    d = canon.edits(a, b)
    assert d == canon.edits(b, a) and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)


def test_planted_slips_are_found(spark):
    rng = random.Random(7)
    values = {}
    for _ in range(150):
        code, name = rng.choice([("DE", "Deutschland"), ("GB", "United Kingdom"), ("US", "United States of America"), ("AT", "Österreich")])
        i = rng.randrange(len(name) - 1)
        slip = rng.choice([name[:i] + name[i + 1 :], name[:i] + "q" + name[i:], name[:i] + name[i + 1] + name[i] + name[i + 2 :], name[:i] + "x" + name[i + 1 :]])
        values["COUNTRY", rng.choice([slip, slip.upper(), f" {slip};"])] = code
    got = mapped(spark, list(values))
    assert sum(got[k] == c for k, c in values.items()) >= 0.97 * len(values)


@pytest.mark.parametrize(("line", "want"), [
    ("12 Main Street", ("12", "main street", "", "")), ("Main Str. 12a, Floor 6", ("12a", "main str.", "", "")), ("Hinterhaus, Rue Siaskàrt 38", ("38", "rue siaskart", "", "")), ("Pl. Grûklàr, n° 55, Bât. C", ("55", "pl. gruklar", "", "")),
    ("144 Place Dux, 01393 Bertrûmmônt", ("144", "place dux", "bertrummont", "1393")), ("13 C.so Voshil", ("13", "cso voshil", "", "")), ("36 R. Gormus", ("36", "r. gormus", "", "")), ("Fiebiswg.128", ("128", "fiebiswg.", "", "")),
    (None, None), ("", None), ("Main Street", None), ("12", None), ("X 3, HX3 8GB Rartdoton", ("3", "x", "rartdoton", "hx38gb")),
])
def test_take_apart(line, want):
    assert places.take_apart(line) == want


def test_town_and_postal():
    assert places.town("8975 LX Nieuw Zennidam") == ("nieuw zennidam", "8975lx") and places.town("Saint Cus 7") == ("saint cus", "") and places.town("Kinziafeld (Zentrum)/03") == ("kinziafeld", "")
    assert places.postal("FR-01393") == places.postal("1393") == places.postal("01393.0") == "1393" and places.postal("n/a") == ""


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id string, street string, city string, code string, town string, n int")
    normal = places.normal_addresses(df, "id", "street", "city", "code", Stage(spark, "p"))
    return {tuple(r) for r in places.pairs_of_places(normal, "id", ["town", "name", "kind", "number"]).collect()}


def test_places(spark):
    rows = [(f"f{i}", f"{i + 100} {n} {k}", "Kinziafeld", "12345") for i in range(45) for n, k in [("Grolkles", "Road"), ("Semindal", "Street"), ("Vonbrackel", "Lane")][i % 3 : i % 3 + 1]]
    rows += [(f"g{i}", f"{i + 100} {n} {k}", "Kinziafeld", "12345") for i in range(45) for n, k in [("Grolkles", "Rd"), ("Semindal", "St."), ("Vonbrackel", "Ln")][i % 3 : i % 3 + 1]]
    rows += [
        ("a", "7 Grolkles Road", "Kinziafeld", "12345"), ("b", "Grolkles Rd, 7, Floor 6", "KINZIAFELD", None), ("c", "No. 7 Grolklse Road", None, "12345.0"), ("d", "7 Grolkles Road", "Kinzaifeld", "12345"),
        ("e", "7 Grolkles Street", "Kinziafeld", "12345"), ("x", "7a Grolkles Road", "Kinziafeld", "12345"), ("y", "7 Grolkles Road", "Otherville", "54321"), ("z", None, "Kinziafeld", "12345"), ("w", "Grolkles Road", "Kinziafeld", "12345"),
        ("a", "7 Grolkles Road", "Kinziafeld", "12345"), (None, "7 Grolkles Road", "Kinziafeld", "12345"), ("v", "", "", ""),
    ]
    got = pairs(spark, rows)
    same = ["a", "b", "c", "d"]
    assert {p for p in got if p[0] in "abcdexyzwv" or p[1] in "abcdexyzwv"} == {(p, q) for p in same for q in same if p < q}
    assert {(f"f{i}", f"g{i}") for i in range(45)} <= got


def test_no_places(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, [("a", None, None, None), ("b", "x", "y", "z")]) == set()


def test_single_near_names_stay_apart(spark):
    rows = [("a", "5 Hansen Road", "Kinziafeld", "12345"), ("b", "5 Jansen Road", "Kinziafeld", "12345"), ("c", "9 Marienberg Lane", "Kinziafeld", "12345"), ("d", "9 Marienburg Lane", "Kinziafeld", "12345")]
    assert pairs(spark, rows) == set()


def test_kinds_outside_the_list_are_mined(spark):
    names = [a + b for a in ("Grol", "Semin", "Vonbra", "Tixu", "Palmo") for b in ("kles", "dalor", "ckel", "mefi", "tanu", "rizo", "whek", "supo")]
    rows = [(f"a{i:02}", f"{i + 1} {n} utca", "Kinziafeld", "12345") for i, n in enumerate(names)] + [(f"b{i:02}", f"{i + 1} {n} u.", "Kinziafeld", "12345") for i, n in enumerate(names)]
    assert pairs(spark, rows) == {(f"a{i:02}", f"b{i:02}") for i in range(len(names))}


def test_every_near_lead_is_weighed(spark):
    """A slip of a common name that is also near another common one goes to the nearer; names both common stay apart."""
    rows = [(f"l{i:03}", f"{i + 1} Lindenbaum Road", "Kinziafeld", "12345") for i in range(40)] + [(f"m{i:03}", f"{i + 1} Lindernbaum Road", "Kinziafeld", "12345") for i in range(60)]
    got = pairs(spark, [*rows, ("s", "7 Linxdenbaum Road", "Kinziafeld", "12345")])
    assert got == {("l006", "s")}


def test_rounds_of_a_scope_run_in_one_task(spark, monkeypatch):
    """All rounds take few jobs (each costs the driver memory), and scopes too large for a task give the same over tables."""
    draw = random.Random(7)
    forms = {}
    for scope, n in (("a", 30), ("b", 60), ("c", 5)):
        for _ in range(n):
            word = "".join(draw.choice("abe") for _ in range(draw.randint(4, 9)))
            for _ in range(4):
                forms[(scope, word)] = draw.choice([1, 1, 2, 3, 9, 40, 200])
                i = draw.randrange(len(word))
                word = word[:i] + draw.choice("abe") + word[i + draw.choice([0, 1, 1]) :]
    table = spark.createDataFrame([(i, *k, n, True, True) for i, (k, n) in enumerate(forms.items())], "id bigint, scope string, word string, n bigint, words boolean, leads boolean")
    stage, context = Stage(spark, "p"), spark.sparkContext
    near = places.near_pairs(table, stage)
    context.setJobGroup("settle", "settle")
    got = {tuple(r) for r in places.settle(table, stage, near).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("settle"))
    context.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(places, "MAX_ROUNDS", 1000)
    sizes = sorted(r[1] for r in near.groupBy("scope").count().collect())
    for most in (0, sizes[-1] - 1):
        monkeypatch.setattr(places, "SCOPE_PAIRS", most)
        assert {tuple(r) for r in places.settle(table, stage, near).collect()} == got
    assert len(got) > 20 and jobs <= 15


def test_the_driver_gives_memory_back(spark):
    version = spark.sparkContext._jvm.System.getProperty("java.version")
    if sys.platform != "linux" or [int(x) for x in version.split("-")[0].split(".")] < [17, 0, 9]:
        pytest.skip("this JVM can't")
    assert places._tidy(spark)
