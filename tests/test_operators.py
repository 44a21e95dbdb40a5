"""Operators of the core on small made-up tables."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators import combine, construct, dedup, delta, exclude, insight, lookup, pii, profile, quality, reconcile, rows, similar, transform, validate
from tidewright.operators.transform import FieldRule, Mapping, Target
from tidewright.plans import expression
from tidewright.session import Stage


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


# ---------------------------------------------------------------- text
def test_blank_means_null(spark):
    assert one(spark, [None, "", "  ", " a "], text.trim_to_null) == [None, None, None, "a"]
    assert one(spark, [None, "", "  ", " a "], text.blank_to_null) == [None, None, None, " a "]


def test_full_match_has_no_line_break(spark):
    assert one(spark, ["1", "1\n"], lambda c: text.full_match(c, "[0-9]")) == [True, False]


def test_name_norm(spark):
    values = ["Müller & Söhne GmbH", "L.L.C.", "Co. Ltd", "Çelik  A/B, Inc.", None, "Straße KG"]
    assert one(spark, values, text.name_norm) == ["MUELLER SOEHNE", "LLC", "CO LTD", "CELIK A B", None, "STRASSE"]


def test_keys_that_identify_nobody(spark):
    assert one(spark, ["DE 12345", "1234", "00000", "n/a", "unknown", None], lambda c: text.key_part(c, "alnum")) == ["DE12345", None, None, None, None, None]
    assert one(spark, ["+49 (0)123456", "111111", "12345"], lambda c: text.key_part(c, "digits")) == ["490123456", None, None]
    assert one(spark, [" A@B.de ", "a@b", "x"], lambda c: text.key_part(c, "email")) == ["a@b.de", None, None]


@settings(max_examples=20, deadline=None)
@given(st.text("0123456789", min_size=1, max_size=19))
def test_luhn(spark, number):
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(ch) for ch in reversed(number)))
    assert one(spark, [number], text.luhn) == [total % 10 == 0]


def test_shape_and_alpha(spark):
    assert one(spark, ["Ab1-É", None], text.shape_mask) == ["Aa9-A", None]
    assert one(spark, ["12", "12345678901", "A1", " 7 "], text.alpha_input) == ["0000000012", "12345678901", "A1", "0000000007"]


def test_numbers_and_dates(spark):
    assert one(spark, ["2.5", "-2.5", "1e3", "x", None, "1.5d"], text.to_long) == [3, -3, 1000, None, None, None]
    assert [str(x) for x in one(spark, ["2021-02-29", "2021-1-3", "2021"], text.to_date)] == ["None", "2021-01-03", "None"]


# ---------------------------------------------------------------- profile and quality
def test_profile(spark):
    df = spark.createDataFrame([("a", "01"), ("a", " "), (None, "02"), ("b", "02")], "x string, y string")
    got = {r["column_name"]: r for r in profile.profile_columns(profile.value_counts(df)).collect()}
    assert (got["x"]["null_count"], got["x"]["distinct_count"], got["y"]["leading_zero_matches"], got["y"]["distinct_ratio"]) == (1, 2, 3, 0.6667)
    assert [r["n"] for r in profile.top_values(profile.value_counts(df)).where("column_name = 'x'").collect()] == [2, 1]
    assert profile.full_row_duplicates(spark.createDataFrame([("a", None), ("a", " "), ("b", "c")], "x string, y string")).first()["duplicate_rows"] == 1


def test_types(spark):
    data = {"i": ["1", "-2"], "d": ["1", "2.5"], "z": ["01", "2"], "dt": ["2021-01-02", "2020-12-31"], "ts": ["2021-01-02", "2021-01-02 10:00:00"], "b": ["true", "FALSE"], "n": [None, " "], "bad": ["2021-13-02", "2021-01-02"]}
    df = spark.createDataFrame(pd.DataFrame(data), ", ".join(f"{k} string" for k in data))
    got = {r["column_name"]: r["inferred_type"] for r in profile.infer_types(profile.value_counts(df)).collect()}
    assert got == {"i": "BIGINT", "d": "DOUBLE", "z": "VARCHAR", "dt": "DATE", "ts": "TIMESTAMP", "b": "BOOLEAN", "n": "VARCHAR", "bad": "VARCHAR"}


def test_quality_roles_and_rules(spark):
    df = spark.createDataFrame([("1", "Test GmbH", "DE123456789", "DE", "1234"), ("1", "A", "DE 123 456 789", "Germany", "12345"), (None, " x", None, "QQ", None)], "ID string, NAME1 string, VAT_ID string, COUNTRY string, POSTAL_CODE string")
    roles = quality.column_roles(df, ["ID"])
    assert roles == {"ID": "key", "NAME1": "name", "VAT_ID": "tax", "COUNTRY": "country", "POSTAL_CODE": "postal"}
    got = {(r["column_name"], r["rule_id"]): r["violations"] for r in quality.assess(df, roles=roles).collect()}
    assert got["ID", "K01"] == 2 and got["VAT_ID", "T03"] == 2 and got["NAME1", "N04"] == 1 and got["NAME1", "N01"] == 2 and got["COUNTRY", "C01"] == 1 and got["COUNTRY", "C02"] == 1 and got["POSTAL_CODE", "Z01"] == 1
    score = {(r["level"], r["name"]): r["score"] for r in quality.scores(quality.assess(df, roles=roles)).collect()}
    assert 0 < score["table", "all"] < 100


def test_mixture_needs_more_than_a_stray_value(spark):
    make = lambda n: spark.createDataFrame([("2021-01-02",)] * 50 + [("02.01.2021",)] * n, "D_DATE string")
    assert [quality.mixture_results(make(n), {"D_DATE": "date"}).first()["violations"] for n in (0, 1, 2)] == [0, 0, 2]


def test_pii(spark):
    df = spark.createDataFrame([("a@b.de", "x"), ("c@d.com", "y"), ("e@f.org", "z")], "ZFIELD7 string, NOTE string")
    got = {r["column_name"]: r["classification"] for r in pii.classify(pii.value_shares(profile.value_counts(df)), df.columns).collect()}
    assert got == {"ZFIELD7": "RESTRICTED_PII", "NOTE": "CONFIDENTIAL"}
    assert pii.stricter("RESTRICTED_PII", "INTERNAL") == "RESTRICTED_PII"


# ---------------------------------------------------------------- combine, exclude, lookup
def tables(spark):
    return {
        "CUSTOMERS": spark.createDataFrame([(1, "1", "Ann", "DE"), (2, " 2", "Bob", "FR"), (3, "x3", "Cid", None), (4, "", "Dot", "DE"), (5, "5", "Eve", "IT")], "rn int, CUST_ID string, NAME string, COUNTRY string"),
        "CONTACTS": spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("X3", "d"), ("", "e"), ("9", "f")], "CUST_ID string, CONTACT string"),
    }


@pytest.mark.parametrize(("match", "unmatched"), [("exact", 4), ("trim", 3), ("trim_ci", 2)])
def test_join_modes(spark, match, unmatched):
    spec = combine.Spec("CUSTOMERS", "c", (combine.Join("CONTACTS", "k", (("c.CUST_ID", "CUST_ID"),), "left", match),))
    row = combine.join_stats(spec, tables(spark), "rn").first()
    assert (row["left_rows"], row["unmatched"], row["several"], row["most"]) == (5, unmatched, 1, 2)
    assert combine.fan_out(spec, tables(spark), "rn").first()["surplus"] == 1


def test_combine_names_and_refusals(spark):
    spec = combine.Spec("CUSTOMERS", "c", (combine.Join("CONTACTS", "k", (("c.CUST_ID", "CUST_ID"),)),), (combine.Filter("c.COUNTRY", "not_blank"), combine.Filter("c.NAME", "regex", ("^[AB]",))))
    out = combine.combine(spec, tables(spark))
    assert out.columns == ["rn", "c_CUST_ID", "NAME", "COUNTRY", "k_CUST_ID", "CONTACT"] and out.count() == 3
    for bad in (combine.Filter("c.NAME", "regex", (r"(a)\1",)), combine.Filter("c.NAME", "equals"), combine.Filter("c.NAME", "huge", ("x",))):
        with pytest.raises(ValueError):
            combine.combine(combine.Spec("CUSTOMERS", "c", (), (bad,)), tables(spark))


def test_exclusion(spark):
    df = spark.createDataFrame([(1, "Test AG", "X"), (2, "Ann", "x"), (3, "Bob", None), (4, "Cid", " ")], "rn int, NAME string, FLAG string")
    rules = [exclude.Exclusion("A", "NAME", "contains", ("test",)), exclude.Exclusion("B", "FLAG", "equals", ("X",)), exclude.Exclusion("C", "FLAG", "is_blank")]
    assert {(r["rn"], r["_EXCLUDED_BY"]) for r in exclude.tag(df, rules).collect()} == {(1, "A"), (2, "B"), (3, "C"), (4, "C")}
    with pytest.raises(ValueError):
        exclude.split(df, rules)
    assert exclude.split(df, rules[:1])[0].count() == 3
    assert exclude.split(df, [])[0].count() == 4


def test_lookup(spark):
    table = lookup.lookup_table(spark.createDataFrame([("Deutschland", "DE"), ("deutschland ", "DX"), ("", "ZZ"), ("Großb", "GB")], "s string, t string"), "s", "t")
    df = spark.createDataFrame([(" DEUTSCHLAND",), ("GROSSB",), ("Oz",), (" ",), (None,)], "c string")
    got = [(r["translated"], r["lookup_error"]) for r in lookup.translate(df, "c", table).collect()]
    assert sorted(got, key=str) == sorted([("DE", None), ("GB", None), (None, "LOOKUP_FAILED: no mapping for 'Oz'"), (None, None), (None, None)], key=str)


# ---------------------------------------------------------------- expressions and transform
def test_expressions(spark):
    df = spark.createDataFrame([("  ab ", "12", None)], "a string, n string, z string")
    known = {c: F.col(c) for c in df.columns}
    cases = {
        "LPAD(TRIM(a), 5, '0')": "000ab", "UPPER(TRIM(a)) || '-' || n": "AB-12", "CAST(n AS INTEGER) + 1": "13", "CAST(a AS INTEGER)": None, "COALESCE(z, 'x''y')": "x'y",
        "CASE WHEN n IN ('1', '12') THEN 'in' ELSE 'out' END": "in", "CASE n WHEN '12' THEN 'a' END": "a", "IF(z IS NULL AND NOT n = '3', 'y', 'n')": "y", "NVL2(z, 'a', 'b')": "b",
        "DECODE(n, '1', 'one', '12', 'twelve', 'other')": "twelve", "SUBSTRING(n, 1, 1)": "1", "CONCAT(n, z, 'q')": "12q", "n LIKE '1%'": "true", "10 / 4": "2.5", "MOD(7, 4)": "3",
        "TO_DATE('2021-02-03')": "2021-02-03", "source_col": "12", "-ROUND(2.5)": "-3.0",
    }
    for rule, want in cases.items():
        assert df.select(expression.compile_rule(rule, known, "n")).first()[0] == want, rule


@pytest.mark.parametrize("rule", ["a; b", "a -- b", "(SELECT 1)", "sleep(1)", "nosuch", "LEFT(a, -1)", "SUBSTRING(a, 0, 2)", "a b", "", "CASE END", "LPAD(a, 5000)", "x" * 1001, "t.a"])
def test_refused_expressions(spark, rule):
    assert expression.refuse(rule, ["a", "b"])


def test_content_functions(spark):
    assert expression.content_functions("LPAD(TRIM(a), 5, '0')", ["a"]) == {"LPAD"}


RULES = (
    FieldRule(Target("T", "NAME", "CHAR", 5, True), "COPY", "n", rule_id="1"),
    FieldRule(Target("T", "NUM", "NUMC", 3), "COPY", "c", rule_id="2"),
    FieldRule(Target("T", "LAND", "CHAR", 2, check_values=("DE",)), "LOOKUP", "l", lookup="l", rule_id="3"),
    FieldRule(Target("T", "QTY", "INT"), "COPY", "q", rule_id="4"),
)


def staged(spark, mapping=None):
    src = spark.createDataFrame([(1, "k1", "Ann", "12", "de", "1"), (2, "k1", "Too long", "x", "fr", "1.5"), (3, None, "a\tb", "1234", " ", "z"), (4, " ", None, None, None, None)], "__rn bigint, k string, n string, c string, l string, q string")
    table = spark.createDataFrame([("DE", "DE")], "k string, v string")
    return src, {"l": table}, mapping or Mapping(RULES, ("k",))


def test_transform_and_validate(spark):
    src, tabs, mapping = staged(spark)
    got = {r["__rn"]: r for r in transform.staging(mapping, src, tabs).collect()}
    assert [got[i]["_SRC_PK"] for i in (1, 2, 3, 4)] == ["k1", "k1", "ROW:3", "ROW:4"]
    assert (got[1]["T_NAME"], got[1]["T_NUM"], got[1]["T_LAND"], got[1]["T_QTY"], got[1]["_TRANSFORM_STATUS"]) == ("Ann", "12", "DE", 1, "OK")
    assert got[2]["T_QTY"] == 2
    assert got[2]["_TRANSFORM_ERRORS"] == "T.NAME: LENGTH_EXCEEDED: value has 8 chars, CHAR(5) allows 5; T.NUM: CONVERSION_FAILED: 'x' is no NUMC; T.LAND: LOOKUP_FAILED: no mapping for 'fr'"
    assert "control character" in got[3]["_TRANSFORM_ERRORS"] and "LENGTH_EXCEEDED: value has 4 chars, NUMC(3)" in got[3]["_TRANSFORM_ERRORS"]
    assert got[4]["_TRANSFORM_ERRORS"] == "T.NAME: MANDATORY_EMPTY: T.NAME is mandatory"
    stage = Stage(spark, "t").write(transform.staging(mapping, src, tabs), "s")
    kinds = {(r["__rn"], r["target"]): r["kind"] for r in validate.failures(stage, RULES).collect()}
    assert kinds == {(2, "T_NAME"): "LENGTH", (2, "T_NUM"): "CONVERSION", (2, "T_LAND"): "LOOKUP_FAILED", (3, "T_NAME"): "CONVERSION", (3, "T_NUM"): "LENGTH", (3, "T_QTY"): "CONVERSION", (4, "T_NAME"): "MANDATORY"}
    assert validate.counts(stage, RULES).first().asDict() == {"evaluated": 4, "valid": 1, "rejected": 3, "duplicates": 0, "score": 25.0}
    facts = reconcile.load_facts(transform.lineage(mapping, src, tabs, "ALL")).first()
    assert facts["cells"] == 16 and facts["failed_cells"] == 7


def test_lookup_fallbacks(spark):
    for mode, want in (("PASS_THROUGH", "fr"), ("USE_DEFAULT", "ZZ"), ("FLAG_FAILED", None)):
        src, tabs, mapping = staged(spark, Mapping(RULES, ("k",), fallback=mode, default="ZZ"))
        assert {r["__rn"]: r["T_LAND"] for r in transform.staging(mapping, src, tabs).collect()}[2] == want


def test_refused_mappings(spark):
    src, tabs, _ = staged(spark)
    for bad in (Mapping(RULES, status="REJECTED"), Mapping((FieldRule(Target("T", "X"), "PYTHON", "n"),)), Mapping((FieldRule(Target("T", "X"), "COPY", "nosuch"),)), Mapping((RULES[0], RULES[0]))):
        with pytest.raises(ValueError):
            transform.staging(bad, src, tabs)


def test_construction(spark):
    src, tabs, mapping = staged(spark)
    s = Stage(spark, "c").write(transform.staging(mapping, src, tabs), "s")
    patches = spark.createDataFrame([(2, "k1", "T_LAND", "DE"), (4, "ROW:4", "T_NAME", "Zoe"), (4, "other", "T_LAND", "DE"), (9, "k", "T_NAME", "A"), (3, "ROW:3", "T_LAND", "FR"), (1, "k1", "T_LAND", " ")], "row_ref bigint, pk string, target string, value string")
    judged = construct.judge(patches, s, RULES)
    assert {(r["row_ref"], r["target"]): (r["outcome"], r["why"]) for r in judged.collect()} == {
        (2, "T_LAND"): ("APPLIED", None), (4, "T_NAME"): ("APPLIED", None), (4, "T_LAND"): ("REJECTED", "OTHER_KEY"), (9, "T_NAME"): ("REJECTED", "NO_SUCH_ROW"), (3, "T_LAND"): ("REJECTED", "CHECKTABLE"), (1, "T_LAND"): ("IGNORED", None),
    }
    got = {r["__rn"]: r for r in construct.apply(s, judged, RULES).collect()}
    assert got[4]["T_NAME"] == "Zoe" and got[4]["_TRANSFORM_STATUS"] == "OK" and "LOOKUP" not in got[2]["_TRANSFORM_ERRORS"] and got[2]["T_LAND"] == "DE"


# ---------------------------------------------------------------- delta, rows, dedup, similar
def test_delta_and_merge(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, v string")
    cur = spark.createDataFrame([(1, "a"), (2, "B"), (3, ""), (5, "e")], "k int, v string")
    assert {(r["k"], r["kind"]) for r in delta.kinds(cur, base, "k", ["v"]).collect()} == {(1, "UNCHANGED"), (2, "CHANGED"), (3, "UNCHANGED"), (4, "REMOVED"), (5, "NEW")}
    with pytest.raises(ValueError):
        delta.kinds(cur, base, "k", ["nosuch"])
    target = base.withColumn("run", F.lit("r1"))
    done = delta.merge(target, cur.where("k in (2, 5)"), "k", "run", "r2", base.where("k = 4").select("k"))
    assert {tuple(r) for r in done["after"].collect()} == {(1, "a", "r1"), (3, None, "r1"), (2, "B", "r2"), (5, "e", "r2")}
    assert {tuple(r) for r in delta.roll_back_merge(done["after"], done["before_image"], "run", "r2").collect()} == {tuple(r) for r in target.collect()}
    assert delta.fingerprint_diff(base, base.orderBy(F.desc("k")), "k", ["v"]).count() == 0
    assert delta.fingerprint_diff(base, base.where("k < 4"), "k", ["v"]).count() == 1


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as x").repartition(7)
    got = [tuple(r) for r in rows.number_rows(df, Stage(spark, "n"), "n", ["x"]).select("x", "n").collect()]
    assert sorted(got) == [(i, i + 1) for i in range(1000)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    parent = list(range(31))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {(x, find(x)) for p in pairs if p[0] != p[1] for x in p}
    got = dedup.components(spark.createDataFrame(pairs, "a bigint, b bigint"), Stage(spark, "cc"))
    assert {tuple(r) for r in got.collect()} == want


def test_similarity():
    assert round(dedup.ratio("kitten", "sitting"), 2) == 61.54 and dedup.ratio("", "") == 100.0
    assert dedup.token_sort_ratio("EVA CELIK", "CELIK EVA") == 100.0 and dedup.token_set_ratio("A B C", "B A") == 100.0
    assert dedup._address_score("MAIN ST 5", "MAIN ST 7", ["5"], ["7"]) is None


def test_fuzzy_pairs_veto_and_clusters(spark):
    data = [(1, "p1", "Acme Tools GmbH", "Main Street 5", "Town", "DE123456", "1234567"), (2, "p2", "ACME Tols", "Main Str. 5", "Town", None, None), (3, "p3", "Acme Tools", "Main Street 7", "Town", "DE999999", None), (4, "p4", "Other Firm", "Side Road 1", "City", None, "1234567"), (5, "p5", None, None, None, "de-123456", None)]
    df = spark.createDataFrame(data, "id bigint, pk string, name string, street string, city string, tax string, phone string")
    keys = [dedup.ExactKey("tax", (("tax", "alnum"),), True), dedup.ExactKey("phone", (("phone", "digits"),))]
    got = {r["id"]: (r["master_pk"], r["is_child"], r["match_type"]) for r in dedup.deduplicate(df, "id", "pk", keys, "name", ["street", "city"], ["street"], ["name", "street", "phone"], F.lit(False), Stage(spark, "dd")).collect()}
    assert got == {1: ("p1", False, "EXACT:phone+EXACT:tax+NAME_ADDRESS"), 2: ("p1", True, "NAME_ADDRESS"), 4: ("p1", True, "EXACT:phone"), 5: ("p1", True, "EXACT:tax")}


def test_windowed_candidates_equal_look_ahead(spark):
    blocks = spark.createDataFrame([(i, f"N{i:03d}", 1, "B", "", 0) for i in range(40)], "id bigint, nn string, pass int, block string, k string, f int")
    got = {(r["a"], r["b"]) for r in dedup.candidates(blocks, 10, 7).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, min(i + 8, 40))}


def test_split_conflicts(spark):
    edges = spark.createDataFrame([(1, 2, "EXACT:phone"), (2, 3, "NAME_ONLY"), (3, 4, "REVIEWED")], "a bigint, b bigint, reason string")
    groups = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "id bigint, root bigint")
    codes = spark.createDataFrame([(1, "A"), (3, "B"), (4, "C")], "id bigint, code string")
    assert {tuple(r) for r in dedup.split_conflicts(edges, groups, codes).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_nearest_vectors(spark):
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [1.0, 0.1])]
    df = spark.createDataFrame(data, "id bigint, v array<double>")
    got = [(r["query_id"], r["id"], r["rank"]) for r in similar.nearest(df, df.where("id = 0"), "id", "v", 2).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 6, 2)]
    assert similar.nearest(df.limit(0), df.limit(0), "id", "v", 2).count() == 0


def test_insight_helpers():
    assert insight.grounded("12 of 1,000 rows, 3.5 %", [12, 1000]) == ["3.5"]
    assert insight.stale_columns(["A", "b"], ["B"]) == ["A"]
    chain = insight.audit_chain([(1, "a"), (2, "b")])
    assert chain[0][2] != chain[1][2]


def test_filtered_candidates_lose_no_fuzzy_pair(spark, sf):
    from tidewright.queries import migrate

    forms, codes = migrate._forms(spark, sf), migrate._codes(spark, sf).groupBy("id").agg(F.min("code").alias("code"))
    plain = dedup.fuzzy_pairs(forms, dedup.candidates(dedup.block_keys(forms)), codes)
    early = dedup.fuzzy_pairs(forms, dedup.candidates(dedup.block_keys(forms, codes), filtered=True))
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in early.collect()}


def test_registered_fuzzy_pairs_compare_whole_blocks(spark, sf, tmp_path):
    from tidewright.queries import migrate

    names = ["Aaa Tools Zedward", *[f"Aaa {text} Filler" for text in ("".join(chr(97 + i * p % 26) for p in (1, 3, 5, 7, 11, 17)) * 2 + chr(97 + i // 26) * 4 for i in range(250))], "Zedward Tools Aaa"]
    like = spark.read.parquet(f"{sf}/lookalikes.parquet")
    rows = spark.createDataFrame(list(enumerate(names)), "rn bigint, CUST_NAME string")
    rows.select(*[c if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in like.dtypes]).write.parquet(f"{tmp_path}/lookalikes.parquet")
    got = migrate.dedup_fuzzy_pairs(spark, str(tmp_path)).where("a = 0").collect()
    assert [(r["b"], r["score"], r["decision"]) for r in got] == [(251, 1.0, "MERGE")]


def test_oversized_blocks_are_compared_completely(spark):
    blocks = spark.range(605).selectExpr("id", "lpad(id, 3, '0') AS nn", "1 AS pass", "if(id < 600, 'B', 'C') AS block", "'' AS k", "0 AS f")
    got = [(r["a"], r["b"]) for r in dedup.candidates(blocks, 100).collect()]
    assert len(got) == 600 * 599 // 2 + 10 and set(got) == {(i, j) for ids in (range(600), range(600, 605)) for i in ids for j in ids if i < j}


@settings(max_examples=200, deadline=None)
@given(st.text("ABCDÉ1 ", max_size=12), st.text("ABCDÉ1 ", max_size=12))
def test_letters_bound_insertions_and_deletions(a, b):
    x, y = next(dedup._letters([pd.Series([a, b])])).to_numpy()
    bits = sum(((int(p) ^ int(q)) % 2**64).bit_count() for p, q in zip(x, y))
    assert bits <= len(a) + len(b) - 2 * dedup._lcs(a, b)


def test_filtered_and_dealt_pairs_lose_no_fuzzy_pair(spark, sf):
    from tidewright.queries import migrate

    forms, codes = migrate._forms(spark, sf), migrate._codes(spark, sf).groupBy("id").agg(F.min("code").alias("code"))
    whole = dedup.fuzzy_pairs(forms, dedup.candidates(dedup.block_keys(forms), 10**9), codes).collect()
    dealt = dedup.fuzzy_pairs(forms, dedup.candidates(dedup.block_keys(forms, codes), 5, filtered=True)).collect()
    assert whole and sorted(map(tuple, whole)) == sorted(map(tuple, dealt))


def test_countries_and_samples(spark):
    df = spark.createDataFrame([("KE",), ("vn",), ("Germany",), ("Atlantis",), ("Atlantis",), (None,), ("Nowhere land 12",)], "COUNTRY string")
    roles = {"COUNTRY": "country"}
    got = {r["rule_id"]: r["violations"] for r in quality.row_results(df, roles).collect()}
    assert (got["C01"], got["C02"]) == (3, 1)
    shown = quality.samples(df, roles, "COUNTRY", "C01").collect()
    assert {r["value"] for r in shown} == {"At******", "No***** **** **"} and all(r["hint"] for r in shown)
    assert {r["value"] for r in quality.samples(df, roles, "COUNTRY", "C01", n=1, width=4, mask=False).collect()} < {"Atla", "Nowh"}
    assert quality.samples(df.limit(0), roles, "COUNTRY", "C01").collect() == []


def test_sides_and_words(spark):
    from pyspark.sql import functions as F

    from tidewright.operators import insight

    df = spark.createDataFrame([("KUNDEN", ["x"]), ("DATA", ["lifnr", "kreditor"]), ("CUST", ["vendor"]), ("CUST", None), (None, None), ("", [None, "AP_no"])], "t string, names array<string>")
    assert [r["side"] for r in insight.partner_side(df, "t", "names").collect()] == ["customer", "supplier", "both", "customer", "customer", "supplier"]
    names = spark.createDataFrame([("CUST_ID",), ("custName",), ("UST-IDNR",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(insight.expand_identifier(F.col("n"))).collect()] == ["cust id customer identifier number", "cust name customer", "ust idnr vat tax number identification number", "", None]
