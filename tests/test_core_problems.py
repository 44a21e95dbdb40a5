"""Snapshot changes and column drift on small tables: nulls, blanks, ties, repeats, empty tables, clashing columns."""

import datetime as dt

from tidewright.operators import drift, snapshot_diff

T = lambda n: dt.datetime(2025, 1, n)
SCHEMA = "snap int, key string, at timestamp_ntz, f1 string, f2 string, k string, s string, sign string, change_note string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x", "y", "z", "n") for r in data], SCHEMA)


def changes(spark, data, **options):
    out = snapshot_diff.snapshot_changes(rows(spark, data), "snap", "key", "at", ["f1", "f2"], **options)
    return {(r["snap"], r["key"], r["change"], tuple(r["changed_fields"])) for r in out.collect()}


def test_added_removed_changed_over_a_gap(spark):
    data = [
        (1, "a", T(1), "x", "y"), (1, "b", T(1), "x", "y"), (1, "c", T(1), "x", None),
        (4, "a", T(2), "x", "y"), (4, "c", T(2), "x", "z"), (4, "d", T(2), None, None),
    ]
    assert changes(spark, data) == {(4, "b", "REMOVED", ()), (4, "c", "CHANGED", ("f2",)), (4, "d", "ADDED", ())}


def test_blanks_corrections_and_ties(spark):
    data = [
        (1, " a ", T(1), " x ", ""), (1, "a", T(3), "x2", "y"), (1, "a", T(2), "x3", "y"),  # the latest counts
        (2, "a", T(1), "x2 ", " y"),
        (1, "t", T(1), "b", None), (1, "t", T(1), "a", None), (2, "t", T(1), "b", None),  # of a tie the greatest
        (1, "n", None, "old", None), (1, "n", T(1), "new", None), (2, "n", T(1), "new", " "),  # no time is earliest
        (1, None, T(1), "x", "y"), (1, "  ", T(1), "x", "y"), (None, "q", T(1), "x", "y"),
    ]
    assert changes(spark, data) == set()


def test_a_key_that_comes_back_and_repeats(spark):
    data = [(1, "a", T(1), "x", None)] * 50 + [(2, "b", T(1), "x", None)] + [(3, "a", T(1), "y", None), (3, "b", T(1), "x", None)]
    want = {(2, "a", "REMOVED", ()), (2, "b", "ADDED", ()), (3, "a", "ADDED", ())}
    assert changes(spark, data) == want
    assert changes(spark, data, per_pass=1) == want  # passes that overlap by a snapshot


def test_swapped_values_are_two_changes(spark):
    assert changes(spark, [(1, "a", T(1), "x", "y"), (2, "a", T(1), "y", "x")]) == {(2, "a", "CHANGED", ("f1", "f2"))}


def test_empty_and_single_snapshot(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(1, "a", T(1), "x", "y")]) == set()


def findings(spark, data):
    df = spark.createDataFrame([(a, b, "clash", "clash") for a, b in data], "load int, CODE string, value string, n string")
    shapes = drift.shape_counts(df, "load", ["CODE"], {"CODE": "[A-Z]+"})
    return {tuple(r) for r in drift.drift_findings(drift.load_drift(shapes)).collect()}


def test_no_drift_and_limits_are_exact(spark):
    base = [(1, "AB")] * 9 + [(1, None)]
    assert findings(spark, base + [(2, "AB")] * 8 + [(2, " ")] * 2) == set()  # 0.2 - 0.1 is not more than 0.1
    assert findings(spark, base + [(2, "AB")] * 7 + [(2, "")] * 3) == {(2, "CODE", "null_rate")}


def test_every_finding(spark):
    got = findings(spark, [(1, "AB")] * 10 + [(3, f"a{i}" + "b" * 9) for i in range(10)])
    assert got == {(3, "CODE", f) for f in ("distinct", "range", "pattern", "distribution")}


def test_loads_without_values_and_empty_tables(spark):
    assert findings(spark, []) == set()
    assert findings(spark, [(1, "AB")]) == set()
    assert (2, "CODE", "range") in findings(spark, [(1, "AB"), (2, None)])
    assert findings(spark, [(1, None), (2, " "), (None, "AB")]) == set()


def test_shapes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Ab12-é3",), ("",), (None,)], "v string").select(drift.shape_of(F.col("v")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["Aa9-é9", "", ""]
