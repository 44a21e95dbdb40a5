"""Landing from every format, detection, delivery and recovery."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewright.sources import deliver, detect, documents, land

ROWS = [("1", "Müller", "x|y"), ("2", 'a "b", c', None), ("3", "  lead", "z")]


def csv_text(sep=","):
    quote = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"' if any(ch in v for ch in f'"{sep}') else v
    return "\n".join(sep.join(map(quote, r)) for r in [("ID", "NAME", "NOTE"), *ROWS]) + "\n"


def landed(spark, path, tmp_path, **options):
    out = str(tmp_path / "out")
    land.land(spark, str(path), out, **options)
    return [(r["ID"], r["NAME"], r["NOTE"]) for r in spark.read.parquet(out).orderBy("__rn").collect()]


@pytest.mark.parametrize(("name", "data"), [
    ("a.csv", csv_text().encode()), ("a.csv", csv_text(";").encode("cp1252")), ("a.tsv", csv_text("\t").encode("utf-16")), ("a.csv.gz", gzip.compress(csv_text("|").encode())), ("a.csv", b"\xef\xbb\xbf" + csv_text().encode()),
    ("a.json", json.dumps([dict(zip(("ID", "NAME", "NOTE"), r)) for r in ROWS]).encode()), ("a.ndjson", "\n".join(json.dumps(dict(zip(("ID", "NAME", "NOTE"), r))) for r in ROWS).encode()),
])
def test_every_format_lands_the_same(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    assert landed(spark, tmp_path / name, tmp_path) == ROWS


def test_zip_parquet_fixed_and_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.csv.zip", "w") as z:
        z.writestr("inner.csv", csv_text())
    assert landed(spark, tmp_path / "a.csv.zip", tmp_path) == ROWS
    df = spark.createDataFrame(ROWS, "ID string, NAME string, NOTE string").coalesce(1)
    df.write.parquet(str(tmp_path / "a.parquet"))
    assert [tuple(r) for r in land.read(spark, str(tmp_path / "a.parquet")).collect()] == ROWS
    (tmp_path / "a.fwf").write_text("".join(f"{a:<3}{b:<10}{c or '':<4}\n" for a, b, c in ROWS) + "\n")
    assert [tuple(r) for r in land.read_fixed(spark, str(tmp_path / "a.fwf"), [("ID", 1, 3), ("NAME", 4, 10), ("NOTE", 14, 4)]).collect()] == ROWS
    deliver.write_workbook({"s": df}, str(tmp_path / "a.xlsx"))
    assert [tuple(r) for r in land.read(spark, str(tmp_path / "a.xlsx")).collect()] == ROWS


def test_refusals(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,B\n1,2\n1,2,3\n4\n")
    with pytest.raises(land.LandingError):
        land.land(spark, str(tmp_path / "a.csv"), str(tmp_path / "o"))
    found = land.land(spark, str(tmp_path / "a.csv"), str(tmp_path / "o"), tolerate_rejects=True)
    assert (found.rows, found.rejected, found.columns) == (2, 1, ["A", "B"])
    with pytest.raises(land.LandingError):
        land.land(spark, str(tmp_path / "a.csv"), str(tmp_path / "o2"), expected_rows=5, tolerate_rejects=True)
    (tmp_path / "e.csv").write_text("A,B\n")
    with pytest.raises(land.LandingError):
        land.land(spark, str(tmp_path / "e.csv"), str(tmp_path / "o3"))
    with pytest.raises(ValueError):
        detect.format_of("a.xls")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("a.csv", "x")
        z.writestr("b.csv", "x")
    with pytest.raises(ValueError):
        detect.unpack(str(tmp_path / "b.zip"))
    with pytest.raises(ValueError):
        detect.unpack(str(tmp_path / "b.zip"), "a.csv", 0)


def test_detection():
    assert detect.encoding_of("ä".encode()) == ("utf-8", "valid") and detect.encoding_of("ä".encode("cp1252") * 9)[0] == "cp1252"
    assert detect.encoding_of("abc".encode("utf-16-le"))[0] == "utf-16-le" and detect.encoding_of("abc".encode("utf-16-be"))[0] == "utf-16-be"
    assert detect.delimiter_of("a;b;c\n1;2,5;3\n") == ";" and detect.delimiter_of("abc\n") == ","
    assert detect.header_names(["a", "A", "", None, "a"]) == ["a", "A_2", "COLUMN_3", "COLUMN_4", "a_3"]
    assert detect.check_key("a/b.csv") == "a/b.csv"
    for bad in ("", "/a", "a/../b", "a//b", "a\\b"):
        with pytest.raises(ValueError):
            detect.check_key(bad)


def test_flatten(spark):
    df = spark.read.json(spark.sparkContext.parallelize(['{"a": {"b": {"c": {"d": {"e": 1}}}}, "l": [1, 2], "n": null}', '{"a": {"x": true}, "q": 2.5}']))
    flat = documents.flatten(df)
    assert sorted(flat.columns) == ["a.b.c.d", "a.x", "l", "n", "q"]
    assert {r["a.b.c.d"] for r in flat.collect()} == {'{"e":1}', None}
    with pytest.raises(ValueError):
        documents.flatten(df, most=2)
    assert sorted(documents.union_of_columns([spark.range(1), spark.range(1).selectExpr("id as z")]).columns) == ["id", "z"]


def test_delivery(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("2", None)], "k string, v string")
    t = deliver.Table(spark, f"file://{tmp_path}/t", "k")
    t.deliver(df, "r1")
    with pytest.raises(deliver.DeliveryError):
        t.deliver(df, "r2")
    t.deliver(df.withColumn("v", F.lit("b")), "r2", "replace")
    assert t.verify(df) == ["v"]
    with pytest.raises(deliver.DeliveryError):
        t.roll_back("r1")
    assert t.roll_back("r2") == "RESTORED" and t.verify(df) == []
    assert t.recover() == "NOTHING"
    t._files.write("JOURNAL", {"version": "vbroken", "run_id": "r3", "want": {}})
    assert t.recover() == "DISCARDED" and t.verify(df) == []
    df.write.parquet(f"file://{tmp_path}/t/vwhole")
    t._files.write("JOURNAL", {"version": "vwhole", "run_id": "r4", "want": t._print(df)})
    assert t.recover() == "ADOPTED" and t.state()["run_id"] == "r4"
    assert t.roll_back("r4") == "RESTORED" and t.roll_back("r1") == "DROPPED" and not t.exists()
    assert deliver.probe(spark, f"file://{tmp_path}")


def test_plan_and_names(spark):
    df = spark.createDataFrame([("k", "v", "a\x00b")], "_SRC_PK string, T_X string, `SRC_a b` string")
    out = deliver.plan(df, ["T_X"], "_SRC_PK", "r1", ["SRC_a b"])
    assert out.columns == ["T_X", "LEGACY_KEY", "MIG_RUN_ID", "SRC_A_B"] and out.first()["SRC_A_B"] == "a␀b"
    assert deliver.safe_name("1x") == "C_1X" and len(deliver.safe_name("y" * 99)) == 30


def test_streams(spark, tmp_path):
    from tidewright.streaming import rules

    spark.createDataFrame([("1", "x"), ("2", "12345")], "id string, z string").write.parquet(str(tmp_path / "in"))
    stream = rules.violations(rules.read_landed(spark, str(tmp_path / "in"), "id string, z string"), "z", "Z02")
    rules.run_once(stream, str(tmp_path / "o"), str(tmp_path / "s"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["1"]


def test_late_byte_and_quoted_short_row(spark, tmp_path):
    late = tmp_path / "late.csv"
    late.write_bytes(b"a,b\n" + b"x,plain\n" * 200_000 + "y,Müller\n".encode("cp1252"))
    assert late.stat().st_size > land.detect.HEAD
    for path in (str(late), f"file://{late}"):
        df, details = land.read_delimited(spark, path)
        assert [r["b"] for r in df.where("a = 'y'").collect()] == ["Müller"] and details["encoding"] == "cp1252"
    quoted = tmp_path / "quoted.csv"
    quoted.write_text('a,b,c\n"x,y,z",1\n1,2,3,4\n"a ""q"", b",2,3\n')
    df, _ = land.read_delimited(spark, f"file://{quoted}")
    assert [(r["a"], r["b"], r["c"], r[land.CORRUPT]) for r in df.collect()] == [("x,y,z", "1", None, None), ("1", "2", "3", "1,2,3,4"), ('a "q", b', "2", "3", None)]
    found = land.land(spark, f"file://{quoted}", str(tmp_path / "out"), tolerate_rejects=True)
    assert (found.rows, found.rejected, found.bytes) == (2, 1, quoted.stat().st_size)
