"""Landing: any delivered file becomes an all-text Parquet table with row numbers, evidence and control totals.

Files that Spark can split (plain UTF-8 text, NDJSON, Parquet) are read by its own readers; a file in a container or another encoding
is unpacked once on the driver, rewritten as UTF-8 into the shared folder, and then read the same way.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid
import xml.etree.ElementTree as ET
import zipfile
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.rows import RN, number_rows
from tidewright.session import Stage, shared_dir
from tidewright.sources import detect

CORRUPT = "__rejected"
MAX_SHEET_CELLS = 20_000_000


@dataclass
class Evidence:
    """What was landed, for the record."""

    name: str
    format: str
    sha256: str
    bytes: int
    rows: int
    rejected: int = 0
    expected: int | None = None
    columns: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)


class LandingError(ValueError):
    """The file can't be landed as it is."""


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _put(spark: SparkSession, text: str, suffix: str) -> str:
    """Writes text into the shared folder, through Hadoop's file system."""
    path = f"{shared_dir(spark)}/landing/{uuid.uuid4().hex}{suffix}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return path


def _file(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a file named by any URI that Hadoop knows, or by a plain path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        raise LandingError(f"there is no file {path}")
    return fs, target


def _chunks(spark: SparkSession, path: str, size: int):
    fs, target = _file(spark, path)
    stream = fs.open(target)
    try:
        while chunk := bytes(stream.readNBytes(size)):
            yield chunk
    finally:
        stream.close()


def _head(spark: SparkSession, path: str) -> bytes:
    return next(_chunks(spark, path, detect.HEAD), b"")


class _Local:
    """The file on this machine: itself, or a copy that is deleted afterwards; containers and workbooks are opened on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.copy = spark, path, None

    def __enter__(self) -> str:
        if os.path.exists(self.path):
            return self.path
        fs, target = _file(self.spark, self.path)
        self.copy = os.path.join(tempfile.mkdtemp(prefix="tidewright-"), os.path.basename(self.path))
        fs.copyToLocalFile(False, target, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{self.copy}"), True)
        return self.copy

    def __exit__(self, *_) -> None:
        if self.copy:
            os.remove(self.copy)
            os.rmdir(os.path.dirname(self.copy))


def _unpacked(spark: SparkSession, path: str, member: str | None = None) -> tuple[str, bytes]:
    with _Local(spark, path) as local:
        return detect.unpack(local, member)


def valid_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line of a file is UTF-8; all of it is read, by all executors."""
    return spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()


def cells_of(line, delimiter: str, quote: str = '"'):
    """Cells of a delimited line; delimiters between quotes are none."""
    q = re.escape(quote)
    bare = F.regexp_replace(line, f"{q}(?:[^{q}]|{q}{q})*{q}", "") if quote else line
    return F.size(F.split(bare, re.escape(delimiter)))


def _all_text(df: DataFrame) -> DataFrame:
    """Every column as text: nested ones as JSON, empty as null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        text = F.to_json(c) if nested else F.when(c.isNotNull(), F.hex(c)) if isinstance(f.dataType, T.BinaryType) else c.cast("string")
        out.append(F.nullif(text, F.lit("")).alias(f.name))
    return df.select(*out)


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, quote: str = '"', skip: int = 0, null_tokens: tuple[str, ...] = (), member: str | None = None, multi_line: bool = False) -> tuple[DataFrame, dict]:
    """(table of text with __rejected, options). Short rows are filled with null; rows with more cells than the header are kept in
    __rejected. Encoding and delimiter are detected."""
    name, packed = os.path.basename(path), path.lower().endswith((".gz", ".zip"))
    if packed:
        name, head = _unpacked(spark, path, member)
        encoding, basis = detect.encoding_of(head, whole=True)
    else:
        head = _head(spark, path)
        encoding, basis = detect.encoding_of(head)
        if basis == "valid" and not valid_utf8(spark, path):
            encoding, basis = "cp1252", "fallback"
    direct = not packed and basis == "valid" and not skip  # Spark reads the file itself
    text, lost = detect.transcode(head if packed or direct else _unpacked(spark, path)[1], encoding)
    if direct:
        lost = 0  # every line is valid; the head may end within a character
    if skip:
        text = "".join(text.splitlines(keepends=True)[skip:])
    delimiter = delimiter or detect.delimiter_of(text[: detect.HEAD])
    rows = detect.rows_of("\n".join(text.splitlines()[:1]), delimiter, quote)
    if not rows:
        raise LandingError(f"{name} is empty")
    names = detect.header_names(rows[0])
    where = path if direct else _put(spark, text, ".csv")
    schema = _text_schema(names).add(CORRUPT, T.StringType())
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", delimiter).option("quote", quote).option("escape", quote)
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line).csv(where)
    for n in names:
        c = F.col(f"`{n}`")
        df = df.withColumn(n, F.when(~F.trim(c).isin(["", *null_tokens]), c))
    short = F.col(CORRUPT).isNotNull() & (cells_of(F.col(CORRUPT), delimiter, quote) <= len(names))
    return df.withColumn(CORRUPT, F.when(~short, F.col(CORRUPT))), {"encoding": encoding, "basis": basis, "delimiter": delimiter, "unreadable": lost}


def read_json(spark: SparkSession, path: str, lines: bool, member: str | None = None) -> DataFrame:
    """Array or lines of objects; nested values as JSON text, columns are the union over all objects."""
    packed = path.lower().endswith((".zip", ".gz")) or member
    where = _put(spark, detect.transcode(_unpacked(spark, path, member)[1], "utf-8")[0], ".json") if packed else path
    return _all_text(spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(where))


def read_fixed(spark: SparkSession, path: str, layout: list[tuple[str, int, int]]) -> DataFrame:
    """layout: (name, start from 1, width). Values are cut on the right only, leading blanks stay; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(*[F.nullif(F.rtrim(F.substring("value", start, width)), F.lit("")).alias(name) for name, start, width in layout])


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _sheet_rows(path: str, sheet: str | None) -> list[list[str | None]]:
    with zipfile.ZipFile(path) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        shown = [s for s in book.find("m:sheets", _NS) if s.get("state", "visible") == "visible"]
        chosen = next((s for s in shown if sheet in (None, s.get("name"))), None)
        if chosen is None:
            raise LandingError("the workbook has no such visible sheet")
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[chosen.get(f"{{{_NS['r']}}}id")].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        rows, n = [], 0
        for row in ET.fromstring(z.read(part)).iter(f"{{{_NS['m']}}}row"):
            cells: dict[int, str | None] = {}
            for c in row:
                letters = "".join(ch for ch in c.get("r", "") if ch.isalpha())
                at = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(letters))) - 1 if letters else len(cells)
                v, kind = c.find("m:v", _NS), c.get("t")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif v is None or v.text is None:
                    value = None
                elif kind == "s":
                    value = strings[int(v.text)]
                elif kind == "b":
                    value = "TRUE" if v.text == "1" else "FALSE"
                else:
                    value = v.text[:-2] if v.text.endswith(".0") else v.text
                cells[at] = value
                n += 1
            if n > MAX_SHEET_CELLS:
                raise LandingError("the sheet is too large for a workbook reader; deliver it as text")
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, header_row: int = 1) -> DataFrame:
    """A visible sheet as text; blank rows are dropped, the width is that of the header."""
    with _Local(spark, path) as local:
        rows = _sheet_rows(local, sheet)[header_row - 1 :]
    if not rows:
        raise LandingError("the sheet is empty")
    width = max((i for i, c in enumerate(rows[0], 1) if (c or "").strip()), default=0)
    names = detect.header_names(rows[0][:width])
    body = [[(r[i] or None) if i < len(r) else None for i in range(width)] for r in rows[1:]]
    return spark.createDataFrame([r for r in body if any(c and c.strip() for c in r)], _text_schema(names))


def read(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """The file as a table of text, by its format."""
    kind = detect.format_of(path, fmt)
    if kind == "delimited":
        return read_delimited(spark, path, **options)[0].drop(CORRUPT)
    if kind in ("json", "ndjson"):
        return read_json(spark, path, kind == "ndjson", **options)
    if kind == "fixed":
        return read_fixed(spark, path, **options)
    if kind == "xlsx":
        return read_workbook(spark, path, **options)
    return _all_text(spark.read.parquet(path))


def preview(spark: SparkSession, path: str, n: int = 20, **options) -> list[dict]:
    return [r.asDict() for r in read(spark, path, **options).limit(n).collect()]


def _size(spark: SparkSession, path: str) -> int:
    fs, target = _file(spark, path)
    return fs.getFileStatus(target).getLen()


def sha256(spark: SparkSession, path: str) -> str:
    h = hashlib.sha256()
    for chunk in _chunks(spark, path, 1 << 20):
        h.update(chunk)
    return h.hexdigest()


def land(spark: SparkSession, path: str, out: str, expected_rows: int | None = None, tolerate_rejects: bool = False, fmt: str | None = None, **options) -> Evidence:
    """Writes the table with __rn to ``out`` (Parquet) and gives the evidence. No rows, rejected lines (unless tolerated) and a row
    count that isn't the expected one are errors; nothing is left behind then."""
    kind = detect.format_of(path, fmt)
    details: dict = {}
    if kind == "delimited":
        df, details = read_delimited(spark, path, **options)
        df = Stage(spark, "land").write(df, "raw")
        rejected = df.where(f"{CORRUPT} is not null").select(CORRUPT).distinct().count()
        if rejected and not tolerate_rejects:
            raise LandingError(f"{rejected} different lines don't fit the header")
        df = df.where(f"{CORRUPT} is null").drop(CORRUPT)
    else:
        df, rejected = read(spark, path, kind, **options), 0
    df = number_rows(df, Stage(spark, "land"))
    rows = df.count()
    if rows == 0:
        raise LandingError("no rows")
    if expected_rows is not None and rows != expected_rows:
        raise LandingError(f"{rows} rows, {expected_rows} expected")
    df.write.mode("overwrite").parquet(out)
    warnings = [f"{details['unreadable']} characters could not be read"] if details.get("unreadable") else []
    return Evidence(os.path.basename(path), kind, sha256(spark, path), _size(spark, path), rows, rejected, expected_rows, [c for c in df.columns if c != RN], details, warnings)


def read_database(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, properties: dict | None = None) -> DataFrame:
    """A table over JDBC, read-only, in parallel ranges of a numeric key where one is given; every column as text."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", 10000)
    dialect = url.split(":")[1] if ":" in url else ""
    if dialect in ("postgresql", "mysql"):
        reader = reader.option("sessionInitStatement", "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY" if dialect == "postgresql" else "SET SESSION TRANSACTION READ ONLY")
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return _all_text(reader.load())
