"""Sinks: all-or-nothing table versions that can be verified and taken back, delivery plans, workbooks, CSV.

A delivered table is a folder of versions and a pointer file. A new version is written beside the others, counted and fingerprinted,
and becomes current when the pointer is replaced; the version before stays as the image for taking it back. A journal names a version
that is being written, so that an interrupted delivery is adopted if it is whole and dropped if not.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.delta import fingerprint, fingerprint_diff

OWNER = "_MIG_OWNED"


class DeliveryError(RuntimeError):
    """The delivery did not happen; the table is as it was."""


class _Files:
    """The few file operations of a delivery, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm = spark.sparkContext._jvm
        self._base = base.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self._base).getFileSystem(conf)
        # unlike FileSystem, FileContext renames over an existing file in one step
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._base}/{name}")

    def read(self, name: str) -> dict | None:
        if not self._fs.exists(self.at(name)):
            return None
        stream = self._fs.open(self.at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Replaces a file in one step: written beside, then renamed."""
        temp = f"{name}.{uuid.uuid4().hex}"
        out = self._fs.create(self.at(temp))
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        self._context.rename(self._context.makeQualified(self.at(temp)), self._context.makeQualified(self.at(name)), overwrite)

    def drop(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


class Table:
    """A delivered table at a folder."""

    def __init__(self, spark: SparkSession, base: str, key: str):
        self.spark, self.base, self.key = spark, base.rstrip("/"), key
        self._files = _Files(spark, base)

    def state(self) -> dict | None:
        return self._files.read("CURRENT")

    def exists(self) -> bool:
        return self.state() is not None

    def read(self, version: str | None = None) -> DataFrame:
        now = version or (self.state() or {}).get("version")
        if now is None:
            raise DeliveryError("there is no such table")
        return self.spark.read.parquet(f"{self.base}/{now}")

    def _print(self, df: DataFrame) -> dict:
        rows = fingerprint(df, self.key, sorted(df.columns)).collect()
        return {"rows": rows[0]["n_rows"] if rows else 0, "totals": {r["column_name"]: r["total"] for r in rows}}

    def deliver(self, df: DataFrame, run_id: str, mode: str = "create") -> dict:
        """create refuses an existing table; replace only takes one this engine owns. The written version is read back and compared by
        count and value before it becomes current."""
        now = self.state()
        if mode == "create" and now:
            raise DeliveryError("the table exists")
        if mode == "replace" and now and not now.get(OWNER):
            raise DeliveryError("the table belongs to somebody else")
        version = f"v{uuid.uuid4().hex}"
        want = self._print(df)
        self._files.write("JOURNAL", {"version": version, "run_id": run_id, "want": want})
        df.write.parquet(f"{self.base}/{version}")
        if self._print(self.read(version)) != want:
            self._files.drop(version)
            self._files.drop("JOURNAL")
            raise DeliveryError("what was written is not what was to be written")
        self._commit(version, run_id, want, now)
        return want

    def _commit(self, version: str, run_id: str, print_: dict, before: dict | None) -> None:
        self._files.write("CURRENT", {"version": version, "run_id": run_id, "print": print_, "before": before, OWNER: True})
        self._files.drop("JOURNAL")

    def recover(self) -> str:
        """After an interruption: ADOPTED if the journal's version is whole, DISCARDED if not, NOTHING without a journal."""
        journal = self._files.read("JOURNAL")
        if journal is None:
            return "NOTHING"
        try:
            whole = self._print(self.read(journal["version"])) == journal["want"]
        except Exception:  # an unreadable version is an incomplete one
            whole = False
        if whole:
            self._commit(journal["version"], journal["run_id"], journal["want"], self.state())
            return "ADOPTED"
        self._files.drop(journal["version"])
        self._files.drop("JOURNAL")
        return "DISCARDED"

    def roll_back(self, run_id: str) -> str:
        """Takes back the current delivery if it is that run's and the table still has its rows: the version before becomes current, or
        the table goes."""
        now = self.state()
        if now is None or now["run_id"] != run_id:
            raise DeliveryError("the current delivery is another run's")
        if self.read().count() != now["print"]["rows"]:
            raise DeliveryError("the table has changed since")
        if now["before"]:
            self._files.write("CURRENT", now["before"])
            self._files.drop(now["version"])
            return "RESTORED"
        self._files.drop("CURRENT")
        self._files.drop(now["version"])
        return "DROPPED"

    def verify(self, payload: DataFrame) -> list[str]:
        """The columns in which the table differs from a payload; none if they are the same."""
        return sorted(r["column_name"] for r in fingerprint_diff(payload, self.read(), self.key, sorted(payload.columns)).collect())


def plan(staging: DataFrame, targets: list[str], key: str, run_id: str, raw: list[str] = ()) -> DataFrame:
    """What is delivered: a column per target, LEGACY_KEY (at most 255 characters), MIG_RUN_ID, and raw SRC_ columns under safe unique
    names of at most 30 characters. NUL shows as a symbol."""
    visible = lambda c: F.replace(c, F.lit("\x00"), F.lit("␀"))
    used: set[str] = {t.upper() for t in targets} | {"LEGACY_KEY", "MIG_RUN_ID"}
    out = [F.col(f"`{t}`") for t in targets] + [F.left(F.col(f"`{key}`"), F.lit(255)).alias("LEGACY_KEY"), F.lit(run_id).alias("MIG_RUN_ID")]
    for c in raw:
        base = safe_name(c)
        name, n = base, 1
        while name in used:
            n += 1
            name = f"{base[: 30 - len(str(n)) - 1]}_{n}"
        used.add(name)
        out.append(visible(F.col(f"`{c}`").cast("string")).alias(name))
    return staging.select(*out)


def safe_name(name: str) -> str:
    """Capitals, digits and underscores, a letter first, at most 30 characters."""
    s = re.sub(r"[^A-Z0-9_]+", "_", name.upper()).strip("_") or "COLUMN"
    return (s if s[0].isalpha() else f"C_{s}")[:30]


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 with header, comma and double quotes."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_lineage(df: DataFrame, path: str, run_id: str) -> None:
    """Appends a run's lineage; the table is partitioned by run, so that one run is read or dropped alone."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def write_database(df: DataFrame, url: str, table: str, properties: dict | None = None, batch: int = 10_000) -> None:
    """Appends over JDBC in batches."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **(properties or {})).mode("append").save()


def probe(spark: SparkSession, base: str) -> bool:
    """Whether a folder can be written, read and cleaned."""
    name = f"{base.rstrip('/')}/probe-{uuid.uuid4().hex}"
    spark.range(3).write.parquet(name)
    ok = spark.read.parquet(name).count() == 3
    _Files(spark, base).drop(name.rpartition("/")[2])
    return ok


_TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>"""
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAX_WORKBOOK_ROWS = 1_048_575


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One sheet per table, every cell as text. Rows stream to the driver one by one; a table longer than a sheet is an error."""
    parts, names = [], list(sheets)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, name in enumerate(names, 1):
            df = sheets[name]
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as raw, io.TextIOWrapper(raw, "utf-8") as f:
                f.write('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", str(v)))}</t></is></c>'
                f.write("<row>" + "".join(map(cell, df.columns)) + "</row>")
                for n, row in enumerate(df.toLocalIterator(), 1):
                    if n > MAX_WORKBOOK_ROWS:
                        raise DeliveryError(f"{name} is longer than a sheet")
                    f.write("<row>" + "".join(map(cell, row)) + "</row>")
                f.write("</sheetData></worksheet>")
            parts.append(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
        z.writestr("[Content_Types].xml", _TYPES.format("".join(parts)))
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
