"""Session settings and the shared staging folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 4, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or (unset, as in tests) a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"tidewright-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per application."""
    context = spark.sparkContext
    if getattr(context, "_tidewright_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidewright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tidewright.zip")
    with zipfile.ZipFile(path, "w") as z:
        for where, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(where, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    if _BATCH not in spark.conf.getAll:  # nobody chose a size; long texts need smaller batches than the default
        spark.conf.set(_BATCH, "2000")
    context._tidewright_shipped = True


class Stage:
    """Tables an iterative operator writes to the shared folder, so that its lineage stays short and a lost executor costs no rework.

    A table lives until ``drop`` names it, at the longest until the application ends. What the returned result still reads must not
    be dropped.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{label}"

    def write(self, df: DataFrame, label: str, schema=None) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(schema or df.schema).parquet(path)
        out._staged = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._staged)
            path.getFileSystem(conf).delete(path, True)
