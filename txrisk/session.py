"""Session set-up, the package on the workers, and lineage cuts through the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()  # applications whose workers have the package


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    Every reader and every written table calls it, so that operators in Python work from any folder and on any
    cluster. A package that came as an archive (``--py-files``) is there already.
    """
    app = spark.sparkContext.applicationId
    root = os.path.dirname(os.path.abspath(__file__))
    if app not in _SHIPPED and os.path.isdir(root):
        # The driver's own copy, which Spark serves to the executors.
        path = os.path.join(tempfile.mkdtemp(prefix="txrisk-package-"), "txrisk.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, files in os.walk(root):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.join("txrisk", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
    return spark


def local_session(cores: str = "*", name: str = "txrisk", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_OWN: dict[str, str] = {}  # application id → folder, only where the session names none


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own; on a
    cluster a machine-local path would vanish with the executor that wrote it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="txrisk-")
    return _OWN[app]


def files_of(spark: SparkSession, path: str):
    """Spark's file system for a path, and the path as it names it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark).rstrip('/')}/txrisk/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later stages depend on the files and not on executors or on the lineage that
    made them, so values such as a range-partition number stay fixed on retry.
    """
    spark = ship(df.sparkSession)
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send at most ``rows`` rows at once to Python; for rows that hold whole blocks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
