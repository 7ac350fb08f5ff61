"""Sessions, and results written to the folder that a cluster's executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_written: set[str] = set()


def local_session(name: str = "gristmill", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        # A megabyte of texts or points is much work here; partitions of that size would leave cores idle.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    }
    return builder.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the session's executors, once, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_gristmill_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="gristmill-ship-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "gristmill_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.join("gristmill", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._gristmill_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, one of our own.

    Our own is a temporary folder on a local master, else one below the warehouse.
    """
    global _own_dir
    conf = spark.sparkContext.getConf()
    if given := conf.get("spark.checkpoint.dir"):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_gristmill"
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="gristmill-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, its lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = register_written(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def register_written(path: str) -> str:
    """``path``, to be deleted when the session stops or the process ends, or by clean_shared before."""
    if not _written:
        atexit.register(_forget)
    _written.add(path)
    return path


def _forget() -> None:
    """At the end of the process: its tables in the shared folder, on whatever file system, as long as a session is there."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            return _delete(spark, list(_written))
    except Exception:  # noqa: BLE001 - the gateway may be gone at exit
        pass
    for path in _written:
        if path.startswith(("/", "file:/")):
            shutil.rmtree(path.removeprefix("file://"), True)


def delete_materialized(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    _delete(df.sparkSession, [p for p in _written if any(f.rsplit("/", 1)[-1] == p.rsplit("/", 1)[-1] for f in folders)])


def clean_shared(spark: SparkSession) -> None:
    """Delete all tables that this process has materialized; results that weren't read or written yet need them."""
    _delete(spark, list(_written))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is materialized within is deleted at the end: for jobs that build a result and write it before they go on."""
    before = set(_written)
    try:
        yield
    finally:
        _delete(spark, list(_written - before))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for folder in paths:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _written.discard(folder)
