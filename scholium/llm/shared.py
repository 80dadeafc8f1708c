"""Shared storage for intermediate tables, and the settings the operators read from the session.

Lineage is cut by writing Parquet below the folder that the cluster names in ``spark.checkpoint.dir``: every
executor sees it, so a lost executor costs a re-read and nothing more. No operator keeps state in a
machine-local folder. What a written table was shuffled through is deleted as soon as it stands, and a table that
has been read for the last time is given back by :func:`release`; the rest goes when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where the session names none and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scholium-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/scholium/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    return path


@contextlib.contextmanager
def _cleanup(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _cleanup(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scholium_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialize` that nothing will read again."""
    for table in tables:
        path = table._scholium_path
        if path in _written:
            _delete(_written.pop(path), path)


@contextlib.contextmanager
def scratch():
    """Deletes on leaving what was written meanwhile, but for the tables appended to the list that it gives."""
    before, keep = set(_written), []
    yield keep
    kept = {t._scholium_path for t in keep}
    for path in [p for p in _written if p not in before and p not in kept]:
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may already have ended
            return


def partitions_of(df: DataFrame) -> int:
    """Number of input partitions, a measure of the input that needs no scan."""
    return max(1, df.rdd.getNumPartitions())
