"""Places for intermediate tables that every executor and the driver can read."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

_KEY = "spark.checkpoint.dir"
_own: str | None = None
#: Where each table that this process has written lies, while it is there.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_run = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where the driver is the sole executor, may run without that setting; it then gets a
    folder of its own. Elsewhere a missing setting is an error, because a machine-local folder would lose rows.
    """
    global _own
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {_KEY} to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="routeloom-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the planner the true size, so that a join with the
    table is broadcast only when its measured size is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/routeloom/{_run}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _places[found] = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that its path names, whichever that is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that was derived from them has been written in turn."""
    for t in tables:
        path = _places.pop(t, None)
        if path is not None:
            _delete(t.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this process has written; for when its results have been consumed or stored."""
    _places.clear()
    _delete(spark, f"{shared_dir(spark)}/routeloom/{_run}")


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which are counted; else as it is.

    For written tables of a few numbers a row: a million of them take some tens of MB in an executor.
    """
    return broadcast(df) if df.count() <= rows else df


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results were written.

    Its cleaner removes them once the driver's collector has seen that no plan refers to them, which else may take
    half an hour; a job of many large steps would meanwhile hold the shuffles of all of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
