"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Of a call to shared_dir() on a local session that names no shared folder.
_LOCAL: dict[str, str] = {}
#: Paths of the intermediate tables that are still there.
_TABLES: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach, for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    the session runs in one process (tests, a laptop) a local temporary folder
    takes its place; any other master without the setting is an error.
    """
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="marketspark-")
    return "file://" + _LOCAL[app]


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver ends, or by ``drop_tables``."""
    path = f"{shared_dir(spark)}/marketspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _TABLES[path] = spark
    return path


def _forget(path: str) -> None:
    spark = _TABLES.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:  # the session has ended; the folder is the cluster's to clear
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _forget_all() -> None:
    from py4j.protocol import Py4JError

    for path in list(_TABLES):
        try:
            _forget(path)
        except (Py4JError, OSError):  # the JVM went first
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table of the shared folder and reads it back.

    Cuts the lineage in a way that outlives any executor.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._marketspark_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Deletes materialised tables that no result reads any more."""
    for t in tables:
        _forget(t._marketspark_path)
