"""Cutting lineage with tables in the folder that all nodes of the cluster share.

An operator that needs the same intermediate result more than once writes it as Parquet and reads it back. The
folder comes from ``spark.checkpoint.dir``; a private one is made only for a local master without that setting (tests,
single-machine sessions), so executors never depend on another machine's local disk and a lost executor costs
no more than the tasks it was running.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_private: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or a private one where the setting is absent and all tasks run on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _private:
        _private[app] = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, _private[app], ignore_errors=True)
    return "file://" + _private[app]


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/skein/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back; its lineage starts at those files."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> None:
    """Delete every table that :func:`materialize` wrote for this application; results that still read them must have been saved."""
    p, fs = _path(spark, _tables(spark))
    fs.delete(p, True)


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the tables below ``folder`` whose writing has ended; none where the folder is absent."""
    p, fs = _path(spark, folder)
    if not fs.exists(p):
        return []
    kinds = spark.sparkContext._jvm.org.apache.hadoop.fs
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory() and fs.exists(kinds.Path(s.getPath(), "_SUCCESS")))
