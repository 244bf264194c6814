"""Tables in the shared scratch folder of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error elsewhere."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return qualified(spark, root.rstrip("/"))
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN_ROOT:
        _OWN_ROOT[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-notelake-")
    return _OWN_ROOT[context.applicationId]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority that Spark reads it by; a path without them is in the default file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = jvm_path.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()
    # Hadoop writes file:/x, other libraries want file:///x
    return "file://" + found[5:] if found.startswith("file:/") and not found.startswith("file://") else found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table or a folder."""
    return f"{scratch_root(spark)}/notelake-{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it again, which cuts the lineage; ``discard`` deletes what was written."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._scratch = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stash`` wrote and that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "_scratch", None)
        if path:
            remove(spark, path)
            table._scratch = None


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
