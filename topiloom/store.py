"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``.  Only where that is unset (a local test
    session) a temporary folder stands in for it.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='topiloom-')}"
        _OWN[app] = f"{base.rstrip('/')}/topiloom-{app}"
        atexit.register(_drop, spark, _OWN[app])
    return _OWN[app]


def _drop(spark: SparkSession, path: str) -> None:
    """Removes what a session has written, when its interpreter ends."""
    if spark.sparkContext._jsc is not None:
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a durable cut of the
    lineage that outlives lost executors and is computed once."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
