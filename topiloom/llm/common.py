"""What the corpus operators share: tables, durable cuts of the lineage, ranks.

Every operator here takes DataFrames and returns DataFrames.  Where an operator
needs a result twice, or must not repeat costly work when an executor is lost,
it calls :func:`cut`, which writes a table to the cluster's shared folder.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Sequence
from contextlib import suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topiloom.store import cut, discard, fresh_path  # noqa: F401 - operators take them from here

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int) -> DataFrame:
    """Adds ``name``: a rank within ``keys``, gapless from 0.

    No task holds a whole key: rows of a key are dealt into hash buckets, ranked
    inside each, and shifted by the counts of the buckets before.  ``rows`` is
    the number of rows of ``df``; it sets only how many buckets there are.
    """
    buckets = max(1, min(65_536, rows // 1_000))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    shifts = counts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_shift"))
    local = dealt.withColumn("_local", F.row_number().over(inner) - 1)
    on = local["_bucket"] == shifts["_b"]
    for k in keys:
        on &= local[k].eqNullSafe(shifts[f"_k_{k}"])
    return local.join(shifts, on).withColumn(name, (F.col("_local") + F.col("_shift")).cast("long")).drop("_bucket", "_local", "_b", "_shift", *(f"_k_{k}" for k in keys))


class Scratch:
    """Tables of one operator's run, which :meth:`drop` deletes once its result is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, what: str, release: bool = False) -> DataFrame:
        """As :func:`cut`; ``release`` lets Spark delete the shuffle files of the finished job and
        gives the driver's free memory back now."""
        path = fresh_path(self.spark, what)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
        del df
        if release:
            release_shuffles(self.spark)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            discard(self.spark, path)
        self.paths = []


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes a finished job's shuffle files when the driver collects its garbage,
    which on a quiet driver may be much later; this asks for it.  The heap shrinks to what is
    in use, and what the driver has freed outside of it goes back to the system as well."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> bool:
    """Gives back what the driver's JVM has freed outside its heap (compilers, compression), which
    its allocator keeps for each thread.  Whether the JVM has that command; without it all stays as it is."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    with suppress(Py4JError):
        # through the interface: the server's own class is closed to reflection
        types, values = gateway.new_array(jvm.java.lang.Class, len(kinds)), gateway.new_array(jvm.java.lang.Object, len(kinds))
        for i, kind in enumerate(kinds):
            types[i] = jvm.java.lang.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
        return True
    return False


def trim_worker() -> None:
    """Gives back what a Python worker has freed.  Workers are used again by later stages, where
    what the allocators keep of large models and tables would count beside what those need.
    A C library without that call keeps it."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def hash_sample(df: DataFrame, bound: int, rows: int, *columns: str) -> DataFrame:
    """``bound`` of the ``rows`` rows of ``df``: those with the least hash of ``columns``, added as ``_h``.

    Ties go by all columns, so the sample does not depend on how the table is stored, and
    however often a value repeats, no more rows leave their tasks.  Only about 1.5 *
    ``bound`` rows are sorted.
    """
    share = min(1.0, (1.5 * bound + 8) / max(1, rows))
    picked = df.withColumn("_h", F.pmod(F.xxhash64(*columns), F.lit(1 << 30))).where(F.col("_h") < int(share * (1 << 30)) + 1)
    return picked.orderBy("_h", *df.columns).limit(bound)


def as_row(df: DataFrame) -> DataFrame:
    """``df`` as one column, ``row``: what is added beside it clashes with none of its names."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def field(name: str) -> Column:
    """A column of the rows of :func:`as_row`."""
    return F.col("row").getField(name)


def from_row(df: DataFrame, columns: Sequence[str], **instead: Column) -> DataFrame:
    """The ``columns`` of the rows of :func:`as_row`, some of them replaced."""
    return df.select(*(instead.get(c, field(c)).alias(c) for c in columns))


#: No more than so many keys of a table can each have a share of rows above 1 / ``HOT_KEYS``.
HOT_KEYS = 100_000
HOT_ROWS = 200


def hot_rows(rows: int) -> int:
    """The number of rows beyond which a key counts as hot.  At most ``HOT_KEYS`` keys can
    have more, so a table of hot keys is small enough to broadcast, however large the input."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def with_value(rows: DataFrame, key: str, values: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with the ``values`` (_key, ...) of their key, inner.  Those of ``hot`` keys, a part
    of ``values`` that :func:`hot_rows` bounds, are broadcast, so that no task gets all rows of a key."""
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    rest = found.where("_key IS NULL").select(*rows.columns).join(values, F.col(key) == F.col("_key"))
    return found.where("_key IS NOT NULL").unionByName(rest).drop("_key")


def salted(rows: DataFrame, key: str, values: DataFrame, total: int) -> DataFrame:
    """``rows`` (a stored table) left-joined with the ``values`` (_key, ...) of their key, however
    large those are: a hot key's rows are dealt into parts, each of which meets a copy of its values.
    ``total`` is the number of rows, which tells what is hot."""
    limit = hot_rows(total)
    hot = rows.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot = F.broadcast(hot.select("_hot", F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_hot", "_parts")
    spread = values.join(hot, F.col("_key") == F.col("_hot"), "left")
    spread = spread.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts")
    return dealt.join(spread, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_part")), "left").drop("_key", "_salt", "_part")
