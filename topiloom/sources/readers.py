"""Sources.  Every reader declares its schema."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADLINES = "publish_date string, headline_text string"
TOPIC_INFO = "Topic int, Count long, Keywords string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str = HEADLINES) -> DataFrame:
    """A CSV file with a header; quoted fields may hold line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def headlines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, publish_date; ids come from the text and date, not from the position."""
    raw = csv(spark, path).where("headline_text IS NOT NULL")
    day = F.coalesce(F.try_to_date("publish_date", "yyyyMMdd"), F.try_to_date("publish_date", "yyyy-MM-dd"))
    return raw.select(F.xxhash64("publish_date", "headline_text").alias("doc_id"), F.col("headline_text").alias("text"), day.alias("publish_date"))


def json_state(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, base64 of binary files, as a vision model takes them."""
    return spark.read.format("binaryFile").load(path).select("path", F.base64("content").alias("base64"))


def list_literal(text):
    """The items of a list written as text, such as ['a', 'b']; a plain text is one item."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\[", ""), r"\]$", "")
    items = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""))
    return F.when(F.trim(text).startswith("["), F.filter(items, lambda x: x != "")).otherwise(F.array(text))


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        n = len(np.load(self.path, mmap_mode="r"))
        return [_Rows(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [_Rows(0, 0)]

    def read(self, partition):
        part = np.load(self.path, mmap_mode="r")[partition.first : partition.last]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.last)), pa.array([x.astype(np.float32) for x in part], pa.list_(pa.float32()))], names=["row", "embedding"])


class NpySource(DataSource):
    """``spark.read.format("npy")``: row, embedding of a two-dimensional array file that all
    executors can open; rows are read through a memory map, part by part."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options["path"], int(self.options.get("rowsPerPartition", 100_000)))


def npy(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").load(path)
