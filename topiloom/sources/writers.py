"""Sinks.  Tables are written by the tasks; only small reports pass through the driver."""

from __future__ import annotations

import io
import json
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiloom.store import cut


def csv_report(rows: DataFrame, path: str, bom: bool = False) -> None:
    """A report of bounded size as one CSV file, with a byte-order mark if wanted."""
    rows.toPandas().to_csv(path, index=False, encoding="utf-8-sig" if bom else "utf-8")


def csv_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def npy_vectors(vectors: DataFrame, folder: str) -> DataFrame:
    """path, first_id, rows: the vectors (doc_id, embedding) as array files in ``folder``, one
    for each task, every one with a file of its ids beside it; rows are in the order of ids."""

    def run(batches):
        rows = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        out = []
        if rows is not None:
            store, base = pyarrow.fs.FileSystem.from_uri(folder)
            store.create_dir(base, recursive=True)
            rows = rows.sort_by("doc_id")
            ids = rows["doc_id"].to_numpy()
            x = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), -1)
            name = uuid.uuid4().hex
            for suffix, array in (("", x), (".ids", ids)):
                with store.open_output_stream(f"{base}/{name}{suffix}.npy") as stream:
                    held = io.BytesIO()
                    np.save(held, array)
                    stream.write(held.getbuffer())
            out = [{"path": f"{folder}/{name}.npy", "first_id": int(ids[0]), "rows": len(ids)}]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("rows", pa.int64())]))

    rows = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("embedding IS NOT NULL")
    return cut(rows.mapInArrow(run, "path string, first_id long, rows long"), "npy")


def json_report(one_row: DataFrame, path: str) -> None:
    Path(path).write_text(json.dumps(one_row.first().asDict(True), indent=2, ensure_ascii=False))


def tree_json(edges: DataFrame, path: str | None = None) -> dict:
    """The nested topic tree from rows of ``tree_edges`` (topics, not documents)."""
    rows = [r.asDict() for r in edges.collect()]
    below: dict = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r)

    def node(r: dict) -> dict:
        children = sorted(below.get(r["id"], []), key=lambda c: (-c["size"], c["id"]))
        return {"id": r["id"], "name": r["name"], "size": r["size"], "depth": r["depth"], "status": r["status"], "children": [node(c) for c in children]}

    known = {r["id"] for r in rows}
    roots = sorted((r for r in rows if r["parent"] not in known), key=lambda r: (-r["size"], r["id"]))
    leaves = [r for r in rows if r["id"] not in below and r["status"] == "accepted"]
    out = {"tree": [node(r) for r in roots], "meta": {"root_groups": len(roots), "leaf_topics": len(leaves), "total_accepted": sum(r["size"] for r in leaves)}}
    if path:
        Path(path).write_text(json.dumps(out, indent=2, ensure_ascii=False))
    return out


def markdown_report(title: str, rows: DataFrame, limit: int = 30) -> str:
    """A heading and a table of the first rows."""
    head = rows.limit(limit).collect()
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in head]) + "\n"


def size_rank(sizes: DataFrame) -> DataFrame:
    """Chart-ready: rank, size, and both on a log scale."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("size"), "topic_id"))
    return sizes.select(rank.alias("rank"), "size", F.log10(rank.cast("double")).alias("log_rank"), F.log10(F.col("size").cast("double")).alias("log_size"))


class CatalogStore:
    """Catalog state by round: each save is a new folder, so a failed round leaves the last one whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, round_: int, nodes: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
        at = f"{self.folder}/round={round_}"
        nodes.write.mode("overwrite").parquet(f"{at}/nodes")
        membership.write.mode("overwrite").parquet(f"{at}/membership")
        self.spark.createDataFrame([(round_,)], "round int").coalesce(1).write.mode("overwrite").json(f"{at}/done")
        return self.load(round_)

    def load(self, round_: int) -> tuple[DataFrame, DataFrame]:
        at = f"{self.folder}/round={round_}"
        return self.spark.read.parquet(f"{at}/nodes"), self.spark.read.parquet(f"{at}/membership")

    def last(self) -> int | None:
        """The last complete round, or None."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n.removeprefix("round=")) for n in names if n.startswith("round=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/done/_SUCCESS"))]
        return max(done, default=None)
