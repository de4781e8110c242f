"""Dense vectors: norms, centroids, similarities, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side of at most so many bytes is broadcast to all tasks; beyond it, blocks meet by joins.
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 1e-10, F.transform(a, lambda x: x / n)).otherwise(a)


def centroids(vectors: DataFrame, key: str = "topic_id") -> DataFrame:
    """key, size, centroid: the mean vector of every group, by partial sums per component."""
    parts = vectors.select(key, F.posexplode("embedding").alias("pos", "x"))
    mean = parts.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return mean.groupBy(key).agg(F.max("n").alias("size"), F.transform(ordered, lambda p: p["m"]).alias("centroid"))


def centroid_similarities(cents: DataFrame, key: str = "topic_id") -> DataFrame:
    """a, b, similarity for a < b: cosines of all pairs of centroids (a small table by nature)."""
    unit_rows = cents.select(F.col(key).alias("k"), unit(F.col("centroid")).alias("u"))
    left, right = unit_rows.select(F.col("k").alias("a"), F.col("u").alias("ua")), unit_rows.select(F.col("k").alias("b"), F.col("u").alias("ub"))
    return left.join(F.broadcast(right), F.col("a") < F.col("b")).select("a", "b", dot(F.col("ua"), F.col("ub")).alias("similarity"))


def nearest_centroid(vectors: DataFrame, cents: DataFrame, key: str = "topic_id") -> DataFrame:
    """doc_id, nearest, similarity: the centroid with the largest cosine, ties to the lower key.

    Centroids, one row per topic, go to all tasks; a batch of vectors is one matrix product.
    Works on streams as well."""
    rows = sorted((r[0], r[1]) for r in cents.select(key, "centroid").collect())
    table = np.array([c for _, c in rows]) if rows else np.zeros((0, 0))
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([k for k, _ in rows], dtype=np.int64), _unit_rows(table) if rows else table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, units = shared.value
        for batch in batches:
            if batch.num_rows and len(keys):
                sims = _unit_rows(_matrix(batch.column(1))) @ units.T
                best = sims.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[best]), pa.array(sims[np.arange(len(best)), best])], names=["doc_id", "nearest", "similarity"])

    wide = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")
    found = wide.mapInArrow(run, "doc_id long, nearest long, similarity double")
    return found.withColumn("nearest", F.col("nearest").cast(cents.schema[key].dataType))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 1e-10, n, 1.0)


def _top(sims: np.ndarray, row_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of each row by (similarity, lower id); ``ids`` ascend."""
    sims = np.where(row_ids[:, None] == ids[None, :], -np.inf, sims)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(sims)), order.shape[1])
    cols = order.ravel()
    keep = np.isfinite(sims[rows, cols])
    rows, cols = rows[keep], cols[keep]
    return row_ids[rows], ids[cols], sims[rows, cols]


KNN = "src long, dst long, similarity double"


def nearest_neighbours(vectors: DataFrame, k: int = 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """src, dst, similarity: the k rows with the largest cosine, never the row itself;
    ties go to the lower id.  ``vectors`` has doc_id and embedding.

    Exact.  A table within ``broadcast_bytes`` is sent to all tasks; a larger one is cut
    into blocks that meet pairwise, each meeting keeps k candidates per row, and a window
    keeps the best of those.
    """
    rows = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if n * (dim or 0) * 8 <= broadcast_bytes:
        return _broadcast_neighbours(rows, k)
    return _blocked_neighbours(rows, k, -(-n // BLOCK_ROWS))


def _broadcast_neighbours(rows: DataFrame, k: int) -> DataFrame:
    table = rows.orderBy("doc_id").toArrow()
    ids = table["doc_id"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((ids, _unit_rows(_matrix(table["embedding"].combine_chunks())) if len(ids) else np.zeros((0, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                own = _unit_rows(_matrix(part.column(1)))
                found = _top(own @ units.T, part.column(0).to_numpy(), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["src", "dst", "similarity"])

    return rows.mapInArrow(run, KNN)


def _blocked_neighbours(rows: DataFrame, k: int, blocks: int) -> DataFrame:
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    # every block meets every block: as the side that asks (role 0) and as the one that answers
    asks = dealt.select(F.col("b").alias("left"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("right"), F.lit(0).alias("role"), "doc_id", "embedding")
    answers = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("left"), F.col("b").alias("right"), F.lit(1).alias("role"), "doc_id", "embedding")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        role, ids = rows["role"].to_numpy(), rows["doc_id"].to_numpy()
        units = _unit_rows(_matrix(rows["embedding"].combine_chunks()))
        a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        b = b[np.argsort(ids[b])]
        return pa.table(dict(zip(("src", "dst", "similarity"), map(pa.array, _top(units[a] @ units[b].T, ids[a], ids[b], k)))))

    met = asks.unionByName(answers).groupBy("left", "right").applyInArrow(run, KNN)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    return met.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def sampled_median_distance(vectors: DataFrame, pairs: int = 2000, seed: int = 42) -> DataFrame:
    """One row: the median of 1 - cosine over pairs drawn by hashes of seed and number.

    Pairs are drawn from the 2 * ``pairs`` rows that come first by a hash, so that only
    those are numbered, however large the table is."""
    spark = vectors.sparkSession
    some = vectors.select("doc_id", "embedding").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), "doc_id").limit(2 * pairs)
    ranked = some.select("embedding", (F.row_number().over(Window.orderBy("doc_id")) - 1).alias("i"))
    n = ranked.count()
    draw = lambda side: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{side}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % max(n, 1)
    drawn = spark.range(pairs).select(draw("a").alias("a"), draw("b").alias("b")).withColumn("b", F.when(F.col("a") == F.col("b"), (F.col("b") + 1) % max(n, 1)).otherwise(F.col("b")))
    unit_rows = ranked.select("i", unit(F.col("embedding").cast("array<double>")).alias("u"))
    sides = drawn.join(unit_rows.select(F.col("i").alias("a"), F.col("u").alias("ua")), "a").join(unit_rows.select(F.col("i").alias("b"), F.col("u").alias("ub")), "b")
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("ua"), F.col("ub"))))
    return sides.select((1 - cosine).alias("d")).agg(F.percentile("d", 0.5).alias("median_dist"))


def mean_pairwise_distance(vectors: DataFrame, key: str = "topic_id") -> DataFrame:
    """key, size, mean_pairwise_dist: the mean of 1 - cosine over all pairs of a group.

    For unit vectors that is (n^2 - |sum|^2) / (n (n - 1)), so no pairs are formed.
    """
    units = vectors.select(key, unit(F.col("embedding").cast("array<double>")).alias("u"))
    sums = units.select(key, F.posexplode("u").alias("pos", "x")).groupBy(key, "pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    total = sums.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("size"))
    n = F.col("size").cast("double")
    return total.select(key, "size", F.when(F.col("size") > 1, (n * n - F.col("q")) / (n * (n - 1))).alias("mean_pairwise_dist"))
