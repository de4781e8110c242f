"""Clustering metrics without a dense distance matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiloom.operators import vectors as vx

BLOCK_ROWS = 2048


def _valid(docs: DataFrame) -> DataFrame:
    return docs.where("topic_id != -1").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("topic_id").cast("int").alias("topic_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def silhouette_cosine(docs: DataFrame) -> DataFrame:
    """One row: the mean silhouette for cosine distance.

    The mean distance of a unit vector to a cluster is 1 - x . (sum of the cluster) / size,
    so only sums of clusters are needed.
    """
    units = _valid(docs).select("doc_id", "topic_id", vx.unit(F.col("embedding")).alias("u"))
    parts = units.select("topic_id", F.posexplode("u").alias("pos", "x")).groupBy("topic_id", "pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = parts.groupBy("topic_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("s"))
    table = sums.orderBy("topic_id").collect()  # one row per topic
    shared = docs.sparkSession.sparkContext.broadcast((np.array([r["topic_id"] for r in table]), np.array([r["n"] for r in table], dtype=float), np.array([r["s"] for r in table])))

    def run(batches):
        topic, n, total = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vx._unit_rows(vx._matrix(batch.column(1)))
            own = np.searchsorted(topic, batch.column(0).to_numpy())
            rows = np.arange(len(x))
            dots = x @ total.T
            mean = 1 - dots / n
            mean[rows, own] = np.inf
            b = mean.min(axis=1)
            size = n[own]
            # a vector's distance to itself is left out of its own cluster's mean
            a = (size - dots[rows, own] - 1 + (x * x).sum(axis=1)) / np.maximum(size - 1, 1)
            s = np.where(size > 1, (b - a) / np.maximum(a, b), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array([float(s.sum())]), pa.array([len(s)])], names=["s", "n"])

    found = _valid(docs).select("topic_id", "embedding").mapInArrow(run, "s double, n long")
    return found.agg((F.sum("s") / F.sum("n")).alias("silhouette"))


def silhouette_euclidean(docs: DataFrame) -> DataFrame:
    """One row: the mean silhouette for Euclidean distance, exact.

    Blocks of rows meet pairwise; a meeting yields per row and cluster the sum of
    distances, so what is shuffled afterwards is rows times clusters.
    """
    rows = _valid(docs)
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = dealt.select(F.col("b").alias("left"), every.alias("right"), F.lit(0).alias("role"), "doc_id", "topic_id", "embedding").unionByName(dealt.select(every.alias("left"), F.col("b").alias("right"), F.lit(1).alias("role"), "doc_id", "topic_id", "embedding"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        role, ids, topic = (rows[c].to_numpy() for c in ("role", "doc_id", "topic_id"))
        x = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        topics, place = np.unique(topic[b], return_inverse=True)
        square = (x**2).sum(axis=1)
        d = np.sqrt(np.maximum(0.0, square[a][:, None] + square[b][None, :] - 2 * x[a] @ x[b].T))
        d[ids[a][:, None] == ids[b][None, :]] = 0.0
        member = np.zeros((len(b), len(topics)))
        member[np.arange(len(b)), place] = 1
        sums, n = d @ member, member.sum(axis=0)
        return pa.table({"doc_id": np.repeat(ids[a], len(topics)), "own": np.repeat(topic[a], len(topics)), "other": np.tile(topics, len(a)), "total": sums.ravel(), "n": np.tile(n, len(a)).astype(np.int64)})

    sums = met.groupBy("left", "right").applyInArrow(run, "doc_id long, own int, other int, total double, n long")
    joined = sums.groupBy("doc_id", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("other")
    per = joined.groupBy("doc_id").agg(F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"))
    return per.select(F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)).alias("s")).agg(F.avg("s").alias("silhouette"))


def silhouette_sampled(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """One row: the silhouette of ``n`` rows with a topic, picked by a hash of seed and id."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    return silhouette_euclidean(docs.where("topic_id != -1").orderBy(h, "doc_id").limit(n))


def silhouette_precomputed(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the silhouette from given distances (a, b, distance; each pair once) of rows
    labelled by ``labels`` (id, topic_id) with an optional weight ``n``: rows at distance 0 that an id stands for."""
    rows = labels.withColumn("n", F.lit(1)) if "n" not in labels.columns else labels
    rows = rows.select("id", "topic_id", F.col("n").cast("double").alias("n"))
    sizes = rows.groupBy("topic_id").agg(F.sum("n").alias("size"))
    both = pairs.select("a", "b", "distance").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    other = rows.select(F.col("id").alias("b"), F.col("topic_id").alias("other"), F.col("n").alias("n_b"))
    sums = both.join(other, "b").groupBy("a", "other").agg(F.sum(F.col("distance") * F.col("n_b")).alias("s"), F.sum("n_b").alias("m"))
    # pairs that are not listed lie at distance 1, the largest of an agreement; rows of one id at 0
    each = rows.crossJoin(F.broadcast(sizes.select(F.col("topic_id").alias("other"), "size")))
    filled = each.join(sums, (F.col("id") == F.col("a")) & (each["other"] == sums["other"]), "left").select("id", "topic_id", "n", each["other"].alias("other"), "size", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("m", F.lit(0.0)).alias("m"))
    own = F.col("topic_id") == F.col("other")
    missing = F.col("size") - F.col("m") - F.when(own, F.col("n")).otherwise(0.0)
    total = F.col("s") + missing
    per = filled.groupBy("id").agg(F.max("n").alias("n"), F.max(F.when(own & (F.col("size") > 1), total / (F.col("size") - 1))).alias("a"), F.min(F.when(~own, total / F.col("size"))).alias("b"))
    s = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg((F.sum(F.coalesce(s, F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("silhouette"))


def _scatter(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = _valid(docs)
    means = vx.centroids(rows)
    apart = rows.join(F.broadcast(means.select("topic_id", "centroid")), "topic_id")
    difference = F.zip_with("embedding", "centroid", lambda x, m: x - m)
    return means, apart.select("topic_id", vx.dot(difference, difference).alias("d2"))


def calinski_harabasz(docs: DataFrame) -> DataFrame:
    """One row: between-group over within-group dispersion, each by its degrees of freedom."""
    means, within = _scatter(docs)
    rows = _valid(docs)
    overall = vx.centroids(rows.withColumn("topic_id", F.lit(0))).select(F.col("centroid").alias("g"), F.col("size").alias("n"))
    ssw = within.agg(F.sum("d2").alias("ssw"))
    difference = F.zip_with("centroid", "g", lambda x, m: x - m)
    ssb = means.crossJoin(F.broadcast(overall)).agg(F.sum(F.col("size") * vx.dot(difference, difference)).alias("ssb"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    return ssb.crossJoin(ssw).select(((F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def davies_bouldin(docs: DataFrame) -> DataFrame:
    """One row: the mean over clusters of the worst ratio of spreads to centroid distance."""
    means, within = _scatter(docs)
    spread = within.groupBy("topic_id").agg(F.avg(F.sqrt("d2")).alias("s"))
    table = means.join(spread, "topic_id").select("topic_id", "centroid", "s")
    other = table.select(F.col("topic_id").alias("t2"), F.col("centroid").alias("c2"), F.col("s").alias("s2"))
    difference = F.zip_with("centroid", "c2", lambda x, y: x - y)
    pairs = table.join(F.broadcast(other), F.col("topic_id") != F.col("t2")).select("topic_id", ((F.col("s") + F.col("s2")) / F.sqrt(vx.dot(difference, difference))).alias("r"))
    return pairs.groupBy("topic_id").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def evaluate(docs: DataFrame, method: str) -> DataFrame:
    """One row with all metrics of a labelling (doc_id, topic_id, embedding)."""
    covered = docs.agg(F.countDistinct(F.when(F.col("topic_id") != -1, F.col("topic_id"))).alias("n_clusters"), F.avg(F.when(F.col("topic_id") != -1, 1.0).otherwise(0.0)).alias("coverage"))
    out = covered.select(F.lit(method).alias("method"), "n_clusters", "coverage")
    if covered.first()["n_clusters"] < 2:
        return out.withColumns({m: F.lit(float("nan")) for m in ("silhouette", "calinski_harabasz", "davies_bouldin")})
    return out.crossJoin(silhouette_euclidean(docs)).crossJoin(calinski_harabasz(docs)).crossJoin(davies_bouldin(docs))
