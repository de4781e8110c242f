"""Clustering and reduction models.

Large tables go through Spark ML or through DataFrame sums; methods that need a whole
matrix (agglomerative, density-based, Gibbs sampling) run in one task on a documented,
bounded number of rows: on all of a table up to ``MATRIX_ROWS`` rows, beyond that on
micro-clusters or a sample, from which every other row gets its topic.  Where the named
method is not available on Spark, the docstring says what stands in for it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA, KMeans, PowerIterationClustering
from pyspark.ml.feature import PCA, CountVectorizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topiloom.functions import text as tx
from topiloom.operators import metrics, text, topics
from topiloom.operators.leiden import by_size
from topiloom.store import cut

#: Rows that a whole-matrix method takes at most.
MATRIX_ROWS = 10_000
#: Micro-clusters that stand for the rows of a larger table.
MICRO_CLUSTERS = 1000
#: Rows of a part that :func:`two_level` clusters in one task.
PART_ROWS = 5_000


def with_vector(docs: DataFrame, column: str = "embedding", out: str = "features") -> DataFrame:
    return docs.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def kmeans(docs: DataFrame, k: int = 12, seed: int = 42) -> DataFrame:
    """doc_id, topic_id."""
    rows = with_vector(docs.select("doc_id", "embedding"))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="topic_id").fit(rows).transform(rows).select("doc_id", "topic_id")


def kmeans_scan(docs: DataFrame, ks: tuple[int, ...], seed: int = 42, sample: int = 5000) -> DataFrame:
    """k, cost, silhouette, davies_bouldin, calinski_harabasz of k-means for each k: what
    :func:`~topiloom.operators.topics.choose_k` chooses from.  The silhouette is that of
    ``sample`` rows by a hash; all else is of the whole table."""
    data = docs.select("doc_id", "embedding")
    rows = with_vector(data).cache()
    parts = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="topic_id").fit(rows)
        found = cut(model.transform(rows).select("doc_id", "topic_id", "embedding"), "kmeans")
        cost = docs.sparkSession.createDataFrame([(k, float(model.summary.trainingCost))], "k int, cost double")
        parts.append(cost.crossJoin(metrics.silhouette_sampled(found, sample)).crossJoin(metrics.davies_bouldin(found)).crossJoin(metrics.calinski_harabasz(found)))
    rows.unpersist()
    return reduce(DataFrame.unionByName, parts)


def prior_scan(docs: DataFrame, dims: int = 50, k: int = 200, priors: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), iterations: int = 20, seed: int = 42, sample: int = 5000) -> DataFrame:
    """prior, silhouette, confidence, entropy, n_topics of a stick-breaking mixture for each
    prior: what :func:`~topiloom.operators.topics.choose_prior` chooses from.  A component
    counts as a topic from a weight of 1e-4 on."""
    reduced = cut(pca(docs, dims, scale=True)[0], "reduced")
    parts = []
    for prior in priors:
        p, weight = diagonal_mixture(reduced, k, iterations, seed, 1e-3, prior)
        soft = cut(topics.soft_assignment(p), "soft")
        labelled = soft.join(reduced, "doc_id").select("doc_id", "topic_id", F.col("reduced").alias("embedding"))
        means = topics.mean_confidence(soft).select(F.col("mean_confidence").alias("confidence"), F.col("mean_entropy").alias("entropy"))
        told = metrics.silhouette_sampled(labelled, sample).crossJoin(means)
        parts.append(told.select(F.lit(float(prior)).alias("prior"), F.coalesce("silhouette", F.lit(0.0)).alias("silhouette"), "confidence", "entropy", F.lit(int((weight > 1e-4).sum())).alias("n_topics")))
    return reduce(DataFrame.unionByName, parts)


def topic_composite(docs: DataFrame, dims: int = 5, min_size: int = 10, outlier_threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, topic_id, new_topic_id) and (topic_id, term, weight, rank): vectors are reduced (PCA
    stands in for UMAP), density clusters found, named by class TF-IDF, and outliers
    taken into the nearest topic.  ``docs`` has doc_id, text and embedding."""
    reduced = pca(docs, dims)[0].select("doc_id", F.col("reduced").alias("x"))
    found = cut(density(reduced, min_size), "density")
    named = docs.select("doc_id", "text", "embedding").join(found, "doc_id")
    moved = topics.reassigned(named.select("doc_id", "topic_id", "embedding"), outlier_threshold, inclusive=False)
    return moved, text.class_tfidf(named.where("topic_id >= 0").select("doc_id", "topic_id", "text"))


def lda_topics(docs: DataFrame, k: int = 10, iterations: int = 10, vocabulary: int = 2000, seed: int = 42) -> DataFrame:
    """doc_id, topic_id by online LDA over content words."""
    words = docs.select("doc_id", tx.without_stop_words(tx.tokens(F.col("text"))).alias("words"))
    counted = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, minDF=2).fit(words).transform(words)
    model = LDA(k=k, maxIter=iterations, optimizer="online", seed=seed).fit(counted)
    shares = vector_to_array("topicDistribution")
    return model.transform(counted).select("doc_id", (F.array_position(shares, F.array_max(shares)) - 1).cast("int").alias("topic_id"))


def svd(docs: DataFrame, dims: int = 100) -> DataFrame:
    """doc_id, reduced: truncated singular value decomposition, without centring."""
    rows = docs.select("doc_id", F.col("embedding").cast("array<double>").alias("x"))
    matrix = RowMatrix(with_vector(rows, "x").select("features").rdd.map(lambda r: r[0].toArray()))
    v = matrix.computeSVD(dims, computeU=False).V.toArray()
    return project(rows, v, np.zeros(len(v)))


def project(rows: DataFrame, axes: np.ndarray, mean: np.ndarray) -> DataFrame:
    """doc_id, reduced: (x - mean) times ``axes``; both are of the size of one vector by some dozens."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list((x - mean) @ axes), pa.list_(pa.float64()))], names=["doc_id", "reduced"])

    return rows.select(F.col("doc_id").cast("long"), "x").mapInArrow(run, "doc_id long, reduced array<double>")


def pca(docs: DataFrame, dims: int = 50, scale: bool = False) -> tuple[DataFrame, list[float]]:
    """(doc_id, reduced) and the explained shares of variance; rows are centred."""
    rows = with_vector(docs)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=scale).fit(rows).transform(rows)
    model = PCA(k=dims, inputCol="scaled", outputCol="reduced").fit(scaled)
    return model.transform(scaled).select("doc_id", vector_to_array("reduced").alias("reduced")), model.explainedVariance.toArray().tolist()


def _log_density(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    out = np.log(weight + 1e-300) - 0.5 * (np.log(2 * np.pi * var)).sum(axis=1)
    return out - 0.5 * ((x**2) @ (1 / var).T - 2 * x @ (mean / var).T + (mean**2 / var).sum(axis=1))


def diagonal_mixture(rows: DataFrame, k: int = 50, iterations: int = 20, seed: int = 42, floor: float = 1e-6, concentration: float | None = None) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, p) and the weights of a Gaussian mixture with diagonal covariances.

    ``rows`` has doc_id and reduced.  Each step is one pass whose tasks return k sums each;
    ``concentration`` makes the weights those of a truncated stick-breaking prior, so that
    needless components die out.
    """
    spark = rows.sparkSession
    data = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("reduced").alias("x"))
    start = data.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))).limit(k).toArrow()
    dim = len(start["x"][0])
    mean = np.array(start["x"].to_pylist())
    k = len(mean)
    stats = data.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.var_pop("v").alias("v")).orderBy("d").toPandas()
    var = np.tile(stats["v"].to_numpy() + floor, (k, 1))
    weight = np.full(k, 1 / k)

    def soft(x, weight, mean, var):
        z = _log_density(x, weight, mean, var)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def matrix(batch):
        return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    for _ in range(iterations):
        shared = spark.sparkContext.broadcast((weight, mean, var))

        def sums(batches):
            n, s, q = np.zeros(k), np.zeros((k, dim)), np.zeros((k, dim))
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch)
                    p = soft(x, *shared.value)
                    n, s, q = n + p.sum(axis=0), s + p.T @ x, q + p.T @ x**2
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int64()), pa.array(n), pa.array(list(s), pa.list_(pa.float64())), pa.array(list(q), pa.list_(pa.float64()))], names=["c", "n", "s", "q"])

        parts = data.mapInArrow(sums, "c long, n double, s array<double>, q array<double>").toArrow()
        c = parts["c"].to_numpy()
        n, s, q = np.zeros(k), np.zeros((k, dim)), np.zeros((k, dim))
        np.add.at(n, c, parts["n"].to_numpy())
        np.add.at(s, c, np.array(parts["s"].to_pylist()))
        np.add.at(q, c, np.array(parts["q"].to_pylist()))
        mean = s / np.maximum(n, 1e-12)[:, None]
        var = np.maximum(q / np.maximum(n, 1e-12)[:, None] - mean**2, 0) + floor
        if concentration is None:
            weight = n / n.sum()
        else:
            order = np.argsort(-n)
            tail = np.cumsum(n[order][::-1])[::-1] - n[order]
            stick = (1 + n[order]) / (1 + n[order] + concentration + tail)
            weight = np.empty(k)
            weight[order] = stick * np.concatenate([[1.0], np.cumprod(1 - stick)[:-1]])
            weight /= weight.sum()
    final = spark.sparkContext.broadcast((weight, mean, var))

    def assign(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(soft(matrix(batch), *final.value)), pa.list_(pa.float64()))], names=["doc_id", "p"])

    return data.mapInArrow(assign, "doc_id long, p array<double>"), weight


def _whole(rows: DataFrame, label, columns: str = "x") -> DataFrame:
    """doc_id, topic_id from one function over the whole (bounded) matrix."""
    if rows.count() > MATRIX_ROWS:
        raise ValueError(f"this method holds a whole matrix; it takes at most {MATRIX_ROWS} rows, so pass a sample")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        x = t["x"].combine_chunks()
        values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) if pa.types.is_list(x.type) and not pa.types.is_string(x.type.value_type) else x.to_pylist()
        return pa.table({"doc_id": t["doc_id"], "topic_id": pa.array(np.asarray(label(values)).astype(np.int32))})

    return rows.select(F.lit(0).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.col(columns).alias("x")).groupBy("g").applyInArrow(run, "doc_id long, topic_id int")


def linkage(distance: np.ndarray, k: int, kind: str = "average", weight: np.ndarray | None = None) -> np.ndarray:
    """Agglomerative clustering of a distance matrix into k groups, by Lance-Williams updates."""
    d = distance.astype(float).copy()
    if kind == "ward":
        d = d**2
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if weight is None else weight.astype(float).copy()
    owner = np.arange(n)
    near, best = d.argmin(axis=1), d.min(axis=1)
    alive = np.ones(n, dtype=bool)
    for _ in range(max(0, n - k)):
        i = int(np.where(alive, best, np.inf).argmin())
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        if kind == "average":
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        elif kind == "complete":
            row = np.maximum(d[i], d[j])
        else:
            total = size[i] + size[j] + size
            row = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / total
        row[~alive] = np.inf
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        best[j] = np.inf
        owner[owner == j] = i
        stale = np.flatnonzero(alive & ((near == i) | (near == j) | (row < best)))
        for r in {*stale.tolist(), i}:
            near[r], best[r] = int(d[r].argmin()), d[r].min()
    return by_size(owner)


def agglomerative(rows: DataFrame, k: int = 30, kind: str = "ward") -> DataFrame:
    """doc_id, topic_id of (doc_id, x); ward, average or complete linkage over Euclidean distance.

    Tables beyond ``MATRIX_ROWS`` rows are first parted into micro-clusters by k-means,
    whose weighted centres are linked; each row takes the topic of its micro-cluster.
    """

    def distances(x: np.ndarray) -> np.ndarray:
        s = (x**2).sum(axis=1)
        return np.sqrt(np.maximum(0, s[:, None] + s[None] - 2 * x @ x.T))

    if rows.count() <= MATRIX_ROWS:
        return _whole(rows, lambda x: linkage(distances(x), min(k, len(x)), kind))
    data = with_vector(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "x"), "x")
    model = KMeans(k=MICRO_CLUSTERS, seed=42, initMode="random", maxIter=10, featuresCol="features", predictionCol="micro").fit(data)
    near = model.transform(data).select("doc_id", "micro").persist()
    size = dict(near.groupBy("micro").count().collect())
    used = np.array(sorted(size))
    weight = np.array([size[m] for m in used.tolist()], dtype=float)
    d = distances(np.array(model.clusterCenters())[used])
    if kind == "ward":  # of groups of such sizes, in the scale of single rows
        d *= np.sqrt(2 * weight[:, None] * weight[None] / (weight[:, None] + weight[None]))
    label = linkage(d, min(k, len(used)), kind, weight)
    named = rows.sparkSession.createDataFrame(list(zip(used.tolist(), label.tolist())), "micro int, topic_id int")
    return near.join(F.broadcast(named), "micro").select("doc_id", "topic_id")


def spectral(edges: DataFrame, k: int = 20, iterations: int = 20) -> DataFrame:
    """doc_id, topic_id by power iteration clustering of a neighbour graph, a close relative of
    spectral clustering that scales out."""
    model = PowerIterationClustering(k=k, maxIter=iterations, initMode="degree", weightCol="weight")
    return model.assignClusters(edges.select("src", "dst", "weight")).select(F.col("id").alias("doc_id"), F.col("cluster").cast("int").alias("topic_id"))


def density_labels(x: np.ndarray, min_size: int, min_samples: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels of a matrix by one density cut, the rows' core distances, and the height of the cut."""
    if not len(x):
        return np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
    n = len(x)
    s = (x**2).sum(axis=1)
    d = np.sqrt(np.maximum(0, s[:, None] + s[None] - 2 * x @ x.T))
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    best, link, seen, tree = reach[0].copy(), np.zeros(n, dtype=int), np.zeros(n, dtype=bool), []
    seen[0] = True
    for _ in range(n - 1):
        j = int(np.where(seen, np.inf, best).argmin())
        tree.append((best[j], int(link[j]), j))
        seen[j] = True
        closer = reach[j] < best
        best[closer], link[closer] = reach[j][closer], j
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size, count, top = [1] * n, 0, (0, 0)
    tree.sort()
    for step, (_, a, b) in enumerate(tree):
        a, b = find(a), find(b)
        count += (size[a] + size[b] >= min_size) - (size[a] >= min_size) - (size[b] >= min_size)
        root[b] = a
        size[a] += size[b]
        top = max(top, (count, step + 1))
    root = list(range(n))
    for _, a, b in tree[: top[1]]:
        root[find(b)] = find(a)
    own = np.array([find(i) for i in range(n)])
    _, place, number = np.unique(own, return_inverse=True, return_counts=True)
    label = by_size(np.where(number[place] >= min_size, own, -1 - own)) if n else own
    return np.where(number[place] >= min_size, label, -1), core, float(tree[top[1] - 1][0]) if top[1] else 0.0


def _sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by a hash of doc_id; only ids and hashes are sorted."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    return rows.join(F.broadcast(rows.select("doc_id").orderBy(h).limit(n)), "doc_id", "left_semi").limit(n)


def density(rows: DataFrame, min_size: int = 10, min_samples: int = 3, least_gap: float = 0.05) -> DataFrame:
    """doc_id, topic_id by hierarchical density: mutual reachability, its minimum spanning tree,
    and the cut with the most clusters of at least ``min_size``; others are -1.

    Stands in for HDBSCAN: one cut of the same hierarchy instead of its excess of mass.
    Beyond ``MATRIX_ROWS`` rows the cut is that of a sample of so many; each row then takes the
    topic of its nearest sampled row, if that one reaches it at the height of the cut.
    """
    if rows.count() <= MATRIX_ROWS:
        return _whole(rows, lambda x: density_labels(x, min_size, min_samples)[0])
    data = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "x")
    drawn = _sample(data, MATRIX_ROWS)

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        label, core, height = density_labels(x, min_size, min_samples)
        return pa.table({"x": pa.array(list(x), pa.list_(pa.float64())), "label": pa.array(label.astype(np.int32)), "core": pa.array(core), "height": pa.array(np.full(len(t), height))})

    fitted = drawn.select(F.lit(0).alias("g"), "doc_id", "x").groupBy("g").applyInArrow(fit, "x array<double>, label int, core double, height double").toArrow()
    points = np.array(fitted["x"].to_pylist())
    shared = rows.sparkSession.sparkContext.broadcast((points, fitted["label"].to_numpy(), fitted["core"].to_numpy(), fitted["height"][0].as_py()))

    def assign(batches):
        points, label, core, height = shared.value
        square = (points**2).sum(axis=1)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out = np.full(len(x), -1, dtype=np.int32)
            for a in range(0, len(x), 512):
                own = x[a : a + 512]
                near = (square[None] - 2 * own @ points.T).argmin(axis=1)
                d = np.sqrt(((own - points[near]) ** 2).sum(axis=1))
                out[a : a + 512] = np.where(np.maximum(d, core[near]) <= height, label[near], -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "topic_id"])

    return data.mapInArrow(assign, "doc_id long, topic_id int")


def two_level(docs: DataFrame, k: int = 12, seed: int = 42, fraction: int = 50) -> DataFrame:
    """doc_id, l1_topic, l2_topic: k-means, then density clusters inside each part; parts run in parallel.

    Rows in no density cluster have l2_topic -1.  A part is one task with some square matrices
    of its rows, so parts of more than ``PART_ROWS`` rows are parted further by k-means, and the
    topics of all pieces of a part are numbered on."""
    first = _bounded_parts(docs, kmeans(docs, k, seed), seed)
    rows = docs.select("doc_id", "embedding").join(first, "doc_id").select("l1_topic", "piece", F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("x"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        n = len(t)
        x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        sub = np.zeros(n, dtype=np.int64) if n <= 10 else density_labels(x, max(5, n // fraction), 3)[0]
        return pa.table({"doc_id": t["doc_id"], "l1_topic": t["l1_topic"], "piece": t["piece"], "l2_topic": pa.array(sub.astype(np.int32))})

    found = cut(rows.groupBy("l1_topic", "piece").applyInArrow(run, "doc_id long, l1_topic int, piece int, l2_topic int"), "parts")
    counts = found.groupBy("l1_topic", "piece").agg((F.max("l2_topic") + 1).alias("n"))
    before = Window.partitionBy("l1_topic").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("l1_topic", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    number = F.when(F.col("l2_topic") >= 0, F.col("l2_topic") + F.col("shift")).otherwise(-1).cast("int")
    return found.join(F.broadcast(shift), ["l1_topic", "piece"]).select("doc_id", "l1_topic", number.alias("l2_topic"))


def _bounded_parts(docs: DataFrame, parts: DataFrame, seed: int) -> DataFrame:
    """doc_id, l1_topic, piece: every (l1_topic, piece) has at most about ``PART_ROWS`` rows."""
    named = cut(parts.select("doc_id", F.col("topic_id").alias("l1_topic"), F.lit(0).alias("piece")), "pieces")
    out = None
    for r in named.groupBy("l1_topic").count().where(F.col("count") > PART_ROWS).collect():  # at most k parts
        own = docs.join(named.where(F.col("l1_topic") == r["l1_topic"]).select("doc_id"), "doc_id")
        split = kmeans(own, -(-2 * r["count"] // PART_ROWS), seed).select("doc_id", F.lit(r["l1_topic"]).alias("l1_topic"), F.col("topic_id").alias("piece"))
        # pieces that k-means leaves too large are dealt by hash
        sized = split.join(F.broadcast(split.groupBy("piece").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("m"))), "piece")
        split = sized.select("doc_id", "l1_topic", (F.col("piece") * 1000 + F.pmod(F.xxhash64("doc_id"), F.col("m"))).cast("int").alias("piece"))
        out = split if out is None else out.unionByName(split)
    if out is None:
        return named
    out = cut(out, "pieces")
    return named.join(out.select("l1_topic").distinct(), "l1_topic", "left_anti").select(*out.columns).unionByName(out)


def gsdmm(docs: DataFrame, k: int = 50, alpha: float = 0.1, beta: float = 0.1, sweeps: int = 30, seed: int = 42) -> DataFrame:
    """doc_id, topic_id by collapsed Gibbs sampling of one topic per document.

    Sampling is sequential, so this runs in one task; the scores of all topics for a
    document are one vector operation.  Beyond ``MATRIX_ROWS`` rows a sample of so many is
    drawn for it, and each document takes its likeliest topic under the sample's counts."""
    words = docs.select("doc_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("words"))

    def gibbs(words_of: list[list[str]]) -> tuple[np.ndarray, dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(seed)
        number: dict[str, int] = {}
        docs_ = [np.array([number.setdefault(w, len(number)) for w in words or []], dtype=np.int64) for words in words_of]
        v, n = max(1, len(number)), len(docs_)
        z = rng.integers(0, k, n)
        in_topic, words, freq = np.bincount(z, minlength=k).astype(float), np.zeros(k), np.zeros((v, k))
        for d, w in enumerate(docs_):
            words[z[d]] += len(w)
            np.add.at(freq[:, z[d]], w, 1)
        for _ in range(sweeps):
            for d, w in enumerate(docs_):
                if not len(w):
                    continue
                old = z[d]
                in_topic[old] -= 1
                words[old] -= len(w)
                np.add.at(freq[:, old], w, -1)
                score = np.log(in_topic + alpha) + np.log(freq[w] + beta).sum(axis=0) - len(w) * np.log(words + v * beta)
                p = np.exp(score - score.max())
                new = int(rng.choice(k, p=p / p.sum()))
                z[d] = new
                in_topic[new] += 1
                words[new] += len(w)
                np.add.at(freq[:, new], w, 1)
        return z, number, in_topic, words, freq

    if docs.count() <= MATRIX_ROWS:
        return _whole(words, lambda x: gibbs(x)[0], "words")

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        _, number, in_topic, total, freq = gibbs(t.sort_by("doc_id")["words"].to_pylist())
        return pa.table({"word": pa.array([*number, None], pa.string()), "n": pa.array([*freq[: len(number)].tolist(), [*in_topic, *total]], pa.list_(pa.float64()))})

    fitted = _sample(words, MATRIX_ROWS).select(F.lit(0).alias("g"), "doc_id", "words").groupBy("g").applyInArrow(fit, "word string, n array<double>").toArrow().to_pylist()
    counts = {r["word"]: i for i, r in enumerate(r for r in fitted if r["word"] is not None)}
    freq = np.array([r["n"] for r in fitted if r["word"] is not None]).reshape(len(counts), k)
    sums = np.array(next(r["n"] for r in fitted if r["word"] is None))
    shared = docs.sparkSession.sparkContext.broadcast((counts, freq, sums[:k], sums[k:]))

    def assign(batches):
        counts, freq, in_topic, total = shared.value
        v = max(1, len(counts))
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.int32)
            for i, own in enumerate(batch.column(1).to_pylist()):
                w = [counts[x] for x in own or [] if x in counts]
                out[i] = int((np.log(in_topic + alpha) + np.log(freq[w] + beta).sum(axis=0) - len(w) * np.log(total + v * beta)).argmax())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "topic_id"])

    return words.select(F.col("doc_id").cast("long"), "words").mapInArrow(assign, "doc_id long, topic_id int")


def discriminant_loop(docs: DataFrame, k: int = 10, dims: int = 9, rounds: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, topic_id: mixture labels and discriminant axes in turn, until labels stand still.

    Scatter matrices are sums over documents; only their eigenvectors are found on the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("x")).cache()
    labels = kmeans(docs, k, seed)
    for _ in range(rounds):

        def sums(batches):
            for batch in batches:
                if batch.num_rows:
                    y = batch.column(0).to_numpy()
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    for c in np.unique(y):
                        own = x[y == c]
                        yield pa.RecordBatch.from_arrays([pa.array([int(c)]), pa.array([len(own)]), pa.array([own.sum(axis=0)], pa.list_(pa.float64())), pa.array([(own.T @ own).ravel()], pa.list_(pa.float64()))], names=["c", "n", "s", "q"])

        parts = rows.join(labels, "doc_id").select(F.col("topic_id").cast("long"), "x").mapInArrow(sums, "c long, n long, s array<double>, q array<double>").toPandas()
        dim = len(parts["s"][0])
        n, total, square = parts["n"].sum(), np.sum(np.stack(parts["s"]), axis=0), np.sum(np.stack(parts["q"]), axis=0).reshape(dim, dim)
        between = -np.outer(total, total) / n
        for _, own in parts.groupby("c"):
            s = np.sum(np.stack(own["s"]), axis=0)
            between += np.outer(s, s) / own["n"].sum()
        within = square - np.outer(total, total) / n - between + 1e-6 * np.eye(dim)
        values, axes = np.linalg.eig(np.linalg.solve(within, between))
        keep = np.argsort(-values.real)[:dims]
        reduced = project(rows, axes.real[:, keep], total / n)
        p, _ = diagonal_mixture(reduced, k, 5, seed)
        new = p.select("doc_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("topic_id")).cache()
        moved = new.join(labels.withColumnRenamed("topic_id", "_old"), "doc_id").where("topic_id != _old").count()
        labels = new
        if not moved:
            break
    rows.unpersist()
    return labels


def fused_features(docs: DataFrame, other: DataFrame) -> DataFrame:
    """doc_id, embedding: the vectors of both tables, one after the other."""
    return docs.select("doc_id", F.col("embedding").cast("array<double>").alias("e")).join(other.select("doc_id", F.col("reduced").alias("r")), "doc_id").select("doc_id", F.concat("e", "r").alias("embedding"))


def hashed_text(docs: DataFrame, dims: int = 64) -> DataFrame:
    """doc_id, embedding: an offline stand-in for a sentence encoder: signed hashes of words, unit length."""
    words = docs.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("w"))
    h = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long")
    sums = words.select("doc_id", (h % dims).cast("int").alias("d"), F.when(F.floor(h / dims) % 2 == 0, 1.0).otherwise(-1.0).alias("s")).groupBy("doc_id", "d").agg(F.sum("s").alias("v"))
    maps = sums.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return maps.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)) / F.greatest("n", F.lit(1e-12))).alias("embedding"))
