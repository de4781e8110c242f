"""Operators over topic assignments: sizes, samples, reassignment, merging, time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topiloom.operators import vectors as vx
from topiloom.operators.graph import connected


def sizes(docs: DataFrame) -> DataFrame:
    return docs.where("topic_id >= 0").groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))


def size_statistics(docs: DataFrame) -> DataFrame:
    return sizes(docs).agg(F.count(F.lit(1)).alias("n_topics"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.percentile("size", 0.5).alias("median_size"))


def coverage(docs: DataFrame) -> DataFrame:
    covered = F.avg(F.when(F.col("topic_id") != -1, 1.0).otherwise(0.0))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct(F.when(F.col("topic_id") != -1, F.col("topic_id"))).alias("n_topics"), covered.alias("coverage"), (1 - covered).alias("outlier_rate"))


def deterministic_sample(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows with a text, in the order of a hash of seed and id; with a gapless ``idx`` by id."""
    picked = docs.where(F.col("text").isNotNull()).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), "doc_id").limit(n)
    return picked.withColumn("idx", F.row_number().over(Window.orderBy("doc_id")) - 1)


def samples(docs: DataFrame, top: int = 5, boundary: int = 3) -> DataFrame:
    """topic_id, kind, rank, doc_id: the ``top`` nearest documents of each topic and its
    ``boundary`` farthest, by the dot product with the topic's mean vector.  Both lists
    run from near to far; ties go to the lower id."""
    means = vx.centroids(docs).select("topic_id", "centroid")
    scored = docs.join(F.broadcast(means), "topic_id").select("topic_id", "doc_id", vx.dot(F.col("embedding").cast("array<double>"), F.col("centroid")).alias("raw"))
    scored = scored.select("topic_id", "doc_id", F.round("raw", 9).alias("score"))
    near = Window.partitionBy("topic_id").orderBy(F.desc("score"), "doc_id")
    far = Window.partitionBy("topic_id").orderBy("score", F.desc("doc_id"))
    first = scored.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top).withColumn("kind", F.lit("top"))
    last = scored.withColumn("back", F.row_number().over(far)).where(F.col("back") <= boundary)
    last = last.withColumn("rank", F.row_number().over(near)).withColumn("kind", F.lit("boundary")).drop("back")
    return first.unionByName(last).select("topic_id", "kind", "rank", "doc_id", "score")


def reassigned(docs: DataFrame, threshold: float, inclusive: bool) -> DataFrame:
    """doc_id, topic_id, new_topic_id: outliers (-1) take the nearest topic's id where the
    cosine reaches the threshold (``inclusive``) or passes it."""
    means = vx.centroids(docs.where("topic_id >= 0"))
    out = vx.nearest_centroid(docs.where("topic_id = -1"), means)
    enough = F.col("similarity") >= threshold if inclusive else F.col("similarity") > threshold
    moved = out.where(enough).select("doc_id", "nearest")
    return docs.select("doc_id", "topic_id").join(moved, "doc_id", "left").select("doc_id", "topic_id", F.coalesce("nearest", "topic_id").cast("int").alias("new_topic_id"))


def reassign_scan(docs: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """threshold, reassigned, remaining, for each threshold at once."""
    means = vx.centroids(docs.where("topic_id >= 0"))
    near = vx.nearest_centroid(docs.where("topic_id = -1"), means)
    counts = near.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("similarity") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("reassigned"), (F.col("n") - F.col(f"t{i}")).alias("remaining")) for i, t in enumerate(thresholds)))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def dissolved(docs: DataFrame, least: int = 5) -> DataFrame:
    """doc_id, topic_id: communities under ``least`` members become -1, the others are renumbered densely."""
    counted = docs.join(F.broadcast(sizes(docs).where(F.col("size") >= least).select("topic_id", (F.dense_rank().over(Window.orderBy("topic_id")) - 1).alias("dense"))), "topic_id", "left")
    return counted.select("doc_id", F.coalesce("dense", F.lit(-1)).cast("int").alias("topic_id"))


def merge_candidates(similarities: DataFrame, low: float = 0.65, high: float = 0.95, limit: int = 30) -> DataFrame:
    """The most similar pairs of topics in [low, high), a top-k report."""
    picked = similarities.select("a", "b", F.round("similarity", 6).alias("similarity")).where((F.col("similarity") >= low) & (F.col("similarity") < high))
    return picked.orderBy(F.desc("similarity"), F.desc("a"), F.desc("b")).limit(limit)


def merge_map(topics: DataFrame, pairs: DataFrame) -> DataFrame:
    """old_topic, new_topic: topics joined by ``pairs`` (a, b) share a number.  Merged groups
    come first, by their least member, then single topics, by id."""
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = connected(edges, topics.select(F.col("topic_id").alias("node")))
    grouped = roots.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("root")))
    number = F.dense_rank().over(Window.orderBy(F.when(F.col("n") > 1, 0).otherwise(1), "root")) - 1
    return grouped.select(F.col("node").alias("old_topic"), number.cast("int").alias("new_topic"))


def neighbour_texts(docs: DataFrame, neighbours: DataFrame, least: float = 0.6, k: int = 3, separator: str = " | ") -> DataFrame:
    """doc_id, enhanced_text: a text and those of its near neighbours, most similar first, ``k`` in all."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    near = neighbours.where(F.col("similarity") > least).withColumn("r", rank).where(F.col("r") < k)
    named = near.join(docs.select(F.col("doc_id").alias("dst"), F.col("text").alias("other")), "dst")
    lists = named.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("r", "other"))).alias("o"))
    joined = docs.select("doc_id", "text").join(lists, F.col("doc_id") == F.col("src"), "left")
    others = F.coalesce(F.transform("o", lambda x: x["other"]), F.array().cast("array<string>"))
    return joined.select("doc_id", F.array_join(F.concat(F.array("text"), others), separator).alias("enhanced_text"))


def over_time(events: DataFrame, topic: str = "topic_id", at: str = "ts", bins: int = 30) -> DataFrame:
    """topic, bin, n over ``bins`` equal spans of time; the last instant falls into the last bin."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    bounds = events.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi"))
    placed = events.where(F.col(at).isNotNull()).crossJoin(F.broadcast(bounds))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    index = F.least(F.floor((micros - F.col("lo")) * bins / width), F.lit(bins - 1)).cast("int")
    return placed.groupBy(F.col(topic).alias("topic"), index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_topics(events: DataFrame, topic: str, n: int) -> DataFrame:
    """The ``n`` most frequent topics, ties by name."""
    return events.groupBy(F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "topic").limit(n)


def histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin, n over equal spans between the least and the largest value."""
    bounds = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    index = F.least(F.floor((F.col(column) - F.col("lo")) / width * bins), F.lit(bins - 1)).cast("int")
    return values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def named_topics(docs: DataFrame, names: DataFrame, missing: str = "Outlier") -> DataFrame:
    """Documents with the name of their topic, or ``missing``."""
    return docs.join(F.broadcast(names.select("topic_id", F.col("name").alias("topic_name"))), "topic_id", "left").withColumn("topic_name", F.coalesce("topic_name", F.lit(missing)))


def resolve_column(df: DataFrame, patterns: tuple[str, ...]) -> str:
    """The first column whose name holds one of ``patterns``, or the first of all."""
    return next((c for c in df.columns for p in patterns if p in c.lower()), df.columns[0])


def soft_assignment(probabilities: DataFrame) -> DataFrame:
    """doc_id, topic_id, confidence, entropy, band from doc_id and an array ``p``."""
    best = F.array_max("p")
    safe = F.transform("p", lambda x: x + 1e-10)
    total = F.aggregate(safe, F.lit(0.0), lambda s, x: s + x)
    entropy = F.aggregate(safe, F.lit(0.0), lambda s, x: s - x / total * F.log(x / total))
    band: Column = F.when(best < 0.3, "outlier").when(best < 0.5, "fuzzy").otherwise("high")
    return probabilities.select("doc_id", (F.array_position("p", best) - 1).cast("int").alias("topic_id"), best.alias("confidence"), entropy.alias("entropy"), band.alias("band"))


def mean_confidence(soft: DataFrame) -> DataFrame:
    """One row: mean_confidence, mean_entropy and the share of rows with a high confidence."""
    return soft.agg(F.avg("confidence").alias("mean_confidence"), F.avg("entropy").alias("mean_entropy"), F.avg(F.when(F.col("band") == "high", 1.0).otherwise(0.0)).alias("high_share"))


def head(docs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by id."""
    return docs.orderBy("doc_id").limit(n)


def choose_resolution(scan: DataFrame) -> DataFrame:
    """The best row of a resolution scan (resolution, modularity, n_topics)."""
    fit = F.greatest(F.lit(0.0), 1 - F.abs(F.col("n_topics") - 80) / 100)
    usable = (F.col("modularity") >= 0.3) & F.col("n_topics").between(30, 150)
    scored = scan.withColumn("score", F.when(usable, 0.6 * F.col("modularity") + 0.4 * fit))
    any_usable = F.max(usable).over(Window.partitionBy())
    order = Window.orderBy(F.desc(F.when(any_usable, F.col("score")).otherwise(F.col("modularity"))), "resolution")
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("resolution", "modularity", "n_topics")


def choose_prior(scan: DataFrame) -> DataFrame:
    """The best row of a prior scan (prior, silhouette, confidence, entropy, n_topics)."""
    score = 0.3 * F.col("silhouette") + 0.3 * F.col("confidence") + 0.2 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("n_topics") - 60) / 80) + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("entropy") / 5)
    usable = scan.where((F.col("silhouette") >= -0.05) & F.col("n_topics").between(20, 150))
    return usable.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "prior").limit(1)


def choose_k(scan: DataFrame) -> DataFrame:
    """One row, k: the middle one of the winners by silhouette, Davies-Bouldin and
    Calinski-Harabasz of a scan (k, silhouette, davies_bouldin, calinski_harabasz)."""
    best = lambda value: F.max(F.struct(value.alias("v"), (-F.col("k")).alias("m")))["m"]
    winners = scan.agg(F.array(-best(F.col("silhouette")), -best(-F.col("davies_bouldin")), -best(F.col("calinski_harabasz"))).alias("w"))
    return winners.select(F.sort_array("w")[1].cast("int").alias("k"))


def choose_consensus(scan: DataFrame, criterion: str = "max_silhouette", size: int = 800) -> DataFrame:
    """The best row of a consensus scan (n_clusters, silhouette, median_size): by the largest
    silhouette, the one nearest to zero (``min_abs_silhouette``), or the median size nearest
    to ``size`` (``median_size``); ties to fewer clusters."""
    order = {"max_silhouette": F.desc("silhouette"), "min_abs_silhouette": F.abs("silhouette"), "median_size": F.abs(F.col("median_size") - size)}[criterion]
    return scan.orderBy(order, "n_clusters").limit(1)


def agreed_pairs(candidates: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """The candidate pairs (a, b) that a judge's replies (a, b, reply) confirm with YES; a missing
    or failed reply counts as NO, and without a judge nothing is merged."""
    if replies is None:
        return candidates.select("a", "b").where(F.lit(False))
    yes = replies.where(F.upper(F.trim(F.coalesce("reply", F.lit("")))).startswith("YES")).select("a", "b").distinct()
    return candidates.select("a", "b").join(yes, ["a", "b"], "left_semi")
