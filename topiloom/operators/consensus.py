"""Consensus of several labellings.

Documents with equal tuples of labels agree on everything, so all work is done on
distinct tuples with their counts; no document pairs are ever formed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topiloom.operators.metrics import silhouette_precomputed
from topiloom.operators.models import MATRIX_ROWS, linkage
from topiloom.store import cut


def label_tuples(labels: DataFrame, names: list[str]) -> DataFrame:
    return labels.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def coassociation(labels: DataFrame, names: list[str], outlier_agrees: dict[str, bool] | None = None) -> DataFrame:
    """Pairs of distinct tuples (a < b by their first document) with their agreement, 0 to 1.

    A label -1 agrees with another -1 unless ``outlier_agrees`` says otherwise."""
    agrees = outlier_agrees or {}
    tuples = label_tuples(labels, names)
    other = tuples.select(*(F.col(c).alias(f"{c}_b") for c in names), F.col("n").alias("n_b"), F.col("first_doc").alias("b"))
    same = [((F.col(c) == F.col(f"{c}_b")) & (F.lit(agrees.get(c, True)) | (F.col(c) != -1))).cast("int") for c in names]
    # tuples that agree in nothing need no row: pairs meet by one of their labels
    hits = [tuples.join(other, (F.col(c) == F.col(f"{c}_b")) & (F.col("first_doc") < F.col("b"))) for c in names]
    met = reduce(DataFrame.unionByName, hits).distinct()
    return met.select(F.col("first_doc").alias("a"), "b", "n", "n_b", (reduce(lambda x, y: x + y, same) / len(names)).alias("agreement")).where("agreement > 0")


def consensus_map(labels: DataFrame, consensus: str, names: list[str]) -> DataFrame:
    """For each consensus cluster the most frequent value of each of two labels (ties to the
    one met first); a later cluster with equal modes overwrites an earlier one."""

    def mode(c: str) -> DataFrame:
        counted = labels.groupBy(consensus, c).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("f"))
        rank = F.row_number().over(Window.partitionBy(consensus).orderBy(F.desc("n"), "f"))
        return counted.withColumn("r", rank).where("r = 1").select(consensus, c)

    modes = reduce(lambda a, b: a.join(b, consensus), (mode(c) for c in names))
    last = F.row_number().over(Window.partitionBy(*names).orderBy(F.desc(consensus)))
    first = F.min(consensus).over(Window.partitionBy(*names))
    return modes.withColumn("inserted", first).withColumn("r", last).where("r = 1").drop("r")


def apply_map(labels: DataFrame, mapping: DataFrame, consensus: str, names: list[str]) -> DataFrame:
    """doc_id, consensus: by equal labels, else by the entry that differs in the fewest (ties to the
    entry inserted first).  Misses are looked up per distinct tuple; the map is a small table."""
    tuples = labels.select(*names).distinct()
    entry = mapping.select(*(F.col(c).alias(f"_{c}") for c in names), F.col(consensus).alias("_to"), F.col("inserted").alias("_at"))
    differs = reduce(lambda x, y: x + y, ((F.col(c) != F.col(f"_{c}")).cast("int") for c in names))
    best = tuples.crossJoin(F.broadcast(entry)).groupBy(*names).agg(F.min(F.struct(differs.alias("d"), F.col("_at"), F.col("_to"))).alias("m"))
    return labels.select("doc_id", *names).join(best, names).select("doc_id", F.col("m._to").alias("consensus"))


def consensus_labels(labels: DataFrame, names: list[str], ks: tuple[int, ...]) -> DataFrame:
    """k, tuple (its first document), n, topic_id: average linkage of the distinct tuples by
    1 - agreement, weighted by their counts, cut into each number of clusters.

    Tuples are few where labellings agree at all; more than ``MATRIX_ROWS`` are refused.
    """
    tuples = label_tuples(labels, names).orderBy("first_doc").limit(MATRIX_ROWS + 1).collect()
    if len(tuples) > MATRIX_ROWS:
        raise ValueError(f"more than {MATRIX_ROWS} distinct tuples of labels: the labellings do not agree")
    values = np.array([[r[c] for c in names] for r in tuples])
    weight = np.array([r["n"] for r in tuples], dtype=float)
    distance = 1 - (values[:, None, :] == values[None]).mean(axis=2) if len(tuples) else np.zeros((0, 0))
    rows = [(k, r["first_doc"], r["n"], int(y)) for k in ks for r, y in zip(tuples, linkage(distance, min(k, len(tuples)), "average", weight) if tuples else [])]
    return labels.sparkSession.createDataFrame(rows, "k int, id long, n long, topic_id int")


def consensus_scan(labels: DataFrame, names: list[str], ks: tuple[int, ...]) -> DataFrame:
    """n_clusters, silhouette, median_size for each number of clusters: what
    :func:`~topiloom.operators.topics.choose_consensus` chooses from."""
    pairs = cut(coassociation(labels, names).select("a", "b", (1 - F.col("agreement")).alias("distance")), "pairs")
    found = cut(consensus_labels(labels, names, ks), "consensus")
    parts = []
    for k in ks:
        own = found.where(F.col("k") == k)
        sizes = own.groupBy("topic_id").agg(F.sum("n").alias("size")).agg(F.percentile("size", 0.5).alias("median_size"))
        parts.append(silhouette_precomputed(pairs, own.select("id", "topic_id", "n")).crossJoin(sizes).select(F.lit(k).alias("n_clusters"), "silhouette", "median_size"))
    return reduce(DataFrame.unionByName, parts)
