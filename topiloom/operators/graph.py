"""Neighbour graphs and communities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topiloom.operators.leiden import leiden
from topiloom.store import cut

#: Edges that the one-task kernel takes at most (some 500 MB).
KERNEL_EDGES = 20_000_000


def undirected(neighbours: DataFrame) -> DataFrame:
    """src < dst, weight: similarities above zero; a mutual pair counts with both of its edges."""
    return neighbours.where("similarity > 0").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("similarity").alias("weight"))


def partition_quality(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: rb_quality 2 W_in - g * sum K_c^2 / 2m, and modularity, its share of 2m."""
    one = labels.select(F.lit(0).alias("of"), "doc_id", "topic_id")
    return partition_qualities(edges, one, "of", F.lit(resolution)).drop("of")


def partition_qualities(edges: DataFrame, labels: DataFrame, of: str, resolution: Column) -> DataFrame:
    """``of``, rb_quality, modularity for each of several labellings (``of``, doc_id, topic_id) of one graph."""
    a, b = labels.select(of, F.col("doc_id").alias("src"), F.col("topic_id").alias("ca")), labels.select(of, F.col("doc_id").alias("dst"), F.col("topic_id").alias("cb"))
    named = edges.join(a, "src").join(b, [of, "dst"])
    inside = named.groupBy(of).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("w_in"), F.sum("weight").alias("m"))
    ends = named.select(of, F.col("ca").alias("c"), "weight").unionAll(named.select(of, F.col("cb").alias("c"), "weight"))
    strength = ends.groupBy(of, "c").agg(F.sum("weight").alias("k")).groupBy(of).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    q = 2 * F.col("w_in") - resolution * F.col("k2") / (2 * F.col("m"))
    return inside.join(strength, of).select(of, q.alias("rb_quality"), (q / (2 * F.col("m"))).alias("modularity"))


def resolution_scan(edges: DataFrame, nodes: DataFrame, resolutions: tuple[float, ...], seed: int = 42) -> DataFrame:
    """resolution, modularity, n_topics of the communities at each resolution: what
    :func:`~topiloom.operators.topics.choose_resolution` chooses from."""
    edges = cut(edges, "edges")
    found = cut(communities(edges, nodes, seed=seed, resolutions=resolutions), "communities")
    named = found.select("resolution", "doc_id", F.col("community").alias("topic_id"))
    quality = partition_qualities(edges, named, "resolution", F.lit(1.0)).select("resolution", "modularity")
    topics = found.groupBy("resolution").agg(F.countDistinct("community").alias("n_topics"))
    return topics.join(quality, "resolution", "left").select("resolution", F.coalesce("modularity", F.lit(0.0)).alias("modularity"), "n_topics")


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, seed: int = 42, resolutions: tuple[float, ...] | None = None) -> DataFrame:
    """(resolution,) doc_id, community: Leiden communities, numbered by size.

    A whole graph is one group, several resolutions are groups of their own and run in
    parallel.  The kernel is a single task's work, so it takes at most ``KERNEL_EDGES``
    edges; larger graphs are clustered by the distributed :func:`propagated`, which knows
    no resolution.
    """
    wanted = resolutions or (resolution,)
    spark = edges.sparkSession
    edges = cut(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "edges")
    if edges.count() > KERNEL_EDGES:
        spread = by_size_labels(propagated(edges, nodes)).crossJoin(F.broadcast(spark.createDataFrame([(float(r),) for r in wanted], "resolution double")))
        return spread.select("resolution", "doc_id", "community") if resolutions else spread.select("doc_id", "community")
    sizes = spark.createDataFrame([(float(r),) for r in wanted], "resolution double")
    rows = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).unionByName(nodes.select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"), F.lit(0.0).alias("weight")))
    spread = rows.crossJoin(F.broadcast(sizes))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        src, dst, weight = (rows[c].to_numpy() for c in ("src", "dst", "weight"))
        ids = np.unique(np.concatenate([src, dst]))
        keep = src != dst
        labels = leiden(len(ids), np.searchsorted(ids, src[keep]), np.searchsorted(ids, dst[keep]), weight[keep], key[0].as_py(), seed)
        return pa.table({"resolution": pa.array(np.full(len(ids), key[0].as_py())), "doc_id": pa.array(ids), "community": pa.array(labels.astype(np.int32))})

    found = spread.groupBy("resolution").applyInArrow(run, "resolution double, doc_id long, community int")
    return found if resolutions else found.drop("resolution")


def propagated(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """doc_id, community by synchronous label propagation: each node takes the label with the
    largest weight around it (its own included), ties to the lower one.  Distributed; for
    graphs that one executor cannot hold."""
    edges = cut(edges.select("src", "dst", "weight"), "edges")
    both = edges.select("src", "dst", "weight").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    labels = nodes.select("doc_id", F.col("doc_id").alias("label"))
    for i in range(rounds):
        around = both.join(labels.withColumnRenamed("doc_id", "dst"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = around.groupBy("src").agg(F.max(F.struct("w", (-F.col("label")).alias("m"))).alias("b")).select(F.col("src").alias("doc_id"), (-F.col("b.m")).alias("new"))
        # every other round only half of the nodes move, so that pairs do not swap for ever
        move = F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(2)) == 0
        labels = labels.join(best, "doc_id", "left").select("doc_id", F.when(move, F.coalesce("new", "label")).otherwise(F.col("label")).alias("label"))
        labels = cut(labels, "labels")  # each round reads the last one twice
    return labels.withColumnRenamed("label", "community")


def by_size_labels(found: DataFrame) -> DataFrame:
    """doc_id, community: communities renumbered from the largest down, ties by their old number.

    One task numbers the table of communities (a number and a size each)."""
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    numbered = sizes.withColumn("number", F.row_number().over(Window.orderBy(F.desc("n"), "community")) - 1)
    return found.join(numbered, "community").select("doc_id", F.col("number").cast("int").alias("community"))


def connected(edges: DataFrame, nodes: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, root: the least node that each node reaches; ``edges`` (u, v) join small tables of topics."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = {}
    for r in both.distinct().collect():  # topics, not documents
        links.setdefault(r["u"], set()).add(r["v"])
    root: dict[int, int] = {}
    for start in sorted(r[0] for r in nodes.select("node").collect()):
        if start in root:
            continue
        stack = [start]
        while stack:
            n = stack.pop()
            if n not in root:
                root[n] = start
                stack.extend(links.get(n, ()))
    return edges.sparkSession.createDataFrame([(int(n), int(r)) for n, r in root.items()], "node int, root int")


def greedy_groups(sizes: dict[str, int], similarity: dict[tuple[str, str], float], ratio: float = 0.35, least: float = 0.55) -> list[tuple[str, str]]:
    """(parent, child) links of small topics to large, similar ones.

    Topics are visited from the largest down (ties by name).  One that has no parent yet
    takes every free topic that is smaller than ``ratio`` of it, more similar than
    ``least``, and likes no other free topic better.
    """
    names = sorted(sizes)
    free = dict.fromkeys(names, True)
    links: list[tuple[str, str]] = []
    sim = lambda a, b: similarity[min(a, b), max(a, b)]
    place = {n: i for i, n in enumerate(names)}
    for parent in sorted(names, key=lambda n: -sizes[n]):
        if not free[parent]:
            continue
        found = []
        for child in names:
            if child == parent or not free[child] or sizes[child] / sizes[parent] >= ratio or sim(parent, child) <= least:
                continue
            favourite = max((n for n in names if n != child and free[n]), key=lambda n: (sim(n, child), place[n]))
            if favourite == parent:
                found.append(child)
        for child in sorted(found, key=lambda n: -sim(parent, n)):
            links.append((parent, child))
            free[child] = False
    return links
