"""The catalog as a whole: cluster, assess, split and check in rounds, then export."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiloom.config import ROOT_NEIGHBOURS, ROOT_RESOLUTION, CatalogConfig
from topiloom.operators import catalog, graph, text
from topiloom.operators import vectors as vx
from topiloom.sources import writers
from topiloom.store import cut, fresh_path

STAGES = ("INIT", "CLUSTER", "ASSESS", "SPLIT", "CHECK", "EXPORT")


def cluster(docs: DataFrame, resolution: float = ROOT_RESOLUTION, neighbours: int = ROOT_NEIGHBOURS, seed: int = 42) -> DataFrame:
    """``docs`` (doc_id, text, embedding) with topic_id: communities of the neighbour graph."""
    edges = graph.undirected(vx.nearest_neighbours(docs, neighbours))
    found = graph.communities(edges, docs.select("doc_id"), resolution, seed)
    return docs.join(found.select("doc_id", F.col("community").alias("topic_id")), "doc_id")


def run_catalog(spark: SparkSession, docs: DataFrame, store: str | None = None, config: CatalogConfig = CatalogConfig(), judge: catalog.Judge = catalog.offline_judge, from_stage: str = "INIT", resume: bool = False, out: str | None = None) -> dict[str, DataFrame]:
    """Runs the stages from ``from_stage`` on and returns the tables of the export.

    ``docs`` has doc_id, text, embedding and, if the clustering is given, topic_id.
    ``resume`` goes on from the last complete round in ``store``; ``from_stage="EXPORT"``
    exports it as it is.
    """
    if from_stage not in STAGES:
        raise ValueError(f"no stage {from_stage}")
    missing = {"doc_id", "text", "embedding"} - set(docs.columns)
    if missing:
        raise ValueError(f"documents lack {sorted(missing)}")
    state = writers.CatalogStore(spark, store or fresh_path(spark, "catalog"))
    total = docs.count()
    median = vx.sampled_median_distance(docs, seed=config.seed).first()[0] if config.enable_r5 else None
    last = state.last() if resume or from_stage not in ("INIT", "CLUSTER") else None
    if last is None:
        topics = docs if "topic_id" in docs.columns else cluster(docs, seed=config.seed)
        weights = text.tfidf(topics, config.root_tfidf)
        keywords = text.keyword_strings(text.topic_keywords(topics, weights, config.keywords))
        nodes, membership = catalog.root_nodes(topics, keywords)
        nodes, membership = state.save(0, catalog.group_roots(nodes, docs, membership, config), membership)
        last = 0
    else:
        nodes, membership = state.load(last)
    dropped = spark.createDataFrame([], "node_id string, doc_id long, round int")
    if from_stage != "EXPORT":
        for round_ in range(last + 1, config.max_rounds + 2):
            with_spread = nodes
            if config.enable_r5:
                spread = vx.mean_pairwise_distance(membership.join(docs.select("doc_id", "embedding"), "doc_id"), "node_id")
                with_spread = nodes.drop("mean_pairwise_dist").join(spread.select(F.col("node_id").alias("id"), "mean_pairwise_dist"), "id", "left").select(*nodes.columns)
            # a judge is asked once a round; what follows reads its stored replies
            assessed = cut(catalog.assess(with_spread, total, median, judge, config), "assessed")
            step = catalog.split(assessed, membership, docs.select("doc_id", "text", "embedding"), round_, config)
            nodes, membership = state.save(round_, step.nodes, step.membership)
            dropped = dropped.unionByName(cut(step.dropped.select("node_id", F.col("doc_id").cast("long").alias("doc_id"), F.lit(round_).alias("round")), "dropped"))
            if catalog.stop_flags(nodes, total, config).first()["all_pass"]:
                break
        else:
            # the last children are graded, and saved, so that a later export is the same
            nodes, membership = state.save(config.max_rounds + 2, catalog.assess(nodes, total, median, judge, config), membership)
    tables = {"nodes": nodes, "membership": membership, "dropped": dropped, "catalog": catalog.catalog_rows(nodes), "buckets": catalog.bucket_rows(nodes), "summary": catalog.catalog_summary(nodes, total), "tree": catalog.tree_edges(nodes), "flags": catalog.stop_flags(nodes, total, config)}
    if out:
        Path(out).mkdir(parents=True, exist_ok=True)
        writers.csv_report(tables["catalog"], f"{out}/catalog.csv")
        for bucket in ("meta", "residual", "rejected"):
            writers.csv_report(tables["buckets"].where(F.col("bucket") == bucket).drop("bucket"), f"{out}/{bucket}_bucket.csv")
        writers.json_report(tables["summary"], f"{out}/summary.json")
        writers.tree_json(tables["tree"], f"{out}/tree.json")
    return tables
