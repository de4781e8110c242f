"""One registered query per operator, over the driver's tables.

``documents`` and ``embeddings`` are paired by doc_id = vec_id; a vector's label stands
for its topic where an operator takes a given clustering.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topiloom.config import RESOLUTIONS, TINY, CatalogConfig, TfIdf
from topiloom.functions import text as tx
from topiloom.operators import catalog, consensus, graph, metrics, models, text, topics
from topiloom.operators import vectors as vx
from topiloom.plans import run
from topiloom.sources.readers import table
from topiloom.sources.writers import size_rank
from topiloom.store import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KNN = 20
SCAN = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3)


def query(f):
    QUERIES[f.__name__] = f
    return f


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic_id"), "embedding")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text, topic_id, embedding."""
    return table(spark, sf, "documents").select("doc_id", "text").join(vectors(spark, sf), "doc_id")


def with_outliers(rows: DataFrame) -> DataFrame:
    return rows.withColumn("topic_id", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("topic_id")))


def uneven(rows: DataFrame) -> DataFrame:
    """Topics of very different sizes, for the rules."""
    big = F.when(F.col("doc_id") % 5 == 1, 200).when(F.col("doc_id") % 3 == 0, (100 + F.col("doc_id") % 7).cast("int"))
    return rows.withColumn("topic_id", F.coalesce(big, F.col("topic_id")))


# --- rows, counts, samples ---------------------------------------------------


@query
def topic_sizes(spark, sf):
    return topics.sizes(vectors(spark, sf))


@query
def size_stats(spark, sf):
    return topics.size_statistics(vectors(spark, sf))


@query
def topic_coverage(spark, sf):
    c = topics.coverage(with_outliers(vectors(spark, sf)))
    return c.select("n_docs", "n_topics", F.round("coverage", 6).alias("coverage"), F.round("outlier_rate", 6).alias("outlier_rate"))


@query
def size_rank_series(spark, sf):
    r = size_rank(topics.sizes(uneven(vectors(spark, sf))))
    return r.select(F.col("rank").cast("long").alias("rank"), "size", F.round("log_rank", 6).alias("log_rank"), F.round("log_size", 6).alias("log_size"))


@query
def clean_sample(spark, sf):
    s = topics.deterministic_sample(table(spark, sf, "documents"), 200)
    return s.select("doc_id", F.col("idx").cast("long").alias("idx"), F.substring("text", 1, 80).alias("head"))


@query
def head_rows(spark, sf):
    return topics.head(table(spark, sf, "documents"), 50).select("doc_id", F.substring("text", 1, 80).alias("head"))


@query
def named_topics(spark, sf):
    names = spark.createDataFrame([(i, f"topic {i}") for i in range(0, 10, 2)], "topic_id int, name string")
    named = topics.named_topics(with_outliers(vectors(spark, sf)), names)
    return named.groupBy("topic_name").agg(F.count(F.lit(1)).alias("n"))


@query
def parsed_dates(spark, sf):
    e = table(spark, sf, "events")
    written = F.when(F.col("event_id") % 10 == 0, "no date").otherwise(F.date_format("ts", "yyyyMMdd"))
    return e.select(F.try_to_date(written, "yyyyMMdd").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


# --- text --------------------------------------------------------------------


@query
def token_counts(spark, sf):
    t = tx.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query
def bigram_counts(spark, sf):
    words = tx.without_stop_words(tx.tokens(F.col("text")))
    pairs = F.filter(tx.with_bigrams(words), lambda t: F.contains(t, F.lit(" ")))
    counted = table(spark, sf, "documents").select(F.explode(pairs).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "term").limit(50)


@query
def content_words(spark, sf):
    w = tx.content_words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.md5(F.array_join(w, " ")).alias("words_md5"))


@query
def tfidf_terms(spark, sf):
    w = text.tfidf(documents(spark, sf)).withColumn("weight", F.round("weight", 6))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))
    return w.withColumn("rank", rank.cast("long")).where("rank <= 5")


@query
def tfidf_sublinear(spark, sf):
    w = text.tfidf(documents(spark, sf), TfIdf(min_df=3, max_df=0.85, max_features=3000, ngrams=(1, 1), stop_words=False, sublinear=True))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("weight"), 6).alias("max_weight"))


@query
def topic_keywords(spark, sf):
    d = documents(spark, sf)
    slim = cut(d.select("doc_id", "topic_id"), "topics")
    return text.topic_keywords(slim, text.tfidf(d.select("doc_id", "text"), n_docs=slim.count())).withColumn("rank", F.col("rank").cast("long"))


@query
def tfidf_coherence(spark, sf):
    d = with_outliers(documents(spark, sf)).where("topic_id != -1")
    config = TfIdf(max_df=1.0, max_features=1000, ngrams=(1, 1))
    return text.coherence(d, text.tfidf(d, config)).select(F.round("tfidf_coherence", 6).alias("tfidf_coherence"))


@query
def class_tfidf(spark, sf):
    return text.class_tfidf(documents(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query
def judge_parse(spark, sf):
    replies = [
        '{"name_zh":"x","grade":"A","action":"keep"}',
        '```json\n{"grade":"C"}\n```',
        'Sure: {"grade":"D"} done',
        '{"grade":"A/B"}',
        '{"name_zh":"y"}',
        "no json",
        "{bad}",
    ]
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.element_at(F.array(*map(F.lit, replies)), (F.pmod("conv_id", F.lit(7)) + 1).cast("int")).alias("reply"))
    parsed = rows.select("conv_id", "turn", tx.parsed_judgement(F.col("reply")).alias("j"))
    return parsed.select("conv_id", "turn", "j.name", "j.grade", "j.action", "j.grade_raw", "j.failed")


# --- vectors and graphs ------------------------------------------------------


@query
def topic_centroids(spark, sf):
    c = vx.centroids(vectors(spark, sf))
    return c.select("topic_id", "size", F.posexplode("centroid").alias("pos", "x")).select("topic_id", "size", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query
def centroid_sims(spark, sf):
    return vx.centroid_similarities(vx.centroids(vectors(spark, sf))).withColumn("similarity", F.round("similarity", 6))


@query
def nearest_centroid(spark, sf):
    v = vectors(spark, sf)
    return vx.nearest_centroid(v, vx.centroids(v)).withColumn("similarity", F.round("similarity", 6))


@query
def knn_edges(spark, sf):
    return vx.nearest_neighbours(vectors(spark, sf), KNN).withColumn("similarity", F.round("similarity", 6))


@query
def knn_graph(spark, sf):
    return graph.undirected(vx.nearest_neighbours(vectors(spark, sf), KNN)).withColumn("weight", F.round("weight", 6))


@query
def label_modularity(spark, sf):
    v = vectors(spark, sf)
    q = graph.partition_quality(graph.undirected(vx.nearest_neighbours(v, KNN)), v)
    return q.select(F.round("rb_quality", 6).alias("rb_quality"), F.round("modularity", 6).alias("modularity"))


@query
def median_pair_dist(spark, sf):
    return vx.sampled_median_distance(vectors(spark, sf)).select(F.round("median_dist", 6).alias("median_dist"))


@query
def mean_pairwise_dist(spark, sf):
    return vx.mean_pairwise_distance(vectors(spark, sf)).withColumn("mean_pairwise_dist", F.round("mean_pairwise_dist", 6))


@query
def topic_samples(spark, sf):
    s = topics.samples(vectors(spark, sf))
    return s.select("topic_id", "kind", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query
def reassign_outliers(spark, sf):
    return topics.reassigned(with_outliers(vectors(spark, sf)), 0.15, inclusive=False)


@query
def reassign_scan(spark, sf):
    return topics.reassign_scan(with_outliers(vectors(spark, sf)), SCAN)


@query
def dissolve_tiny(spark, sf):
    v = vectors(spark, sf).withColumn("topic_id", F.when(F.col("doc_id") % 4 == 0, (1000 + F.col("doc_id") / 16).cast("int")).otherwise(F.col("topic_id") * 3))
    return topics.dissolved(v, TINY)


@query
def merge_candidates(spark, sf):
    return topics.merge_candidates(vx.centroid_similarities(vx.centroids(vectors(spark, sf))), 0.0, 0.95, 30)


@query
def merge_components(spark, sf):
    v = vectors(spark, sf)
    pairs = topics.merge_candidates(vx.centroid_similarities(vx.centroids(v)), 0.0, 0.95, 4)
    return topics.merge_map(v.select("topic_id").distinct(), pairs)


@query
def merged_sizes(spark, sf):
    v = vectors(spark, sf)
    pairs = topics.merge_candidates(vx.centroid_similarities(vx.centroids(v)), 0.0, 0.95, 4)
    mapping = topics.merge_map(v.select("topic_id").distinct(), pairs)
    return v.join(F.broadcast(mapping), F.col("topic_id") == F.col("old_topic")).groupBy("new_topic").agg(F.count(F.lit(1)).alias("size"))


@query
def merged_keywords(spark, sf):
    v, d = vectors(spark, sf), documents(spark, sf).select("doc_id", "text", "topic_id")
    pairs = topics.merge_candidates(vx.centroid_similarities(vx.centroids(v)), 0.0, 0.95, 4)
    mapping = topics.merge_map(v.select("topic_id").distinct(), pairs)
    merged = d.join(F.broadcast(mapping), F.col("topic_id") == F.col("old_topic")).select("doc_id", F.col("new_topic").alias("topic_id"))
    return text.topic_keywords(merged, text.tfidf(d), 8).withColumn("rank", F.col("rank").cast("long"))


@query
def neighbor_concat(spark, sf):
    d = documents(spark, sf)
    out = topics.neighbour_texts(d, vx.nearest_neighbours(d, 3), 0.3)
    return out.select("doc_id", F.length("enhanced_text").cast("long").alias("n_chars"), F.md5("enhanced_text").alias("text_md5"))


# --- time, distributions, choices ---------------------------------------------


@query
def topics_over_time(spark, sf):
    return topics.over_time(table(spark, sf, "events"), "event_type").withColumn("bin", F.col("bin").cast("long"))


@query
def topics_over_time_top(spark, sf):
    e = table(spark, sf, "events")
    series = topics.over_time(e, "event_type").withColumn("bin", F.col("bin").cast("long"))
    return series.join(F.broadcast(topics.top_topics(e, "event_type", 3).select("topic")), "topic", "left_semi")


TIME_BINS = 5


@query
def keywords_over_time(spark, sf):
    dated = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts")
    k = text.keywords_over_time(documents(spark, sf).select("doc_id", "text", "topic_id").join(dated, "doc_id"), bins=TIME_BINS)
    return k.select("topic_id", F.col("bin").cast("long").alias("bin"), "term", "weight", F.col("rank").cast("long").alias("rank"))


def _probabilities(v: DataFrame) -> DataFrame:
    """doc_id, p: shares of exp(8 * cosine) over the topics, in their order."""
    cents = vx.centroids(v).select("topic_id", vx.unit(F.col("centroid")).alias("u"))
    units = v.select("doc_id", vx.unit(F.col("embedding").cast("array<double>")).alias("e"))
    scored = units.crossJoin(F.broadcast(cents)).select("doc_id", "topic_id", F.exp(8 * vx.dot(F.col("e"), F.col("u"))).alias("w"))
    grouped = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("topic_id", "w"))).alias("all"), F.sum("w").alias("total"))
    return grouped.select("doc_id", F.transform("all", lambda x: x["w"] / F.col("total")).alias("p"))


@query
def soft_assignment(spark, sf):
    s = topics.soft_assignment(_probabilities(vectors(spark, sf)))
    return s.select("doc_id", "topic_id", F.round("confidence", 6).alias("confidence"), F.round("entropy", 6).alias("entropy"), "band")


@query
def mean_confidence(spark, sf):
    return _rounded(topics.mean_confidence(topics.soft_assignment(_probabilities(vectors(spark, sf)))))


@query
def confidence_histogram(spark, sf):
    s = topics.soft_assignment(_probabilities(vectors(spark, sf))).withColumn("confidence", F.round("confidence", 5))
    return topics.histogram(s, "confidence").withColumn("bin", F.col("bin").cast("long"))


RESOLUTION_ROWS = [(0.1, 0.12, 4), (0.5, 0.31, 28), (1.0, 0.42, 61), (1.5, 0.44, 92), (2.0, 0.41, 131), (3.0, 0.36, 210), (5.0, 0.29, 400)]
PRIOR_ROWS = [(0.01, -0.02, 0.61, 1.1, 34), (0.1, 0.01, 0.58, 1.3, 58), (1.0, 0.02, 0.52, 1.7, 97), (10.0, -0.2, 0.4, 2.4, 180)]


@query
def resolution_choice(spark, sf):
    scan = spark.createDataFrame(RESOLUTION_ROWS, "resolution double, modularity double, n_topics int")
    return topics.choose_resolution(scan)


@query
def prior_choice(spark, sf):
    return topics.choose_prior(spark.createDataFrame(PRIOR_ROWS, "prior double, silhouette double, confidence double, entropy double, n_topics int"))


K_ROWS = [(5, 0.051, 3.9, 410.0), (10, 0.062, 3.7, 388.5), (15, 0.071, 3.8, 300.25), (20, 0.066, 3.5, 281.0), (25, 0.071, 3.6, 266.5)]
CONSENSUS_ROWS = [(20, -0.02, 2100.0), (50, 0.03, 905.0), (80, 0.01, 640.0), (100, 0.03, 500.0)]


@query
def k_choice(spark, sf):
    return topics.choose_k(spark.createDataFrame(K_ROWS, "k int, silhouette double, davies_bouldin double, calinski_harabasz double"))


@query
def consensus_choice(spark, sf):
    scan = spark.createDataFrame(CONSENSUS_ROWS, "n_clusters int, silhouette double, median_size double")
    kinds = ("max_silhouette", "min_abs_silhouette", "median_size")
    parts = [topics.choose_consensus(scan, c).select(F.lit(c).alias("criterion"), "n_clusters") for c in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def agreed_merges(spark, sf):
    pairs = topics.merge_candidates(vx.centroid_similarities(vx.centroids(vectors(spark, sf))), 0.0, 0.95, 30)
    reply = F.when((F.col("a") + F.col("b")) % 3 == 0, "yes, merge").when((F.col("a") + F.col("b")) % 3 == 1, "NO")
    return topics.agreed_pairs(pairs, pairs.select("a", "b", reply.alias("reply")))


# --- metrics -------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) for c in df.columns))


@query
def silhouette_cosine(spark, sf):
    return _rounded(metrics.silhouette_cosine(vectors(spark, sf)))


@query
def silhouette_euclid(spark, sf):
    return _rounded(metrics.silhouette_euclidean(vectors(spark, sf)))


@query
def silhouette_sample(spark, sf):
    return _rounded(metrics.silhouette_sampled(vectors(spark, sf), 200))


@query
def calinski_harabasz(spark, sf):
    return _rounded(metrics.calinski_harabasz(vectors(spark, sf)))


@query
def davies_bouldin(spark, sf):
    return _rounded(metrics.davies_bouldin(vectors(spark, sf)))


# --- catalog -------------------------------------------------------------------


def _nodes(spark, sf) -> tuple[DataFrame, DataFrame, int]:
    d = uneven(documents(spark, sf))
    slim = cut(d.select("doc_id", "topic_id"), "topics")
    total = slim.count()
    keywords = text.keyword_strings(text.topic_keywords(slim, text.tfidf(d.select("doc_id", "text"), n_docs=total)))
    nodes, membership = catalog.root_nodes(slim, keywords)
    return cut(nodes, "nodes"), membership, total  # a row per topic, read by all that follows


@query
def rule_scores(spark, sf):
    nodes, _, total = _nodes(spark, sf)
    s = catalog.score_rules(nodes, total)
    said = F.array_join(F.array_sort(F.transform(F.map_entries("rule_signals"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return s.select("id", "size", "keywords", "rule_grade", F.col("triggered").cast("long").alias("triggered"), said.alias("signals"))


@query
def assess_nodes(spark, sf):
    nodes, _, total = _nodes(spark, sf)
    return catalog.assess(nodes, total).select("id", "size", "rule_grade", "llm_grade", "llm_name", "llm_action", "final_grade", "action", "status")


def _assessed(spark, sf) -> tuple[DataFrame, int]:
    nodes, _, total = _nodes(spark, sf)
    return catalog.assess(nodes, total), total


@query
def stop_flags(spark, sf):
    nodes, total = _assessed(spark, sf)
    return catalog.stop_flags(nodes, total)


@query
def catalog_rows(spark, sf):
    nodes, _ = _assessed(spark, sf)
    return catalog.catalog_rows(nodes).withColumn("topic_id", F.col("topic_id").cast("long"))


@query
def assess_deep(spark, sf):
    """As assess_nodes, with nodes of the depths 0 to 2: the deepest are accepted as they are."""
    nodes, _, total = _nodes(spark, sf)
    deep = nodes.withColumn("depth", (F.regexp_extract("id", r"_c(\d+)$", 1).cast("int") % 3).cast("int"))
    return catalog.assess(deep, total).select("id", "depth", "rule_grade", "llm_grade", "llm_name", "llm_action", "final_grade", "action", "status")


def _tree(spark, sf) -> tuple[DataFrame, int]:
    """Nodes of three rounds: split, accepted and binned roots, one of them hung under another,
    children of the split ones, one still pending, and grandchildren."""
    v = vectors(spark, sf).withColumns({"t": F.col("topic_id"), "m": (F.col("doc_id") % 3).cast("int"), "h": (F.col("doc_id") % 2).cast("int")})
    name = lambda r, k: F.concat(F.lit(f"v{r}_c"), k.cast("string"))
    t, m, h = F.col("t"), F.col("m"), F.col("h")
    none = F.lit(None).cast("string")
    status = F.when(t % 3 == 0, "split").when(t % 3 == 1, "accepted").otherwise("binned")
    action = F.when(t % 3 == 0, "split_done").when(t % 3 == 1, "accept").when(t == 2, "bin_meta").when(t == 5, "bin_fragment").otherwise("reject")
    grade = F.when(t % 3 == 0, "C").when(t % 3 == 1, "B").when(t == 2, "D-meta").when(t == 5, "D-fragment").otherwise("D")
    roots = v.groupBy("t").agg(F.count(F.lit(1)).alias("size"))
    roots = roots.select(name(0, t).alias("id"), F.when(t == 4, "v0_c1").alias("parent"), F.when(t == 4, 1).otherwise(0).alias("depth"), "size", F.concat(F.lit("k"), t.cast("string")).alias("keywords"), none.alias("rule_grade"), grade.alias("final_grade"), action.alias("action"), status.alias("status"))
    below = v.where(t % 3 == 0)
    pending = (m == 2) & (t == 0)
    children = below.groupBy("t", "m").agg(F.count(F.lit(1)).alias("size"))
    children = children.select(name(1, t * 3 + m).alias("id"), name(0, t).alias("parent"), F.lit(1).alias("depth"), "size", F.concat(F.lit("k"), t.cast("string"), F.lit(", w"), m.cast("string")).alias("keywords"), F.when(pending, "D-meta").alias("rule_grade"), F.when(m == 0, "C").when(m == 1, "A").when(~pending, "B").alias("final_grade"), F.when(m == 0, "split_done").when(~pending, "accept").alias("action"), F.when(m == 0, "split").when(pending, "pending").otherwise("accepted").alias("status"))
    deep = below.where(m == 0).groupBy("t", "h").agg(F.count(F.lit(1)).alias("size"))
    deep = deep.select(name(2, t * 2 + h).alias("id"), name(1, t * 3).alias("parent"), F.lit(2).alias("depth"), "size", F.lit("").alias("keywords"), none.alias("rule_grade"), F.lit("B").alias("final_grade"), F.lit("accept").alias("action"), F.lit("accepted").alias("status"))
    rows = roots.unionByName(children).unionByName(deep)
    blank = catalog.new_nodes(rows)
    named = F.when(F.col("status") == "accepted", F.concat(F.lit("topic "), F.col("id")))
    filled = rows.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in ("rule_grade", "final_grade", "action", "status")))
    nodes = blank.join(filled, F.col("id") == F.col("_id")).withColumns({c: F.col(f"_{c}") for c in ("rule_grade", "final_grade", "action", "status")}).withColumn("llm_name", named)
    return cut(nodes.select(*blank.columns), "tree"), v.count()


@query
def tree_stop_flags(spark, sf):
    nodes, total = _tree(spark, sf)
    return catalog.stop_flags(nodes, total)


@query
def tree_catalog(spark, sf):
    return catalog.catalog_rows(_tree(spark, sf)[0]).withColumn("topic_id", F.col("topic_id").cast("long"))


@query
def tree_buckets(spark, sf):
    return catalog.bucket_rows(_tree(spark, sf)[0])


@query
def tree_summary(spark, sf):
    nodes, total = _tree(spark, sf)
    return catalog.catalog_summary(nodes, total)


@query
def tree_levels(spark, sf):
    return catalog.tree_edges(_tree(spark, sf)[0])


@query
def leaf_nodes(spark, sf):
    return catalog.leaves(_tree(spark, sf)[0]).select("id", "depth", "size", "status")


@query
def round_nodes(spark, sf):
    return catalog.of_round(_tree(spark, sf)[0], 1).select("id", "parent", "depth", "size", "status")


@query
def nodes_by_status(spark, sf):
    nodes, _ = _tree(spark, sf)
    kept = catalog.with_status(nodes, "pending", "accepted")
    return kept.groupBy("status", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query
def catalog_buckets(spark, sf):
    return catalog.bucket_rows(_assessed(spark, sf)[0])


@query
def catalog_summary(spark, sf):
    nodes, total = _assessed(spark, sf)
    return catalog.catalog_summary(nodes, total)


@query
def tree_edges(spark, sf):
    return catalog.tree_edges(_assessed(spark, sf)[0])


@query
def grouped_roots(spark, sf):
    nodes, membership, _ = _nodes(spark, sf)
    return catalog.group_roots(nodes, vectors(spark, sf), membership, CatalogConfig(group_ratio=0.9, group_similarity=0.05)).select("id", "parent", "depth", "size")


# --- consensus -------------------------------------------------------------------


def _labellings(spark, sf) -> DataFrame:
    v = vectors(spark, sf)
    near = vx.nearest_centroid(v, vx.centroids(v)).select("doc_id", F.col("nearest").alias("l3"))
    return v.select("doc_id", F.col("topic_id").alias("l1"), (F.col("doc_id") % 7).cast("int").alias("l2")).join(near, "doc_id")


@query
def coassoc_tuples(spark, sf):
    c = consensus.coassociation(_labellings(spark, sf), ["l1", "l2", "l3"])
    return c.withColumn("agreement", F.round("agreement", 6))


@query
def consensus_silhouette(spark, sf):
    """Of the first labelling, over distances 1 - agreement of the distinct tuples."""
    labels = _labellings(spark, sf)
    pairs = consensus.coassociation(labels, ["l1", "l2", "l3"]).select("a", "b", (1 - F.col("agreement")).alias("distance"))
    rows = consensus.label_tuples(labels, ["l1", "l2", "l3"]).select(F.col("first_doc").alias("id"), F.col("l1").alias("topic_id"), "n")
    return _rounded(metrics.silhouette_precomputed(pairs, rows))


@query
def consensus_modes(spark, sf):
    rows = _labellings(spark, sf).withColumn("c", (F.col("doc_id") % 11).cast("int"))
    return consensus.consensus_map(rows, "c", ["l1", "l2"]).select("c", "l1", "l2", "inserted")


@query
def consensus_labels(spark, sf):
    rows = _labellings(spark, sf).withColumn("c", (F.col("doc_id") % 11).cast("int"))
    return consensus.apply_map(rows, consensus.consensus_map(rows, "c", ["l1", "l2"]), "c", ["l1", "l2"])


# --- not in SQL: iterative or random methods ----------------------------------------


@query
def leiden_communities(spark, sf):
    v = vectors(spark, sf)
    return graph.communities(graph.undirected(vx.nearest_neighbours(v, KNN)), v.select("doc_id"))


@query
def propagated_communities(spark, sf):
    v = vectors(spark, sf)
    return graph.propagated(graph.undirected(vx.nearest_neighbours(v, KNN)), v.select("doc_id"), 3)


def _resolutions(spark, sf) -> DataFrame:
    v = vectors(spark, sf)
    return graph.resolution_scan(graph.undirected(vx.nearest_neighbours(v, KNN)), v.select("doc_id"), RESOLUTIONS)


@query
def resolution_scan(spark, sf):
    return _resolutions(spark, sf)


@query
def best_resolution(spark, sf):
    return topics.choose_resolution(_resolutions(spark, sf))


@query
def split_children(spark, sf):
    d = documents(spark, sf)
    nodes, membership, total = _nodes(spark, sf)
    return catalog.split(catalog.assess(nodes, total), membership, d.select("doc_id", "text", "embedding"), 1).nodes.select("id", "parent", "depth", "size", "keywords", "status")


@query
def catalog_run(spark, sf):
    return run.run_catalog(spark, uneven(documents(spark, sf)))["nodes"].select("id", "parent", "depth", "size", "final_grade", "action", "status")


@query
def kmeans_topics(spark, sf):
    return models.kmeans(vectors(spark, sf))


@query
def kmeans_scan(spark, sf):
    return models.kmeans_scan(vectors(spark, sf), (5, 10, 15))


@query
def best_k(spark, sf):
    return topics.choose_k(models.kmeans_scan(vectors(spark, sf), (5, 10, 15)))


@query
def prior_scan(spark, sf):
    return models.prior_scan(vectors(spark, sf), dims=10, k=40, iterations=5)


@query
def consensus_scan(spark, sf):
    return consensus.consensus_scan(_labellings(spark, sf), ["l1", "l2", "l3"], (20, 50, 100))


@query
def best_consensus(spark, sf):
    scan = cut(consensus.consensus_scan(_labellings(spark, sf), ["l1", "l2", "l3"], (20, 50, 100)), "scan")
    parts = [topics.choose_consensus(scan, c).select(F.lit(c).alias("criterion"), "n_clusters") for c in ("max_silhouette", "min_abs_silhouette", "median_size")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def topic_composite(spark, sf):
    return models.topic_composite(documents(spark, sf))[0]


@query
def explained_variance(spark, sf):
    shares = models.pca(vectors(spark, sf), 10)[1]
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(shares)], "component int, share double")


@query
def lda_topics(spark, sf):
    return models.lda_topics(documents(spark, sf), 5, 5)


@query
def svd_features(spark, sf):
    return models.svd(vectors(spark, sf), 10)


@query
def pca_features(spark, sf):
    return models.pca(vectors(spark, sf), 10)[0]


@query
def mixture_topics(spark, sf):
    p, _ = models.diagonal_mixture(models.pca(vectors(spark, sf), 10)[0], 10, 5)
    return topics.soft_assignment(p)


@query
def bayesian_mixture_topics(spark, sf):
    p, _ = models.diagonal_mixture(models.pca(vectors(spark, sf), 10, scale=True)[0], 20, 5, floor=1e-3, concentration=0.1)
    return topics.soft_assignment(p)


@query
def agglomerative_topics(spark, sf):
    return models.agglomerative(vectors(spark, sf).select("doc_id", F.col("embedding").cast("array<double>").alias("x")), 30)


@query
def spectral_topics(spark, sf):
    return models.spectral(graph.undirected(vx.nearest_neighbours(vectors(spark, sf), 15)), 10)


@query
def density_topics(spark, sf):
    reduced = models.pca(vectors(spark, sf), 5)[0]
    return models.density(reduced.select("doc_id", F.col("reduced").alias("x")))


@query
def two_level_topics(spark, sf):
    return models.two_level(vectors(spark, sf))


@query
def gsdmm_topics(spark, sf):
    return models.gsdmm(documents(spark, sf).select("doc_id", "text"), 10)


@query
def discriminant_topics(spark, sf):
    return models.discriminant_loop(vectors(spark, sf), 5, 4, 2)


HASHED_DIMS = 32


@query
def hashed_vectors(spark, sf):
    v = models.hashed_text(documents(spark, sf), HASHED_DIMS)
    return v.select("doc_id", F.posexplode("embedding").alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")).where("x != 0")


def _fused(spark, sf) -> DataFrame:
    encoded = models.hashed_text(documents(spark, sf), HASHED_DIMS)
    return models.fused_features(vectors(spark, sf), encoded.withColumnRenamed("embedding", "reduced"))


@query
def fused_vectors(spark, sf):
    place = F.transform("embedding", lambda x, i: x * (i + 1))
    total = F.aggregate(place, F.lit(0.0), lambda s, x: s + x)
    return _fused(spark, sf).select("doc_id", F.size("embedding").cast("long").alias("dims"), F.round(total, 5).alias("weighted_sum"))


@query
def fused_topics(spark, sf):
    """Fusion: vectors and hashed words side by side, reduced, then a mixture."""
    reduced = cut(models.pca(_fused(spark, sf), 10)[0], "reduced")
    return topics.soft_assignment(models.diagonal_mixture(reduced, 10, 5)[0]).select("doc_id", "topic_id")
