"""The topic catalog: rules, judge, split loop, stop check, export.

State is two tables that are never changed in place: ``nodes`` (one row per topic) and
``membership`` (node_id, doc_id).  Every round makes new versions of both.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topiloom.config import CatalogConfig, TfIdf
from topiloom.functions import text as tx
from topiloom.operators import graph, text, topics
from topiloom.operators import vectors as vx
from topiloom.operators.leiden import leiden
from topiloom.store import cut

NODES = (
    "id string, parent string, depth int, size long, keywords string, mean_pairwise_dist double, rule_grade string,"
    " rule_signals map<string,string>, llm_grade string, llm_name string, llm_action string, final_grade string,"
    " action string, status string, round int"
)


def new_nodes(sized: DataFrame, round_: int = 0) -> DataFrame:
    """Pending nodes from (id, parent, depth, size, keywords)."""
    empty = lambda kind: F.lit(None).cast(kind)
    return sized.select(
        "id", "parent", F.col("depth").cast("int").alias("depth"), F.col("size").cast("long").alias("size"), "keywords", empty("double").alias("mean_pairwise_dist"),
        empty("string").alias("rule_grade"), empty("map<string,string>").alias("rule_signals"), empty("string").alias("llm_grade"), empty("string").alias("llm_name"),
        empty("string").alias("llm_action"), empty("string").alias("final_grade"), empty("string").alias("action"), F.lit("pending").alias("status"), F.lit(round_).alias("round"),
    )


def root_nodes(docs: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and membership of a first clustering (doc_id, topic_id); outliers (-1) have none."""
    sized = topics.sizes(docs)
    named = sized.withColumn("id", F.concat(F.lit("v0_c"), (F.row_number().over(Window.orderBy("topic_id")) - 1).cast("string")))
    nodes = named.join(keywords, "topic_id", "left").select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "size", F.coalesce("keywords", F.lit("")).alias("keywords"))
    membership = docs.join(F.broadcast(named.select("topic_id", F.col("id").alias("node_id"))), "topic_id").select("node_id", "doc_id")
    return new_nodes(nodes), membership


def score_rules(nodes: DataFrame, total: int, median_dist: float | None = None, config: CatalogConfig = CatalogConfig()) -> DataFrame:
    """``nodes`` with rule_grade, rule_signals and triggered.

    The last of these that holds decides: too small (fragment), too large (split),
    blacklisted (meta); if none does, four or more domains or too wide a spread split.
    """
    largest = int(total * config.max_topic_share)
    size, words = F.col("size"), F.coalesce("keywords", F.lit(""))
    domains = tx.domain_count(words, config.domain_match)
    small, large, meta = size < config.min_size, size > largest, tx.blacklisted(words)
    mixed, unusual = domains >= config.mixed_domains, (domains == 0) & (F.length(words) > 0)
    wide = F.lit(False)
    if config.enable_r5 and median_dist is not None:
        wide = F.coalesce(F.col("mean_pairwise_dist") > config.spread_factor * median_dist, F.lit(False))
    grade = F.when(meta, "D-meta").when(large, "C").when(small, "D-fragment").when(mixed | wide, "C")
    said = {
        "R1": F.when(small, F.concat(F.lit("size="), size.cast("string"), F.lit(f" < {config.min_size}"))),
        "R2": F.when(large, F.concat(F.lit("size="), size.cast("string"), F.lit(f" > {largest} ({config.max_topic_share * 100:.0f}%)"))),
        "R3": F.when(meta, F.lit("blacklist match in keywords")),
        "R4": F.when(mixed, F.concat(F.lit("domains="), domains.cast("string"), F.lit(", suggests mixed bag"))).when(unusual, F.lit("domains=0, unusual keywords")),
    }
    if config.enable_r5 and median_dist is not None:
        said["R5"] = F.when(wide, F.format_string("mpd=%.4f > %.4f", F.col("mean_pairwise_dist"), F.lit(config.spread_factor * median_dist)))
    signals = F.map_filter(F.create_map(*(x for k, v in said.items() for x in (F.concat(F.lit(f"{k}_"), F.col("id")), v))), lambda _, v: v.isNotNull())
    triggered = sum((c.cast("int") for c in (large, meta, mixed | unusual, wide)), small.cast("int"))
    return nodes.withColumns({"rule_grade": grade, "rule_signals": signals, "triggered": triggered})


#: A judge takes undecided nodes (id, size, keywords) and returns id, name, grade, action, failed.
Judge = Callable[[DataFrame], DataFrame]


def offline_judge(nodes: DataFrame) -> DataFrame:
    """Without a language model: the first keyword is the name, the grade is B."""
    first = F.trim(F.split("keywords", ",")[0])
    name = F.when(F.length("keywords") > 0, first).otherwise("unknown")
    return nodes.select("id", F.substring(name, 1, 20).alias("name"), F.lit("B").alias("grade"), F.lit("keep").alias("action"), F.lit(False).alias("failed"))


def text_judge(reply: Callable[[DataFrame], DataFrame]) -> Judge:
    """A judge from a function that gives (id, reply): replies are parsed and repaired here."""

    def judge(nodes: DataFrame) -> DataFrame:
        j = reply(nodes).select("id", tx.parsed_judgement(F.col("reply")).alias("j"))
        return j.select("id", "j.name", "j.grade", "j.action", "j.failed")

    return judge


def prompt_key(prompt: Column) -> Column:
    """The key of a cached reply: replies hold for equal prompts only."""
    return F.sha2(prompt, 256)


def cached_judge(judge: Judge, store: str, prompt: Callable[[DataFrame], Column] | None = None) -> Judge:
    """``judge`` behind a stored cache of replies: nodes whose prompt has been answered are not
    asked again, also not by later runs; failed replies are.

    ``prompt`` makes a node's prompt (default: size and keywords).  Replies are appended to
    the folder ``store``, so what one call has paid for is there for the next.
    """

    def ask(nodes: DataFrame) -> DataFrame:
        spark = nodes.sparkSession
        text = prompt(nodes) if prompt else F.concat_ws("|", F.col("size").cast("string"), "keywords")
        keyed = cut(nodes.withColumn("_key", prompt_key(text)), "asked")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        schema = "key string, name string, grade string, action string, failed boolean"
        old = spark.read.schema(schema).parquet(store) if there else spark.createDataFrame([], schema)
        old = old.where("NOT failed").dropDuplicates(["key"])
        unknown = keyed.join(old.select(F.col("key").alias("_key")), "_key", "left_anti")
        if unknown.take(1):
            # equal prompts are asked once
            first = unknown.groupBy("_key").agg(F.min("id").alias("id"))
            fresh = judge(unknown.join(first, ["_key", "id"]).select(*nodes.columns)).join(first, "id")
            fresh.select(F.col("_key").alias("key"), "name", "grade", "action", "failed").write.mode("append").parquet(store)
        # a good reply goes before a failed one
        known = spark.read.schema(schema).parquet(store) if there or unknown.take(1) else old
        best = known.groupBy("key").agg(F.min_by(F.struct("name", "grade", "action", "failed"), F.struct("failed", "name")).alias("r"))
        return keyed.join(best, F.col("_key") == F.col("key")).select("id", "r.*")

    return ask


def without_failed(cache: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A reply cache (node_id, failed, ...) without failed entries (of ``ids``, if given)."""
    bad = cache.where("failed").select("node_id")
    return cache.join(bad if ids is None else bad.join(ids, "node_id", "left_semi"), "node_id", "left_anti")


def assess(nodes: DataFrame, total: int, median_dist: float | None = None, judge: Judge = offline_judge, config: CatalogConfig = CatalogConfig()) -> DataFrame:
    """Grades all pending nodes: deep ones are accepted, then rules decide, then the judge."""
    pending, settled = nodes.where("status = 'pending'"), nodes.where("status != 'pending'")
    scored = score_rules(pending, total, median_dist, config).drop("triggered")
    deep = F.col("depth") >= config.auto_accept_depth
    open_ = scored.where(~deep & F.col("rule_grade").isNull())
    judged = judge(open_.select("id", "size", "keywords")).select(F.col("id").alias("_id"), "name", "grade", F.col("action").alias("asked"), "failed")
    joined = scored.join(judged, F.col("id") == F.col("_id"), "left")
    by_rule, failed = F.col("rule_grade").isNotNull(), F.coalesce("failed", F.lit(True))
    first_three = F.when(F.length("keywords") > 0, F.array_join(F.slice(F.split("keywords", ", "), 1, 3), "、")).otherwise("杂项")
    final = F.when(deep, "B").when(by_rule, F.col("rule_grade")).when(failed, "B").otherwise(F.col("grade"))
    joined = joined.withColumn("_final", final)
    f = F.col("_final")
    action = F.when(f == "D-meta", "bin_meta").when(f == "D-fragment", "bin_fragment").when(f == "C", "split").when(f == "D", "reject").otherwise("accept")
    joined = joined.withColumn("_action", action)
    told = ~deep & ~by_rule & ~failed
    done = joined.withColumns(
        {
            "rule_grade": F.when(~deep, F.col("rule_grade")),
            "rule_signals": F.when(~deep, F.col("rule_signals")),
            "llm_grade": F.when(deep, "B").when(told, F.col("grade")),
            "llm_name": F.when(deep, first_three).when(told, F.col("name")),
            "llm_action": F.when(told, F.col("asked")),
            "final_grade": f,
            "action": F.col("_action"),
            "status": F.when(F.col("_action") == "accept", "accepted").when(F.col("_action") == "split", "split").otherwise("binned"),
        }
    )
    return settled.unionByName(done.select(*settled.columns))


def split_resolution(n: int, config: CatalogConfig = CatalogConfig()) -> float:
    if config.ladder == "paper":
        return 0.6 if n < 30 else 0.8 if n < 100 else 1.2
    return 1.2 if n > 2000 else 1.0 if n > 500 else 0.8


def sub_communities(vectors: DataFrame, config: CatalogConfig = CatalogConfig()) -> DataFrame:
    """node_id, doc_id, sub for (node_id, doc_id, embedding): every node is clustered by itself,
    nodes in parallel.  ``sub`` is -1 for members of communities that are too small; a node
    that is small or falls apart wholly stays one community, 0."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        ids = rows["doc_id"].to_numpy()
        n = len(ids)
        sub = np.zeros(n, dtype=np.int64)
        if n >= config.split_least:
            units = vx._unit_rows(vx._matrix(rows["embedding"].combine_chunks()))
            src, dst, sim = [], [], []
            for a in range(0, n, 512):
                s, d, w = vx._top(units[a : a + 512] @ units.T, ids[a : a + 512], ids, min(config.split_neighbours, n - 1))
                src.append(s), dst.append(d), sim.append(w)
            src, dst, sim = np.concatenate(src), np.concatenate(dst), np.concatenate(sim)
            keep = sim > 0
            label = leiden(n, np.searchsorted(ids, src[keep]), np.searchsorted(ids, dst[keep]), sim[keep], split_resolution(n, config), config.seed)
            size = np.bincount(label)
            if (size >= config.split_min_size).any():
                sub = np.where(size[label] >= config.split_min_size, label, -1)
        return pa.table({"node_id": rows["node_id"], "doc_id": rows["doc_id"], "sub": pa.array(sub.astype(np.int32))})

    rows = vectors.select("node_id", F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.groupBy("node_id").applyInArrow(run, "node_id string, doc_id long, sub int")


def grouped_keywords(docs: DataFrame, group: str, part: str, config: TfIdf, top_n: int = 10) -> DataFrame:
    """group, part, keywords: TF-IDF fitted on each group's own texts."""
    tf = text.terms(docs, config, group)
    vocab = text.vocabulary(tf, 0, config, group)
    n = docs.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    raw = tf.join(vocab, [group, "term"]).join(F.broadcast(n), group).withColumn("raw", F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1))
    weight = raw.withColumn("w", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(group, "doc_id"))))
    sizes = docs.groupBy(group, part).agg(F.count(F.lit(1)).alias("size"))
    sums = weight.join(docs.select(group, "doc_id", part), [group, "doc_id"]).groupBy(group, part, "term").agg(F.sum("w").alias("w"))
    mean = sums.join(F.broadcast(sizes), [group, part]).withColumn("mean", F.round(F.col("w") / F.col("size"), 6))
    rank = F.row_number().over(Window.partitionBy(group, part).orderBy(F.desc("mean"), "term"))
    top = mean.withColumn("r", rank).where(F.col("r") <= top_n)
    return top.groupBy(group, part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ", ").alias("keywords"))


@dataclasses.dataclass
class Split:
    nodes: DataFrame
    membership: DataFrame
    dropped: DataFrame  # node_id, doc_id of members of communities that are too small


def split(nodes: DataFrame, membership: DataFrame, docs: DataFrame, round_: int, config: CatalogConfig = CatalogConfig()) -> Split:
    """Splits every node whose action is ``split``; one that does not fall apart is accepted as B.

    ``docs`` has doc_id, text and embedding."""
    asked = nodes.where("action = 'split'").select("id")
    members = membership.join(F.broadcast(asked.withColumnRenamed("id", "node_id")), "node_id").join(docs, "doc_id")
    # the clustering is the costly part and is read several times below
    found = cut(sub_communities(members.select("node_id", "doc_id", "embedding"), config), "subs")
    subs = members.select("node_id", "doc_id", "text").join(found, ["node_id", "doc_id"])
    counts = found.where("sub >= 0").groupBy("node_id").agg(F.countDistinct("sub").alias("parts"))
    parts = subs.join(F.broadcast(counts.where("parts > 1").select("node_id")), "node_id", "left_semi")
    kept = parts.where("sub >= 0")
    words = grouped_keywords(parts.select("node_id", "doc_id", "text", "sub"), "node_id", "sub", config.split_tfidf, config.keywords)
    sized = kept.groupBy("node_id", "sub").agg(F.count(F.lit(1)).alias("size"))
    parents = nodes.select(F.col("id").alias("node_id"), "depth")
    number = F.row_number().over(Window.orderBy("node_id", F.desc("size"), "sub")) - 1
    named = sized.join(F.broadcast(parents), "node_id").join(words, ["node_id", "sub"], "left").withColumn("id", F.concat(F.lit(f"v{round_}_c"), number.cast("string")))
    children = new_nodes(named.select("id", F.col("node_id").alias("parent"), (F.col("depth") + 1).alias("depth"), "size", F.coalesce("keywords", F.lit("")).alias("keywords")), round_)
    into = kept.join(F.broadcast(named.select("node_id", "sub", "id")), ["node_id", "sub"]).select(F.col("id").alias("node_id"), "doc_id")
    done = F.broadcast(counts.select(F.col("node_id").alias("_split"), "parts"))
    marked = nodes.join(done, F.col("id") == F.col("_split"), "left")
    was_asked, divided = F.col("action") == "split", F.coalesce("parts", F.lit(0)) > 1
    changed = marked.withColumns(
        {
            "final_grade": F.when(was_asked & ~divided, "B").otherwise(F.col("final_grade")),
            "status": F.when(was_asked & ~divided, "accepted").otherwise(F.col("status")),
            "action": F.when(was_asked, F.when(divided, "split_done").otherwise("accept")).otherwise(F.col("action")),
        }
    ).select(*nodes.columns)
    return Split(changed.unionByName(children), membership.unionByName(into), parts.where("sub < 0").select("node_id", "doc_id"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children that are not binned."""
    parents = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("_p")).distinct()
    return nodes.join(parents, F.col("id") == F.col("_p"), "left_anti").where("status != 'binned'")


def of_round(nodes: DataFrame, round_: int) -> DataFrame:
    """Nodes that a round has made, by the prefix of their id."""
    return nodes.where(F.col("id").startswith(f"v{round_}_"))


def with_status(nodes: DataFrame, *status: str) -> DataFrame:
    """Nodes that are pending, accepted, split or binned."""
    return nodes.where(F.col("status").isin(*status))


def stop_flags(nodes: DataFrame, total: int, config: CatalogConfig = CatalogConfig()) -> DataFrame:
    """One row: the six stop conditions, their figures, and whether all hold."""
    accepted, binned, shallow = F.col("status") == "accepted", F.col("status") == "binned", F.col("depth") < 2
    one = nodes.agg(
        F.count_if(accepted).alias("n"),
        F.count_if(accepted & F.coalesce(F.col("final_grade").isin("A", "B"), F.lit(False))).alias("named"),
        F.coalesce(F.max(F.when(accepted, F.col("size"))), F.lit(0)).alias("largest"),
        F.coalesce(F.min(F.when(accepted & shallow, F.col("size"))), F.lit(0)).alias("min_size_shallow_min"),
        F.count_if(accepted & ~shallow & (F.col("size") < 10)).alias("deep_under_10"),
        F.coalesce(F.sum(F.when(binned, F.col("size"))), F.lit(0)).alias("binned"),
        F.count_if((F.col("status") == "pending") & (F.col("rule_grade") == "D-meta")).alias("meta"),
        F.count_if(F.col("status") == "pending").alias("pending"),
    )
    flags = {
        "all_named": (F.col("n") > 0) & (F.col("named") == F.col("n")),
        "max_topic_ok": F.col("largest") < total * config.max_topic_share,
        "min_size_ok": F.col("min_size_shallow_min") >= config.min_shallow,
        "cd_ratio_ok": F.col("binned") < total * config.max_binned_share,
        "meta_clean": F.col("meta") == 0,
        "no_pending": F.col("pending") == 0,
    }
    told = one.select(*(v.alias(k) for k, v in flags.items()), "min_size_shallow_min", "deep_under_10")
    both = F.lit(True)
    for k in flags:
        both &= F.col(k)
    return told.withColumn("all_pass", both)


def catalog_rows(nodes: DataFrame) -> DataFrame:
    """The accepted leaves, numbered from 1 in order of round and number."""
    made = leaves(nodes).where("status = 'accepted'")
    place = [F.regexp_extract("id", r"^v(\d+)_", 1).cast("int"), F.regexp_extract("id", r"_c(\d+)$", 1).cast("int")]
    return made.select(F.row_number().over(Window.orderBy(*place)).alias("topic_id"), F.coalesce("llm_name", F.lit("")).alias("topic_name"), F.coalesce("final_grade", F.lit("")).alias("grade"), "size", "depth", "keywords", "action")


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """Binned nodes with their bucket: meta, residual or rejected."""
    bucket = F.when(F.col("action") == "bin_meta", "meta").when(F.col("action").isin("bin_fragment", "bin_residual"), "residual").otherwise("rejected")
    return nodes.where("status = 'binned'").select(bucket.alias("bucket"), F.col("id").alias("source_id"), "size", "keywords")


def catalog_summary(nodes: DataFrame, total: int) -> DataFrame:
    """One row of totals; what is neither accepted nor binned is ``unaccounted``."""
    made = catalog_rows(nodes).agg(F.count(F.lit(1)).alias("accepted_topics"), F.coalesce(F.sum("size"), F.lit(0)).alias("accepted_headlines"))
    gone = bucket_rows(nodes).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("binned_headlines"), F.count_if(F.col("bucket") == "meta").alias("meta_items"), F.count_if(F.col("bucket") == "residual").alias("residual_items"))
    share = lambda c: F.round(F.col(c) / max(total, 1) * 100, 1)
    both = made.crossJoin(gone)
    return both.select(F.lit(total).cast("long").alias("total_headlines"), "accepted_topics", "accepted_headlines", share("accepted_headlines").alias("accepted_pct"), "binned_headlines", share("binned_headlines").alias("binned_pct"), (F.lit(total) - F.col("accepted_headlines") - F.col("binned_headlines")).alias("unaccounted"), "meta_items", "residual_items")


def tree_edges(nodes: DataFrame) -> DataFrame:
    """parent, id, name, size, depth, status of every node that hangs on an accepted or split root."""
    own = nodes.select("parent", "id", F.coalesce("llm_name", F.substring("keywords", 1, 30)).alias("name"), "size", "depth", "status")
    level = own.where("parent IS NULL AND status IN ('accepted', 'split')")
    out = level
    for _ in range(3):
        level = own.join(level.select(F.col("id").alias("_up")), F.col("parent") == F.col("_up")).drop("_up")
        out = out.unionByName(level)
    return out


def group_roots(nodes: DataFrame, vectors: DataFrame, membership: DataFrame, config: CatalogConfig = CatalogConfig()) -> DataFrame:
    """Hangs small roots under large similar ones.  Centroids and similarities come from
    Spark; the greedy choice among the roots, some dozens of them, is made on the driver."""
    roots = nodes.where("depth = 0").select("id", "size")
    assigned = membership.join(F.broadcast(roots.select(F.col("id").alias("node_id"))), "node_id", "left_semi").join(vectors.select("doc_id", "embedding"), "doc_id")
    sims = vx.centroid_similarities(vx.centroids(assigned, "node_id"), "node_id")
    sizes = {r["id"]: r["size"] for r in roots.collect()}
    links = graph.greedy_groups(sizes, {(r["a"], r["b"]): r["similarity"] for r in sims.collect()}, config.group_ratio, config.group_similarity)
    if not links:
        return nodes
    table = nodes.sparkSession.createDataFrame([(c, p) for p, c in links], "_child string, _parent string")
    joined = nodes.join(F.broadcast(table), F.col("id") == F.col("_child"), "left")
    return joined.withColumns({"parent": F.coalesce("_parent", "parent"), "depth": F.when(F.col("_parent").isNotNull(), 1).otherwise(F.col("depth")).cast("int")}).select(*nodes.columns)
