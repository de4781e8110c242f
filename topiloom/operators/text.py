"""Term tables: counts, document frequencies, TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topiloom.config import TfIdf
from topiloom.functions import text as tx
from topiloom.store import cut


def terms(docs: DataFrame, config: TfIdf = TfIdf(), group: str | None = None) -> DataFrame:
    """(group,) doc_id, term, tf: one row per document and distinct term.

    Texts are dealt by document before they are taken apart, so counts per document and
    norms need no shuffle of single terms."""
    words = tx.tokens(F.col("text"))
    if config.stop_words:
        words = tx.without_stop_words(words)
    if config.ngrams == (1, 2):
        words = tx.with_bigrams(words)
    keys = [group] if group else []
    dealt = docs.select(*keys, "doc_id", "text").repartition("doc_id")
    return dealt.select(*keys, "doc_id", F.explode(words).alias("term")).groupBy(*keys, "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(tf: DataFrame, n_docs: Column | int, config: TfIdf = TfIdf(), group: str | None = None) -> DataFrame:
    """(group,) term, df: terms within the document-frequency bounds, the most frequent
    ``max_features`` by corpus count, ties by term."""
    keys = [group] if group else []
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    counted = tf.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if group:
        counted = counted.join(tf.groupBy(group).agg(F.countDistinct("doc_id").alias("_n")), group)
        n = F.col("_n")
    bounded = counted.where((F.col("df") >= config.min_df) & (F.col("df") <= config.max_df * n))
    if group:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("total"), "term"))
        return bounded.withColumn("_r", rank).where(F.col("_r") <= config.max_features).select(group, "term", "df")
    return bounded.orderBy(F.desc("total"), "term").limit(config.max_features).select("term", "df")


def tfidf(docs: DataFrame, config: TfIdf = TfIdf(), n_docs: int | None = None) -> DataFrame:
    """doc_id, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), rows of unit length.

    The vocabulary has at most ``max_features`` rows, so it is broadcast.  Texts are taken
    apart once: the term table is stored, and vocabulary and weights are read from it.
    """
    n = docs.count() if n_docs is None else n_docs
    tf = cut(terms(docs, config), "terms")
    vocab = vocabulary(tf, n, config)
    count = 1 + F.log("tf") if config.sublinear else F.col("tf")
    raw = tf.join(F.broadcast(vocab), "term").select("doc_id", "term", (count * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("raw") / norm).alias("weight"))


def topic_keywords(docs: DataFrame, weights: DataFrame, top_n: int = 10) -> DataFrame:
    """topic_id, term, weight, rank: terms with the largest mean weight in a topic.

    Absent terms count as zero, so sums are divided by the topic's size.  Weights are
    rounded before they are ranked; ties go by term.
    """
    sizes = docs.groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))
    sums = weights.join(docs.select("doc_id", "topic_id"), "doc_id").groupBy("topic_id", "term").agg(F.sum("weight").alias("w"))
    mean = sums.join(F.broadcast(sizes), "topic_id").select("topic_id", "term", F.round(F.col("w") / F.col("size"), 6).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term"))
    return mean.withColumn("rank", rank).where(F.col("rank") <= top_n)


def keyword_strings(ranked: DataFrame) -> DataFrame:
    """topic_id, keywords: the ranked terms joined by commas."""
    in_order = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return ranked.groupBy("topic_id").agg(F.array_join(F.transform(in_order, lambda x: x["term"]), ", ").alias("keywords"))


def coherence(docs: DataFrame, weights: DataFrame, top_n: int = 10, least: int = 5) -> DataFrame:
    """One row: the mean over topics of at least ``least`` documents of the mean weight of their top terms."""
    large = docs.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("topic_id")
    top = topic_keywords(docs, weights, top_n).join(large, "topic_id", "left_semi")
    return top.groupBy("topic_id").agg(F.avg("weight").alias("c")).agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("tfidf_coherence"))


def class_tfidf(docs: DataFrame, config: TfIdf = TfIdf(), top_n: int = 10) -> DataFrame:
    """topic_id, term, weight, rank by class-based TF-IDF: tf in the topic times ln(1 + A / f)."""
    tf = cut(terms(docs, config).join(docs.select("doc_id", "topic_id"), "doc_id").groupBy("topic_id", "term").agg(F.sum("tf").alias("tf")), "class-terms")
    per_topic = tf.groupBy("topic_id").agg(F.sum("tf").alias("words"))
    average = per_topic.agg(F.avg("words").alias("a"))
    overall = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    scored = tf.join(overall, "term").join(F.broadcast(per_topic), "topic_id").crossJoin(F.broadcast(average))
    weight = F.round(F.col("tf") / F.col("words") * F.log(1 + F.col("a") / F.col("f")), 6)
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term"))
    return scored.select("topic_id", "term", weight.alias("weight")).withColumn("rank", rank).where(F.col("rank") <= top_n)


def keywords_over_time(docs: DataFrame, at: str = "ts", bins: int = 30, top_n: int = 5, config: TfIdf = TfIdf()) -> DataFrame:
    """topic_id, bin, term, weight, rank: terms by class TF-IDF within each bin of time, where a
    class is a topic's documents (doc_id, text, topic_id, ``at``) of that bin."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    bounds = docs.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi"))
    index = F.least(F.floor((micros - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(bins - 1))
    placed = docs.where(F.col(at).isNotNull()).crossJoin(F.broadcast(bounds)).select("doc_id", "topic_id", index.cast("int").alias("bin"))
    tf = terms(docs, config).join(placed, "doc_id").groupBy("topic_id", "bin", "term").agg(F.sum("tf").alias("tf"))
    tf = cut(tf, "bin-terms")
    words = tf.groupBy("topic_id", "bin").agg(F.sum("tf").alias("words"))
    average = words.groupBy("bin").agg(F.avg("words").alias("a"))
    overall = tf.groupBy("bin", "term").agg(F.sum("tf").alias("f"))
    scored = tf.join(overall, ["bin", "term"]).join(words, ["topic_id", "bin"]).join(average, "bin")
    weight = F.round(F.col("tf") / F.col("words") * F.log(1 + F.col("a") / F.col("f")), 6)
    rank = F.row_number().over(Window.partitionBy("topic_id", "bin").orderBy(F.desc("weight"), "term"))
    return scored.select("topic_id", "bin", "term", weight.alias("weight")).withColumn("rank", rank).where(F.col("rank") <= top_n)
