"""The flagship: keywords, nearest samples, size and rule grade of every topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiloom.operators import catalog, text, topics
from topiloom.plans.oracle import DOCS, _BLACK, _DOMAINS, _centroids, _keywords, _tfidf
from topiloom.plans.queries import documents
from topiloom.store import cut


def topic_report(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    # ids and topics are stored for the steps that read only them; texts are read once
    slim = cut(d.select("doc_id", "topic_id"), "topics")
    keywords = text.keyword_strings(text.topic_keywords(slim, text.tfidf(d.select("doc_id", "text"), n_docs=slim.count())))
    near = topics.samples(d.select("doc_id", "topic_id", "embedding")).where("kind = 'top'")
    ids = near.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("samples"))
    total = slim.count()
    rows = topics.sizes(slim).join(keywords, "topic_id").join(ids, "topic_id").withColumn("id", F.col("topic_id").cast("string"))
    scored = catalog.score_rules(rows, total)
    return scored.select("topic_id", "size", "keywords", "samples", "rule_grade", F.col("triggered").cast("long").alias("triggered"))


ORACLE = f"""
WITH {DOCS}, {_tfidf()}, {_keywords()}, n_all AS (SELECT count(*) AS total FROM docs),
vecs AS (SELECT d.doc_id, d.topic_id, CAST(e.embedding AS DOUBLE[]) AS e FROM docs d JOIN embeddings e ON e.vec_id = d.doc_id), {_centroids()},
near AS (SELECT v.topic_id, doc_id, row_number() OVER (PARTITION BY v.topic_id ORDER BY round(list_dot_product(e, c), 9) DESC, doc_id) AS r FROM vecs v JOIN cents USING (topic_id) QUALIFY r <= 5),
rows_ AS (SELECT topic_id, size, floor(total * 0.15) AS largest, (SELECT string_agg(term, ', ' ORDER BY rank) FROM ranked r WHERE r.topic_id = s.topic_id) AS keywords,
  (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY r) FROM near n WHERE n.topic_id = s.topic_id) AS samples FROM sized s, n_all),
facts AS (SELECT *, {_DOMAINS} AS domains, regexp_matches(lower(keywords), '{_BLACK}') AS meta FROM rows_)
SELECT topic_id, size, keywords, samples, CASE WHEN meta THEN 'D-meta' WHEN size > largest THEN 'C' WHEN size < 30 THEN 'D-fragment' WHEN domains >= 4 THEN 'C' END AS rule_grade,
  CAST(size < 30 AS BIGINT) + CAST(size > largest AS BIGINT) + CAST(meta AS BIGINT) + CAST(domains >= 4 OR (domains = 0 AND len(keywords) > 0) AS BIGINT) AS triggered FROM facts
"""
