"""DuckDB statements that give the same rows as the registered queries."""

from __future__ import annotations

from topiloom.functions.lists import BLACKLIST, DOMAINS, STOP_WORDS
from topiloom.plans.queries import CONSENSUS_ROWS, HASHED_DIMS, K_ROWS, PRIOR_ROWS, RESOLUTION_ROWS, SCAN, TIME_BINS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TOKEN = r"[\p{L}\p{N}_]{2,}"

VECS = "vecs AS (SELECT vec_id AS doc_id, label AS topic_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
UNITS = f"{VECS}, units AS (SELECT doc_id, topic_id, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM vecs)"
DOCS = "docs AS (SELECT d.doc_id, d.text, e.label AS topic_id FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"
OUTLIER = "CASE WHEN doc_id % 5 = 0 THEN -1 ELSE topic_id END"
UNEVEN = "CASE WHEN doc_id % 5 = 1 THEN 200 WHEN doc_id % 3 = 0 THEN 100 + doc_id % 7 ELSE topic_id END"


def _centroids(source: str = "vecs", where: str = "true", name: str = "cents") -> str:
    return f"""{name} AS (SELECT topic_id, max(n) AS size, list(m ORDER BY pos) AS c FROM (
      SELECT topic_id, pos, avg(x) AS m, count(*) AS n FROM (SELECT topic_id, unnest(e) AS x, unnest(range(len(e))) AS pos FROM {source} WHERE {where}) GROUP BY 1, 2) GROUP BY 1)"""


UNIT_CENTS = "ucents AS (SELECT topic_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS uc FROM cents)"
SIMS = "sims AS (SELECT a.topic_id AS a, b.topic_id AS b, list_dot_product(a.uc, b.uc) AS similarity FROM ucents a JOIN ucents b ON a.topic_id < b.topic_id)"
CANDIDATES = "candidates AS (SELECT a, b, round(similarity, 6) AS similarity FROM sims WHERE round(similarity, 6) >= 0.0 AND round(similarity, 6) < 0.95 ORDER BY similarity DESC, a DESC, b DESC LIMIT {0})"
BLOCK_SIMS = f"WITH {VECS}, {_centroids()}, {UNIT_CENTS}, {SIMS}"


def _words(stop: bool = True, bigrams: bool = True, source: str = "docs") -> str:
    words = f"regexp_extract_all(lower(text), '{_TOKEN}')"
    if stop:
        words = f"list_filter({words}, lambda w: NOT list_contains({_STOP}, w))"
    terms = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))" if bigrams else "w"
    return f"terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms}) AS term FROM (SELECT doc_id, {words} AS w FROM {source})) GROUP BY 1, 2)"


def _tfidf(source: str = "docs", min_df: int = 2, max_df: float = 0.9, features: int = 5000, stop: bool = True, bigrams: bool = True, sublinear: bool = False) -> str:
    tf = "1 + ln(tf)" if sublinear else "tf"
    return f"""{_words(stop, bigrams, source)}, total AS (SELECT count(*) AS n FROM {source}),
    vocab AS (SELECT term, df FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM terms GROUP BY 1), total WHERE df >= {min_df} AND df <= {max_df} * n ORDER BY total.total DESC, term LIMIT {features}),
    raw AS (SELECT doc_id, term, ({tf}) * (ln((1.0 + n) / (1 + df)) + 1) AS r FROM terms JOIN vocab USING (term), total),
    weights AS (SELECT doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS weight FROM raw)""".replace("ORDER BY total.total", "ORDER BY total")


def _keywords(source: str = "docs", topic: str = "topic_id", top: int = 10, least: int = 1) -> str:
    return f"""sized AS (SELECT {topic} AS topic_id, count(*) AS size FROM {source} GROUP BY 1 HAVING count(*) >= {least}),
    means AS (SELECT d.t AS topic_id, term, round(sum(weight) / any_value(size), 6) AS weight FROM weights JOIN (SELECT doc_id, {topic} AS t FROM {source}) d USING (doc_id) JOIN sized s ON d.t = s.topic_id GROUP BY 1, 2),
    ranked AS (SELECT topic_id, term, weight, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank FROM means QUALIFY rank <= {top})"""


KNN = f"""WITH {UNITS}, knn AS (SELECT a.doc_id AS src, b.doc_id AS dst, list_dot_product(a.u, b.u) AS similarity,
  row_number() OVER (PARTITION BY a.doc_id ORDER BY list_dot_product(a.u, b.u) DESC, b.doc_id) AS r
  FROM units a JOIN units b ON a.doc_id != b.doc_id QUALIFY r <= {{0}}),
edges AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(similarity) AS weight FROM knn WHERE similarity > 0 GROUP BY 1, 2)"""

_NEAREST = """near AS (SELECT doc_id, topic_id AS nearest, s AS similarity FROM (
  SELECT u.doc_id, c.topic_id, list_dot_product(u.u, c.uc) AS s, row_number() OVER (PARTITION BY u.doc_id ORDER BY list_dot_product(u.u, c.uc) DESC, c.topic_id) AS r
  FROM {0} u, ucents c QUALIFY r = 1))"""

_PROBS = f"""WITH {UNITS}, {_centroids()}, {UNIT_CENTS},
  w AS (SELECT doc_id, topic_id, exp(8 * list_dot_product(u.u, c.uc)) AS w FROM units u, (SELECT topic_id AS t, uc FROM ucents) c(topic_id, uc)),
  p AS (SELECT doc_id, topic_id, w / sum(w) OVER (PARTITION BY doc_id) AS p FROM w)""".replace("SELECT doc_id, topic_id, exp", "SELECT doc_id, c.topic_id, exp")
_SOFT = """soft AS (SELECT doc_id, CAST(arg_max(k, (p, -k)) AS INTEGER) AS topic_id, max(p) AS confidence,
  sum(-((p + 1e-10) / t) * ln((p + 1e-10) / t)) AS entropy
  FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY topic_id) - 1 AS k, sum(p + 1e-10) OVER (PARTITION BY doc_id) AS t FROM p) GROUP BY 1)"""

_UDOCS = f"{DOCS}, udocs AS (SELECT doc_id, text, CAST({UNEVEN} AS INTEGER) AS topic_id FROM docs)"
_DOMAINS = " + ".join("CAST((" + " OR ".join(f"contains(lower(keywords), '{s}')" for s in seeds) + ") AS INTEGER)" for seeds in DOMAINS.values())
_BLACK = "|".join(f"(?:{p})" for p in BLACKLIST)
_NODES = f"""WITH {_UDOCS}, {_tfidf("udocs")}, {_keywords("udocs")}, n_all AS (SELECT count(*) AS total FROM docs),
nodes AS (SELECT 'v0_c' || (row_number() OVER (ORDER BY topic_id) - 1) AS id, row_number() OVER (ORDER BY topic_id) - 1 AS place, topic_id, size,
  coalesce((SELECT string_agg(term, ', ' ORDER BY rank) FROM ranked r WHERE r.topic_id = s.topic_id), '') AS keywords FROM sized s),
facts AS (SELECT nodes.*, total, floor(total * 0.15) AS largest, {_DOMAINS} AS domains, regexp_matches(lower(keywords), '{_BLACK}') AS meta FROM nodes, n_all),
graded AS (SELECT *, CASE WHEN meta THEN 'D-meta' WHEN size > largest THEN 'C' WHEN size < 30 THEN 'D-fragment' WHEN domains >= 4 THEN 'C' END AS rule_grade FROM facts),
assessed AS (SELECT *, coalesce(rule_grade, 'B') AS final_grade,
  CASE rule_grade WHEN 'D-meta' THEN 'bin_meta' WHEN 'D-fragment' THEN 'bin_fragment' WHEN 'C' THEN 'split' ELSE 'accept' END AS action,
  CASE WHEN rule_grade IN ('D-meta', 'D-fragment') THEN 'binned' WHEN rule_grade = 'C' THEN 'split' ELSE 'accepted' END AS status,
  CASE WHEN rule_grade IS NULL THEN CASE WHEN len(keywords) > 0 THEN substr(trim(string_split(keywords, ',')[1]), 1, 20) ELSE 'unknown' END END AS llm_name
  FROM graded)"""

_TREE = f"""WITH RECURSIVE {VECS}, n_all AS (SELECT count(*) AS total FROM vecs), v AS (SELECT topic_id AS t, doc_id % 3 AS m, doc_id % 2 AS h FROM vecs),
nodes AS (
  SELECT 'v0_c' || t AS id, 0 AS r, t AS k, CASE WHEN t = 4 THEN 'v0_c1' END AS parent, CASE WHEN t = 4 THEN 1 ELSE 0 END AS depth, count(*) AS size, 'k' || t AS keywords, NULL AS rule_grade,
    CASE WHEN t % 3 = 0 THEN 'C' WHEN t % 3 = 1 THEN 'B' WHEN t = 2 THEN 'D-meta' WHEN t = 5 THEN 'D-fragment' ELSE 'D' END AS final_grade,
    CASE WHEN t % 3 = 0 THEN 'split_done' WHEN t % 3 = 1 THEN 'accept' WHEN t = 2 THEN 'bin_meta' WHEN t = 5 THEN 'bin_fragment' ELSE 'reject' END AS action,
    CASE t % 3 WHEN 0 THEN 'split' WHEN 1 THEN 'accepted' ELSE 'binned' END AS status FROM v GROUP BY t
  UNION ALL SELECT 'v1_c' || (t * 3 + m), 1, t * 3 + m, 'v0_c' || t, 1, count(*), 'k' || t || ', w' || m, CASE WHEN m = 2 AND t = 0 THEN 'D-meta' END,
    CASE WHEN m = 0 THEN 'C' WHEN m = 1 THEN 'A' WHEN t != 0 THEN 'B' END, CASE WHEN m = 0 THEN 'split_done' WHEN m = 1 OR t != 0 THEN 'accept' END,
    CASE WHEN m = 0 THEN 'split' WHEN m = 2 AND t = 0 THEN 'pending' ELSE 'accepted' END FROM v WHERE t % 3 = 0 GROUP BY t, m
  UNION ALL SELECT 'v2_c' || (t * 2 + h), 2, t * 2 + h, 'v1_c' || (t * 3), 2, count(*), '', NULL, 'B', 'accept', 'accepted' FROM v WHERE t % 3 = 0 AND m = 0 GROUP BY t, h),
named AS (SELECT *, CASE WHEN status = 'accepted' THEN 'topic ' || id END AS llm_name FROM nodes),
leaves AS (SELECT * FROM named WHERE status != 'binned' AND id NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)),
made AS (SELECT * FROM leaves WHERE status = 'accepted'), gone AS (SELECT * FROM named WHERE status = 'binned')"""

_LABELLINGS = f"""WITH {UNITS}, {_centroids()}, {UNIT_CENTS}, {_NEAREST.format("units")},
labels AS (SELECT v.doc_id, v.topic_id AS l1, CAST(v.doc_id % 7 AS INTEGER) AS l2, nearest AS l3, CAST(v.doc_id % 11 AS INTEGER) AS c FROM vecs v JOIN near USING (doc_id))"""
_MODES = """mode1 AS (SELECT c, l1 FROM (SELECT c, l1, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, min(doc_id)) AS r FROM labels GROUP BY 1, 2) WHERE r = 1),
mode2 AS (SELECT c, l2 FROM (SELECT c, l2, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, min(doc_id)) AS r FROM labels GROUP BY 1, 2) WHERE r = 1),
mapping AS (SELECT max(c) AS c, l1, l2, min(c) AS inserted FROM mode1 JOIN mode2 USING (c) GROUP BY l1, l2)"""

_VALUES = lambda rows: ", ".join("(" + ", ".join(f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)

_REPLIES = [
    '{"name_zh":"x","grade":"A","action":"keep"}',
    '```json\n{"grade":"C"}\n```',
    'Sure: {"grade":"D"} done',
    '{"grade":"A/B"}',
    '{"name_zh":"y"}',
    "no json",
    "{bad}",
]

HASHED = f"""WITH {DOCS}, words AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS w FROM docs)),
sums AS (SELECT doc_id, h % {HASHED_DIMS} AS d, sum(CASE WHEN (h // {HASHED_DIMS}) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM words GROUP BY 1, 2),
hashed AS (SELECT doc_id, d, CAST(v AS DOUBLE) / greatest(sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 1e-12) AS x FROM sums)"""

ORACLES: dict[str, str] = {
    "topic_sizes": f"WITH {VECS} SELECT topic_id, count(*) AS size FROM vecs WHERE topic_id >= 0 GROUP BY 1",
    "size_stats": f"WITH {VECS}, s AS (SELECT count(*) AS size FROM vecs GROUP BY topic_id) SELECT count(*) AS n_topics, min(size) AS min_size, max(size) AS max_size, median(size) AS median_size FROM s",
    "topic_coverage": f"""WITH {VECS}, o AS (SELECT {OUTLIER} AS t FROM vecs)
      SELECT count(*) AS n_docs, count(DISTINCT t) FILTER (t != -1) AS n_topics, round(avg(CASE WHEN t != -1 THEN 1.0 ELSE 0 END), 6) AS coverage, round(1 - avg(CASE WHEN t != -1 THEN 1.0 ELSE 0 END), 6) AS outlier_rate FROM o""",
    "size_rank_series": f"""WITH {VECS}, s AS (SELECT CAST({UNEVEN} AS INTEGER) AS t, count(*) AS size FROM vecs GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY size DESC, t) AS rank, size FROM s)
      SELECT rank, size, round(log10(rank), 6) AS log_rank, round(log10(size), 6) AS log_size FROM r""",
    "clean_sample": """WITH s AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL ORDER BY md5('42:' || doc_id), doc_id LIMIT 200)
      SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, substr(text, 1, 80) AS head FROM s""",
    "named_topics": f"""WITH {VECS}, o AS (SELECT {OUTLIER} AS t FROM vecs)
      SELECT CASE WHEN t >= 0 AND t % 2 = 0 THEN 'topic ' || t ELSE 'Outlier' END AS topic_name, count(*) AS n FROM o GROUP BY 1""",
    "parsed_dates": "SELECT CASE WHEN event_id % 10 != 0 THEN CAST(ts AS DATE) END AS day, count(*) AS n FROM events GROUP BY 1",
    "token_counts": f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{_TOKEN}') AS w FROM documents) SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM t",
    "bigram_counts": f"WITH {_words(source='documents')} SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM terms WHERE contains(term, ' ') GROUP BY 1 ORDER BY n DESC, term LIMIT 50",
    "content_words": f"""WITH t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: len(w) >= 3 AND NOT list_contains({_STOP}, w)) AS w FROM documents)
      SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM t""",
    "tfidf_terms": f"WITH {DOCS}, {_tfidf()}, r AS (SELECT doc_id, term, round(weight, 6) AS weight FROM weights) SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM r QUALIFY rank <= 5",
    "tfidf_sublinear": f"WITH {DOCS}, {_tfidf(min_df=3, max_df=0.85, features=3000, stop=False, bigrams=False, sublinear=True)} SELECT doc_id, count(*) AS n_terms, round(max(weight), 6) AS max_weight FROM weights GROUP BY 1",
    "topic_keywords": f"WITH {DOCS}, {_tfidf()}, {_keywords()} SELECT topic_id, term, weight, rank FROM ranked",
    "tfidf_coherence": f"""WITH docs0 AS (SELECT d.doc_id, d.text, e.label AS topic_id FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id), docs AS (SELECT * FROM docs0 WHERE doc_id % 5 != 0),
      {_tfidf(max_df=1.0, features=1000, bigrams=False)}, {_keywords(least=5)} SELECT round(coalesce(avg(c), 0), 6) AS tfidf_coherence FROM (SELECT avg(weight) AS c FROM ranked GROUP BY topic_id)""",
    "class_tfidf": f"""WITH {DOCS}, {_words()}, t AS (SELECT topic_id, term, sum(tf) AS tf FROM terms JOIN docs USING (doc_id) GROUP BY 1, 2), per AS (SELECT topic_id, sum(tf) AS words FROM t GROUP BY 1),
      f AS (SELECT term, sum(tf) AS f FROM t GROUP BY 1), a AS (SELECT avg(words) AS a FROM per), s AS (SELECT topic_id, term, round(tf / words * ln(1 + a / f), 6) AS weight FROM t JOIN f USING (term) JOIN per USING (topic_id), a)
      SELECT topic_id, term, weight, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank FROM s QUALIFY rank <= 10""",
    "judge_parse": f"""WITH r AS (SELECT conv_id, turn, [{", ".join("'" + x.replace("'", "''") + "'" for x in _REPLIES)}][conv_id % 7 + 1] AS reply FROM conversations),
      t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim(reply), '^```(?:json)?\\s*', ''), '\\s*```$', ''), ' \n') AS t FROM r),
      b AS (SELECT conv_id, turn, CASE WHEN json_valid(t) AND t LIKE '{{%' THEN t WHEN json_valid(nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '')) THEN regexp_extract(t, '(?s)\\{{.*\\}}') END AS b FROM t),
      g AS (SELECT conv_id, turn, b, json_extract_string(b, '$.grade') AS raw FROM b)
      SELECT conv_id, turn, coalesce(json_extract_string(b, '$.name_zh'), '') AS name, CASE WHEN regexp_full_match(raw, '[ABCD]') THEN raw ELSE 'B' END AS grade,
        coalesce(json_extract_string(b, '$.action'), 'keep') AS action, CASE WHEN NOT coalesce(regexp_full_match(raw, '[ABCD]'), false) THEN raw END AS grade_raw, b IS NULL AS failed FROM g""",
    "topic_centroids": f"WITH {VECS}, {_centroids()} SELECT topic_id, size, pos, round(x, 6) AS x FROM (SELECT topic_id, size, unnest(c) AS x, unnest(range(len(c))) AS pos FROM cents)",
    "centroid_sims": f"{BLOCK_SIMS} SELECT a, b, round(similarity, 6) AS similarity FROM sims",
    "nearest_centroid": f"WITH {UNITS}, {_centroids()}, {UNIT_CENTS}, {_NEAREST.format('units')} SELECT doc_id, nearest, round(similarity, 6) AS similarity FROM near",
    "knn_edges": KNN.format(20) + " SELECT src, dst, round(similarity, 6) AS similarity FROM knn",
    "knn_graph": KNN.format(20) + " SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "label_modularity": KNN.format(20)
    + """, named AS (SELECT a.topic_id AS ca, b.topic_id AS cb, weight FROM edges JOIN vecs a ON a.doc_id = src JOIN vecs b ON b.doc_id = dst),
      w AS (SELECT sum(CASE WHEN ca = cb THEN weight ELSE 0 END) AS w_in, sum(weight) AS m FROM named),
      k AS (SELECT sum(k * k) AS k2 FROM (SELECT sum(weight) AS k FROM (SELECT ca AS c, weight FROM named UNION ALL SELECT cb, weight FROM named) GROUP BY c))
      SELECT round(2 * w_in - k2 / (2 * m), 6) AS rb_quality, round((2 * w_in - k2 / (2 * m)) / (2 * m), 6) AS modularity FROM w, k""",
    "median_pair_dist": f"""WITH {UNITS}, picked AS (SELECT doc_id, u FROM units ORDER BY md5('42:' || doc_id), doc_id LIMIT 4000), r AS (SELECT u, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM picked), n AS (SELECT count(*) AS n FROM r),
      d AS (SELECT CAST('0x' || substr(md5('42:a:' || id), 1, 8) AS BIGINT) % n AS a, CAST('0x' || substr(md5('42:b:' || id), 1, 8) AS BIGINT) % n AS b, n FROM range(2000) t(id), n),
      p AS (SELECT a, CASE WHEN a = b THEN (b + 1) % n ELSE b END AS b FROM d)
      SELECT round(median(1 - least(1.0, greatest(-1.0, list_dot_product(x.u, y.u)))), 6) AS median_dist FROM p JOIN r x ON x.i = a JOIN r y ON y.i = b""",
    "mean_pairwise_dist": f"""WITH {UNITS}, s AS (SELECT topic_id, pos, sum(x) AS s, count(*) AS n FROM (SELECT topic_id, unnest(u) AS x, unnest(range(len(u))) AS pos FROM units) GROUP BY 1, 2),
      t AS (SELECT topic_id, max(n) AS size, sum(s * s) AS q FROM s GROUP BY 1)
      SELECT topic_id, size, CASE WHEN size > 1 THEN round((CAST(size AS DOUBLE) * size - q) / (CAST(size AS DOUBLE) * (size - 1)), 6) END AS mean_pairwise_dist FROM t""",
    "topic_samples": f"""WITH {VECS}, {_centroids()}, s AS (SELECT v.topic_id, doc_id, round(list_dot_product(e, c), 9) AS score FROM vecs v JOIN cents USING (topic_id)),
      near AS (SELECT *, 'top' AS kind, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5),
      far AS (SELECT topic_id, doc_id, score, 'boundary' AS kind, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score, doc_id DESC) AS b FROM s QUALIFY b <= 3))
      SELECT topic_id, kind, rank, doc_id, round(score, 6) AS score FROM near UNION ALL SELECT topic_id, kind, rank, doc_id, round(score, 6) FROM far""",
    "reassign_outliers": f"""WITH {UNITS}, {_centroids(where='doc_id % 5 != 0')}, {UNIT_CENTS}, out_ AS (SELECT * FROM units WHERE doc_id % 5 = 0), {_NEAREST.format('out_')}
      SELECT doc_id, {OUTLIER} AS topic_id, CASE WHEN similarity > 0.15 THEN nearest ELSE {OUTLIER} END AS new_topic_id FROM vecs LEFT JOIN near USING (doc_id)""",
    "reassign_scan": f"""WITH {UNITS}, {_centroids(where='doc_id % 5 != 0')}, {UNIT_CENTS}, out_ AS (SELECT * FROM units WHERE doc_id % 5 = 0), {_NEAREST.format('out_')},
      t AS (SELECT unnest([{", ".join(f"CAST({x} AS DOUBLE)" for x in SCAN)}]) AS threshold)
      SELECT threshold, count(*) FILTER (similarity >= threshold) AS reassigned, count(*) FILTER (similarity < threshold) AS remaining FROM near, t GROUP BY 1""",
    "dissolve_tiny": f"""WITH {VECS}, c AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1000 + doc_id // 16 ELSE topic_id * 3 END AS t FROM vecs),
      k AS (SELECT t, dense_rank() OVER (ORDER BY t) - 1 AS d FROM (SELECT t FROM c GROUP BY t HAVING count(*) >= 5))
      SELECT doc_id, CAST(coalesce(d, -1) AS INTEGER) AS topic_id FROM c LEFT JOIN k USING (t)""",
    "merge_candidates": f"{BLOCK_SIMS}, {CANDIDATES.format(30)} SELECT a, b, similarity FROM candidates",
    "merge_components": BLOCK_SIMS.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {CANDIDATES.format(4)}, links AS (SELECT a AS u, b AS v FROM candidates UNION ALL SELECT b, a FROM candidates), topics AS (SELECT DISTINCT topic_id AS t FROM vecs),
      reach AS (SELECT t AS x, t AS y FROM topics UNION SELECT x, v FROM reach JOIN links ON y = u), roots AS (SELECT x, min(y) AS root, count(*) AS n FROM reach GROUP BY x)
      SELECT x AS old_topic, CAST(dense_rank() OVER (ORDER BY CASE WHEN n > 1 THEN 0 ELSE 1 END, root) - 1 AS INTEGER) AS new_topic FROM roots""",
    "merged_sizes": BLOCK_SIMS.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {CANDIDATES.format(4)}, links AS (SELECT a AS u, b AS v FROM candidates UNION ALL SELECT b, a FROM candidates), topics AS (SELECT DISTINCT topic_id AS t FROM vecs),
      reach AS (SELECT t AS x, t AS y FROM topics UNION SELECT x, v FROM reach JOIN links ON y = u), roots AS (SELECT x, min(y) AS root, count(*) AS n FROM reach GROUP BY x),
      m AS (SELECT x, CAST(dense_rank() OVER (ORDER BY CASE WHEN n > 1 THEN 0 ELSE 1 END, root) - 1 AS INTEGER) AS new_topic FROM roots)
      SELECT new_topic, count(*) AS size FROM vecs JOIN m ON topic_id = x GROUP BY 1""",
    "neighbor_concat": f"""WITH {DOCS}, {VECS}, units AS (SELECT doc_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM vecs WHERE doc_id IN (SELECT doc_id FROM docs)),
      knn AS (SELECT a.doc_id AS src, b.doc_id AS dst, list_dot_product(a.u, b.u) AS s, row_number() OVER (PARTITION BY a.doc_id ORDER BY list_dot_product(a.u, b.u) DESC, b.doc_id) AS r FROM units a JOIN units b ON a.doc_id != b.doc_id QUALIFY r <= 3),
      n AS (SELECT src, string_agg(text, ' | ' ORDER BY r) AS t FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM knn WHERE s > 0.3 QUALIFY r < 3) JOIN docs ON dst = doc_id GROUP BY 1),
      o AS (SELECT doc_id, text || coalesce(' | ' || t, '') AS x FROM docs LEFT JOIN n ON src = doc_id)
      SELECT doc_id, len(x) AS n_chars, md5(x) AS text_md5 FROM o""",
    "topics_over_time": """WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)
      SELECT event_type AS topic, least((epoch_us(ts) - lo) * 30 // greatest(hi - lo, 1), 29) AS bin, count(*) AS n FROM events, b WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "topics_over_time_top": """WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), t AS (SELECT event_type AS k FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
      SELECT event_type AS topic, least((epoch_us(ts) - lo) * 30 // greatest(hi - lo, 1), 29) AS bin, count(*) AS n FROM events, b WHERE ts IS NOT NULL AND event_type IN (SELECT k FROM t) GROUP BY 1, 2""",
    "soft_assignment": f"{_PROBS}, {_SOFT} SELECT doc_id, topic_id, round(confidence, 6) AS confidence, round(entropy, 6) AS entropy, CASE WHEN confidence < 0.3 THEN 'outlier' WHEN confidence < 0.5 THEN 'fuzzy' ELSE 'high' END AS band FROM soft",
    "confidence_histogram": f"""{_PROBS}, {_SOFT}, c AS (SELECT round(confidence, 5) AS x FROM soft), b AS (SELECT min(x) AS lo, max(x) AS hi FROM c)
      SELECT CAST(least(floor((x - lo) / greatest(hi - lo, 1e-12) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM c, b GROUP BY 1""",
    "resolution_choice": f"""WITH s(resolution, modularity, n_topics) AS (VALUES {_VALUES(RESOLUTION_ROWS)}), u AS (SELECT *, modularity >= 0.3 AND n_topics BETWEEN 30 AND 150 AS ok, 0.6 * modularity + 0.4 * greatest(0, 1 - abs(n_topics - 80) / 100) AS score FROM s)
      SELECT resolution, modularity, n_topics FROM u ORDER BY CASE WHEN (SELECT bool_or(ok) FROM u) THEN CASE WHEN ok THEN score END ELSE modularity END DESC NULLS LAST, resolution LIMIT 1""",
    "prior_choice": f"""WITH s(prior, silhouette, confidence, entropy, n_topics) AS (VALUES {_VALUES(PRIOR_ROWS)})
      SELECT *, round(0.3 * silhouette + 0.3 * confidence + 0.2 * greatest(0, 1 - abs(n_topics - 60) / 80) + 0.2 * greatest(0, 1 - entropy / 5), 6) AS score FROM s WHERE silhouette >= -0.05 AND n_topics BETWEEN 20 AND 150 ORDER BY score DESC, prior LIMIT 1""",
    "k_choice": f"""WITH s(k, sil, db, ch) AS (VALUES {_VALUES(K_ROWS)}), w AS (SELECT (SELECT k FROM s ORDER BY sil DESC, k LIMIT 1) AS a, (SELECT k FROM s ORDER BY db, k LIMIT 1) AS b, (SELECT k FROM s ORDER BY ch DESC, k LIMIT 1) AS c)
      SELECT list_sort([a, b, c])[2] AS k FROM w""",
    "consensus_choice": f"""WITH s(n_clusters, sil, med) AS (VALUES {_VALUES(CONSENSUS_ROWS)})
      SELECT 'max_silhouette' AS criterion, (SELECT n_clusters FROM s ORDER BY sil DESC, n_clusters LIMIT 1) AS n_clusters UNION ALL
      SELECT 'min_abs_silhouette', (SELECT n_clusters FROM s ORDER BY abs(sil), n_clusters LIMIT 1) UNION ALL SELECT 'median_size', (SELECT n_clusters FROM s ORDER BY abs(med - 800), n_clusters LIMIT 1)""",
    "agreed_merges": f"{BLOCK_SIMS}, {CANDIDATES.format(30)} SELECT a, b FROM candidates WHERE (a + b) % 3 = 0",
    "silhouette_cosine": f"""WITH {UNITS}, d AS (SELECT a.doc_id, a.topic_id AS own, b.topic_id AS other, sum(1 - list_dot_product(a.u, b.u)) / count(*) AS m FROM units a JOIN units b ON a.doc_id != b.doc_id GROUP BY 1, 2, 3),
      s AS (SELECT doc_id, max(m) FILTER (own = other) AS a, min(m) FILTER (own != other) AS b FROM d GROUP BY 1) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s""",
    "silhouette_euclid": f"""WITH {UNITS}, d AS (SELECT a.doc_id, a.topic_id AS own, b.topic_id AS other, sum(list_distance(a.e, b.e)) / count(*) AS m FROM units a JOIN units b ON a.doc_id != b.doc_id GROUP BY 1, 2, 3),
      s AS (SELECT doc_id, max(m) FILTER (own = other) AS a, min(m) FILTER (own != other) AS b FROM d GROUP BY 1) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s""",
    "calinski_harabasz": f"""WITH {VECS}, {_centroids()}, one AS (SELECT doc_id, 0 AS topic_id, e FROM vecs), {_centroids('one', name='overall')},
      w AS (SELECT sum(list_distance(e, c) ** 2) AS ssw FROM vecs JOIN cents USING (topic_id)), b AS (SELECT sum(x.size * list_distance(x.c, y.c) ** 2) AS ssb, count(*) AS k, max(y.size) AS n FROM cents x, overall y)
      SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS calinski_harabasz FROM w, b""",
    "davies_bouldin": f"""WITH {VECS}, {_centroids()}, s AS (SELECT topic_id, avg(list_distance(e, c)) AS s, any_value(c) AS c FROM vecs JOIN cents USING (topic_id) GROUP BY 1),
      r AS (SELECT x.topic_id, max((x.s + y.s) / list_distance(x.c, y.c)) AS r FROM s x JOIN s y ON x.topic_id != y.topic_id GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r""",
    "rule_scores": f"""{_NODES} SELECT id, size, keywords, rule_grade,
      CAST(size < 30 AS BIGINT) + CAST(size > largest AS BIGINT) + CAST(meta AS BIGINT) + CAST(domains >= 4 OR (domains = 0 AND len(keywords) > 0) AS BIGINT) AS triggered,
      concat_ws('; ', CASE WHEN size < 30 THEN 'R1_' || id || ': size=' || size || ' < 30' END, CASE WHEN size > largest THEN 'R2_' || id || ': size=' || size || ' > ' || CAST(largest AS BIGINT) || ' (15%)' END,
        CASE WHEN meta THEN 'R3_' || id || ': blacklist match in keywords' END,
        CASE WHEN domains >= 4 THEN 'R4_' || id || ': domains=' || domains || ', suggests mixed bag' WHEN domains = 0 AND len(keywords) > 0 THEN 'R4_' || id || ': domains=0, unusual keywords' END) AS signals FROM graded""",
    "assess_nodes": f"""{_NODES} SELECT id, size, rule_grade, CASE WHEN rule_grade IS NULL THEN 'B' END AS llm_grade, llm_name, CASE WHEN rule_grade IS NULL THEN 'keep' END AS llm_action, final_grade, action, status FROM assessed""",
    "stop_flags": f"""{_NODES}, f AS (SELECT any_value(total) AS total, count(*) FILTER (status = 'accepted') AS n, coalesce(max(size) FILTER (status = 'accepted'), 0) AS big, coalesce(min(size) FILTER (status = 'accepted'), 0) AS small, coalesce(sum(size) FILTER (status = 'binned'), 0) AS binned FROM assessed),
      g AS (SELECT n > 0 AS all_named, big < total * 0.15 AS max_topic_ok, small >= 15 AS min_size_ok, binned < total * 0.10 AS cd_ratio_ok, true AS meta_clean, true AS no_pending, small AS min_size_shallow_min, CAST(0 AS BIGINT) AS deep_under_10 FROM f)
      SELECT *, all_named AND max_topic_ok AND min_size_ok AND cd_ratio_ok AS all_pass FROM g""",
    "catalog_rows": f"{_NODES} SELECT row_number() OVER (ORDER BY place) AS topic_id, coalesce(llm_name, '') AS topic_name, final_grade AS grade, size, 0 AS depth, keywords, action FROM assessed WHERE status = 'accepted'",
    "catalog_buckets": f"{_NODES} SELECT CASE action WHEN 'bin_meta' THEN 'meta' ELSE 'residual' END AS bucket, id AS source_id, size, keywords FROM assessed WHERE status = 'binned'",
    "catalog_summary": f"""{_NODES}, s AS (SELECT any_value(total) AS total_headlines, count(*) FILTER (status = 'accepted') AS accepted_topics, CAST(coalesce(sum(size) FILTER (status = 'accepted'), 0) AS BIGINT) AS accepted_headlines,
        CAST(coalesce(sum(size) FILTER (status = 'binned'), 0) AS BIGINT) AS binned_headlines, count(*) FILTER (action = 'bin_meta') AS meta_items, count(*) FILTER (action = 'bin_fragment') AS residual_items FROM assessed)
      SELECT total_headlines, accepted_topics, accepted_headlines, round(accepted_headlines / total_headlines * 100, 1) AS accepted_pct, binned_headlines, round(binned_headlines / total_headlines * 100, 1) AS binned_pct,
        total_headlines - accepted_headlines - binned_headlines AS unaccounted, meta_items, residual_items FROM s""",
    "tree_edges": f"{_NODES} SELECT CAST(NULL AS VARCHAR) AS parent, id, coalesce(llm_name, substr(keywords, 1, 30)) AS name, size, 0 AS depth, status FROM assessed WHERE status IN ('accepted', 'split')",
    "head_rows": "SELECT doc_id, substr(text, 1, 80) AS head FROM documents ORDER BY doc_id LIMIT 50",
    "merged_keywords": BLOCK_SIMS.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {CANDIDATES.format(4)}, links AS (SELECT a AS u, b AS v FROM candidates UNION ALL SELECT b, a FROM candidates), topics AS (SELECT DISTINCT topic_id AS t FROM vecs),
      reach AS (SELECT t AS x, t AS y FROM topics UNION SELECT x, v FROM reach JOIN links ON y = u), roots AS (SELECT x, min(y) AS root, count(*) AS n FROM reach GROUP BY x),
      m AS (SELECT x, CAST(dense_rank() OVER (ORDER BY CASE WHEN n > 1 THEN 0 ELSE 1 END, root) - 1 AS INTEGER) AS new_topic FROM roots),
      {DOCS}, mdocs AS (SELECT doc_id, new_topic AS topic_id FROM docs JOIN m ON topic_id = x), {_tfidf()}, {_keywords("mdocs", top=8)} SELECT topic_id, term, weight, rank FROM ranked""",
    "keywords_over_time": f"""WITH docs AS (SELECT d.doc_id, d.text, e.label AS topic_id, epoch_us(v.ts) AS us FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id JOIN events v ON v.event_id = d.doc_id),
      span AS (SELECT min(us) AS lo, max(us) AS hi FROM docs), placed AS (SELECT doc_id, topic_id, least((us - lo) * {TIME_BINS} // greatest(hi - lo, 1), {TIME_BINS - 1}) AS bin FROM docs, span WHERE us IS NOT NULL),
      {_words()}, t AS (SELECT topic_id, bin, term, sum(tf) AS tf FROM terms JOIN placed USING (doc_id) GROUP BY 1, 2, 3), per AS (SELECT topic_id, bin, sum(tf) AS words FROM t GROUP BY 1, 2),
      f AS (SELECT bin, term, sum(tf) AS f FROM t GROUP BY 1, 2), a AS (SELECT bin, avg(words) AS a FROM per GROUP BY 1),
      s AS (SELECT topic_id, bin, term, round(tf / words * ln(1 + a / f), 6) AS weight FROM t JOIN f USING (bin, term) JOIN per USING (topic_id, bin) JOIN a USING (bin))
      SELECT topic_id, CAST(bin AS BIGINT) AS bin, term, weight, row_number() OVER (PARTITION BY topic_id, bin ORDER BY weight DESC, term) AS rank FROM s QUALIFY rank <= 5""",
    "mean_confidence": f"{_PROBS}, {_SOFT} SELECT round(avg(confidence), 6) AS mean_confidence, round(avg(entropy), 6) AS mean_entropy, round(avg(CASE WHEN confidence >= 0.5 THEN 1.0 ELSE 0 END), 6) AS high_share FROM soft",
    "silhouette_sample": f"""WITH {VECS}, picked AS (SELECT * FROM vecs WHERE topic_id != -1 ORDER BY md5('42:' || doc_id), doc_id LIMIT 200),
      d AS (SELECT a.doc_id, a.topic_id AS own, b.topic_id AS other, sum(list_distance(a.e, b.e)) / count(*) AS m FROM picked a JOIN picked b ON a.doc_id != b.doc_id GROUP BY 1, 2, 3),
      s AS (SELECT doc_id, max(m) FILTER (own = other) AS a, min(m) FILTER (own != other) AS b FROM d GROUP BY 1) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s""",
    "assess_deep": f"""{_NODES}, d AS (SELECT *, CAST(place % 3 AS INTEGER) AS depth, place % 3 = 2 AS deep FROM assessed)
      SELECT id, depth, CASE WHEN NOT deep THEN rule_grade END AS rule_grade, CASE WHEN deep OR rule_grade IS NULL THEN 'B' END AS llm_grade,
        CASE WHEN deep THEN CASE WHEN len(keywords) > 0 THEN array_to_string(list_slice(string_split(keywords, ', '), 1, 3), '、') ELSE '杂项' END ELSE llm_name END AS llm_name,
        CASE WHEN NOT deep AND rule_grade IS NULL THEN 'keep' END AS llm_action, CASE WHEN deep THEN 'B' ELSE final_grade END AS final_grade, CASE WHEN deep THEN 'accept' ELSE action END AS action, CASE WHEN deep THEN 'accepted' ELSE status END AS status FROM d""",
    "tree_stop_flags": f"""{_TREE}, f AS (SELECT any_value(total) AS total, count(*) FILTER (status = 'accepted') AS n, count(*) FILTER (status = 'accepted' AND final_grade IN ('A', 'B')) AS good, coalesce(max(size) FILTER (status = 'accepted'), 0) AS big,
        coalesce(min(size) FILTER (status = 'accepted' AND depth < 2), 0) AS small, count(*) FILTER (status = 'accepted' AND depth >= 2 AND size < 10) AS deep, coalesce(sum(size) FILTER (status = 'binned'), 0) AS binned,
        count(*) FILTER (status = 'pending' AND rule_grade = 'D-meta') AS meta, count(*) FILTER (status = 'pending') AS pending FROM named, n_all),
      g AS (SELECT n > 0 AND good = n AS all_named, big < total * 0.15 AS max_topic_ok, small >= 15 AS min_size_ok, binned < total * 0.10 AS cd_ratio_ok, meta = 0 AS meta_clean, pending = 0 AS no_pending, small AS min_size_shallow_min, deep AS deep_under_10 FROM f)
      SELECT *, all_named AND max_topic_ok AND min_size_ok AND cd_ratio_ok AND meta_clean AND no_pending AS all_pass FROM g""",
    "tree_catalog": f"{_TREE} SELECT row_number() OVER (ORDER BY r, k) AS topic_id, coalesce(llm_name, '') AS topic_name, coalesce(final_grade, '') AS grade, size, depth, keywords, action FROM made",
    "tree_buckets": f"{_TREE} SELECT CASE WHEN action = 'bin_meta' THEN 'meta' WHEN action = 'bin_fragment' THEN 'residual' ELSE 'rejected' END AS bucket, id AS source_id, size, keywords FROM gone",
    "tree_summary": f"""{_TREE}, a AS (SELECT count(*) AS accepted_topics, CAST(coalesce(sum(size), 0) AS BIGINT) AS accepted_headlines FROM made),
      b AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS binned_headlines, count(*) FILTER (action = 'bin_meta') AS meta_items, count(*) FILTER (action = 'bin_fragment') AS residual_items FROM gone)
      SELECT total AS total_headlines, accepted_topics, accepted_headlines, round(accepted_headlines / total * 100, 1) AS accepted_pct, binned_headlines, round(binned_headlines / total * 100, 1) AS binned_pct,
        total - accepted_headlines - binned_headlines AS unaccounted, meta_items, residual_items FROM a, b, n_all""",
    "tree_levels": f"""{_TREE}, own AS (SELECT parent, id, coalesce(llm_name, substr(keywords, 1, 30)) AS name, size, depth, status FROM named),
      tree AS (SELECT * FROM own WHERE parent IS NULL AND status IN ('accepted', 'split') UNION ALL SELECT own.* FROM own JOIN tree ON own.parent = tree.id) SELECT * FROM tree""",
    "leaf_nodes": f"{_TREE} SELECT id, depth, size, status FROM leaves",
    "round_nodes": f"{_TREE} SELECT id, parent, depth, size, status FROM named WHERE starts_with(id, 'v1_')",
    "nodes_by_status": f"{_TREE} SELECT status, depth, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM named WHERE status IN ('pending', 'accepted') GROUP BY 1, 2",
    "consensus_silhouette": f"""{_LABELLINGS}, t AS (SELECT l1, l2, l3, count(*) AS n, min(doc_id) AS f FROM labels GROUP BY 1, 2, 3),
      d AS (SELECT x.f, x.n, x.l1 AS own, y.l1 AS other, sum(y.n * (1 - (CAST(x.l1 = y.l1 AS INTEGER) + CAST(x.l2 = y.l2 AS INTEGER) + CAST(x.l3 = y.l3 AS INTEGER)) / 3)) AS s, sum(y.n) AS m FROM t x, t y GROUP BY 1, 2, 3, 4),
      s AS (SELECT f, n, max(s / (m - 1)) FILTER (own = other AND m > 1) AS a, min(s / m) FILTER (own != other) AS b FROM d GROUP BY 1, 2)
      SELECT round(sum(coalesce((b - a) / nullif(greatest(a, b), 0), 0) * n) / sum(n), 6) AS silhouette FROM s""",
    "hashed_vectors": f"{HASHED} SELECT doc_id, d AS pos, round(x, 6) AS x FROM hashed WHERE round(x, 6) != 0",
    "fused_vectors": f"""{HASHED}, {VECS}, parts AS (SELECT doc_id, d + 65 AS place, x FROM hashed UNION ALL SELECT doc_id, unnest(range(1, len(e) + 1)) AS place, unnest(e) AS x FROM vecs WHERE doc_id IN (SELECT doc_id FROM hashed))
      SELECT doc_id, CAST(64 + {HASHED_DIMS} AS BIGINT) AS dims, round(sum(x * place), 5) AS weighted_sum FROM parts GROUP BY 1""",
    "coassoc_tuples": f"""{_LABELLINGS}, t AS (SELECT l1, l2, l3, count(*) AS n, min(doc_id) AS f FROM labels GROUP BY 1, 2, 3),
      p AS (SELECT x.f AS a, y.f AS b, x.n, y.n AS n_b, (CAST(x.l1 = y.l1 AS INTEGER) + CAST(x.l2 = y.l2 AS INTEGER) + CAST(x.l3 = y.l3 AS INTEGER)) AS k FROM t x JOIN t y ON x.f < y.f)
      SELECT a, b, n, n_b, round(k / 3, 6) AS agreement FROM p WHERE k > 0""",
    "consensus_modes": f"{_LABELLINGS}, {_MODES} SELECT c, l1, l2, inserted FROM mapping",
    "consensus_labels": f"""{_LABELLINGS}, {_MODES}, best AS (SELECT t.l1, t.l2, arg_min(m.c, (CAST(t.l1 != m.l1 AS INTEGER) + CAST(t.l2 != m.l2 AS INTEGER), m.inserted, m.c)) AS c FROM (SELECT DISTINCT l1, l2 FROM labels) t, mapping m GROUP BY 1, 2)
      SELECT doc_id, best.c AS consensus FROM labels JOIN best USING (l1, l2)""",
}
