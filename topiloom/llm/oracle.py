"""DuckDB statements for the corpus queries that SQL can express."""

OP1 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS r
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)
), spans AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, spans WHERE len(w) >= n)
), hits AS (SELECT d.r, d.i, d.n, t.item_id FROM doc_windows d JOIN item_windows t ON d.g = t.g AND d.n = t.n),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

# Sequential breaking of the control strings listed in chat.CONTROL_STRINGS.
_ESCAPED = "replace(coalesce({0}, ''), '\u241b', '\u241b\u241b')"
for _c in ("<|", "|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\u241b-{_c[1:]}')"

OP2 = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(len('<|turn|><|body|><|end|>') + len({_ESCAPED.format('role')}) + len({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""


def _secret_spans(kind: str, rank: int, pattern: str, condition: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, pos, pos + len(m[k]) AS stop FROM (
    SELECT r, m, k, list_sum(list_transform(list_slice(g, 1, k), lambda x: len(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, k - 1), lambda x: len(x))), 0) AS pos
    FROM (SELECT r, g, m, unnest(range(1, len(m) + 1)) AS k FROM (
      SELECT r, regexp_split_to_array(t, '{quoted}') AS g, regexp_extract_all(t, '{quoted}') AS m FROM texts) WHERE len(m) > 0)
  ) WHERE {condition}"""


# The same fixed patterns as in secrets.BASE_RULES and EXTRA_RULES.
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""[A-Za-z]["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$"""  # in SQL quotes

_KEY = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\x20\r\n]*"

OP4 = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
found AS ({_secret_spans('assign', 0, _ASSIGN, f"len(regexp_extract(m[k], '{_VALUE}', 1)) >= 6")}
  UNION ALL {_secret_spans('access', 1, 'AKIA[A-Z0-9]+', 'len(m[k]) >= 20')}
  UNION ALL {_secret_spans('hex', 2, '[0-9a-f]+', 'len(m[k]) >= 24')}
  UNION ALL {_secret_spans('key', 3, _KEY, 'true')}
  UNION ALL {_secret_spans('github', 4, 'gh[pousr]_[A-Za-z0-9]{36,}', 'true')}
  UNION ALL {_secret_spans('slack', 5, 'xox[abprs]-[A-Za-z0-9-]{10,}', 'true')}
  UNION ALL {_secret_spans('jwt', 6, 'eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}', 'true')}),
spans AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY pos, rank) FILTER (rank < 3) AS b,
         string_agg(kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY pos, rank) AS s
  FROM found GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM texts LEFT JOIN spans USING (r)
"""

OP5 = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x != '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM rows_ WHERE len(w) > 0)
), sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
sets AS (SELECT r, n, md5(string_agg(g, chr(10) ORDER BY g)) AS s FROM shingles JOIN sizes USING (r) GROUP BY r, n),
reps AS (SELECT s, min(r) AS rep, any_value(n) AS n FROM sets GROUP BY s),
common AS (
  SELECT a.r AS u, b.r AS v, count(*) AS c
  FROM (SELECT * FROM shingles WHERE r IN (SELECT rep FROM reps)) a JOIN (SELECT * FROM shingles WHERE r IN (SELECT rep FROM reps)) b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2
), links AS (
  SELECT u, v FROM common JOIN reps x ON x.rep = u JOIN reps y ON y.rep = v WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT a, v FROM reach JOIN both_ways ON b = u),
ids AS (SELECT rep, min(doc_id) AS d FROM reps JOIN sets USING (s) JOIN rows_ USING (r) GROUP BY rep),
labels AS (SELECT a, min(d) AS component_id FROM reach JOIN ids ON b = rep GROUP BY a)
SELECT doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       doc_id = coalesce(component_id, doc_id) AS kept
FROM rows_ LEFT JOIN sets USING (r) LEFT JOIN reps USING (s) LEFT JOIN labels ON a = rep
"""

OP8 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), first AS (SELECT h, min(page_id) AS f FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM p JOIN first USING (h)
"""

OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS r, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x != 0)) > 0
), links AS (
  SELECT a.r AS u, b.r AS w FROM usable a JOIN usable b ON a.label = b.label AND a.r != b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (SELECT r AS a, r AS b FROM v UNION SELECT a, w FROM reach JOIN links ON b = u),
labels_ AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON b = r GROUP BY a),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN labels_ ON a = r LEFT JOIN counts ON u = r
"""

ORACLES = {
    "op1_decontaminate": OP1,
    "op2_chat": OP2,
    "op4_secrets": OP4,
    "op5_minhash": OP5,
    "op8_warc": OP8,
    "op9_covertree": OP9,
}
