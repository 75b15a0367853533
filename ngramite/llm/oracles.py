"""DuckDB SQL for the numbered queries that SQL can express."""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(15 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0:' || md5(coalesce(text, ''))) AS key FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][nth % 3 + 1] AS weight, [0.5::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE][nth % 3 + 1] AS slope,
    CAST(source_size AS DOUBLE) * 2 AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM per
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM weighed
), targets AS (
  SELECT *, CASE WHEN max(CASE WHEN lv * weight <= cap THEN lv END) OVER () IS NULL THEN cap
    ELSE least(max(CASE WHEN lv * weight <= cap THEN lv END) OVER () * weight, cap) END AS target FROM levels
), placed AS (
  SELECT s.*, source_size, target, slope, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(start + size / 2.0::DOUBLE <= target AS INT) + CAST(start + source_size + size / 2.0::DOUBLE <= target AS INT) ELSE 0 END AS copies,
    (start + size / 2.0::DOUBLE) / target AS y FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST(size * copies AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN round(least(1.0, CASE WHEN slope = 0 THEN y ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * y) - (1 - slope)) / (2 * slope) END), 6) END AS first_position
FROM counted
"""

WARC = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.page_id, payload_bytes, p.payload_digest, CASE WHEN first IS NULL OR first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> p.page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

ORACLES = {"op5_chat_format": CHAT, "op6_mix_sources": MIX, "op8_warc_index": WARC}

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), p AS (
  SELECT rid, doc_id, len(sh) AS n, unnest(sh) AS t FROM s
), links AS (
  SELECT a.rid AS x, b.rid AS y FROM p a JOIN p b ON a.t = b.t AND a.rid <> b.rid AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.rid, b.rid HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(x, y) AS (
  SELECT rid, rid FROM s UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id FROM s
JOIN (SELECT reach.x AS rid, min(o.doc_id) AS component_id FROM reach JOIN s o ON reach.y = o.rid GROUP BY 1) c ON s.rid = c.rid
"""

ORACLES["op9_ngram_jaccard"] = NEAR

# A run of matches that counts begins with four equal words or, in an item of five, has five: alignments of equal four words.
LEAKS = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), dp AS (
  SELECT rid, p, array_to_string(w[p:p + 3], ' ') AS seed FROM (SELECT rid, w, unnest(range(1, len(w) - 2)) AS p FROM d WHERE len(w) >= 4)
), bp AS (
  SELECT item_id, p, array_to_string(w[p:p + 3], ' ') AS seed FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS p FROM b WHERE len(w) >= 5)
), hits AS (
  SELECT DISTINCT rid, item_id, dp.p - bp.p AS off FROM dp JOIN bp USING (seed)
), eq AS (
  SELECT d.doc_id, h.item_id, len(b.w) AS n, list_transform(b.w, lambda x, j: CASE WHEN off + j >= 1 AND d.w[off + j] = x THEN 1 ELSE -3 END) AS s
  FROM hits h JOIN d ON h.rid = d.rid JOIN b ON h.item_id = b.item_id
), runs AS (
  SELECT doc_id, item_id, n, list_reduce(list_transform(s, lambda x: [x, CASE WHEN x > 0 THEN 1 ELSE 0 END, 0]),
    lambda a, x: [greatest(0, a[1] + x[1]), CASE WHEN a[1] + x[1] <= 0 THEN 0 ELSE a[2] + x[2] END,
      greatest(a[3], CASE WHEN a[1] + x[1] <= 0 THEN 0 ELSE a[2] + x[2] END)], [0, 0, 0]) AS r FROM eq
)
SELECT doc_id, item_id, CAST(max(n) AS INT) AS item_words, CAST(max(r[3]) AS INT) AS matched FROM runs
WHERE r[3] >= greatest(least(8, n), ceil(least(16, n) * 0.75)) GROUP BY doc_id, item_id
"""

ORACLES["op7_decontaminate"] = LEAKS

TOP = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""

ORACLES["op4_exact_topk"] = TOP

LINES = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS txt FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), w AS (
  SELECT doc_id, line, regexp_extract_all(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM l
), s AS (
  SELECT row_number() OVER (ORDER BY doc_id, line) AS rid, doc_id, line, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w WHERE len(ws) > 0
), p AS (
  SELECT rid, len(sh) AS n, unnest(sh) AS t FROM s
), links AS (
  SELECT a.rid AS x, b.rid AS y FROM p a JOIN p b ON a.t = b.t AND b.rid < a.rid AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.rid, b.rid HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), gone AS (
  SELECT s.doc_id, count(DISTINCT line) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS listed
  FROM s WHERE rid IN (SELECT x FROM links) GROUP BY s.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS INT) AS n_lines, CAST(coalesce(gone.n, 0) AS INT) AS n_removed, coalesce(listed, '') AS removed_lines
FROM documents d LEFT JOIN gone USING (doc_id)
"""

ORACLES["op1_line_dedup"] = LINES

SECRETS = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS txt FROM documents
), p AS (
  SELECT * FROM (VALUES (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'), (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+')) v(kind, name, pattern)
), cut AS (
  SELECT rid, kind, name, string_split(CASE kind
    WHEN 0 THEN regexp_replace(txt, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', chr(1) || '\0' || chr(1), 'g')
    WHEN 1 THEN regexp_replace(txt, 'AKIA[A-Z0-9]+', chr(1) || '\0' || chr(1), 'g')
    ELSE regexp_replace(txt, '[0-9a-f]+', chr(1) || '\0' || chr(1), 'g') END, chr(1)) AS pieces
  FROM t, p
), piece AS (
  SELECT rid, kind, name, unnest(pieces) AS word, generate_subscripts(pieces, 1) AS i FROM cut WHERE len(pieces) > 1
), placed AS (
  SELECT *, CAST(sum(length(word)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS stop FROM piece
), span AS (
  SELECT rid, kind, name, stop - length(word) AS start, stop FROM placed WHERE i % 2 = 0 AND CASE kind
    WHEN 0 THEN length(regexp_extract(word, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 8
    WHEN 1 THEN length(word) >= 16 ELSE length(word) >= 32 END
), per AS (
  SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS listed FROM span GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256
FROM t LEFT JOIN per USING (rid)
"""

ORACLES["secret_base_spans"] = SECRETS
