"""DuckDB SQL for the registered queries."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
TYPES = rf"""
ws AS (SELECT {WORDS} AS w FROM documents),
win AS (SELECT w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM ws)),
tri AS (SELECT w1, w2, w3, count(*) AS c FROM win WHERE w3 IS NOT NULL GROUP BY ALL),
bi AS (SELECT w1, w2, count(*) AS c FROM win WHERE w2 IS NOT NULL GROUP BY ALL),
uni AS (SELECT w1, count(*) AS c FROM win GROUP BY ALL)"""
CONT = """
SELECT '<*> ' || w2 AS ngram, count(*) AS value FROM bi GROUP BY w2
UNION ALL SELECT w1 || ' <*>', count(*) FROM bi GROUP BY w1
UNION ALL SELECT '<*> ' || w2 || ' ' || w3, count(*) FROM tri GROUP BY w2, w3
UNION ALL SELECT '<*> ' || w2 || ' <*>', count(*) FROM tri GROUP BY w2
UNION ALL SELECT w1 || ' ' || w2 || ' <*>', count(*) FROM tri GROUP BY w1, w2"""
MODEL = f"""
SELECT w1 || ' ' || w2 || ' ' || w3 AS ngram, c AS value FROM tri
UNION ALL SELECT w1 || ' ' || w2, c FROM bi
UNION ALL {CONT}"""
KN = rf"""
WITH {TYPES}, model AS ({MODEL}),
q AS (SELECT {WORDS} AS w FROM conversations),
types AS (
  SELECT w1, w2, w3, count(*) AS n FROM (
    SELECT CASE WHEN i > 2 THEN w[i - 2] ELSE '<NA>' END AS w1, CASE WHEN i > 1 THEN w[i - 1] ELSE '<NA>' END AS w2, w[i] AS w3
    FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM q)) GROUP BY ALL
), g AS (
  SELECT w1, w2, w3, any_value(n) AS n, {', '.join(f"coalesce(max(CASE WHEN slot = {i} THEN value END), 0) AS {c}" for i, c in enumerate(('c123', 'c12', 'c12x', 'x23', 'x2x', 'c2x', 'x3')))}
  FROM (
    SELECT *, [w1 || ' ' || w2 || ' ' || w3, w1 || ' ' || w2, w1 || ' ' || w2 || ' <*>', '<*> ' || w2 || ' ' || w3, '<*> ' || w2 || ' <*>', w2 || ' <*>', '<*> ' || w3][slot + 1] AS key
    FROM (SELECT *, unnest(range(7)) AS slot FROM types)
  ) LEFT JOIN model ON ngram = key GROUP BY w1, w2, w3
), s AS (SELECT *, 0.8::DOUBLE AS d, (SELECT count(*) FROM bi) AS b FROM g),
u AS (SELECT *, CASE WHEN x3 <> 0 THEN (x3 - d) / b + d / b ELSE d / b END AS uni FROM s),
v AS (SELECT *, CASE WHEN x23 <> 0 THEN (x23 - d) / nullif(x2x, 0) + c2x * d / nullif(x2x, 0) * uni
  WHEN x2x <> 0 AND c2x <> 0 THEN c2x * d / nullif(x2x, 0) * uni ELSE uni END AS bi FROM u),
t AS (SELECT *, CASE WHEN c123 <> 0 THEN (c123 - d) / nullif(c12, 0) + c12x * d / nullif(c12, 0) * bi
  WHEN c12x <> 0 THEN c12x * d / nullif(c12, 0) * bi ELSE bi END AS raw FROM v),
scored AS (SELECT *, raw IS NULL OR raw <= 0 OR raw > 1 AS invalid, CASE WHEN raw IS NULL OR raw <= 0 OR raw > 1 THEN d / b ELSE raw END AS prob FROM t)
"""
BIGRAMS = f"{TYPES}, m AS (SELECT w1 || ' ' || w2 AS ngram, c AS value FROM bi)"
RANKED = f"{BIGRAMS}, r AS (SELECT ngram, value, row_number() OVER (ORDER BY ngram) - 1 AS idx, dense_rank() OVER (ORDER BY value) - 1 AS rank FROM m), dv AS (SELECT DISTINCT rank, value FROM r)"
CODES = f"{RANKED}, codes AS (SELECT idx, rank, length(bin(rank + 2)) - 1 AS code_len FROM r)"
OFFSETS = f"{CODES}, offs AS (SELECT idx, code_len, coalesce(sum(code_len) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bit_offset FROM codes)"
BITS = f"{OFFSETS}, bits AS (SELECT bit_offset + k AS pos, CASE WHEN k = 0 THEN 1 ELSE 0 END AS bit FROM (SELECT bit_offset, unnest(range(code_len)) AS k FROM offs))"
ASKED = rf"aw AS (SELECT {WORDS} AS w FROM benchmark), asked AS (SELECT w[i] || ' ' || w[i + 1] AS key, count(*) AS expected FROM (SELECT w, unnest(range(1, len(w))) AS i FROM aw) GROUP BY 1)"
FOUND = f"{BIGRAMS}, {ASKED}, found AS (SELECT key, expected, coalesce(value, 0) AS value FROM asked LEFT JOIN m ON key = ngram)"
VERIFIED = f"{FOUND}, v AS (SELECT *, CASE WHEN expected = 0 THEN 'lookup' WHEN value = 0 THEN 'notfound' WHEN value = expected THEN 'correct' ELSE 'incorrect' END AS status FROM found)"


def murmur2(text: str, seed: int = 0) -> str:
    """MurmurHash2 of a text expression, over its bytes as hex."""
    m, low = 1540483477, 4294967295
    h = f"hex(encode({text}))"
    byte = lambda at: f"('0x' || substr({h}, CAST(({at}) * 2 + 1 AS BIGINT), 2))::BIGINT"
    size = f"octet_length(encode({text}))"
    four = f"({byte('i * 4')} + ({byte('i * 4 + 1')} << 8) + ({byte('i * 4 + 2')} << 16) + ({byte('i * 4 + 3')} << 24))"
    k1 = f"(({four} * {m}) & {low})"
    k2 = f"((xor({k1}, {k1} >> 24) * {m}) & {low})"
    blocks = f"list_transform(range({size} // 4), lambda i: {k2})"
    mixed = f"list_reduce({blocks}, lambda a, k: xor((a * {m}) & {low}, k), xor({seed}::BIGINT, {size}::BIGINT))"
    at = f"({size} // 4) * 4"
    tail = f"CASE {size} % 4 WHEN 3 THEN xor(xor({byte(at + ' + 2')} << 16, {byte(at + ' + 1')} << 8), {byte(at)}) WHEN 2 THEN xor({byte(at + ' + 1')} << 8, {byte(at)}) WHEN 1 THEN {byte(at)} END"
    return f"list_transform([{mixed}], lambda h: CASE WHEN {size} % 4 > 0 THEN (xor(h, {tail}) * {m}) & {low} ELSE h END)", m, low


def hash_cte(name: str, source: str, column: str, seed: int = 0) -> str:
    """A table of source's rows with hash added."""
    first, m, low = murmur2(column, seed)
    return f"{name} AS (SELECT *, xor(h2, h2 >> 15) AS hash FROM (SELECT *, (xor(h1, h1 >> 13) * {m}) & {low} AS h2 FROM (SELECT *, ({first})[1] AS h1 FROM {source})))"


FIB = """fib(n, a, b) AS (SELECT 1, 1::BIGINT, 2::BIGINT UNION ALL SELECT n + 1, b, a + b FROM fib WHERE n < 29),
zeck(rank, rest, i, code) AS (
  SELECT rank, rank + 1, 29, '' FROM dv
  UNION ALL SELECT rank, CASE WHEN rest >= a THEN rest - a ELSE rest END, i - 1,
    CASE WHEN rest >= a THEN '1' || code WHEN code <> '' THEN '0' || code ELSE '' END FROM zeck JOIN fib ON n = i
), fibs AS (SELECT rank, code || '1' AS code FROM zeck WHERE i = 0)"""
QUANTITIES = "WITH p AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) - 1 AS pos, CAST(l_quantity AS BIGINT) AS value FROM lineitem)"
STRANGE = rf"sw AS (SELECT {WORDS} AS w FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)), strange AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS key FROM (SELECT w, unnest(range(1, len(w))) AS i FROM sw))"
SLOTS = f"{RANKED}, {STRANGE}, {hash_cte('hs', 'r', 'ngram')}, {hash_cte('hk', 'strange', 'key')}, {hash_cte('hz', '(SELECT key FROM strange)', 'key', 1)}, placed AS (SELECT hk.key, hk.hash, r.idx AS own, coalesce(r.idx, hz.hash % (SELECT count(*) FROM r)) AS idx FROM hk JOIN hz USING (key) LEFT JOIN r ON hk.key = r.ngram)"


def accepted(bits: int) -> str:
    return f"SELECT {bits} AS bits, count(*) AS unseen, count(hs.idx) AS accepted FROM placed LEFT JOIN hs ON placed.idx = hs.idx AND placed.hash >> {32 - bits} = hs.hash >> {32 - bits} WHERE own IS NULL"


ORACLES = {
    "tokenize": f"SELECT doc_id, CAST(i - 1 AS INT) AS pos, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents))",
    "trigrams": f"SELECT doc_id, CAST(i - 1 AS INT) AS pos, CASE WHEN i > 2 THEN w[i - 2] ELSE '<NA>' END AS w1, CASE WHEN i > 1 THEN w[i - 1] ELSE '<NA>' END AS w2, w[i] AS w3 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents))",
    "ngram_counts": f"WITH {TYPES} SELECT w1 || ' ' || w2 || ' ' || w3 AS ngram, 3 AS n, c AS value FROM tri UNION ALL SELECT w1 || ' ' || w2, 2, c FROM bi UNION ALL SELECT w1, 1, c FROM uni",
    "continuation_counts": f"WITH {TYPES} {CONT}",
    "kn_model": f"WITH {TYPES} {MODEL}",
    "kn_lookup_keys": f"{KN} SELECT w1, w2, w3, n, c123, c12, c12x, x23, x2x, c2x, x3 FROM g",
    "kn_unigram": f"{KN} SELECT DISTINCT w3, uni FROM scored",
    "kn_bigram": f"{KN} SELECT DISTINCT w2, w3, bi FROM scored",
    "kn_prob": f"{KN} SELECT w1, w2, w3, n, prob FROM scored",
    "kn_invalid": f"{KN} SELECT invalid, count(*) AS types, sum(n)::BIGINT AS tokens FROM scored GROUP BY invalid",
    "kn_perplexity": f"{KN} SELECT sum(n)::BIGINT AS tokens, round(pow(2, -sum(log2(prob) * n) / sum(n)), 6) AS perplexity FROM scored",
    "murmur2": f"WITH {TYPES}, {hash_cte('hw', '(SELECT w1 AS word FROM uni)', 'word')} SELECT word, hash FROM hw",
    "fingerprint": f"WITH {TYPES}, {hash_cte('hw', '(SELECT w1 AS word FROM uni)', 'word')} SELECT word, CAST(hash >> 20 AS INT) AS fp12, CAST(hash >> 24 AS INT) AS fp8 FROM hw",
    "assign_index": f"WITH {RANKED} SELECT idx, ngram FROM r",
    "perfect_hash_slots": f"WITH {TYPES} SELECT count(*) AS n_keys, count(*) AS n_slots, 0::BIGINT AS low, count(*) - 1 AS high FROM bi",
    "rank_dense": f"WITH {RANKED} SELECT ngram, value, rank FROM r",
    "rank_runs": f"{QUANTITIES}, c AS (SELECT pos, value, CASE WHEN lag(value) OVER (ORDER BY pos) <> value THEN 1 ELSE 0 END AS new FROM p) SELECT pos, value, sum(new) OVER (ORDER BY pos)::BIGINT AS rank FROM c",
    "scan_numbers": f"{QUANTITIES} SELECT pos, value FROM p",
    "rank_tiered": f"WITH {RANKED} SELECT ngram, CASE WHEN rank + 2 >= 512 THEN 0 WHEN rank + 2 >= 256 THEN 1 ELSE rank + 2 END::BIGINT AS tiered FROM r",
    "distinct_values": f"WITH {RANKED} SELECT rank, value FROM dv",
    "rank_roundtrip": f"WITH {BIGRAMS} SELECT ngram, value FROM m",
    "elias_encode": f"WITH {RANKED} SELECT rank, substr(bin(rank + 2), 2) AS code, CAST(length(bin(rank + 2)) - 1 AS INT) AS code_len FROM dv",
    "elias_roundtrip": f"WITH {RANKED} SELECT rank, rank AS decoded FROM dv",
    "elias_markers": f"WITH {RANKED} SELECT rank, '1' || repeat('0', length(bin(rank + 2)) - 2) AS markers FROM dv",
    "elias_size": f"WITH {CODES} SELECT count(*) AS codes, sum(code_len)::BIGINT AS bits FROM codes",
    "fib_encode": f"WITH RECURSIVE {RANKED}, {FIB} SELECT rank, code FROM fibs",
    "fib_roundtrip": f"WITH {RANKED} SELECT rank, rank AS decoded FROM dv",
    "fib_size": f"WITH RECURSIVE {RANKED}, {FIB} SELECT count(*) AS codes, sum(length(code))::BIGINT AS bits FROM r JOIN fibs USING (rank)",
    "fixed_width_pack": f"WITH {RANKED} SELECT rank, lpad(bin(rank), 20, '0') AS cell, rank AS decoded FROM dv",
    "cseq_encode": f"WITH {RANKED} SELECT value, substr(bin(value + 1), 2) AS code, value AS decoded FROM dv",
    "bit_offsets": f"WITH {OFFSETS} SELECT idx, CAST(code_len AS INT) AS code_len, bit_offset FROM offs",
    "bit_select": f"WITH {BITS} SELECT row_number() OVER (ORDER BY pos) - 1 AS i, pos FROM bits WHERE bit = 1",
    "bit_select_zero": f"WITH {BITS} SELECT row_number() OVER (ORDER BY pos) - 1 AS i, pos FROM bits WHERE bit = 0",
    "pair_select": f"WITH RECURSIVE {RANKED}, {FIB} SELECT idx AS i, coalesce(sum(length(code)) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r JOIN fibs USING (rank)",
    "bit_rank": f"WITH {BITS} SELECT pos, coalesce(sum(bit) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank FROM bits",
    "compressed_rank": "WITH p AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) * 10 AS idx FROM lineitem) SELECT idx, (SELECT count(*) FROM lineitem WHERE floor(l_extendedprice / 100) < idx) AS smaller FROM p",
    "storage_report": f"""WITH RECURSIVE {CODES}, {FIB}, t AS (
      SELECT (SELECT count(*) FROM codes) AS ones, (SELECT sum(code_len) FROM codes)::BIGINT AS elias, (SELECT sum(length(code)) FROM r JOIN fibs USING (rank))::BIGINT AS fib
    ), a AS (SELECT *, ceil(ones / 1024)::BIGINT AS inv, CASE WHEN ones = 0 OR elias // ones = 0 THEN 0 ELSE length(bin(elias // ones)) - 1 END::INT AS l FROM t),
    b AS (SELECT *, (inv + 1) * 64 + inv * 256 AS select_half, ceil(elias / 512)::BIGINT * 2 AS counts FROM a),
    c AS (SELECT *, ones * l + ones + (elias >> l) + select_half AS elias_fano, counts * 64 AS rank9, (counts + ceil(ones / 512)::BIGINT + ceil(elias / 64)::BIGINT // 4) * 64 AS rank9sel, ones * 20 AS fixed_width FROM b)
    SELECT unnest(['ones', 'elias', 'fib', 'select_half', 'elias_fano', 'rank9', 'rank9sel', 'fixed_width', 'elias_with_index', 'saved']) AS item,
      unnest([ones, elias, fib, select_half, elias_fano, rank9, rank9sel, fixed_width, elias + elias_fano, fixed_width - elias - elias_fano])::BIGINT AS bits FROM c""",
    "bucket_sizes": f"WITH {BIGRAMS}, {hash_cte('hm', 'm', 'ngram')}, per AS (SELECT hash % greatest(1, (SELECT count(*) // 4 FROM m)) AS bucket, count(*) AS size FROM hm GROUP BY 1) SELECT size, count(*) AS buckets FROM per GROUP BY size",
    "lookup_exact": f"WITH {FOUND} SELECT key, value FROM found",
    "lookup_file": f"WITH {FOUND} SELECT key, value FROM found",
    "lookup_hits": f"WITH {FOUND} SELECT key FROM found WHERE value > 0",
    "lookup_missing": f"WITH {FOUND} SELECT key FROM found WHERE value = 0",
    "lookup_formatted": f"WITH {FOUND} SELECT lpad(CAST(value AS VARCHAR), 11, ' ') || ' ' || key AS line FROM found",
    "lookup_fingerprint": f"WITH {SLOTS} SELECT placed.key, coalesce(hs.value, 0) AS value FROM placed LEFT JOIN hs ON placed.idx = hs.idx AND placed.hash >> 20 = hs.hash >> 20",
    "fp_false_positive_rate": f"WITH {SLOTS} {accepted(4)} UNION ALL {accepted(8)} UNION ALL {accepted(12)}",
    "verify_errors": f"WITH {VERIFIED} SELECT substr(key, 1, 50) AS shown, expected, value, status FROM v WHERE status IN ('notfound', 'incorrect')",
    "verify_summary": f"WITH {VERIFIED} SELECT count_if(status = 'correct')::BIGINT AS correct, count_if(status = 'incorrect')::BIGINT AS incorrect, count_if(status = 'notfound')::BIGINT AS notfound, count(*) AS total FROM v WHERE status <> 'lookup' HAVING count(*) > 0",
    "verify_self": f"WITH {TYPES} SELECT count(*) AS correct, 0::BIGINT AS incorrect, 0::BIGINT AS notfound, count(*) AS total FROM bi",
    "scan_kv": f"WITH {BIGRAMS} SELECT ngram, value FROM m",
    "save_load_roundtrip": f"WITH {RANKED} SELECT idx, ngram, value FROM r",
    "stream_lookup": f"WITH {VERIFIED} SELECT key, expected, value, status FROM v",
    "stream_perplexity": f"""{KN}, o AS (
      SELECT conv_id, CASE WHEN i > 2 THEN w[i - 2] ELSE '<NA>' END AS w1, CASE WHEN i > 1 THEN w[i - 1] ELSE '<NA>' END AS w2, w[i] AS w3
      FROM (SELECT conv_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, {WORDS} AS w FROM conversations)))
    SELECT conv_id AS doc_id, count(*) AS tokens, round(pow(2, -sum(log2(prob)) / count(*)), 6) AS perplexity FROM o JOIN scored USING (w1, w2, w3) GROUP BY conv_id""",
}
