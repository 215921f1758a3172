"""Registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bayworks.llm import (
    collocations, host_rules, languages, line_dedup, merkle, packing, pieces, quality, simhash, tool_calls, toxicity, urls, vectors,
)
from bayworks.llm.common import held_out, table


def op1_quality_classifier(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    model = quality.fit(docs, labels, ~out)
    found = quality.score(docs.select("doc_id", "text", "n_chars"), model)
    predicted = (F.col("quality") >= 0.7).cast("int").alias("predicted")
    return found.select("doc_id", out.alias("held_out"), F.col("quality").alias("score"), predicted)


def op2_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_url_filter(spark, folder):
    found = urls.classify(table(spark, folder, "pages").select("page_id", "url"))
    return found.select("page_id", "url_filter.*")


def op4_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    model = languages.fit(docs.select("doc_id", "text", "lang"), ~out)
    found = languages.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "language.lang_pred", "language.score")


def op5_tool_calls(spark, folder):
    return tool_calls.format_conversations(table(spark, folder, "conversations"))


def op6_best_fit_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


def op7_embedding_near_dedup(spark, folder):
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op8_sentencepiece(spark, folder):
    return pieces.digest(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "pieces.*")


def op9_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels, ~out)
    found = toxicity.score(docs.select("doc_id", "text"), model)
    predicted = (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", out.alias("held_out"), F.col("toxicity").alias("score"), predicted)


def op10_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    found = host_rules.judge(docs).select("doc_id", "verdict.*")
    return found.withColumn("host_rate", F.round("host_rate", 6))


def op11_collocations(spark, folder):
    return collocations.phrases(table(spark, folder, "documents").select("text", "lang"))


def op12_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    tampered = {"n_chars": F.col("n_chars") + F.coalesce(held_out(F.col("doc_id"), 7, 0) & F.col("doc_id").isNotNull(), F.lit(False)).cast("long")}
    found = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", tampered)
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op13_line_dedup(spark, folder):
    return line_dedup.digest(table(spark, folder, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_tool_calls": op5_tool_calls,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_line_dedup": op13_line_dedup,
}
_WORD = r"[^\x20\x09-\x0D]+"
ORACLE_SQL: dict[str, str] = {
    "op5_tool_calls": rf"""
WITH calls AS (
  SELECT conv_id, turn, role, text, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id,
    len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS words
  FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
results AS (
  SELECT conv_id, turn, text, conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS call_id
  FROM conversations WHERE role = 'assistant'),
judged AS (
  SELECT c.*, r.call_id IS NOT NULL AS answered, r.text AS result,
    CASE WHEN role IS NULL OR role NOT IN ('user', 'system') THEN 'unknown tool' WHEN c.text IS NULL THEN 'missing text'
         WHEN c.text = '' THEN 'text breaks minLength' ELSE '' END AS errors
  FROM calls c LEFT JOIN results r USING (call_id))
SELECT conv_id, call_id, turn, turn AS step, role AS tool, CASE WHEN answered THEN 'linked' ELSE 'unanswered' END AS status,
  errors = '' AS valid, errors,
  '{{"arguments":{{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || to_json(text) || ',' END || '"words":' || words || '}},"call_id":"'
    || call_id || '"' || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || to_json(result) END || ',"step":' || turn
    || CASE WHEN role IS NULL THEN '' ELSE ',"tool":' || to_json(role) END || '}}' AS line
FROM judged
UNION ALL
SELECT conv_id, call_id, turn, NULL, NULL, 'orphan', NULL, NULL,
  '{{"call_id":"' || call_id || '"' || CASE WHEN text IS NULL THEN '' ELSE ',"result":' || to_json(text) END || '}}'
FROM results WHERE NOT EXISTS (SELECT 1 FROM calls WHERE calls.call_id = results.call_id)""",
    "op10_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
wins AS (
  SELECT rid, pos, ws[pos:pos + 4] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS pos FROM d WHERE len(ws) >= 5)),
twice AS (SELECT rid, w FROM wins GROUP BY rid, w HAVING count(*) > 1),
covered AS (
  SELECT rid, count(DISTINCT pos + k) AS n FROM wins JOIN twice USING (rid, w) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(k) GROUP BY rid),
counted AS (
  SELECT d.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered c USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
prior AS (
  SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n))
    - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * (count(*) - 1) / sum(n) AS b FROM hosts),
shrunk AS (SELECT m, CASE WHEN b > 0 THEN least(greatest(m * (1 - m) / b - 1, 1), 1e6) ELSE 1e6 END AS k FROM prior),
rates AS (SELECT source, (f + k * m) / (n + k) AS rate FROM hosts, shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words,
  base_failed, round(rate, 6) AS host_rate, NOT base_failed AND coalesce(rate <= 0.5, TRUE) AS kept
FROM judged LEFT JOIN rates USING (source)""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT id, lang, unnest(w) AS w1, unnest(range(len(w))) AS i FROM lists),
runs AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w1 AS p FROM runs UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, p, count(*)::BIGINT AS c FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (
  SELECT lang, k, p, c AS a, split_part(p, ' ', 1) AS w1, split_part(p, ' ', 2) AS w2, split_part(p, ' ', 3) AS w3
  FROM f WHERE k >= 2 AND c >= 10),
cuts AS (
  SELECT c.lang, c.k, c.p, c.a, l.c AS l, r.c AS r, cut,
    (1000000::HUGEINT * c.a * c.a // (l.c::HUGEINT * r.c))::BIGINT AS score
  FROM (SELECT *, 1 AS cut, w1 AS lp, CASE WHEN k = 2 THEN w2 ELSE w2 || ' ' || w3 END AS rp FROM cand
        UNION ALL SELECT *, 2, w1 || ' ' || w2, w3 FROM cand WHERE k = 3) c
  JOIN f l ON l.lang = c.lang AND l.p = c.lp JOIN f r ON r.lang = c.lang AND r.p = c.rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
around AS (
  SELECT lang, p, max(a) AS most FROM (
    SELECT lang, w1 || ' ' || w2 AS p, a FROM cand WHERE k = 3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM cand WHERE k = 3) GROUP BY lang, p),
kept AS (SELECT b.* FROM best b LEFT JOIN around t ON t.lang = b.lang AND t.p = b.p WHERE coalesce(100 * t.most < 50 * b.a, TRUE))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
field AS (
  SELECT doc_id, lang, n_chars, 7 AS every,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
tested AS (
  SELECT field.*, doc_id IS NOT NULL AND xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8))) % every = 0 AS tampered FROM field, crc_table),
leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + tampered::INT)::VARCHAR) || ':' || (n_chars + tampered::INT), '-') || tail) AS received,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM tested),
low AS (
  SELECT lang, 0 AS lvl, i, leaf AS h, n FROM leaf
  UNION ALL
  SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
subroots AS (
  SELECT lang, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, t AS i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, i // 2, n),
path AS (
  SELECT l.doc_id, l.leaf, s.lvl, s.h, s.i < (l.i >> s.lvl) AS is_left
  FROM leaf l JOIN low s ON s.lang IS NOT DISTINCT FROM l.lang AND s.i = xor(l.i >> s.lvl, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, u.depth + s.lvl, s.h, s.i < (u.t >> s.lvl)
  FROM leaf l JOIN subroots u ON u.lang IS NOT DISTINCT FROM l.lang JOIN high s ON s.i = xor(u.t >> s.lvl, 1)),
folded AS (
  SELECT l.doc_id, l.leaf, l.received AS h, 0 AS lvl, u.depth + (SELECT max(lvl) FROM high) AS depth
  FROM leaf l JOIN subroots u ON u.lang IS NOT DISTINCT FROM l.lang
  UNION ALL
  SELECT f.doc_id, f.leaf, sha256(CASE WHEN p.h IS NULL THEN f.h WHEN p.is_left THEN p.h || f.h ELSE f.h || p.h END), f.lvl + 1, f.depth
  FROM folded f LEFT JOIN path p ON p.leaf = f.leaf AND p.doc_id IS NOT DISTINCT FROM f.doc_id AND p.lvl = f.lvl WHERE f.lvl < f.depth),
proofs AS (SELECT doc_id, leaf, string_agg(h, '' ORDER BY lvl) AS proof FROM path GROUP BY doc_id, leaf)
SELECT l.doc_id, l.leaf, u.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaf l JOIN subroots u ON u.lang IS NOT DISTINCT FROM l.lang
JOIN high r ON r.n = 1 JOIN folded f ON f.leaf = l.leaf AND f.doc_id IS NOT DISTINCT FROM l.doc_id AND f.lvl = f.depth
LEFT JOIN proofs p ON p.leaf = l.leaf AND p.doc_id IS NOT DISTINCT FROM l.doc_id""",
    "op13_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id""",
}
