"""Queries opN_<name> of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, html_text, langid, packing, quality, recompress, runs, simhash, suffix_dedup, topk, vector_codes
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary, with_ids=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.withColumn("held_out", quality.is_held_out(docs.doc_id))
    return langid.predict(held, langid.fit(docs), keep=["doc_id", "held_out"])


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.remove_repeats(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_versions(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.withColumn("held_out", quality.is_held_out(docs.doc_id))
    return quality.score(held, quality.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id", "held_out"])


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), ["vec_id", "label"])
    low_bytes = F.regexp_replace(F.lower(F.hex("codes")), "(..)..", "$1")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", low_bytes.alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """documents, of which those with a tenth of all checksums of doc_id have, from some word on, a stretch of words over and over."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("_words")
    g = F.floor(h / 10)
    rows = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_a", F.when(n > 0, g % n))
    period = 1 + F.floor((n - F.col("_a")) / (3 + g % 8))
    source = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % period)
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("_words", source(i).cast("int") + 1))
    return rows.withColumn("text", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text"))).drop("_words", "_a")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", runs.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP3_SQL = """
WITH m AS (
  SELECT conv_id, turn, text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE role END AS role,
    CASE role WHEN 'user' THEN concat('turn-', turn) WHEN 'assistant' THEN concat('turn-', turn - 1) END AS call_id
  FROM conversations
), calls AS (
  SELECT conv_id, call_id, min(turn) AS turn FROM m WHERE role = 'call' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), results AS (
  SELECT conv_id, call_id, min({'t': turn, 'x': coalesce(text, '')}) AS first FROM m
  WHERE role = 'result' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
)
SELECT m.conv_id, m.turn, m.role, m.call_id,
  CASE
    WHEN m.role NOT IN ('call', 'result') OR m.role IS NULL THEN 'message'
    WHEN m.call_id IS NULL OR m.conv_id IS NULL THEN 'unnamed'
    WHEN m.role = 'call' AND r.call_id IS NULL THEN 'unanswered'
    WHEN m.role = 'result' AND c.call_id IS NULL THEN 'orphan_result'
    WHEN m.role = 'result' AND r.first <> {'t': m.turn, 'x': coalesce(m.text, '')} THEN 'repeated_result'
    ELSE 'linked'
  END AS status,
  CASE WHEN m.role = 'call' THEN coalesce(m.text, '') <> '' END AS valid,
  CASE WHEN m.role = 'call' THEN CASE WHEN coalesce(m.text, '') = '' THEN 'prompt: too short' ELSE '' END END AS errors,
  m.turn AS order_turn, CAST(0 AS INTEGER) AS order_depth,
  CASE
    WHEN m.role = 'call' THEN concat('{"arguments":{"prompt":', CAST(to_json(coalesce(m.text, '')) AS VARCHAR), ',"turn":', m.turn, '},"call_id":"', m.call_id, '","role":"call","tool":"reply"}')
    ELSE concat('{', CASE WHEN m.call_id IS NOT NULL THEN concat('"call_id":"', m.call_id, '",') ELSE '' END,
      CASE WHEN m.text IS NOT NULL THEN concat('"content":', CAST(to_json(m.text) AS VARCHAR), ',') ELSE '' END,
      CASE WHEN m.role IS NOT NULL THEN concat('"role":', CAST(to_json(m.role) AS VARCHAR)) ELSE '' END, '}')
  END AS message
FROM m
LEFT JOIN calls c ON c.conv_id = m.conv_id AND c.call_id = m.call_id
LEFT JOIN results r ON r.conv_id = m.conv_id AND r.call_id = m.call_id
"""
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d
), s AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(ws[i:i + 19], ' ')) ORDER BY doc_id, i) > 1 AS again
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)
), c AS (
  SELECT w.doc_id, w.i, w.word,
    coalesce(bool_or(s.again) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM w LEFT JOIN s ON w.doc_id = s.doc_id AND w.i = s.i
), k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), c AS (
  SELECT r, k, substring(x, 500 * k + 1, 1298) AS x FROM (SELECT r, x, unnest(range((len(x) // 2 - 400) // 250 + 1)) AS k FROM d WHERE len(x) >= 800)
), w AS (
  SELECT r, 250 * k + i AS i, md5(substring(x, 2 * i + 1, 800)) AS h FROM (SELECT r, k, x, unnest(range(least(250, len(x) // 2 - 399))) AS i FROM c)
), s AS (
  SELECT r, i, n > 1 AS again FROM w JOIN (SELECT h, count(*) AS n FROM w GROUP BY h) c ON w.h = c.h
), e AS (
  SELECT r, i, i + 400 AS j, max(i + 400) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s WHERE again
), g AS (
  SELECT r, i, j, sum(CASE WHEN before IS NULL OR i > before THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM e
), spans AS (
  SELECT r, k, min(i) AS a, max(j) AS b FROM g GROUP BY r, k
), gaps AS (
  SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS b FROM spans
  UNION ALL
  SELECT r, max(b), NULL FROM spans GROUP BY r
), t AS (
  SELECT gaps.r, string_agg(CASE WHEN b IS NULL THEN substring(x, 2 * a + 1) ELSE substring(x, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS x FROM gaps JOIN d USING (r) GROUP BY gaps.r
), n AS (
  SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r
)
SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t.x, d.x))) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), part AS (
  SELECT r, vec_id, k.k AS part, v[k.k * len(v) // 16 + 1 : (k.k + 1) * len(v) // 16] AS x FROM v, (SELECT unnest(range(16)) AS k) k
), b0 AS (
  SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id, x) - 1 AS BIGINT) AS entry, x FROM part
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id, x) <= 64
), a1 AS (
  SELECT p.r, p.part, any_value(p.x) AS x, min({'d': CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': b.entry}).e AS entry
  FROM part p JOIN b0 b USING (part) GROUP BY p.r, p.part
), m1 AS (
  SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x
  FROM (SELECT part, entry, i, sum(c) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS i FROM a1) GROUP BY ALL) GROUP BY part, entry
), b1 AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b0 b LEFT JOIN m1 m USING (part, entry)
), a2 AS (
  SELECT p.r, p.part, any_value(p.x) AS x, min({'d': CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': b.entry}).e AS entry
  FROM part p JOIN b1 b USING (part) GROUP BY p.r, p.part
), m2 AS (
  SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x
  FROM (SELECT part, entry, i, sum(c) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS i FROM a2) GROUP BY ALL) GROUP BY part, entry
), b2 AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b1 b LEFT JOIN m2 m USING (part, entry)
), a3 AS (
  SELECT p.r, p.part, min({'d': CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': b.entry}) AS best
  FROM part p JOIN b2 b USING (part) GROUP BY p.r, p.part
), coded AS (
  SELECT r, string_agg(format('{:02x}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a3 GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2
)
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN coded ON v.r = coded.r, books
"""
OP13_SQL = r"""
WITH o AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
      lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)))) AS h
  FROM documents
), a AS (
  SELECT *, CAST(h // 10 AS BIGINT) AS g, CAST(len(ws) AS BIGINT) AS n, CAST(CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS BIGINT) AS a FROM o
), d AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM a
), w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM d
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k
), runs AS (
  SELECT doc_id, start, CAST(length AS BIGINT) AS length, CAST(min(q) AS BIGINT) AS period FROM islands WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length
), per AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), collapsed AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN collapsed USING (doc_id)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_language_id, op3_chat_format, op4_substring_dedup, op5_simhash, op6_main_text, op7_iblt_fingerprint, op8_exact_topk, op9_best_fit_packing, op10_subword_quality, op11_suffix_dedup, op12_vector_codes, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op8_exact_topk": OP8_SQL, "op11_suffix_dedup": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_periodic_runs": OP13_SQL}
