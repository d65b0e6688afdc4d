"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm import conversation_repair, decontamination, html_extraction, language_id, ngram_join, packing, pii
from keysieve.llm import quality_classifier, quality_rules, sharding, suffix_dedup, url_filters, whitening
from keysieve.llm.common import id_remainder

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = id_remainder("doc_id", 5)
    scored = quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), remainder != 0)
    return scored.select("doc_id", (remainder == 0).alias("held_out"), "score", "predicted")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii.spans_text(F.col("spans")).alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    model = language_id.Field()
    model = language_id.fit_field(language_id.learning_rows(docs, ~held_out, "text", "lang", "doc_id", model), model)
    rows = language_id.identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"),
                       F.col("language.score").alias("score"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.quality_rules(docs, carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.tokenized_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                      added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place_pieces(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("copies").alias("c")).select(
        "doc_id", "c.item_id", "c.score", F.col("c.begin").alias("begin_word"), F.col("c.end").alias("end_word"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "class_id", "n_links", "n_copies", "representative")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    explained = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return (whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                    F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened",
                    F.get(explained, F.col("at")).alias("explained"),
                    F.lit(model.identity_error).cast("double").alias("identity_error")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    repaired = conversation_repair.repair(conversation_repair.damage(rows), rows.select("conv_id"))
    return repaired.withColumnRenamed("conv", "conv_id")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"), shards=8, seed=13)
    body = F.coalesce("text", F.lit(""))
    return shuffled.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"),
                           F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                           F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_classifier, op2_url_filters, op3_pii, op4_language_id, op5_quality_rules, op6_packing,
    op7_decontamination, op8_suffix_dedup, op9_ngram_join, op10_html_extraction, op11_embedding_whitening,
    op12_conversation_repair, op13_sharding)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op5_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS w
  FROM documents),
g AS (
  SELECT r, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
l AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (
  SELECT d.r, doc_id, host, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN l ON l.r = d.r LEFT JOIN rep ON rep.r = d.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
s AS (
  SELECT *, base_failed OR n_symbols > CAST(0.1 AS DOUBLE) * n_words OR n_dup_lines > CAST(0.3 AS DOUBLE) * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS suspect FROM f),
h AS (SELECT host, count(*) AS docs, sum(CASE WHEN suspect THEN 1 ELSE 0 END)::DOUBLE AS failed FROM s GROUP BY host),
t AS (SELECT count(*)::DOUBLE AS h, sum(docs)::DOUBLE AS n, sum(failed) AS f, sum(failed * failed / docs) AS q FROM h),
m AS (SELECT f / n AS mean, q / n - (f / n) * (f / n) - (f / n) * (1 - f / n) * h / n AS spread FROM t),
p AS (SELECT mean, CASE WHEN spread > 1e-12 THEN least(greatest(mean * (1 - mean) / spread - 1, 2.0), 1000.0) ELSE 1000.0 END AS weight FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (suspect AND (failed + mean * weight) / (docs + weight) > 0.5) AS kept
FROM s JOIN h USING (host), p""",
    "op9_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS body, {_WORDS} AS w FROM documents),
c AS (SELECT min(doc_id) AS rep, count(*) AS n_copies, any_value(w) AS w, body FROM d GROUP BY body),
g AS (
  SELECT DISTINCT rep, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS gram
  FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM c WHERE len(w) > 0)),
n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
x AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n na ON na.rep = a JOIN n nb ON nb.rep = b WHERE 10 * common >= 8 * (na.n + nb.n - common)),
walk AS (SELECT rep AS node, rep AS root FROM c UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.node),
k AS (SELECT node, min(root) AS class_id FROM walk GROUP BY node),
links AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, n_copies::BIGINT AS n_copies, d.doc_id = class_id AS representative
FROM d JOIN c ON c.body = d.body JOIN k ON k.node = c.rep LEFT JOIN links ON links.a = c.rep""",
    "op12_conversation_repair": r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS key
  FROM conversations),
drawn AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(key, lambda crc, b: list_reduce(
           range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, b)), 4294967295::BIGINT), 4294967295) % 20 AS draw
  FROM raw),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE draw <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_)),
faults AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
inserts(q, r, extra, letters, lines) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']),
  (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
  (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
kept(initial, q, r) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edits AS (
  SELECT conv_id, i, q, 'D' AS letter, 2 AS cost, q AS r, []::VARCHAR[] AS lines FROM faults, (VALUES (0), (1), (2), (3)) states(q)
  UNION ALL
  SELECT conv_id, i, q, 'R', CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, CASE WHEN q = 2 THEN 3 ELSE 2 END,
         [CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END || ':' || text]
  FROM faults, (VALUES (0), (1), (2), (3)) states(q) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, i, q, 'K', CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, r, [role || ':' || text]
  FROM faults JOIN kept USING (initial) WHERE fault NOT IN ('blank', 'duplicate')),
paths AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM conversations
  UNION ALL
  SELECT p.conv_id, p.i + 1, e.r, p.cost + n.extra + e.cost AS c, p.audit || n.letters || e.letter AS a, p.lines || n.lines || e.lines
  FROM paths p JOIN inserts n ON n.q = p.q
  JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 AND e.q = n.r
  QUALIFY row_number() OVER (PARTITION BY p.conv_id, e.r ORDER BY p.cost + n.extra + e.cost, p.audit || n.letters || e.letter) = 1),
sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
ends AS (
  SELECT p.conv_id, p.cost + n.extra AS cost, p.audit || n.letters AS audit, p.lines || n.lines AS lines, s.gaps, s.blank,
         s.duplicate, s.truncated, s.illegal
  FROM paths p LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM p.conv_id JOIN inserts n ON n.q = p.q AND n.r IN (0, 3)
  WHERE p.i = coalesce(s.n, 0)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + n.extra, p.audit || n.letters) = 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit,
       sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM ends""",
}
