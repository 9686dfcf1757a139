"""Queries of the operators over the standard tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.tables import read, spread


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ring import shard

    docs = read(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return shard(docs, F.col("doc_id"), 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.lengths import length_histogram, token_counts

    return length_histogram(token_counts(spread(read(spark, sf_dir, "documents"))))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.packing import pack_documents

    out = pack_documents(spread(read(spark, sf_dir, "documents")), 2048)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.hostrules import judge

    return judge(spread(read(spark, sf_dir, "documents")))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.curriculum import place, sized

    placed = place(sized(spread(read(spark, sf_dir, "documents"))), lambda rank, _: rank % 3 + 1)
    first = placed.withColumn("position", F.get("copies", F.lit(0))["position"]).withColumn("n_copies", F.size("copies"))
    out = first.select("doc_id", "size", "source_size", "target", "taken", "source", "n_copies", "position", F.transform("copies", lambda c: c["position"]).alias("positions"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.pii import pseudonymise

    return pseudonymise(spread(read(spark, sf_dir, "documents")).select("doc_id", "text"), "a key kept outside the data")


def op10_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.digest import edited_fingerprints

    return edited_fingerprints(spread(read(spark, sf_dir, "documents")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ngramjoin import join_classes

    return join_classes(spread(read(spark, sf_dir, "documents")), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.lmscore import cross_entropy_difference

    return cross_entropy_difference(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))


def op7_line_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.html import extract

    return extract(spread(read(spark, sf_dir, "pages")).select("page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_feistel_pseudonyms,
        op2_host_quality_rules,
        op3_cross_entropy_difference,
        op4_ring_shards,
        op5_length_histogram,
        op6_best_fit_packing,
        op7_line_block_extraction,
        op8_curriculum_mix,
        op9_ngram_jaccard_join,
        op10_canonical_digest,
    )
}
#: Words of a text in DuckDB.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE: dict[str, str] = {
    "op2_host_quality_rules": rf"""
WITH w AS (
  SELECT doc_id, source AS host, {_WORDS} AS ws, coalesce(text, '') AS t,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(n - i, 8)))::BIGINT AS c
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM twice) GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
), hosts AS (
  SELECT host, count(*) AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged GROUP BY host
), whole AS (
  SELECT sum(f) / sum(n) AS m, count(*) / sum(n) AS hn, sum(f * f / n) / sum(n) AS q FROM hosts
), prior AS (
  SELECT m, CASE WHEN q - m * m - m * (1 - m) * hn > 1e-12 THEN greatest(m * (1 - m) / (q - m * m - m * (1 - m) * hn) - 1, 1.0) ELSE 1e12 END AS s FROM whole
), rates AS (
  SELECT host, (f + m * s) / (n + s) AS rate, m FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.8 AND NOT (rate > 0.3 AND rate > 2 * m AND (n_symbols > 0.1 * word_chars OR 20 * n_dup_lines > 0.3 * n_words)) AS kept,
  j.host, round(rate, 6) AS host_rate,
  CASE WHEN rate > 0.8 THEN 'rejected' WHEN rate > 0.3 AND rate > 2 * m THEN 'suspect' ELSE 'kept' END AS host_verdict
FROM judged j JOIN rates r ON j.host IS NOT DISTINCT FROM r.host
""",
    # words folded as the operator folds them; counts by fold of the text and by whether it is a target
    "op3_cross_entropy_difference": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, md5(coalesce(text, ''))[1] IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS fold,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL) IS TRUE AS t,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), w AS (
  SELECT r, fold, t, unnest(ws) AS w, unnest(list_concat([NULL], ws[:-2])) AS p FROM d
), words AS (SELECT fold, t, w, count(*) AS n FROM w GROUP BY ALL),
contexts AS (SELECT fold, t, p, count(*) AS n FROM w GROUP BY ALL),
pairs AS (SELECT fold, t, p, w, count(*) AS n FROM w GROUP BY ALL),
sizes AS (
  SELECT f.fold, k.t, (SELECT count(*) FROM w WHERE w.fold = f.fold AND w.t = k.t)::DOUBLE AS size, (SELECT count(DISTINCT w) FROM w) AS v
  FROM (VALUES (true), (false)) f(fold), (VALUES (true), (false)) k(t)
), scaled AS (
  SELECT s.fold, s.t, s.v, s.size, CASE WHEN NOT s.t AND s.size > 0 AND o.size > 0 THEN o.size / s.size ELSE 1.0 END AS scale
  FROM sizes s JOIN sizes o ON o.fold = s.fold AND o.t
), losses AS (
  SELECT w.r, s.t, avg(-ln(
    CASE WHEN coalesce(c.n, 0) > 0 THEN 0.4::DOUBLE * coalesce(b.n, 0) / c.n + 0.6::DOUBLE * (coalesce(u.n, 0) * s.scale + 0.5::DOUBLE) / (s.size * s.scale + 0.5::DOUBLE * s.v)
    ELSE (coalesce(u.n, 0) * s.scale + 0.5::DOUBLE) / (s.size * s.scale + 0.5::DOUBLE * s.v) END)) AS loss
  FROM w JOIN scaled s ON s.fold <> w.fold
  LEFT JOIN words u ON u.fold = s.fold AND u.t = s.t AND u.w = w.w
  LEFT JOIN contexts c ON c.fold = s.fold AND c.t = s.t AND c.p IS NOT DISTINCT FROM w.p
  LEFT JOIN pairs b ON b.fold = s.fold AND b.t = s.t AND b.p IS NOT DISTINCT FROM w.p AND b.w = w.w
  GROUP BY w.r, s.t
)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(i.loss, 6) AS target_loss, round(o.loss, 6) AS background_loss, round(i.loss - o.loss, 6) AS score
FROM d LEFT JOIN losses i ON i.r = d.r AND i.t LEFT JOIN losses o ON o.r = d.r AND NOT o.t
""",
    # the tables' pages hold their text in one article of headings and paragraphs
    "op7_line_block_extraction": r"""
WITH blocks AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)(?:</article>|\z)', 1, 's'), '</?(?:p|h1)>') AS b FROM pages
), plain AS (
  SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM blocks
)
SELECT page_id, url, array_to_string(b, chr(10)) AS text, length(array_to_string(b, chr(10)))::BIGINT AS n_chars FROM plain
""",
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM d
), each AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = s.doc_id
""",
}
