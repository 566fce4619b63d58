"""One thin query per operator over its whole table, and the DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.session import table

from . import support


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    support.ship(spark)
    return table(spark, sf_dir, "documents")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_cascade

    return quality_cascade(_docs(spark, sf_dir))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), tri AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS t
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, words, lines, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 100 > n_words * 10 OR n_dup_lines * 100 > len(lines) * 60
            OR word_chars < n_words * 2 OR word_chars > n_words * 20
            OR len(list_filter(lines, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) * 100 > len(lines) * 30
            OR len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) * 100 > len(lines) * 90
            OR len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) * 100 < n_words * 70) AS kept
FROM b
"""

def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(_docs(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


OP1_SQL = r"""
WITH u AS (
  SELECT doc_id, i AS raw_i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(w) OVER (PARTITION BY doc_id ORDER BY i) - w AS before FROM u
), pairs AS (
  SELECT a.doc_id, a.i AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.before >= 50
    AND b.upto - a.before < 50 + a.w + b.w
), win AS (
  SELECT doc_id, s, min(e) AS e FROM pairs GROUP BY doc_id, s
  UNION
  SELECT doc_id, max(s) AS s, e FROM pairs GROUP BY doc_id, e
), content AS (
  SELECT w.doc_id, w.s, w.e, string_agg(u.line, chr(10) ORDER BY u.i) AS content
  FROM win w JOIN u ON u.doc_id = w.doc_id AND u.i BETWEEN w.s AND w.e GROUP BY w.doc_id, w.s, w.e
), later AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS r FROM content) WHERE r > 1
), gone AS (
  SELECT l.doc_id, a.raw_i AS lo, b.raw_i AS hi FROM later l
  JOIN u a ON a.doc_id = l.doc_id AND a.i = l.s JOIN u b ON b.doc_id = l.doc_id AND b.i = l.e
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), marked AS (
  SELECT doc_id, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS unit,
         EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = lines.doc_id AND lines.i BETWEEN g.lo AND g.hi) AS gone
  FROM lines
)
SELECT d.doc_id, coalesce(count(*) FILTER (unit), 0)::BIGINT AS n_lines, coalesce(count(*) FILTER (unit AND gone), 0)::BIGINT AS n_removed,
       CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') END AS text
FROM documents d LEFT JOIN marked USING (doc_id) GROUP BY d.doc_id
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digest_columns, suffix_dedup

    return digest_columns(suffix_dedup(_docs(spark, sf_dir)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, learnable, predict

    docs = _docs(spark, sf_dir)
    own = docs.select("doc_id", "text").withColumn("held_out", held_out())
    return predict(own, fit(learnable(docs, held_out()))).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import cross_entropy_difference

    return cross_entropy_difference(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_classes

    return near_classes(_docs(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    support.ship(spark)
    return extract(table(spark, sf_dir, "pages"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import chat_format, in_reply_order

    support.ship(spark)
    return in_reply_order(chat_format(table(spark, sf_dir, "conversations")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    support.ship(spark)
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH r AS (
  SELECT vec_id::BIGINT AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH lab AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, doc_id > min(doc_id) OVER (PARTITION BY t) AS later FROM d
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < 50)::INT + 2 * (100 * list_unique(words) < 65 * len(words))::INT
         + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(later, false)::INT AS mask
  FROM w LEFT JOIN lab USING (doc_id)
), m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a JOIN l b ON a.x <> b.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), st AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS pre FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (pre + bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & pre = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & pre > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit > 0 AND mask & pre = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & pre = 0), 0)::BIGINT AS toxic_lost
  FROM m, st GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import digests, read_archives, scratch_folder, write_archives

    support.ship(spark)
    folder = scratch_folder(spark)
    write_archives(table(spark, sf_dir, "pages"), folder)
    return digests(read_archives(spark, folder))


OP13_SQL = """
WITH d AS (
  SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS bits,
         max(page_id) OVER (PARTITION BY payload) AS first
  FROM d
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(1, 6), lambda k: CAST(bits[g * 5 + k] AS INT) * CAST(pow(2, 5 - k) AS INT)))::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM b
"""


QUERIES = {
    "op4_lm_scoring": op4_lm_scoring,
    "op9_chat_format": op9_chat_format,
    "op7_decontaminate": op7_decontaminate,
    "op10_html_extract": op10_html_extract,
    "op5_minhash": op5_minhash,
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op6_byte_bpe": op6_byte_bpe,
    "op8_quality_cascade": op8_quality_cascade,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_warc": op13_warc,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op8_quality_cascade": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_warc": OP13_SQL,
}
