"""The queries ``opN_<name>`` and ``pipeline``, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair,
    countmin_dedup,
    exact_dedup,
    language_id,
    license_scan,
    mixing,
    oracles,
    packing,
    quality_rules,
    simhash,
    suffix_dedup,
    token_files,
    url_filter,
    vector_codes,
)
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("dup_ngram_chars")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op6_countmin_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = countmin_dedup.remove_repeated_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.conversation_repair(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_files": op5_token_files,
    "op6_countmin_substrings": op6_countmin_substrings,
    "op7_simhash": op7_simhash,
    "op8_suffix_array": op8_suffix_array,
    "op9_url_filter": op9_url_filter,
    "op10_language_id": op10_language_id,
    "op11_license_scan": op11_license_scan,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op2_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
lengths(n) AS (VALUES (3), (5), (6), (7), (8), (9), (10)),
grams AS (
  SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, g) AS times
  FROM (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lengths))),
inside AS (SELECT DISTINCT doc_id, n, i + o AS j FROM (SELECT doc_id, n, i, unnest(range(n)) AS o FROM grams WHERE times > 1)),
each AS (SELECT doc_id, generate_subscripts(ws, 1) AS j, length(unnest(ws)) AS chars FROM w),
repeats AS (SELECT doc_id, n, count(*) AS n_words, sum(chars) AS chars FROM inside JOIN each USING (doc_id, j) GROUP BY 1, 2),
wide AS (SELECT doc_id, max(n_words) FILTER (WHERE n = 3) AS r3, max(chars) FILTER (WHERE n = 5) AS c5, max(chars) FILTER (WHERE n = 6) AS c6,
  max(chars) FILTER (WHERE n = 7) AS c7, max(chars) FILTER (WHERE n = 8) AS c8, max(chars) FILTER (WHERE n = 9) AS c9, max(chars) FILTER (WHERE n = 10) AS c10
  FROM repeats GROUP BY 1),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) AS k
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
again AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM lines WHERE k > 1 GROUP BY 1),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(again.n, 0) AS n_dup_lines, coalesce(r3, 0) AS n_repeat_words,
    CAST(coalesce(again.chars, 0) AS BIGINT) AS dup_line_chars, coalesce(c5, 0) c5, coalesce(c6, 0) c6, coalesce(c7, 0) c7, coalesce(c8, 0) c8, coalesce(c9, 0) c9, coalesce(c10, 0) c10
  FROM w LEFT JOIN wide USING (doc_id) LEFT JOIN again USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, dup_line_chars,
  NOT base_failed AND NOT (dup_line_chars > 0.30::DOUBLE * word_chars OR n_symbols > 0.5::DOUBLE * n_words OR c5 > 0.45::DOUBLE * word_chars OR c6 > 0.43::DOUBLE * word_chars
    OR c7 > 0.41::DOUBLE * word_chars OR c8 > 0.39::DOUBLE * word_chars OR c9 > 0.37::DOUBLE * word_chars OR c10 > 0.35::DOUBLE * word_chars) AS kept
FROM b""",
    "op6_countmin_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS times
  FROM (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w))),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM (SELECT doc_id, i, unnest(range(35)) AS o FROM windows WHERE times > 1)),
lists AS (SELECT w.doc_id, count(*) AS n_removed FROM gone JOIN w USING (doc_id) GROUP BY 1),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY j) AS text
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w) t ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_suffix_array": r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS times
  FROM (SELECT doc_id, i, md5_number(substring(h, 2 * i - 1, 800)) AS g FROM (SELECT doc_id, h, unnest(range(1, n - 398)) AS i FROM b))),
-- windows that are repeated, joined to maximal removed runs
marked AS (SELECT doc_id, i, i + 400 AS stop, max(i + 400) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM windows WHERE times > 1),
runs AS (SELECT doc_id, min(i) AS start, max(stop) AS stop FROM (SELECT *, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
edges AS (SELECT doc_id, start, stop, lag(stop, 1, 1) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM runs),
removed AS (SELECT e.doc_id, CAST(sum(stop - start) AS BIGINT) AS n_removed, count(*) AS n_spans,
    string_agg(substring(h, 2 * before - 1, 2 * (start - before)), '' ORDER BY start) || substring(any_value(h), 2 * max(stop) - 1) AS rest
  FROM edges e JOIN b USING (doc_id) GROUP BY 1)
SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM b LEFT JOIN removed USING (doc_id)""",
    "op3_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix') AS turn,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
ranked AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM totals),
-- in order of what a source can give for its weight: the first k sources are capped
tried AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS most,
         coalesce(sum(3 * source_size) OVER o, 0) AS fixed, sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source IS NULL, source
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM ranked
  WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (
  SELECT min_by((t.total - fixed) / CAST(open AS DOUBLE), most) AS r
  FROM tried, (SELECT sum(source_size) AS total FROM totals) t
  WHERE (t.total - fixed) / CAST(open AS DOUBLE) <= most),
targets AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size < weight * r THEN CAST(3 * source_size AS DOUBLE) ELSE weight * r END AS target
  FROM ranked, rate),
flows AS (
  SELECT s.doc_id, s.size, s.turn, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.doc_id ROWS UNBOUNDED PRECEDING) AS so_far
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
queue AS (
  SELECT doc_id, size, source_size, target,
         sum(size) OVER (ORDER BY CAST(so_far + round * source_size AS DOUBLE) / nullif(target, 0) NULLS FIRST, turn, doc_id, round
                         ROWS UNBOUNDED PRECEDING) AS played
  FROM flows, (VALUES (0), (1), (2)) rounds(round))
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN played <= (SELECT sum(source_size) FROM totals) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM queue GROUP BY ALL""",
    "op4_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOW.format("coalesce(text, '')")} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""",
    "op9_url_filter": f"""
WITH p AS (
  SELECT page_id, {_LOW.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                      ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
listed AS (SELECT name || '.example.' || top AS host
           FROM (VALUES ('adult-x'), ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) a(name),
                (VALUES ('com'), ('net'), ('org')) b(top)),
best AS (
  SELECT p.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
         max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY 1),
bad AS (SELECT DISTINCT p.page_id FROM p JOIN listed l ON p.host = l.host OR ends_with(p.host, '.' || l.host))
SELECT p.page_id, p.host, p.path, best.rule,
       coalesce(best.verdict, CASE WHEN bad.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id) LEFT JOIN bad USING (page_id)""",
}
SQL |= oracles.SQL
