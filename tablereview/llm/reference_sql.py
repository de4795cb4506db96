"""The queries that SQL can express, for DuckDB. Parameters are written out, not imported."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NEAR_DEDUP = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                               "'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM worded WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
steps AS (SELECT a AS src, b AS dst FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
  SELECT src, dst FROM steps
  UNION
  SELECT r.doc_id, s.dst FROM reached r JOIN steps s ON r.other = s.src),
least_of AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id),
found AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id
  FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.doc_id = d.doc_id)
SELECT *, doc_id = component_id AS kept FROM found
"""

LINE_RULES = rf"""
WITH held AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, {WORDS.format("text")} AS words FROM held),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS x
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM worded WHERE len(words) >= 5)),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(5, coalesce(following - i, 5))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM repeated) GROUP BY doc_id),
cut AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM held),
lines AS (
  SELECT *, lower(trim(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ')) AS normal,
    len({WORDS.format("line")}) AS n
  FROM cut),
again AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE n > 0 GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM held GROUP BY host),
common AS (
  SELECT l.host, l.normal FROM lines l JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host
  WHERE l.normal <> '' GROUP BY l.host, l.normal, h.docs
  HAVING count(DISTINCT l.text) > 20 AND count(DISTINCT l.text) > 0.10 * h.docs),
lost AS (
  SELECT l.doc_id, sum(l.n) AS lost_words, count(*) AS lost_lines
  FROM lines l JOIN common c ON l.host IS NOT DISTINCT FROM c.host AND l.normal = c.normal GROUP BY l.doc_id),
found AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(a.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(o.lost_words, 0) AS lost_words, CAST(coalesce(o.lost_lines, 0) AS BIGINT) AS n_common_lines
  FROM worded w LEFT JOIN again a ON a.doc_id = w.doc_id LEFT JOIN covered c ON c.doc_id = w.doc_id
  LEFT JOIN lost o ON o.doc_id = w.doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM found)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (lost_words > 0 AND n_words - lost_words < 10) AS kept,
  n_common_lines, CAST(n_words - lost_words AS BIGINT) AS n_words_left
FROM judged
"""

MIX_SOURCES = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
weights AS (SELECT source, docs, pow(docs, 0.5) AS weight FROM counts),
rates AS (
  SELECT source, CAST((SELECT sum(docs) FROM weights) AS DOUBLE) * (weight / (SELECT sum(weight) FROM weights)) / docs
    AS rate FROM weights),
steps(source, rate, k, log, total) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log + ln(rate / (k + 1)), total + exp(log + ln(rate / (k + 1)))
  FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
drawn AS (
  SELECT *, CAST(CAST('0x' || substr(md5('17|' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE)
    / 4503599627370496.0 AS u FROM documents),
copies AS (
  SELECT d.doc_id, count(s.k) AS n
  FROM drawn d JOIN steps s ON s.source IS NOT DISTINCT FROM d.source AND s.total <= d.u GROUP BY d.doc_id)
SELECT d.*, unnest(range(1, c.n + 1)) AS copy_no FROM documents d JOIN copies c ON c.doc_id = d.doc_id
"""

HEAD_TAIL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS entries FROM (
    SELECT i, list_reduce(list_concat([i], range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
raw AS (SELECT 0 AS part, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
numbered AS (SELECT *, row_number() OVER () AS r FROM raw),
worded AS (
  SELECT part, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM numbered),
placed AS (SELECT part, r, words, unnest(range(1, len(words) + 1)) AS i FROM worded),
features AS (
  SELECT part, r, words[i] AS feature FROM placed
  UNION ALL
  SELECT part, r, words[i] || ' ' || words[i + 1] FROM placed WHERE i < len(words)),
distinct_features AS (SELECT DISTINCT feature FROM features),
hexed AS (SELECT feature, hex(encode(feature)) AS digits FROM distinct_features),
hashed AS (
  SELECT feature, xor(list_reduce(list_concat([4294967295], list_transform(range(CAST(len(digits) / 2 AS BIGINT)),
      lambda k: CAST('0x' || substr(digits, 2 * k + 1, 2) AS BIGINT))),
    lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM hexed, crc_table),
placed_features AS (SELECT part, r, bucket FROM features JOIN hashed USING (feature)),
totals AS (
  SELECT bucket, CAST(count(*) FILTER (part = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (part = 1) AS DOUBLE) AS t
  FROM placed_features GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000)
    / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000)))) AS BIGINT) AS gain FROM totals),
sums AS (
  SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM placed_features JOIN gains USING (bucket)
  WHERE part = 0 GROUP BY r),
weighed AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM worded w LEFT JOIN sums s ON s.r = w.r WHERE part = 0),
scored AS (
  SELECT doc_id, n_words, n_features, weight,
    weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END
    AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank, n_words
FROM ranked
"""

LINE_DEDUP = """
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM cut),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped FROM keyed k LEFT JOIN common c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id, r
"""

SQL: dict[str, str] = {
    "op2_minhash_near_dedup": NEAR_DEDUP,
    "op4_line_rules": LINE_RULES,
    "op10_mix_sources": MIX_SOURCES,
    "op11_head_tail_resampling": HEAD_TAIL,
    "op12_line_dedup": LINE_DEDUP,
}
