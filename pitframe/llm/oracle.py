"""DuckDB SQL for the rows of those text queries that SQL can express."""

QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), tri AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, sum(step) AS n_repeat_words
  FROM (SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS step FROM tri WHERE n > 1)
  GROUP BY rid
), c AS (
  SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)
), r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS letters_rate,
         CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbol_rate,
         CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_rate,
         CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_rate
  FROM c
), t AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r
), v AS (
  SELECT lang, source, 'letters_rate' AS rate, letters_rate AS value FROM t WHERE NOT base_failed UNION ALL SELECT lang, source, 'symbol_rate' AS rate, symbol_rate AS value FROM t WHERE NOT base_failed UNION ALL SELECT lang, source, 'dup_line_rate' AS rate, dup_line_rate AS value FROM t WHERE NOT base_failed UNION ALL SELECT lang, source, 'repeat_rate' AS rate, repeat_rate AS value FROM t WHERE NOT base_failed
), b AS (
  SELECT lang, source, rate, ((value >> greatest(length(bin(value)) - 6, 0)::BIGINT) << greatest(length(bin(value)) - 6, 0)::BIGINT) AS bucket FROM v
), sk AS (SELECT lang, source, rate, bucket, count(*) AS n FROM b GROUP BY ALL),
q0 AS (SELECT lang, source, rate, bucket, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, rate) AS total FROM sk),
q1 AS (SELECT lang, rate, bucket, sum(n) OVER (PARTITION BY lang, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, rate) AS total FROM (SELECT lang, rate, bucket, sum(n) AS n FROM sk GROUP BY ALL)),
q2 AS (SELECT rate, bucket, sum(n) OVER (PARTITION BY rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY rate) AS total FROM (SELECT rate, bucket, sum(n) AS n FROM sk GROUP BY ALL)),
a0 AS (SELECT lang, source, rate, max(total) AS total, min(bucket) FILTER (upto * 4 >= total) AS low, min(bucket) FILTER (upto * 2 >= total) AS mid, min(bucket) FILTER (upto * 100 >= total * CASE rate WHEN 'letters_rate' THEN 75 WHEN 'symbol_rate' THEN 88 ELSE 99 END) AS high FROM q0 GROUP BY ALL),
a1 AS (SELECT lang, rate, max(total) AS total, min(bucket) FILTER (upto * 4 >= total) AS low, min(bucket) FILTER (upto * 2 >= total) AS mid, min(bucket) FILTER (upto * 100 >= total * CASE rate WHEN 'letters_rate' THEN 75 WHEN 'symbol_rate' THEN 88 ELSE 99 END) AS high FROM q1 GROUP BY ALL),
a2 AS (SELECT rate, max(total) AS total, min(bucket) FILTER (upto * 4 >= total) AS low, min(bucket) FILTER (upto * 2 >= total) AS mid, min(bucket) FILTER (upto * 100 >= total * CASE rate WHEN 'letters_rate' THEN 75 WHEN 'symbol_rate' THEN 88 ELSE 99 END) AS high FROM q2 GROUP BY ALL),
p AS (
  SELECT a0.lang, a0.source, a0.rate, CASE WHEN a0.total >= 200 THEN a0.low WHEN a1.total >= 200 THEN a1.low ELSE a2.low END AS low, CASE WHEN a0.total >= 200 THEN a0.mid WHEN a1.total >= 200 THEN a1.mid ELSE a2.mid END AS mid, CASE WHEN a0.total >= 200 THEN a0.high WHEN a1.total >= 200 THEN a1.high ELSE a2.high END AS high
  FROM a0 JOIN a1 ON a0.lang IS NOT DISTINCT FROM a1.lang AND a0.rate = a1.rate JOIN a2 ON a0.rate = a2.rate
), x AS (
  SELECT lang, source, rate, low - CASE rate WHEN 'letters_rate' THEN 12 WHEN 'symbol_rate' THEN 8 ELSE 0 END * (mid - low) AS lo, high + CASE rate WHEN 'letters_rate' THEN 12 WHEN 'symbol_rate' THEN 8 ELSE 0 END * (high - mid) AS hi FROM p
), f AS (
  SELECT lang, source, max(lo) FILTER (rate = 'letters_rate') AS lo, max(hi) FILTER (rate = 'letters_rate') AS letters_rate_hi, max(hi) FILTER (rate = 'symbol_rate') AS symbol_rate_hi, max(hi) FILTER (rate = 'dup_line_rate') AS dup_line_rate_hi, max(hi) FILTER (rate = 'repeat_rate') AS repeat_rate_hi FROM x GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(((letters_rate >> greatest(length(bin(letters_rate)) - 6, 0)::BIGINT) << greatest(length(bin(letters_rate)) - 6, 0)::BIGINT) >= lo AND ((letters_rate >> greatest(length(bin(letters_rate)) - 6, 0)::BIGINT) << greatest(length(bin(letters_rate)) - 6, 0)::BIGINT) <= letters_rate_hi AND ((symbol_rate >> greatest(length(bin(symbol_rate)) - 6, 0)::BIGINT) << greatest(length(bin(symbol_rate)) - 6, 0)::BIGINT) <= symbol_rate_hi AND ((dup_line_rate >> greatest(length(bin(dup_line_rate)) - 6, 0)::BIGINT) << greatest(length(bin(dup_line_rate)) - 6, 0)::BIGINT) <= dup_line_rate_hi AND ((repeat_rate >> greatest(length(bin(repeat_rate)) - 6, 0)::BIGINT) << greatest(length(bin(repeat_rate)) - 6, 0)::BIGINT) <= repeat_rate_hi, FALSE) AS kept
FROM t LEFT JOIN f ON t.lang IS NOT DISTINCT FROM f.lang AND t.source IS NOT DISTINCT FROM f.source
"""

LEXICAL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), c AS (
  SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
), t AS (
  SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t, c GROUP BY term, n_docs
), s AS (
  SELECT item_id, rid, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term), c GROUP BY item_id, rid, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
