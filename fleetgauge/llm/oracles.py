"""SQL of the operators that SQL can express, written from their definitions."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT r, k, array_to_string(words[k:k + 4], ' ') AS g FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, 1))) AS k FROM w) x),
again AS (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT k + j) AS n FROM windows JOIN again USING (r, g), (SELECT unnest(range(0, 5)) AS j) o GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
 CAST(len(lines) AS BIGINT) AS n_lines,
 CAST(len(list_filter(range(1, greatest(len(words), 1)), lambda i: words[i] = words[i + 1])) AS BIGINT) AS n_stutter,
 CAST(length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper,
 CAST(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS BIGINT) AS n_letters
 FROM w LEFT JOIN covered c USING (r)),
f AS (SELECT *, n_words < 10 AS few, 100 * n_repeat_words > 20 * n_words AS repeated, 4 * n_symbols > n_words AS symbols,
 n_words > 0 AND (word_chars > 20 * n_words OR word_chars < 2 * n_words) AS wordlength,
 n_lines >= 4 AND 2 * n_dup_lines > n_lines AS lines, 10 * n_stutter > 3 * n_words AS stutter,
 n_letters > 0 AND 2 * n_upper > n_letters AS capitals FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR repeated AS base_failed,
 NOT (few OR repeated OR symbols OR wordlength OR lines OR stutter OR capitals) AS kept, n_lines, n_stutter, n_upper, n_letters,
 CAST(CAST(few AS INT) + 2 * CAST(repeated AS INT) + 4 * CAST(symbols AS INT) + 8 * CAST(wordlength AS INT) + 16 * CAST(lines AS INT)
  + 32 * CAST(stutter AS INT) + 64 * CAST(capitals AS INT) AS INT) AS failed_bits,
 NOT (few OR repeated) AS kept_base, NOT (few OR repeated OR symbols OR stutter) AS kept_v1,
 NOT (few OR repeated OR symbols OR wordlength OR lines OR stutter OR capitals) AS kept_v2, lone_rule,
 CASE WHEN lone_rule IS NOT NULL THEN count(*) OVER (PARTITION BY lone_rule) END AS lone_rejects
FROM (SELECT *, CASE WHEN CAST(few AS INT) + CAST(repeated AS INT) + CAST(symbols AS INT) + CAST(wordlength AS INT) + CAST(lines AS INT)
  + CAST(stutter AS INT) + CAST(capitals AS INT) = 1 THEN CASE WHEN few THEN 'few_words' WHEN repeated THEN 'repeated_windows' WHEN symbols THEN 'many_symbols'
  WHEN wordlength THEN 'word_length' WHEN lines THEN 'duplicate_lines' WHEN stutter THEN 'stutter' ELSE 'capitals' END END AS lone_rule FROM f) v"""


# CRC-32 of an id's digits, a bit at a time: a byte is put in, then eight steps of -1 follow.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(s) + 1),
 lambda i: list_prepend(ascii(substr(s, i, 1))::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
 lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"""

LANGUAGE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(({CRC}) % 3 = 1, false) AS held_out, s, text FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents) x),
t AS (SELECT r, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) AS t FROM d),
g AS (SELECT r, substr(t, CAST(k AS BIGINT), n) AS g FROM (SELECT r, ' ' || t || ' ' AS t, unnest(range(1, length(t) + 3)) AS k FROM t WHERE t <> '') x,
  (SELECT unnest([1, 2, 3]) AS n) y WHERE k + n <= length(t) + 1 AND substr(t, CAST(k AS BIGINT), n) <> ' '),
own AS (SELECT r, g, count(*) AS n, row_number() OVER (PARTITION BY r ORDER BY count(*) DESC, length(g), g) - 1 AS place FROM g GROUP BY r, g QUALIFY place < 400),
learnt AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, length(g), g) - 1 AS place
  FROM g JOIN d USING (r) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, g QUALIFY place < 400),
langs AS (SELECT DISTINCT lang FROM learnt),
apart AS (SELECT o.r, l.lang, CAST(sum(coalesce(abs(p.place - o.place), 400)) AS BIGINT) AS distance, count(*) AS n
  FROM own o CROSS JOIN langs l LEFT JOIN learnt p ON p.lang = l.lang AND p.g = o.g GROUP BY o.r, l.lang),
best AS (SELECT * FROM apart QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, lang) = 1)
SELECT d.doc_id, d.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - CAST(b.distance AS DOUBLE) / (400 * b.n), 0.0::DOUBLE) AS score
FROM d LEFT JOIN best b USING (r)"""

# Runs by their definition: pairs of equal five-word stretches lie on diagonals, an unbroken diagonal is a stretch
# with a period, and of stretches with several periods the smallest counts.
RUNS = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words, CAST(doc_id AS VARCHAR) AS s FROM documents),
h AS (SELECT r, doc_id, words, len(words) AS n, coalesce(CAST({CRC} AS BIGINT), 1) AS h FROM w),
g AS (SELECT *, (h // 10) % n AS a, (h // 10) % 8 AS e FROM h WHERE n > 0),
p AS (SELECT *, 1 + (n - a) // (3 + e) AS p FROM g),
u AS (SELECT r, n, unnest(words) AS word, unnest(range(n)) AS i, CASE WHEN h % 10 = 0 THEN p ELSE n END AS p, CASE WHEN h % 10 = 0 THEN a ELSE 0 END AS a FROM p),
v AS (SELECT r, n, i, CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS j FROM u),
d AS (SELECT v.r, v.i, u.word FROM v JOIN u ON u.r = v.r AND u.i = v.j),
f AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS five FROM d WINDOW o AS (PARTITION BY r ORDER BY i)),
pairs AS (SELECT b.r, b.i AS k, b.i - c.i AS q FROM f b JOIN f c ON b.r = c.r AND b.five = c.five AND b.i > c.i),
islands AS (SELECT r, q, k, k - row_number() OVER (PARTITION BY r, q ORDER BY k) AS island FROM pairs),
stretches AS (SELECT r, q, min(k) - q AS start, count(*) + 4 + q AS length FROM islands GROUP BY r, q, island),
runs AS (SELECT * FROM stretches t WHERE length >= greatest(6, 4 * q)
  AND NOT EXISTS (SELECT 1 FROM stretches o WHERE o.r = t.r AND o.q < t.q AND o.start <= t.start AND o.start + o.length >= t.start + t.length)),
told AS (SELECT r, count(*) AS n_runs, max(struct_pack(l := length, s := -start, q := -q)) AS best,
  string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs),
stay AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM d ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.l AS length, -best.q AS period, 1000 * best.l // -best.q AS exponent_milli,
 sha256(coalesce(lines, '')) AS runs_sha256,
 sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN told USING (r) LEFT JOIN stay USING (r)"""

ORACLES = {"op1_language_id": LANGUAGE, "op7_quality_rules": QUALITY, "op13_periodic_runs": RUNS}
