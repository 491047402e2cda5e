"""SQL that the queries are checked against, written apart from the operators."""

from __future__ import annotations

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN component USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

# The rate of one rule is 0.02 / 6; the level of one test is 0.05 / (strata x 6), strata that have good labels.
OP7 = r"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id
), s AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
    length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
    length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits,
    len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [n_symbols / greatest(word_chars, 1), n_capitals / greatest(word_chars, 1), n_marks / greatest(word_chars, 1),
     n_digits / greatest(word_chars, 1), n_repeat_words / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1)] AS x
  FROM s
), good AS (
  SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), labelled AS (
  SELECT coalesce(lang, '?') AS stratum, x FROM judged JOIN good USING (doc_id) WHERE NOT base_failed
), grid AS (
  SELECT CAST(i AS DOUBLE) / 100 AS c FROM range(1, 20) r(i) UNION ALL SELECT CAST(i AS DOUBLE) / 20 FROM range(4, 20) r(i)
), rules AS (SELECT i AS r FROM range(1, 7) t(i)),
above AS (
  SELECT stratum, r, c, count(*) AS n, count(*) FILTER (x[r] > c) AS k FROM labelled, rules, grid GROUP BY stratum, r, c
), tests AS (SELECT 6 * count(DISTINCT stratum) AS m FROM labelled),
proven AS (
  SELECT stratum, r, min(c) AS cut FROM above, tests
  WHERE k <= n * (0.02 / 6) AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
    + j * ln(CAST(0.02 AS DOUBLE) / 6) + (n - j) * ln(1 - CAST(0.02 AS DOUBLE) / 6)))) <= CAST(0.05 AS DOUBLE) / m
  GROUP BY stratum, r
), broken AS (
  SELECT DISTINCT doc_id FROM judged JOIN proven ON coalesce(lang, '?') = stratum AND x[r] > cut
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept
FROM judged
"""

# CRC-32 by its rule: a table of 256 remainders, then one step a byte, once for each distinct word.
OP11 = r"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT CAST(i AS UBIGINT), CAST(i AS UBIGINT), 0 FROM range(256) g(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), lists AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), words AS (SELECT side, id, unnest(words) AS word FROM lists),
hashed AS (
  SELECT word, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
      list_transform(range(CAST(len(hex(word)) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(word), 2 * i + 1, 2) AS UBIGINT))),
      lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 10000 AS BIGINT) AS bucket
  FROM (SELECT DISTINCT word FROM words), crc_table
), counts AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words JOIN hashed USING (word) GROUP BY bucket
), sums AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM counts, sums
), weights AS (
  SELECT id, count(*) AS n, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight
  FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights ON doc_id = id
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n_long FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n_long // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM lists, range(1, 5) g(size) WHERE len(w) >= size
), f AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE f >= 30),
cuts AS (
  SELECT lang, size, phrase, f, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM often, range(1, 4) g(k) WHERE k < size
), cut_scores AS (
  SELECT c.lang, c.size, c.phrase, c.f AS a, k, h.f AS l, t.f AS r, CAST((CAST(c.f AS HUGEINT) * 2000000) // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
  FROM cuts c JOIN f h ON c.lang = h.lang AND c.head = h.phrase JOIN f t ON c.lang = t.lang AND c.tail = t.phrase
), lowest AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT o.lang, array_to_string(string_split(o.phrase, ' ')[i:i + s - 1], ' ') AS phrase, o.f
  FROM often o, range(2, 4) g(s), range(1, 4) h(i) WHERE o.size > s AND i + s - 1 <= o.size
), kept AS (
  SELECT * FROM lowest l0 WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = l0.lang AND i.phrase = l0.phrase AND CAST(i.f AS HUGEINT) * 100 >= CAST(l0.a AS HUGEINT) * 80)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept
) JOIN n USING (lang) WHERE rank <= 2000
"""
