"""SQL for the queries whose results SQL can state."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {}

ORACLE["op6_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT r, unnest(range(1, len(w) - 6)) AS p, w FROM d WHERE len(w) >= 8
), s AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, list_slice(w, p, p + 7)) AS c FROM g
), f AS (
  SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM s WHERE c > 1
), e AS (
  SELECT r, sum(least(8, p - coalesce(q, p - 8))) AS n FROM f GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN e USING (r)
), b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
           + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
           + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
           + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
           + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END
           + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed = 0 AS kept, failed
FROM b
"""

ORACLE["op8_source_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         2.0::DOUBLE * sum(size)::DOUBLE AS cap
  FROM d GROUP BY source
), a AS (
  SELECT s.source, s.source_size, s.w, s.cap,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
          - coalesce(sum(o.cap) FILTER (o.cap / o.w < s.cap / s.w), 0))
         / ((SELECT sum(w) FROM s) - coalesce(sum(o.w) FILTER (o.cap / o.w < s.cap / s.w), 0)) AS level
  FROM s, s AS o GROUP BY ALL
), l AS (
  SELECT min(level) AS level FROM a
  WHERE cap / w >= level AND cap / w = (SELECT min(cap / w) FROM a WHERE cap / w >= level)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l) * w, cap)) AS target
  FROM s
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.*, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS same
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), k AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE whole + CASE
         WHEN upto <= rest THEN 1
         WHEN upto - same <= rest AND 2 * (rest - upto + same) >= same THEN 1 ELSE 0 END END AS n
  FROM c
)
SELECT doc_id, size, source_size, target, (n * size)::BIGINT AS taken, n::BIGINT AS copies FROM k
"""

ORACLE["op7_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, list_slice(w, p, p + 4) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id
"""

ORACLE["op5_substring_dedup"] = rf"""
WITH d AS (
  SELECT doc_id, {WORDS} AS w FROM documents
), g AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50
), s AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY list_slice(w, p, p + 49)) AS first FROM g
), r AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM s WHERE first < doc_id
), k AS (
  SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id
), x AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
         CASE WHEN gone IS NULL THEN w
              ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END AS kept
  FROM d LEFT JOIN k USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM x
"""

ORACLE["op9_vector_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
         sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT c.a AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, c.a = component_id AS kept
FROM c LEFT JOIN n ON n.a = c.a
"""

ASCII_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op11_benchmark_decontamination"] = rf"""
WITH i AS (
  SELECT item_id, regexp_extract_all({ASCII_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), x AS (
  SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p
  FROM i WHERE len(w) > 0
), g AS (
  SELECT DISTINCT list_slice(w, p, p + k - 1) AS g, k, item_id FROM x
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all({ASCII_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), p AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k
), h AS (
  SELECT doc_id, p, p.k, item_id FROM p JOIN g ON list_slice(w, p, p + p.k - 1) = g.g
), n AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) FROM h) GROUP BY doc_id
), l AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit,
       coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)
"""

_TERMS = rf"regexp_extract_all({ASCII_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE["op12_ranked_search"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce({_TERMS}, []) AS t FROM documents
), s AS (
  SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0
), p AS (
  SELECT doc_id, any_value(len(t))::BIGINT AS n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY doc_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM p, s GROUP BY term
), q AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term
), r AS (
  SELECT item_id, doc_id, sum(times * w * (
    (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * p.n * s.n) // s.l))
  ))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id
), o AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""

ORACLE["op13_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
