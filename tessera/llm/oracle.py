"""DuckDB SQL of the queries of this subpackage that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {}

ORACLE["op2_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(it, ',' ORDER BY it) AS its
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS it FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
""".replace("LOWERED", _LOWER.format("text"))

_SHINGLES = r"""
d AS (SELECT doc_id, regexp_extract_all(LOWERED, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d
),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
    FROM t x JOIN t y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2)
  WHERE 100 * c >= 80 * (na + nb - c)
),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
""".replace("LOWERED", _LOWER.format("text"))

ORACLE["op3_ngram_join"] = "WITH RECURSIVE " + _SHINGLES + """
, cls AS (SELECT list_sort(s) AS k, min(doc_id) AS class_id FROM s WHERE len(s) > 0 GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(low.m, s.doc_id)) AS component_id, cls.class_id
FROM s LEFT JOIN low USING (doc_id) LEFT JOIN cls ON list_sort(s.s) = cls.k
"""

#: Lines to remove of a view {docs}: (doc_id, line), line numbers from 0.
LINES_GONE = r"""
l0 AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM {docs}),
l AS (SELECT doc_id, line, regexp_extract_all(LOWERED, '[^\x20\x09-\x0D]+') AS w FROM l0),
ls AS (
  SELECT doc_id, line, w, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM l WHERE len(w) >= 5
),
firsts AS (SELECT min(doc_id * 100000000 + line) AS k, any_value(s) AS s FROM ls GROUP BY w),
lt AS (SELECT k, len(s) AS n, unnest(s) AS sh FROM firsts),
near AS (
  SELECT DISTINCT b FROM (
    SELECT x.k AS a, y.k AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
    FROM lt x JOIN lt y ON x.sh = y.sh AND x.k < y.k GROUP BY 1, 2)
  WHERE 100 * c >= 80 * (na + nb - c)
),
gone AS (
  SELECT doc_id, line FROM ls WHERE doc_id * 100000000 + line NOT IN (SELECT k FROM firsts)
  UNION SELECT b // 100000000, b % 100000000 FROM near
)
""".replace("LOWERED", "lower(t)")

ORACLE["op7_line_dedup"] = "WITH " + LINES_GONE.replace("{docs}", "documents") + """
, kept AS (SELECT l0.doc_id, string_agg(t, chr(10) ORDER BY l0.line) AS text FROM l0 ANTI JOIN gone USING (doc_id, line) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CASE WHEN n.n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE["op13_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(LOWERED, 'TERM') AS w FROM documents
), tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
size AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
b AS (
  SELECT item_id, t, count(*) AS c
  FROM (SELECT item_id, unnest(regexp_extract_all(LOWERED, 'TERM')) AS t FROM benchmark) GROUP BY ALL
),
bw AS (SELECT item_id, t, c * CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM b JOIN df USING (t), size),
s AS (
  SELECT item_id, doc_id, r, CAST(sum(bw.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * n) // l)))) AS BIGINT) AS score
  FROM bw JOIN tf USING (t) JOIN d USING (r), size GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
""".replace("LOWERED", _LOWER.format("text")).replace("TERM", _TERM)
