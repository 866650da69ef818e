"""DuckDB oracle SQL, written independently of the Spark plans.

Tables `documents conversations labels embeddings events pages benchmark ...`
are views over the same parquet files.  The derived views of the fixtures are
CTEs here; each query string carries only the CTEs it needs.
"""

from __future__ import annotations

import math

# ------------------------------------------------------------------ view CTEs
VIEWS = {
    "corpus_base": r"""
corpus_base AS (
  SELECT doc_id, text, lang AS language, source, n_chars,
         CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words,
         CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation'
              ELSE 'test' END AS split
  FROM documents)""",
    "corpus_edges": r"""
corpus_edges AS (SELECT quantile_cont(n_words, [0.25, 0.5, 0.75]) AS e FROM corpus_base)""",
    "corpus": r"""
corpus AS (
  SELECT b.*, ['short', 'short', 'medium', 'long'][1 + (n_words >= e[1])::INT
         + (n_words >= e[2])::INT + (n_words >= e[3])::INT] AS length
  FROM corpus_base b, corpus_edges)""",
    "pairs": r"""
pairs AS (
  SELECT a.conv_id, a.turn, u.text AS input, a.text AS target
  FROM conversations a JOIN conversations u
    ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
  WHERE a.role = 'assistant' AND u.role = 'user')""",
    "pred_ref": r"""
pred_ref AS (
  SELECT conv_id, turn, input,
         array_to_string(list_filter(toks, lambda x, i: (i - 1) % 7 <> 3), ' ') AS pred,
         array_to_string(toks, ' ') AS ref
  FROM (SELECT *, regexp_extract_all(target, '\S+') AS toks FROM pairs))""",
    "pr_tok": r"""
pr_tok AS (
  SELECT conv_id, turn, regexp_extract_all(pred, '\S+') AS h,
         regexp_extract_all(ref, '\S+') AS r FROM pred_ref)""",
    "dist": r"""
dist AS (
  SELECT vec_id, CAST(i - 1 AS INTEGER) AS token,
         10.0 * CAST(embedding[i] AS DOUBLE) AS logit, label AS target
  FROM embeddings, range(1, len(embedding) + 1) AS t(i))""",
    "tasks": r"""
tasks AS (
  SELECT task_id, ['assert easy(' || task_id || ')', 'assert easy_long(' || task_id || ')'] AS test_list,
         ['assert hard(' || task_id || ')', 'assert hard_quality(' || task_id || ')',
          'assert hard_en(' || task_id || ')'] AS challenge_test_list
  FROM (SELECT DISTINCT source AS task_id FROM documents
        UNION ALL SELECT 'no_candidate_1' UNION ALL SELECT 'no_candidate_2'))""",
    "attempts": r"""
attempts AS (
  SELECT d.source AS task_id, l.doc_id AS candidate, CAST(l.quality AS INTEGER) AS easy_pass,
         CAST(1 - l.toxic AS INTEGER) AS hard_pass
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)""",
    "pair_loss": r"""
plp AS (SELECT vec_id, max(logit) FILTER (WHERE token = target) - (max(logit) + ln(sum(exp(logit - mx)))) AS logprob
        FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS mx FROM dist) GROUP BY vec_id),
pair_loss AS (SELECT p.conv_id, p.turn, -plp.logprob AS loss FROM pairs p JOIN plp ON plp.vec_id = p.conv_id)""",
    "pr_mix": r"""
pr_mix AS (SELECT * FROM pr_class UNION ALL SELECT * REPLACE ('mix' AS length) FROM pr_class)""",
    "vocab": r"""
vtok AS (
  SELECT t AS token, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS t FROM corpus WHERE split = 'train')
  GROUP BY t),
vtop AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS token_id
  FROM vtok QUALIFY token_id <= 32767),
vbase AS (SELECT 0 AS token_id, '<UNK>' AS token UNION ALL SELECT token_id, token FROM vtop),
vocab AS (
  SELECT CAST(token_id AS INTEGER) AS token_id, token, false AS special FROM vbase
  UNION ALL
  SELECT CAST(m + k AS INTEGER), t, s
  FROM (SELECT max(token_id) AS m FROM vbase),
       (VALUES (1, '<MASK>', true), (2, '<PAD>', true), (3, '<BOS>', true), (4, '<EOS>', true),
               (5, '<NEW_LINE>', false)) v(k, t, s)),
sid AS (
  SELECT max(token_id) FILTER (WHERE token = '<PAD>') AS pad_id,
         max(token_id) FILTER (WHERE token = '<EOS>') AS eos_id FROM vocab)""",
    "spans": r"""
dlines AS (
  SELECT doc_id, text, i - 1 AS line_no, ls[i] AS line
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
       range(1, len(ls) + 1) AS t(i)),
spans AS (
  SELECT doc_id, text, line_no, line, CAST(length(line) AS BIGINT) AS span_len,
         CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(line) - 1 AS BIGINT) AS start
  FROM dlines),
span_tok AS (
  SELECT doc_id, line_no, CAST(len(regexp_extract_all(line, '\S+')) AS BIGINT) AS n_tokens
  FROM spans WHERE span_len > 0)""",
    "enc_pairs": r"""
in_tok AS (
  SELECT conv_id, turn, i, toks[i] AS token
  FROM (SELECT conv_id, turn, regexp_extract_all(input, '\S+')[1:512] AS toks FROM pairs),
       range(1, len(toks) + 1) AS t(i)),
in_ids AS (
  SELECT a.conv_id, a.turn, list(coalesce(v.token_id, 0) ORDER BY a.i) AS ids
  FROM in_tok a LEFT JOIN vocab v ON v.token = a.token GROUP BY a.conv_id, a.turn),
lab_tok AS (
  SELECT conv_id, turn, i, toks[i] AS token
  FROM (SELECT conv_id, turn,
               list_concat(list_concat(['<BOS>'], regexp_extract_all(target, '\S+')), ['<EOS>'])[1:128] AS toks
        FROM pairs),
       range(1, len(toks) + 1) AS t(i)),
lab_ids AS (
  SELECT a.conv_id, a.turn, list(coalesce(v.token_id, 0) ORDER BY a.i) AS ids
  FROM lab_tok a LEFT JOIN vocab v ON v.token = a.token GROUP BY a.conv_id, a.turn),
enc AS (
  SELECT p.conv_id, p.turn, coalesce(i.ids, []::INTEGER[]) AS input_ids,
         list_transform(coalesce(i.ids, []::INTEGER[]), lambda x: 1) AS attention_mask,
         coalesce(l.ids, []::INTEGER[]) AS labels
  FROM pairs p LEFT JOIN in_ids i USING (conv_id, turn) LEFT JOIN lab_ids l USING (conv_id, turn))""",
    "padded": r"""
bat AS (
  SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 32 AS batch_id FROM enc),
wid AS (
  SELECT *, CAST(ceil(max(len(input_ids)) OVER (PARTITION BY batch_id) / 8) * 8 AS INTEGER) AS wi,
         CAST(ceil(max(len(labels)) OVER (PARTITION BY batch_id) / 8) * 8 AS INTEGER) AS wl
  FROM bat),
padded AS (
  SELECT conv_id, turn, CAST(batch_id AS BIGINT) AS batch_id, pad_id,
    list_concat(input_ids, list_transform(range(wi - len(input_ids)), lambda x: pad_id)) AS input_ids,
    list_concat(attention_mask, list_transform(range(wi - len(attention_mask)), lambda x: 0)) AS attention_mask,
    list_concat(labels, list_transform(range(wl - len(labels)), lambda x: pad_id)) AS labels
  FROM wid, sid)""",
    "pr_class": r"""
pr_n AS (SELECT *, len(regexp_extract_all(ref, '\S+')) AS rn FROM pred_ref),
pr_e AS (SELECT quantile_cont(rn, [0.25, 0.5, 0.75]) AS e FROM pr_n),
pr_class AS (
  SELECT pr_n.*, ['short', 'short', 'medium', 'long'][1 + (rn >= e[1])::INT + (rn >= e[2])::INT
         + (rn >= e[3])::INT] AS length
  FROM pr_n, pr_e)""",
    "doc_ids": r"""
dtok AS (
  SELECT split, length, language, unnest(regexp_extract_all(text, '\S+')) AS token
  FROM corpus WHERE split IN ('train', 'test')),
doc_ids AS (
  SELECT split, length, language, coalesce(v.token_id, 0) AS token_id
  FROM dtok LEFT JOIN vocab v USING (token)),
freq_sl AS (
  SELECT g.split, g.length, v.token_id, CAST(coalesce(c.n, 0) + 1 AS BIGINT) AS n
  FROM (SELECT DISTINCT split, length FROM doc_ids) g CROSS JOIN vocab v
  LEFT JOIN (SELECT split, length, token_id, count(*) AS n FROM doc_ids GROUP BY ALL) c
    ON c.split = g.split AND c.length = g.length AND c.token_id = v.token_id)""",
    "step_log": r"""
step_log AS (
  SELECT user_id % 4 AS run, CAST(day(ts) AS INTEGER) AS epoch, event_id AS step,
         event_type AS metric, value, 1 + event_id % 8 AS batch_size
  FROM events)""",
}

# Dependencies between the view CTEs.
DEPS = {
    "corpus": ["corpus_base", "corpus_edges"],
    "corpus_edges": ["corpus_base"],
    "pred_ref": ["pairs"],
    "pr_tok": ["pred_ref"],
    "vocab": ["corpus"],
    "enc_pairs": ["pairs", "vocab"],
    "padded": ["enc_pairs"],
    "pr_class": ["pred_ref"],
    "pr_mix": ["pr_class"],
    "pair_loss": ["pairs", "dist"],
    "doc_ids": ["corpus", "vocab"],
}


def with_views(*names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "WITH " + ",".join(VIEWS[n] for n in order)


def _r(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


# --------------------------------------------------------------------- BLEU
_NG = r"""
grams AS (
  SELECT conv_id, turn, 0 AS side, n, list_slice(h, i, i + n - 1) AS gram
  FROM pr_tok, range(1, 5) AS o(n), range(1, len(h) - n + 2) AS s(i)
  UNION ALL
  SELECT conv_id, turn, 1 AS side, n, list_slice(r, i, i + n - 1) AS gram
  FROM pr_tok, range(1, 5) AS o(n), range(1, len(r) - n + 2) AS s(i)),
cnt AS (
  SELECT conv_id, turn, n, gram, count(*) FILTER (WHERE side = 0) AS ch,
         count(*) FILTER (WHERE side = 1) AS cr
  FROM grams GROUP BY ALL)"""

_BLEU_TAIL = """
SELECT {keys}
  CASE WHEN least(p1, p2, p3, p4) > 0
       THEN exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) * bp ELSE 0.0 END AS bleu,
  bp AS brevity_penalty, t1 AS translation_length, rlen AS reference_length
FROM (
  SELECT {keys} p1, p2, p3, p4, t1, rlen,
    CASE WHEN t1 > rlen THEN 1.0 WHEN t1 = 0 THEN 0.0 ELSE exp(1 - rlen / t1) END AS bp
  FROM (
    SELECT {keys}
      CASE WHEN t1 > 0 THEN m1 / t1 ELSE 0 END AS p1, CASE WHEN t2 > 0 THEN m2 / t2 ELSE 0 END AS p2,
      CASE WHEN t3 > 0 THEN m3 / t3 ELSE 0 END AS p3, CASE WHEN t4 > 0 THEN m4 / t4 ELSE 0 END AS p4,
      CAST(t1 AS BIGINT) AS t1, CAST(rlen AS BIGINT) AS rlen
    FROM (
      SELECT {keys}
        coalesce(sum(m) FILTER (WHERE n = 1), 0)::DOUBLE AS m1, coalesce(sum(th) FILTER (WHERE n = 1), 0)::DOUBLE AS t1,
        coalesce(sum(m) FILTER (WHERE n = 2), 0)::DOUBLE AS m2, coalesce(sum(th) FILTER (WHERE n = 2), 0)::DOUBLE AS t2,
        coalesce(sum(m) FILTER (WHERE n = 3), 0)::DOUBLE AS m3, coalesce(sum(th) FILTER (WHERE n = 3), 0)::DOUBLE AS t3,
        coalesce(sum(m) FILTER (WHERE n = 4), 0)::DOUBLE AS m4, coalesce(sum(th) FILTER (WHERE n = 4), 0)::DOUBLE AS t4,
        coalesce(sum(tr) FILTER (WHERE n = 1), 0)::DOUBLE AS rlen
      FROM stats {group})))"""

oracle("bleu_corpus", with_views("pr_tok") + "," + _NG + r""",
stats AS (SELECT n, sum(least(ch, cr)) AS m, sum(ch) AS th, sum(cr) AS tr FROM cnt GROUP BY n),
res AS (""" + _BLEU_TAIL.format(keys="", group="") + r""")
SELECT """ + ", ".join([_r("bleu") + " AS bleu", _r("brevity_penalty") + " AS brevity_penalty",
                       "translation_length", "reference_length"]) + " FROM res")

oracle("bleu_macro_vs_corpus", with_views("pr_tok") + "," + _NG + r""",
stats AS (SELECT n, sum(least(ch, cr)) AS m, sum(ch) AS th, sum(cr) AS tr FROM cnt GROUP BY n),
pstats AS (SELECT conv_id, turn, n, sum(least(ch, cr)) AS m, sum(ch) AS th, sum(cr) AS tr
           FROM cnt GROUP BY conv_id, turn, n),
corp AS (""" + _BLEU_TAIL.format(keys="", group="") + r"""),
per AS (""" + _BLEU_TAIL.format(keys="conv_id, turn,", group="GROUP BY conv_id, turn").replace(
    "FROM stats", "FROM pstats") + r""")
SELECT """ + _r("avg(per.bleu)") + r""" AS bleu_macro, count(*) AS n_pairs,
       """ + _r("any_value(corp.bleu)") + r""" AS bleu_corpus
FROM per, corp""")

# --------------------------------------------------------------------- chrF
oracle("chrf_corpus", with_views("pred_ref") + r""",
s AS (SELECT conv_id, turn, regexp_replace(pred, '\s+', '', 'g') AS h,
             regexp_replace(ref, '\s+', '', 'g') AS r FROM pred_ref),
grams AS (
  SELECT conv_id, turn, 0 AS side, n, substring(h, i, n) AS gram
  FROM s, range(1, 7) AS o(n), range(1, length(h) - n + 2) AS q(i)
  UNION ALL
  SELECT conv_id, turn, 1 AS side, n, substring(r, i, n) AS gram
  FROM s, range(1, 7) AS o(n), range(1, length(r) - n + 2) AS q(i)),
cnt AS (SELECT conv_id, turn, n, gram, count(*) FILTER (WHERE side = 0) AS ch,
               count(*) FILTER (WHERE side = 1) AS cr FROM grams GROUP BY ALL),
st AS (SELECT n, sum(least(ch, cr))::DOUBLE AS m, sum(ch)::DOUBLE AS th, sum(cr)::DOUBLE AS tr
       FROM cnt GROUP BY n),
pr AS (SELECT sum(m / th) FILTER (WHERE th > 0 AND tr > 0) AS sp,
              sum(m / tr) FILTER (WHERE th > 0 AND tr > 0) AS sr,
              count(*) FILTER (WHERE th > 0 AND tr > 0) AS eff FROM st)
SELECT """ + _r("""CASE WHEN eff = 0 OR sp + sr = 0 THEN 0.0
  ELSE 5 * (sp / eff) * (sr / eff) / (4 * (sp / eff) + (sr / eff)) * 100.0 END""") + " AS chrf FROM pr")

# ------------------------------------------------------------------ exact match
oracle("exact_match", with_views("pred_ref") + r"""
SELECT """ + _r("avg(CAST(pred = ref AS DOUBLE))") + r""" AS exact_match, count(*) AS n_pairs
FROM pred_ref""")

# ------------------------------------------------------------ edit distance
# The DP table of (h, r) by anti-diagonals in a recursive CTE: p1 holds the
# cells with i + j = s, p2 those before (element i + 1 is row i).  A cell needs
# only those two lists, so no prefix scan is needed and any number of distinct
# tokens works.
def _antidiagonals(name: str, src: str, h: str, r: str, edge_h: str, edge_r: str, cell: str, out: str) -> str:
    return f""",
{name} AS MATERIALIZED (
  WITH RECURSIVE d(conv_id, turn, k, s, p1, p2) AS (
    SELECT conv_id, turn, k, 0, list_transform(range(0, len({h}) + 1), lambda x: CASE WHEN x = 0 THEN 0 END),
           list_transform(range(0, len({h}) + 1), lambda x: CAST(NULL AS INTEGER)) FROM {src}
    UNION ALL
    SELECT d.conv_id, d.turn, d.k, d.s + 1,
      list_transform(range(0, len(p.{h}) + 1), lambda i:
        CASE WHEN d.s + 1 - i < 0 OR d.s + 1 - i > len(p.{r}) THEN NULL
             WHEN i = 0 THEN {edge_r} WHEN i = d.s + 1 THEN {edge_h}
             ELSE {cell} END),
      d.p1
    FROM d JOIN {src} p USING (conv_id, turn, k)
    WHERE d.s < len(p.{h}) + len(p.{r}))
  SELECT d.conv_id, d.turn, d.k, CAST(d.p1[len(p.{h}) + 1] AS BIGINT) AS {out}
  FROM d JOIN {src} p USING (conv_id, turn, k) WHERE d.s = len(p.{h}) + len(p.{r}))"""


_ED_CELL = ("least(d.p1[i] + 1, d.p1[i + 1] + 1, "
            "d.p2[i] + CASE WHEN p.{h}[i] = p.{r}[d.s + 1 - i] THEN 0 ELSE 1 END)")
_LCS_CELL = ("CASE WHEN p.{h}[i] = p.{r}[d.s + 1 - i] THEN d.p2[i] + 1 "
             "ELSE greatest(d.p1[i], d.p1[i + 1]) END")


def _edit_distance(name: str, src: str, h: str, r: str, out: str) -> str:
    return _antidiagonals(name, src, h, r, "i", "d.s + 1", _ED_CELL.format(h=h, r=r), out)


_ED = """,
pe AS (SELECT *, 0 AS k FROM pr_tok)""" + _edit_distance("de", "pe", "h", "r", "d") + """,
ed AS (SELECT p.conv_id, p.turn, de.d, len(p.h) AS lh, len(p.r) AS lr FROM pe p JOIN de USING (conv_id, turn, k))"""

oracle("token_edit_distance", with_views("pr_tok") + _ED + r"""
SELECT conv_id, turn, d AS edit_distance,
       """ + _r("CASE WHEN greatest(lh, lr) = 0 THEN 1.0 ELSE 1 - d / greatest(lh, lr) END") + r""" AS similarity
FROM ed""")

oracle("edit_similarity", with_views("pr_tok") + _ED + r"""
SELECT """ + _r("avg(CASE WHEN greatest(lh, lr) = 0 THEN 1.0 ELSE 1 - d / greatest(lh, lr) END)") + r"""
         AS edit_similarity, CAST(sum(d) AS BIGINT) AS edit_distance_total
FROM ed""")

# ------------------------------------------------------------------- METEOR
oracle("meteor_exact", with_views("pred_ref") + r""",
t AS (SELECT conv_id, turn, regexp_extract_all(lower(pred), '\S+') AS h,
             regexp_extract_all(lower(ref), '\S+') AS r FROM pred_ref),
hw AS (SELECT conv_id, turn, i - 1 AS hp, h[i] AS w FROM t, range(1, len(h) + 1) AS q(i)),
rw AS (SELECT conv_id, turn, i - 1 AS rp, r[i] AS w FROM t, range(1, len(r) + 1) AS q(i)),
hk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY hp DESC) AS k FROM hw),
rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY rp DESC) AS k FROM rw),
m AS (SELECT hk.conv_id, hk.turn, hp, rp FROM hk JOIN rk USING (conv_id, turn, w, k)),
c AS (SELECT conv_id, turn,
        CASE WHEN lag(hp) OVER (PARTITION BY conv_id, turn ORDER BY hp) = hp - 1
              AND lag(rp) OVER (PARTITION BY conv_id, turn ORDER BY hp) = rp - 1 THEN 0 ELSE 1 END AS nc
      FROM m),
per AS (SELECT conv_id, turn, count(*) AS mm, sum(nc) AS ch FROM c GROUP BY ALL),
sc AS (SELECT t.conv_id, t.turn, len(h) AS hl, len(r) AS rl, coalesce(mm, 0) AS mm, ch
       FROM t LEFT JOIN per USING (conv_id, turn))
SELECT """ + _r("""avg(CASE WHEN mm = 0 OR hl = 0 OR rl = 0 THEN 0.0 ELSE
  (1 - 0.5 * pow(ch / mm, 3)) * ((mm / hl) * (mm / rl) / (0.9 * (mm / hl) + 0.1 * (mm / rl))) END)""") + r""" AS meteor
FROM sc""")

# -------------------------------------------------------------------- ROUGE-L
_LCS = """,
pl AS (SELECT *, 0 AS k FROM pr_tok)""" + _antidiagonals("dl", "pl", "h", "r", "0", "0", _LCS_CELL.format(h="h", r="r"), "l") + """,
lc AS (SELECT p.conv_id, p.turn, len(p.h) AS lh, len(p.r) AS lr, dl.l FROM pl p JOIN dl USING (conv_id, turn, k))"""

oracle("rouge_l", with_views("pr_tok") + _LCS + r"""
SELECT """ + _r("""avg(CASE WHEN l = 0 THEN 0.0 ELSE
  2 * (l / lh) * (l / lr) / ((l / lh) + (l / lr)) END)""") + r""" AS rouge_l,
  CAST(sum(l) AS BIGINT) AS lcs_total
FROM lc""")

BOOTSTRAP_REPLICATES = 1000
# Distribution function of Poisson(1) in units of 2^-32, as hex.
POISSON_HEX = [f"{int(2 ** 32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))):08x}" for k in range(12)]
POISSON_HEX = [x for x in POISSON_HEX if x < "ffffffff"]

oracle("rouge_l_bootstrap", with_views("pr_tok") + _LCS + f""",
f AS (SELECT concat_ws('-', conv_id, turn) AS key, CASE WHEN l = 0 THEN 0.0 ELSE 2 * l / (lh + lr) END AS f FROM lc),
d AS (SELECT f, four, md5(concat_ws('-', key, '0', four)) AS hx FROM f, range(0, {BOOTSTRAP_REPLICATES // 4}) t(four)),
u AS (SELECT f, four * 4 + i AS b, substring(hx, CAST(8 * i + 1 AS INTEGER), 8) AS u FROM d, range(0, 4) s(i)),
w AS (SELECT f, b, {" + ".join(f"CAST(u >= '{x}' AS INTEGER)" for x in POISSON_HEX)} AS w FROM u),
m AS (SELECT b, sum(w * f) / sum(w) AS mean FROM w GROUP BY b HAVING sum(w) > 0),
e AS (SELECT quantile_cont(mean, [0.025, 0.5, 0.975]) AS e, count(*) AS n_replicates FROM m)
SELECT {_r("e[2]")} AS rouge_l_mid, {_r("e[1]")} AS rouge_l_low, {_r("e[3]")} AS rouge_l_high, n_replicates FROM e""")

# ---------------------------------------------------------------------- loss
oracle("masked_nll", with_views("dist") + r""",
lp AS (SELECT vec_id, target,
          max(logit) FILTER (WHERE token = target) - (max(logit) + ln(sum(exp(logit - mx)))) AS logprob
       FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS mx FROM dist) GROUP BY vec_id, target)
SELECT """ + _r("avg(-logprob)") + r""" AS nll, count(*) AS n_tokens FROM lp WHERE target <> 0""")


# =================================================================== S1-S4, P4-P9
_CC = "doc_id, language, length, split, n_words"

oracle("scan_config", with_views("corpus") + f"""
SELECT {_CC} FROM corpus WHERE language = 'en' AND length = 'short'""")

oracle("scan_split", with_views("corpus") + f"""
SELECT {_CC} FROM corpus WHERE split = 'test'""")

oracle("corpus_scan", with_views("corpus") + """
SELECT doc_id, text AS original_method FROM corpus WHERE split = 'train'""")

oracle("scan_tasks", with_views("tasks") + """
SELECT task_id, test_list, challenge_test_list FROM tasks""")

oracle("sample_exact", with_views("corpus") + """
SELECT doc_id, split FROM (
  SELECT doc_id, split,
         row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '-115'), doc_id) - 1 AS r,
         count(*) OVER () AS tot
  FROM corpus WHERE split = 'test')
WHERE r < floor(tot * 0.1)""")

oracle("sample_aligned", with_views("corpus") + """,
idx AS (SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS row_idx FROM corpus),
pos AS (
  SELECT row_idx FROM (
    SELECT row_idx, row_number() OVER (ORDER BY md5(CAST(row_idx AS VARCHAR) || '-115'), row_idx) - 1 AS r,
           count(*) OVER () AS tot
    FROM idx WHERE split = 'test')
  WHERE r < floor(tot * 0.1))
SELECT doc_id, split, row_idx FROM idx WHERE row_idx IN (SELECT row_idx FROM pos)""")

oracle("sample_cap", with_views("corpus") + """
SELECT doc_id, length FROM (
  SELECT doc_id, length,
         row_number() OVER (PARTITION BY length ORDER BY md5(CAST(doc_id AS VARCHAR) || '-115'), doc_id) AS r
  FROM corpus)
WHERE r <= 20""")

oracle("limit_batches", with_views("corpus") + """,
b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM corpus WHERE split = 'test')
SELECT doc_id, CAST(batch_id AS BIGINT) AS batch_id FROM b
WHERE batch_id < floor((SELECT max(batch_id) + 1 FROM b) * 0.5)""")

oracle("head_rows", with_views("corpus") + f"""
SELECT {_CC} FROM corpus ORDER BY doc_id LIMIT 10""")

oracle("point_lookup", with_views("corpus") + """
SELECT doc_id, n_words, row_idx FROM (
  SELECT doc_id, n_words, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM corpus WHERE split = 'test')
WHERE row_idx = 0""")

_BEST = """,
sizes AS (SELECT * FROM (VALUES ('simple', 11), ('medium', 19), ('complex', 45)) s(size, avg_len)),
cand AS (
  SELECT s.doc_id, s.text, s.line_no, s.start, s.span_len, t.n_tokens, z.size,
         row_number() OVER (PARTITION BY s.doc_id, z.size ORDER BY abs(t.n_tokens - z.avg_len), s.line_no) AS r
  FROM spans s JOIN span_tok t USING (doc_id, line_no) CROSS JOIN sizes z),
best AS (SELECT * FROM cand WHERE r = 1)"""

oracle("unpivot_sizes", with_views("spans") + _BEST + """
SELECT d.doc_id, z.size, b.line_no, b.n_tokens,
       substring(b.text, b.start + 1, b.span_len) AS target
FROM documents d CROSS JOIN sizes z LEFT JOIN best b ON b.doc_id = d.doc_id AND b.size = z.size""")

oracle("mask_by_class", with_views("spans") + _BEST + """
SELECT doc_id, size, line_no, n_tokens,
       md5(substring(text, 1, start) || '<MASK>' || substring(text, start + span_len + 1)) AS input_md5,
       substring(text, start + 1, span_len) AS target
FROM best""")

# ======================================================================= T1-T13
# The published pre-token pattern ends in `\s+(?!\S)|\s+`: of a run of white
# space before a word all but the last character come off first.  Without
# look-ahead: put a mark before that last character, which ends `\s+`.
_PRETOK = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+""".replace("'", "''")
_MARKED = r"regexp_replace(text, '(\s)(\S)', chr(1) || '\1\2', 'g')"

oracle("byte_alphabet", r"""
WITH b AS (
  SELECT CAST(range AS INTEGER) AS byte,
         (range BETWEEN 33 AND 126 OR range BETWEEN 161 AND 172 OR range BETWEEN 174 AND 255) AS p
  FROM range(256)),
a AS (
  SELECT byte, CASE WHEN p THEN byte ELSE 256 + CAST(coalesce(count(*) FILTER (WHERE NOT p) OVER (
           ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) END AS code_point
  FROM b),
bs AS (SELECT unnest(regexp_extract_all(hex(text), '..')) AS hh FROM documents),
cnt AS (
  SELECT CAST((instr('0123456789ABCDEF', hh[1]) - 1) * 16 + instr('0123456789ABCDEF', hh[2]) - 1 AS INTEGER) AS byte,
         count(*) AS n FROM bs GROUP BY 1)
SELECT a.byte, CAST(a.code_point AS INTEGER) AS code_point, chr(a.code_point) AS symbol,
       coalesce(cnt.n, 0) AS n_occurrences
FROM a LEFT JOIN cnt USING (byte)""")

oracle("pretokenize", f"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, ps[i] AS piece
FROM (SELECT doc_id, regexp_extract_all({_MARKED}, '{_PRETOK}') AS ps FROM documents), range(1, len(ps) + 1) AS t(i)""")

_WC = f""",
wc AS (
  SELECT w AS word, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all({_MARKED}, '{_PRETOK}')) AS w FROM corpus WHERE split = 'train')
  GROUP BY w)"""

oracle("word_counts", with_views("corpus") + _WC + """
SELECT word, n FROM wc""")

oracle("bpe_pair_counts", with_views("corpus") + _WC + """
SELECT c[i] AS "left", c[i + 1] AS "right", CAST(sum(n) AS BIGINT) AS n
FROM (SELECT n, string_split(word, '') AS c FROM wc), range(1, len(c)) AS t(i)
GROUP BY 1, 2""")

oracle("bpe_decode", with_views("pairs") + """
SELECT conv_id, turn, input AS decoded FROM pairs""")

oracle("vocab_with_specials", with_views("vocab") + """
SELECT token_id, token, special FROM vocab""")

oracle("encode_input", with_views("enc_pairs") + """
SELECT conv_id, turn, input_ids, attention_mask FROM enc""")

oracle("frame_target", with_views("pairs") + """
SELECT conv_id, turn, '<BOS>' || target || '<EOS>' AS framed FROM pairs""")

oracle("encode_labels", with_views("enc_pairs") + """
SELECT conv_id, turn, labels FROM enc""")

oracle("decode_ids", with_views("enc_pairs") + """,
dt AS (
  SELECT e.conv_id, e.turn, i, v.token
  FROM enc e, range(1, len(e.labels) + 1) AS t(i)
  JOIN vocab v ON v.token_id = e.labels[i] AND NOT v.special),
dec AS (SELECT conv_id, turn, string_agg(token, ' ' ORDER BY i) AS text FROM dt GROUP BY ALL)
SELECT p.conv_id, p.turn, coalesce(dec.text, '') AS text FROM pairs p LEFT JOIN dec USING (conv_id, turn)""")

oracle("token_lengths", with_views("pairs") + r"""
SELECT conv_id, turn, CAST(len(regexp_extract_all(input, '\S+')) AS BIGINT) AS n_input_tokens,
       CAST(len(regexp_extract_all(target, '\S+')) AS BIGINT) AS n_target_tokens
FROM pairs""")

# ======================================================================== B1-B7
oracle("batch_assign", with_views("corpus") + """
SELECT doc_id, CAST(r AS BIGINT) AS row_idx, CAST(r // 32 AS BIGINT) AS batch_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM corpus WHERE split = 'test')""")

oracle("batch_shuffled", with_views("corpus") + """
SELECT doc_id, CAST(r AS BIGINT) AS row_idx, CAST(r // 32 AS BIGINT) AS batch_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '-115-0'), doc_id) - 1 AS r
      FROM corpus WHERE split = 'train')""")

oracle("pad_batches", with_views("padded") + """
SELECT conv_id, turn, batch_id, input_ids, attention_mask, labels FROM padded""")

oracle("nonpad_counts", with_views("padded") + """
SELECT conv_id, turn, CAST(len(list_filter(input_ids, lambda x: x <> pad_id)) AS BIGINT) AS n_input,
       CAST(len(list_filter(labels, lambda x: x <> pad_id)) AS BIGINT) AS n_labels,
       CAST(len(list_filter(attention_mask, lambda x: x = 1)) AS BIGINT) AS n_mask
FROM padded""")

oracle("batch_budget", with_views("padded") + """
SELECT batch_id, CAST(max(len(list_filter(labels, lambda x: x <> pad_id))) - 1 AS BIGINT) AS budget
FROM padded GROUP BY batch_id""")

oracle("batch_plan", with_views("corpus") + """
SELECT split, count(*) AS n_rows, CAST(ceil(count(*) / 32) AS BIGINT) AS n_batches,
       CAST(ceil(count(*) / 32) * 5 AS BIGINT) AS total_steps, 8 AS grad_accum
FROM corpus GROUP BY split""")

# ======================================================================== M1-M9
oracle("line_spans", with_views("spans") + """
SELECT doc_id, line_no, start, span_len FROM spans""")

_CODE_DOCS = r"""WITH src AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS k, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
), c AS (SELECT *, CAST(len(regexp_extract_all(line, '\S+')) AS BIGINT) AS n FROM src),
h AS (
  SELECT doc_id, k, n % 4 AS depth, repeat('    ', n % 4) AS lead,
         'if f(' || n || CASE WHEN n % 3 = 0 THEN ',' || chr(10) ELSE ', ' END || k || '):' AS head, line
  FROM c
), code AS (
  SELECT *, coalesce(CAST(sum(length(lead) + length(head) + 3 + length(line) + 1) OVER
           (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) + length(lead) AS at,
         lag(depth) OVER (PARTITION BY doc_id ORDER BY k) AS before
  FROM h
), lasts AS (SELECT doc_id, max(k) AS last FROM code GROUP BY doc_id),
opened AS (
  SELECT o.doc_id, o.k, o.at, min(e.k) AS shut
  FROM code o LEFT JOIN code e ON e.doc_id = o.doc_id AND e.k > o.k AND e.depth < o.depth
  WHERE o.depth > o.before GROUP BY o.doc_id, o.k, o.at
), blocks AS (
  SELECT o.doc_id, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.k) - 1 AS block_no,
         CAST(o.at AS BIGINT) AS start, CAST(e.at + length(e.head) - o.at AS BIGINT) AS span_len
  FROM opened o JOIN lasts USING (doc_id) JOIN code e ON e.doc_id = o.doc_id AND e.k = coalesce(o.shut - 1, last)
)"""

oracle("block_spans", _CODE_DOCS + """
SELECT doc_id, block_no, start, span_len FROM blocks""")

oracle("block_tasks", _CODE_DOCS + """, whole AS (
  SELECT doc_id, string_agg(lead || head || ' # ' || line, chr(10) ORDER BY k) AS code FROM code GROUP BY doc_id
)
SELECT doc_id, block_no, md5(substring(code, 1, start) || '<MASK>' || substring(code, start + span_len + 1)) AS masked_md5,
       md5(substring(code, start + 1, span_len)) AS solution_md5
FROM blocks JOIN whole USING (doc_id)""")

oracle("span_offsets", with_views("spans") + """
SELECT doc_id, line_no, CAST(length(line) - length(ltrim(line)) AS BIGINT) AS col,
       CAST(start + length(line) - length(ltrim(line)) AS BIGINT) AS "offset"
FROM spans""")

_MASKED = "md5(substring(text, 1, start) || '<MASK>' || substring(text, start + span_len + 1))"

oracle("mask_spans", with_views("spans") + f"""
SELECT doc_id, line_no, {_MASKED} AS masked_md5, substring(text, start + 1, span_len) AS solution
FROM spans WHERE span_len > 0""")

oracle("nested_tasks", with_views("spans") + f""",
n AS (
  SELECT doc_id, list(line_no ORDER BY line_no) AS line_nos, list({_MASKED} ORDER BY line_no) AS masked_md5s,
         list(substring(text, start + 1, span_len) ORDER BY line_no) AS solutions
  FROM spans WHERE span_len > 0 GROUP BY doc_id)
SELECT d.doc_id, coalesce(line_nos, []::BIGINT[]) AS line_nos, coalesce(masked_md5s, []::VARCHAR[]) AS masked_md5s,
       coalesce(solutions, []::VARCHAR[]) AS solutions
FROM documents d LEFT JOIN n USING (doc_id)""")

oracle("length_quantiles", with_views("spans") + """
SELECT quantile_cont(n_tokens, [0.25, 0.5, 0.75]) AS edges FROM span_tok""")

_BINS = """,
e AS (SELECT quantile_cont(n_tokens, [0.25, 0.5, 0.75]) AS e FROM span_tok),
bins AS (
  SELECT doc_id, line_no, n_tokens,
         CAST((n_tokens >= e[1])::INT + (n_tokens >= e[2])::INT + (n_tokens >= e[3])::INT AS INTEGER) AS bin
  FROM span_tok, e)"""

oracle("length_bins", with_views("spans") + _BINS + """
SELECT doc_id, line_no, n_tokens, bin FROM bins""")

oracle("length_buckets", with_views("spans") + _BINS + """
SELECT CASE bin WHEN 1 THEN 'sm' WHEN 2 THEN 'md' ELSE 'lg' END AS bucket, count(*) AS n_spans
FROM bins GROUP BY 1""")

oracle("mix_lengths", with_views("corpus") + """
SELECT 'mix' AS config, length, count(*) AS n_docs FROM corpus
WHERE length IN ('short', 'medium', 'long') GROUP BY length""")

# ======================================================================= C1-C15
_PREFIX = r""",
pt AS (SELECT conv_id, turn, regexp_extract_all(pred, '\S+') AS p FROM pred_ref),
pc AS (
  SELECT conv_id, turn, CAST(k AS INTEGER) AS k, array_to_string(p[1:k], ' ') AS candidate
  FROM pt, range(1, len(p) + 1) AS t(k))"""

oracle("prefix_candidates", with_views("pred_ref") + _PREFIX + """
SELECT conv_id, turn, k, candidate FROM pc""")

oracle("fill_mask", with_views("spans") + """
SELECT doc_id, line_no, md5(f) AS filled_md5, f = text AS restored
FROM (SELECT *, replace(substring(text, 1, start) || '<MASK>' || substring(text, start + span_len + 1), '<MASK>',
                        substring(text, start + 1, span_len)) AS f
      FROM spans WHERE span_len > 0)""")


def _bal(c: str) -> str:
    conds = []
    for o, cl in (("(", ")"), ("[", "]"), ("{", "}")):
        conds.append(f"length({c}) - length(replace({c}, '{o}', '')) = length({c}) - length(replace({c}, '{cl}', ''))")
    return " AND ".join(conds)


oracle("balanced_candidates", with_views("pred_ref") + _PREFIX + f"""
SELECT conv_id, turn, k FROM pc WHERE {_bal('candidate')}""")

_CODE_TOKEN = "|".join((
    r'"""[\s\S]*?"""', r"'''[\s\S]*?'''", r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"', r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'",
    r"#[^\n]*", r"[\s\S]")).replace("'", "''")

oracle("nested_candidates", f"""
WITH p AS (
  SELECT page_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS k, unnest(parts) AS candidate
  FROM (SELECT page_id, string_split(html, '>') AS parts FROM pages)
), t AS (
  SELECT page_id, k, candidate,
         list_filter(regexp_extract_all(candidate, '{_CODE_TOKEN}'), lambda x: x IN ('(', '[', '{{', ')', ']', '}}', '"', '''')) AS marks
  FROM p
)
SELECT page_id, k, md5(candidate) AS candidate_md5 FROM t
WHERE list_reduce(list_prepend('', marks), lambda s, x: CASE
  WHEN x IN ('(', '[', '{{') THEN s || x
  WHEN (x = ')' AND s[-1] = '(') OR (x = ']' AND s[-1] = '[') OR (x = '}}' AND s[-1] = '{{') THEN s[:-2]
  ELSE s || '!' END) = ''
""")

oracle("first_block", with_views("pairs") + r"""
SELECT conv_id, turn,
       input || regexp_replace(regexp_split_to_array(replace(input || ' ' || target, input, ''), '\n\p{Lu}')[1],
                               '\s+$', '') AS block
FROM pairs""")

oracle("fanout_candidates", with_views("pred_ref") + r""",
s AS (SELECT * FROM (VALUES (0, 5), (1, 7), (2, 11)) v(sample, period)),
x AS (
  SELECT conv_id, turn, 'Q' || CAST(conv_id AS VARCHAR) || ':' AS prompt, CAST(sample AS INTEGER) AS sample,
         list_filter(regexp_extract_all(ref, '\S+'), lambda x, i: (i - 1) % period <> 3) AS tk
  FROM pred_ref, s),
c AS (
  SELECT conv_id, turn, prompt, sample, CAST(k AS INTEGER) AS k,
         prompt || ' ' || array_to_string(tk[1:k], ' ') AS completion
  FROM x, range(1, len(tk) + 1) AS t(k))
SELECT conv_id, turn, sample, k,
       md5(prompt || regexp_replace(regexp_split_to_array(replace(completion, prompt, ''), '\n\p{Lu}')[1],
                                    '\s+$', '')) AS text_md5
FROM c""")

_CA = """,
ta AS (
  SELECT task_id, 'easy' AS kind, CAST(i - 1 AS INTEGER) AS assert_idx, test_list[i] AS assertion
  FROM tasks, range(1, len(test_list) + 1) AS t(i)
  UNION ALL
  SELECT task_id, 'hard', CAST(i - 1 AS INTEGER), challenge_test_list[i]
  FROM tasks, range(1, len(challenge_test_list) + 1) AS t(i)),
ca AS (
  SELECT t.task_id, l.doc_id AS candidate, t.kind, t.assert_idx, t.assertion,
         CAST(coalesce(CASE t.kind || t.assert_idx WHEN 'easy0' THEN quality = 1 WHEN 'easy1' THEN n_chars >= 1000
           WHEN 'hard0' THEN toxic = 0 WHEN 'hard1' THEN quality = 1 WHEN 'hard2' THEN lang = 'en' END, false) AS INTEGER) AS passed
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN ta t ON t.task_id = d.source),
per AS (
  SELECT task_id, kind, candidate, CAST(sum(passed) AS BIGINT) AS n_passed,
         list(passed ORDER BY assert_idx) AS asserts
  FROM ca GROUP BY ALL),
best AS (
  SELECT task_id, kind, candidate AS best_candidate, n_passed, asserts FROM per
  QUALIFY row_number() OVER (PARTITION BY task_id, kind ORDER BY n_passed DESC, candidate) = 1),
boz AS (
  SELECT t.task_id,
         coalesce(e.asserts, list_transform(t.test_list, lambda x: 0)) AS easy_asserts,
         coalesce(h.asserts, list_transform(t.challenge_test_list, lambda x: 0)) AS hard_asserts,
         e.best_candidate AS easy_candidate, h.best_candidate AS hard_candidate
  FROM tasks t LEFT JOIN best e ON e.task_id = t.task_id AND e.kind = 'easy'
  LEFT JOIN best h ON h.task_id = t.task_id AND h.kind = 'hard')"""

oracle("test_programs", with_views("tasks", "attempts") + _CA + """
SELECT ca.task_id, ca.candidate, ca.kind, ca.assert_idx,
       CAST(length(d.text || chr(10) || ca.assertion) AS BIGINT) AS program_chars,
       md5(d.text || chr(10) || ca.assertion) AS program_md5
FROM ca JOIN documents d ON d.doc_id = ca.candidate""")

oracle("candidate_assertions", with_views("tasks", "attempts") + _CA + """
SELECT task_id, candidate, kind, assert_idx, passed FROM ca""")

oracle("best_candidate", with_views("tasks", "attempts") + _CA + """
SELECT task_id, kind, best_candidate, n_passed, asserts FROM best""")

oracle("best_or_zero", with_views("tasks", "attempts") + _CA + """
SELECT task_id, easy_asserts, hard_asserts, easy_candidate, hard_candidate FROM boz""")

oracle("assert_accuracy", with_views("tasks", "attempts") + _CA + """,
al AS (SELECT 'easy' AS kind, unnest(easy_asserts) AS a FROM boz
       UNION ALL SELECT 'hard', unnest(hard_asserts) FROM boz)
SELECT kind, """ + _r("avg(a)") + """ AS accuracy, count(*) AS n_asserts FROM al GROUP BY kind""")

oracle("uncompleted_count", with_views("tasks", "attempts") + _CA + """
SELECT count(*) FILTER (WHERE easy_candidate IS NULL) AS n_uncompleted, count(*) AS n_tasks FROM boz""")

oracle("pass_at_k", with_views("attempts") + """,
per AS (SELECT task_id, count(*) AS n, CAST(sum(easy_pass) AS BIGINT) AS c FROM attempts GROUP BY task_id),
ks AS (SELECT CAST(k AS INTEGER) AS k FROM (VALUES (1), (5), (10), (100)) v(k)),
est AS (
  SELECT k, n, CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0
                    ELSE 1.0 - (SELECT product(1.0 - k / i) FROM range(n - c + 1, n + 1) AS t(i)) END AS e
  FROM per, ks)
SELECT k, """ + _r("avg(e)") + """ AS pass_at_k FROM est GROUP BY k HAVING min(n) >= k""")

oracle("pass_at_k_by_length", with_views("attempts", "corpus") + """,
per AS (SELECT length, task_id, count(*) AS n, CAST(sum(easy_pass) AS BIGINT) AS c
        FROM attempts a JOIN corpus d ON d.doc_id = a.candidate GROUP BY length, task_id),
ks AS (SELECT CAST(k AS INTEGER) AS k FROM (VALUES (1), (5), (10)) v(k)),
est AS (
  SELECT length, k, n, CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0
                       ELSE 1.0 - (SELECT product(1.0 - k / i) FROM range(n - c + 1, n + 1) AS t(i)) END AS e
  FROM per, ks)
SELECT length, k, """ + _r("avg(e)") + """ AS pass_at_k FROM est GROUP BY length, k HAVING min(n) >= k""")

oracle("trim_eos", with_views("enc_pairs") + """
SELECT conv_id, turn,
       CASE WHEN list_position(labels, eos_id) > 0 THEN labels[1:list_position(labels, eos_id) - 1]
            ELSE labels END AS trimmed
FROM enc, sid""")

oracle("trim_length", with_views("padded", "pred_ref") + r""",
pd_tok AS (
  SELECT conv_id, turn, i, toks[i] AS token
  FROM (SELECT conv_id, turn, regexp_extract_all(pred, '\S+')[1:128] AS toks FROM pred_ref),
       range(1, len(toks) + 1) AS t(i)),
pd_ids AS (
  SELECT a.conv_id, a.turn, list(coalesce(v.token_id, 0) ORDER BY a.i) AS ids
  FROM pd_tok a LEFT JOIN vocab v ON v.token = a.token GROUP BY a.conv_id, a.turn),
j AS (
  SELECT p.conv_id, p.turn, coalesce(d.ids, []::INTEGER[]) AS pred_ids, p.labels,
         len(list_filter(p.labels, lambda x: x <> p.pad_id)) AS n
  FROM padded p JOIN pred_ref r USING (conv_id, turn) LEFT JOIN pd_ids d USING (conv_id, turn))
SELECT conv_id, turn, pred_ids[1:greatest(n - 1, 0)] AS pred_trim, labels[1:greatest(n, 0)] AS target_trim
FROM j""")

oracle("top_p_filter", with_views("dist") + """,
pr AS (
  SELECT vec_id, token, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM dist),
pr2 AS (SELECT vec_id, token, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM pr),
cum AS (
  SELECT *, coalesce(sum(prob) OVER (PARTITION BY vec_id ORDER BY prob DESC, token
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cb FROM pr2)
SELECT vec_id, token, """ + _r("prob") + """ AS prob FROM cum WHERE cb <= 0.9""")

# ======================================================================= E10-E14
oracle("epoch_rollup", with_views("step_log") + """
SELECT run, epoch, metric, """ + _r("sum(value * batch_size) / sum(batch_size)") + """ AS epoch_value,
       count(*) AS n_steps, """ + _r("arg_max(value, step)") + """ AS last_value
FROM step_log GROUP BY run, epoch, metric""")

oracle("top_checkpoints", with_views("step_log") + """,
r AS (
  SELECT run, epoch, sum(value * batch_size) / sum(batch_size) AS val_loss
  FROM step_log WHERE metric = 'error' GROUP BY run, epoch),
t AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS rk FROM r)
SELECT run, CAST(rk AS INTEGER) AS rank, epoch, """ + _r("val_loss") + """ AS val_loss,
       printf('checkpoint-%02d-%.2f', epoch, val_loss) AS label, rk = 1 AS is_best
FROM t WHERE rk <= 5""")

_RESULT = r""",
rr AS (
  SELECT conv_id, turn, 0 AS k, regexp_extract_all(input, '\S+') AS input, regexp_extract_all(ref, '\S+') AS reference,
         regexp_extract_all(pred, '\S+') AS prediction, pred = ref AS exact_match, length AS test_type
  FROM pr_class)""" + _edit_distance("dr", "rr", "prediction", "reference", "d") + """,
re AS (SELECT rr.*, dr.d, greatest(len(prediction), len(reference)) AS mx FROM rr JOIN dr USING (conv_id, turn, k))"""

oracle("result_rows", with_views("pr_class", "pair_loss") + _RESULT + """
SELECT conv_id, turn, '7' AS train_type, test_type, input, reference, prediction, """ + _r("loss") + """ AS loss,
       exact_match, """ + _r("CASE WHEN mx = 0 THEN 1.0 ELSE 1 - d / mx END") + """ AS levenshtein_distance
FROM re LEFT JOIN pair_loss USING (conv_id, turn)""")

oracle("train_test_matrix", with_views("pairs") + r""",
b AS (SELECT conv_id, turn, regexp_extract_all(target, '\S+') AS toks FROM pairs),
bn AS (SELECT *, len(toks) AS rn FROM b),
be AS (SELECT quantile_cont(rn, [0.25, 0.5, 0.75]) AS e FROM bn),
bc AS (
  SELECT bn.*, ['short', 'short', 'medium', 'long'][1 + (rn >= e[1])::INT + (rn >= e[2])::INT
         + (rn >= e[3])::INT] AS test_type
  FROM bn, be),
x AS (
  SELECT conv_id, turn, period AS k, CAST(period AS VARCHAR) AS train_type, test_type, toks AS reference,
         list_filter(toks, lambda x, i: (i - 1) % period <> 3) AS prediction
  FROM bc, (VALUES (5), (7), (11)) v(period))""" + _edit_distance("dx", "x", "prediction", "reference", "d") + r""",
xe AS (
  SELECT x.*, dx.d, greatest(len(prediction), len(reference)) AS mx,
         array_to_string(prediction, ' ') = array_to_string(reference, ' ') AS em
  FROM x JOIN dx USING (conv_id, turn, k))
SELECT train_type, test_type, count(*) AS n_rows, """ + _r("avg(CAST(em AS DOUBLE))") + """ AS exact_match,
       """ + _r("avg(CASE WHEN mx = 0 THEN 1.0 ELSE 1 - d / mx END)") + """ AS leven_dist
FROM xe GROUP BY train_type, test_type""")

oracle("matrix_margins", with_views("pairs") + r""",
b AS (SELECT conv_id, turn, regexp_extract_all(target, '\S+') AS toks FROM pairs),
bn AS (SELECT *, len(toks) AS rn FROM b),
be AS (SELECT quantile_cont(rn, [0.25, 0.5, 0.75]) AS e FROM bn),
bc AS (
  SELECT bn.*, ['short', 'short', 'medium', 'long'][1 + (rn >= e[1])::INT + (rn >= e[2])::INT
         + (rn >= e[3])::INT] AS test_type
  FROM bn, be),
x AS (
  SELECT conv_id, turn, phase AS k, position AS train_type, test_type, toks AS reference,
         list_filter(toks, lambda x, i: (i - 1) % 7 <> phase) AS prediction
  FROM bc, (VALUES (0, 'sinusoidal'), (1, 'rotary'), (2, 'alibi'), (3, 'relative')) v(phase, position))""" + _edit_distance(
    "dx", "x", "prediction", "reference", "d") + r""",
xe AS (
  SELECT x.*, dx.d, greatest(len(prediction), len(reference)) AS mx,
         array_to_string(prediction, ' ') = array_to_string(reference, ' ') AS em
  FROM x JOIN dx USING (conv_id, turn, k))
SELECT train_type, test_type, CAST(grouping(train_type, test_type) AS INTEGER) AS level, count(*) AS n_rows,
       """ + _r("avg(CAST(em AS DOUBLE))") + """ AS exact_match, """ + _r("avg(CASE WHEN mx = 0 THEN 1.0 ELSE 1 - d / mx END)") + """ AS leven_dist
FROM xe GROUP BY CUBE (train_type, test_type)""")

oracle("value_quantiles", "SELECT list_transform(quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.25, 0.5, 0.75]), lambda x: round(x, 6)) AS edges FROM lineitem")

oracle("value_bins", """
WITH e AS (SELECT quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.25, 0.5, 0.75]) AS e FROM lineitem)
SELECT CAST((l_extendedprice >= e[1])::INT + (l_extendedprice >= e[2])::INT + (l_extendedprice >= e[3])::INT AS INTEGER) AS bin, count(*) AS n
FROM lineitem, e GROUP BY 1""")

# ======================================================================== X1-X5
oracle("token_freq", with_views("doc_ids") + """
SELECT split, length, token_id, n FROM freq_sl""")

oracle("token_topk", with_views("doc_ids") + """,
t AS (SELECT *, row_number() OVER (PARTITION BY split, length ORDER BY n DESC, token_id) AS rk FROM freq_sl)
SELECT split, length, CAST(rk AS INTEGER) AS rank, t.token_id, v.token, n
FROM t JOIN vocab v USING (token_id) WHERE rk <= 10""")

oracle("js_distance", with_views("doc_ids") + """,
fl AS (
  SELECT g.language, v.token_id, coalesce(c.n, 0) + 1 AS n
  FROM (SELECT DISTINCT language FROM doc_ids) g CROSS JOIN vocab v
  LEFT JOIN (SELECT language, token_id, count(*) AS n FROM doc_ids GROUP BY ALL) c
    ON c.language = g.language AND c.token_id = v.token_id),
pa AS (SELECT token_id, n / sum(n) OVER () AS p FROM fl WHERE language = 'en'),
qa AS (SELECT token_id, n / sum(n) OVER () AS q FROM fl WHERE language = 'fr'),
j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM pa FULL JOIN qa USING (token_id))
SELECT """ + _r("""sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
  + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 0))""") + """ AS js FROM j""")

_JS = """,
pr AS (SELECT split, length, token_id, n / sum(n) OVER (PARTITION BY split, length) AS p FROM freq_sl)"""
_JSV = _r("""sqrt(greatest(sum(CASE WHEN a.p > 0 THEN a.p * ln(a.p / ((a.p + b.p) / 2)) ELSE 0 END
  + CASE WHEN b.p > 0 THEN b.p * ln(b.p / ((a.p + b.p) / 2)) ELSE 0 END) / 2, 0))""")

oracle("js_within_split", with_views("doc_ids") + _JS + """
SELECT a.split, a.length AS size_a, b.length AS size_b, """ + _JSV + """ AS js
FROM pr a JOIN pr b ON a.split = b.split AND a.token_id = b.token_id AND a.length < b.length
GROUP BY ALL""")

oracle("js_cross_split", with_views("doc_ids") + _JS + """
SELECT a.split AS part_a, a.length AS size_a, b.split AS part_b, b.length AS size_b, """ + _JSV + """ AS js
FROM pr a JOIN pr b ON a.token_id = b.token_id AND a.split = 'train' AND b.split = 'test'
GROUP BY ALL""")

ORACLE["epoch_rollup_stream"] = ORACLE["epoch_rollup"]

# ============================================================ metric suite
_SUITE = with_views("pr_tok", "pr_mix", "pair_loss") + "," + _NG + r""",
gstats AS (SELECT c.length, n, sum(least(ch, cr)) AS m, sum(ch) AS th, sum(cr) AS tr
           FROM cnt JOIN pr_mix c USING (conv_id, turn) GROUP BY c.length, n),
s_bleu AS (""" + _BLEU_TAIL.format(keys="length,", group="GROUP BY length").replace("FROM stats", "FROM gstats") + r"""),
cs AS (SELECT conv_id, turn, length, regexp_replace(pred, '\s+', '', 'g') AS h,
              regexp_replace(ref, '\s+', '', 'g') AS r FROM pr_mix),
cg AS (
  SELECT conv_id, turn, length, 0 AS side, n, substring(h, i, n) AS gram
  FROM cs, range(1, 7) AS o(n), range(1, length(h) - n + 2) AS q(i)
  UNION ALL
  SELECT conv_id, turn, length, 1 AS side, n, substring(r, i, n) AS gram
  FROM cs, range(1, 7) AS o(n), range(1, length(r) - n + 2) AS q(i)),
cc AS (SELECT conv_id, turn, length, n, gram, count(*) FILTER (WHERE side = 0) AS ch,
              count(*) FILTER (WHERE side = 1) AS cr FROM cg GROUP BY ALL),
cst AS (SELECT length, n, sum(least(ch, cr))::DOUBLE AS m, sum(ch)::DOUBLE AS th, sum(cr)::DOUBLE AS tr
        FROM cc GROUP BY length, n),
cpr AS (SELECT length, sum(m / th) FILTER (WHERE th > 0 AND tr > 0) AS sp,
               sum(m / tr) FILTER (WHERE th > 0 AND tr > 0) AS sr,
               count(*) FILTER (WHERE th > 0 AND tr > 0) AS eff FROM cst GROUP BY length),
s_chrf AS (SELECT length, CASE WHEN eff = 0 OR sp + sr = 0 THEN 0.0
  ELSE 5 * (sp / eff) * (sr / eff) / (4 * (sp / eff) + (sr / eff)) * 100.0 END AS v FROM cpr),
s_em AS (SELECT length, avg(CAST(pred = ref AS DOUBLE)) AS v FROM pr_mix GROUP BY length)""" + _ED + r""",
s_ed AS (SELECT c.length, avg(CASE WHEN greatest(lh, lr) = 0 THEN 1.0 ELSE 1 - d / greatest(lh, lr) END) AS v
         FROM ed JOIN pr_mix c USING (conv_id, turn) GROUP BY c.length),
mt AS (SELECT conv_id, turn, regexp_extract_all(lower(pred), '\S+') AS h,
              regexp_extract_all(lower(ref), '\S+') AS r FROM pred_ref),
hw AS (SELECT conv_id, turn, i - 1 AS hp, h[i] AS w FROM mt, range(1, len(h) + 1) AS q(i)),
rw AS (SELECT conv_id, turn, i - 1 AS rp, r[i] AS w FROM mt, range(1, len(r) + 1) AS q(i)),
hk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY hp DESC) AS k FROM hw),
rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY rp DESC) AS k FROM rw),
mm AS (SELECT hk.conv_id, hk.turn, hp, rp FROM hk JOIN rk USING (conv_id, turn, w, k)),
mc AS (SELECT conv_id, turn,
        CASE WHEN lag(hp) OVER (PARTITION BY conv_id, turn ORDER BY hp) = hp - 1
              AND lag(rp) OVER (PARTITION BY conv_id, turn ORDER BY hp) = rp - 1 THEN 0 ELSE 1 END AS nc
      FROM mm),
mper AS (SELECT conv_id, turn, count(*) AS mm, sum(nc) AS ch FROM mc GROUP BY ALL),
msc AS (SELECT mt.conv_id, mt.turn, len(h) AS hl, len(r) AS rl, coalesce(mm, 0) AS mm, ch
        FROM mt LEFT JOIN mper USING (conv_id, turn)),
s_meteor AS (
  SELECT c.length, avg(CASE WHEN mm = 0 OR hl = 0 OR rl = 0 THEN 0.0 ELSE
    (1 - 0.5 * pow(ch / mm, 3)) * ((mm / hl) * (mm / rl) / (0.9 * (mm / hl) + 0.1 * (mm / rl))) END) AS v
  FROM msc JOIN pr_mix c USING (conv_id, turn) GROUP BY c.length)""" + _LCS + r""",
s_rouge AS (SELECT c.length, avg(CASE WHEN l = 0 THEN 0.0 ELSE 2 * (l / lh) * (l / lr) / ((l / lh) + (l / lr)) END) AS v
            FROM lc JOIN pr_mix c USING (conv_id, turn) GROUP BY c.length),
s_loss AS (SELECT c.length, avg(loss) AS v FROM pair_loss JOIN pr_mix c USING (conv_id, turn) GROUP BY c.length),
allm AS (
  SELECT length, 'bleu' AS metric, bleu AS v FROM s_bleu
  UNION ALL SELECT length, 'chrf', v FROM s_chrf
  UNION ALL SELECT length, 'exact_match', v FROM s_em
  UNION ALL SELECT length, 'leven_dist', v FROM s_ed
  UNION ALL SELECT length, 'meteor', v FROM s_meteor
  UNION ALL SELECT length, 'rouge', v FROM s_rouge
  UNION ALL SELECT length, 'tst_loss', v FROM s_loss)
SELECT length, metric, metric || '_' || length AS name, """ + _r("v") + """ AS value FROM allm"""

oracle("metric_suite", _SUITE)

oracle("metric_record_wide", _SUITE.replace(
    "SELECT length, metric, metric || '_' || length AS name, " + _r("v") + " AS value FROM allm",
    "SELECT length, " + ", ".join(
        f"{_r(f'max(v) FILTER (WHERE metric = {chr(39)}{m}{chr(39)})')} AS {m}"
        for m in ("bleu", "chrf", "exact_match", "leven_dist", "meteor", "rouge", "tst_loss"))
    + " FROM allm GROUP BY length"))

oracle("metrics_json", _SUITE.replace(
    "SELECT length, metric, metric || '_' || length AS name, " + _r("v") + " AS value FROM allm",
    "SELECT length, '{' || string_agg('\"' || metric || '_' || length || '\":' || CAST("
    + _r("v") + " AS VARCHAR), ',' ORDER BY metric || '_' || length) || '}' AS json FROM allm GROUP BY length"))

# ================================================================ sinks S5-S9
oracle("ledger_rollup", """
WITH t AS (SELECT user_id % 4 AS run, date_trunc('second', ts) AS ts FROM events),
p AS (SELECT run, day(ts) AS epoch, max(ts) AS ts, count(*) AS n FROM t GROUP BY ALL)
SELECT 'run ' || run AS project_name, count(*) AS n_runs, """ + _r("sum(n * 0.5)") + """ AS duration,
       """ + _r("sum(n * 0.25)") + """ AS emissions, """ + _r("sum(n * 2.0)") + """ AS energy_consumed,
       CAST(epoch(min(ts)) AS BIGINT) AS first_run, CAST(epoch(max(ts)) AS BIGINT) AS last_run
FROM p GROUP BY run""")

ORACLE["vocab_store"] = ORACLE["vocab_with_specials"]

oracle("results_csv", with_views("pr_class", "pair_loss") + """
SELECT conv_id, turn, '7' AS train_type, length AS test_type, """ + _r("loss") + """ AS loss, pred = ref AS exact_match,
       CAST(len(regexp_extract_all(ref, '\\S+')) AS BIGINT) AS n_reference
FROM pr_class LEFT JOIN pair_loss USING (conv_id, turn)""")

oracle("append_samples", with_views("pred_ref") + """
SELECT input, pred AS completion, CAST(conv_id % 2 AS BIGINT) AS step FROM pred_ref""")
