"""Evaluation metrics as grouped DataFrame aggregates.

Input convention: a DataFrame with key columns, a prediction string column and a
reference string column.  `tokenizer` is a ``Column -> Column`` function giving
an array of tokens (white-space tokens by default), standing in for the
tokenizer callable the reference passes to its metrics.  Every metric takes
`group_cols` (length class, train type x test type, ...) and returns one row
per group.

Scale notes: everything that concerns one pair is computed in its row and needs
no shuffle: clipped n-gram counts with built-in array functions, LCS, edit
distance and METEOR alignment in one Arrow function over token hashes.  Only a
few numbers per pair reach the (partial, then final) aggregate of a group.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.alignment import alignment, pair_scores, staged
from tessera.functions.lcs import lcs, lcs_and_distance
from tessera.functions.ngrams import with_ngram_stats
from tessera.functions.text import chars, ws_tokens

Tokenizer = Callable[[Column], Column]

# Fixed values of the metrics.
BLEU_MAX_ORDER = 4
CHRF_CHAR_ORDER = 6
CHRF_BETA = 2.0
BOOTSTRAP_REPLICATES = 1000
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5


def _g(group_cols) -> list[str]:
    return list(group_cols or [])


# ------------------------------------------------------------------ n-gram stats

def _order_sums(df: DataFrame, keys: Sequence[str], hyp: Column, ref: Column, orders: Sequence[int],
                group_cols: Sequence[str], per_key: bool, char_level: bool = False) -> DataFrame:
    """Per group, or per pair with `per_key`: the columns m{n}, t{n} and r{n} of
    every order n: clipped matches, hypothesis and reference n-grams.  Pairs
    with a null side are left out."""
    held = list(dict.fromkeys([*group_cols, *keys] if per_key else group_cols))
    base = df.select(*held, hyp.alias("_hyp"), ref.alias("_ref")).where(F.col("_hyp").isNotNull() & F.col("_ref").isNotNull())
    rows = with_ngram_stats(base, F.col("_hyp"), F.col("_ref"), orders, "_g", char_level)
    cols = [(f"{a}{n}", F.col(f"_g{n}.{b}")) for n in orders for a, b in (("m", "m"), ("t", "th"), ("r", "tr"))]
    if per_key:
        return rows.select(*held, *[c.alias(name) for name, c in cols])
    return rows.groupBy(*held).agg(*[F.sum(c).alias(name) for name, c in cols])


def _ngram_stats(df: DataFrame, keys: Sequence[str], hyp: Column, ref: Column,
                 orders: Sequence[int], group_cols: Sequence[str], per_key: bool,
                 char_level: bool = False, per_row: bool = True) -> DataFrame:
    """Per (group[, key], n): matches = sum of clipped counts, hyp/ref totals.

    per_row=True (default): `_order_sums` in long form.  per_row=False: a
    relational plan that the tests hold against it: the token (or character)
    arrays are fanned out to one row per (side, order), their n-grams
    exploded, counted per (pair, n, gram) and summed per order."""
    out_keys = list(dict.fromkeys([*group_cols, *keys] if per_key else group_cols))
    if per_row:
        wide = _order_sums(df, keys, hyp, ref, orders, group_cols, per_key, char_level)
        return wide.select(*out_keys, F.inline(F.array(*[
            F.struct(F.lit(n).alias("n"), F.col(f"m{n}").alias("m"), F.col(f"t{n}").alias("th"), F.col(f"r{n}").alias("tr")) for n in orders])))
    if char_level:
        hyp, ref = chars(hyp), chars(ref)
    base = df.select(*group_cols, *keys, hyp.alias("_h"), ref.alias("_r"))
    fan = F.explode(F.array(*[F.struct(F.lit(sd).alias("_side"), F.lit(n).alias("_ord"))
                              for sd in (0, 1) for n in orders])).alias("o")
    x = base.select(*group_cols, *keys, fan, "_h", "_r").select(
        *group_cols, *keys, "o._side", "o._ord",
        F.when(F.col("o._side") == 0, F.col("_h")).otherwise(F.col("_r")).alias("_c"))
    span = F.size("_c") - F.col("_ord") + 1
    if char_level:
        gram = lambda i: F.array_join(F.slice("_c", i, F.col("_ord")), "")
    else:
        gram = lambda i: F.slice("_c", i, F.col("_ord"))
    exploded = x.select(*group_cols, *keys, "_side", "_ord",
                        F.explode(F.when(span >= 1, F.transform(F.sequence(F.lit(1), span), gram)))
                        .alias("_gram"))
    counts = exploded.groupBy(*group_cols, *keys, "_ord", "_gram").agg(
        F.count_if(F.col("_side") == 0).alias("ch"), F.count_if(F.col("_side") == 1).alias("cr"))
    return counts.groupBy(*out_keys, F.col("_ord").alias("n")).agg(
        F.sum(F.least("ch", "cr")).alias("m"), F.sum("ch").alias("th"), F.sum("cr").alias("tr"))


def _with_bleu(sums: DataFrame, out_keys: Sequence[str], max_order: int) -> DataFrame:
    """BLEU of every row of order sums."""
    w = sums.fillna(0, [c for c in sums.columns if c not in out_keys]).withColumn("rlen", F.col("r1"))
    bleu, bp = _bleu(max_order)
    return w.select(*out_keys, bleu.alias("bleu"), bp.alias("brevity_penalty"),
                    F.col("t1").cast("long").alias("translation_length"),
                    F.col("rlen").cast("long").alias("reference_length"))


def _bleu(max_order: int, prefix: str | None = None) -> tuple[Column, Column]:
    """(BLEU, brevity penalty) from summed matches m1.., totals t1.. and rlen;
    with a prefix b from bm1.., bth1.. and btr1."""
    m, t, rl = ("m{}", "t{}", "rlen") if prefix is None else (prefix + "m{}", prefix + "th{}", prefix + "tr1")
    n = range(1, max_order + 1)
    prec = [F.when(F.col(t.format(k)) > 0, F.col(m.format(k)) / F.col(t.format(k))).otherwise(F.lit(0.0)) for k in n]
    min_p = F.least(*prec) if len(prec) > 1 else prec[0]
    geo = F.exp(sum(F.log(F.when(p > 0, p)) for p in prec) / max_order)
    hlen, rlen = F.col(t.format(1)).cast("double"), F.col(rl).cast("double")
    bp = F.when(hlen > rlen, F.lit(1.0)).when(hlen == 0, F.lit(0.0)).otherwise(F.exp(1 - rlen / hlen))
    return F.when(min_p > 0, geo * bp).otherwise(F.lit(0.0)), bp


def bleu_corpus(df: DataFrame, keys: Sequence[str], pred: str = "pred", ref: str = "ref",
                tokenizer: Tokenizer = ws_tokens, max_order: int = BLEU_MAX_ORDER,
                group_cols=None) -> DataFrame:
    """Corpus BLEU (clipped n-gram precision, geometric mean, brevity
    penalty, no smoothing)."""
    g = _g(group_cols)
    sums = _order_sums(df, keys, tokenizer(F.col(pred)), tokenizer(F.col(ref)), range(1, max_order + 1), g, per_key=False)
    return _with_bleu(sums, g, max_order)


def bleu_sentence(df: DataFrame, keys: Sequence[str], pred: str = "pred", ref: str = "ref",
                  tokenizer: Tokenizer = ws_tokens, max_order: int = BLEU_MAX_ORDER,
                  group_cols=None) -> DataFrame:
    """Per-pair BLEU (each pair scored as a corpus of one)."""
    g = _g(group_cols)
    sums = _order_sums(df, keys, tokenizer(F.col(pred)), tokenizer(F.col(ref)), range(1, max_order + 1), g, per_key=True)
    return _with_bleu(sums, list(dict.fromkeys([*g, *keys])), max_order)


def bleu_macro_vs_corpus(df: DataFrame, keys: Sequence[str], pred: str = "pred", ref: str = "ref",
                         tokenizer: Tokenizer = ws_tokens, group_cols=None) -> DataFrame:
    """Mean of per-pair BLEU next to corpus BLEU."""
    g = _g(group_cols)
    per = _order_sums(df, keys, tokenizer(F.col(pred)), tokenizer(F.col(ref)), range(1, BLEU_MAX_ORDER + 1), g, per_key=True)
    per = per.withColumn("rlen", F.col("r1"))
    sums = [f"{c}{n}" for n in range(1, BLEU_MAX_ORDER + 1) for c in "mt"] + ["rlen"]
    bleu = _bleu(BLEU_MAX_ORDER)[0]
    whole = per.select(*g, *sums, bleu.alias("_one")).groupBy(*g).agg(
        F.avg("_one").alias("bleu_macro"), F.count("*").alias("n_pairs"), *[F.sum(c).alias(c) for c in sums])
    return whole.select(*g, "bleu_macro", "n_pairs", bleu.alias("bleu_corpus"))


def chrf_corpus(df: DataFrame, keys: Sequence[str], pred: str = "pred", ref: str = "ref",
                char_order: int = CHRF_CHAR_ORDER, beta: float = CHRF_BETA,
                group_cols=None) -> DataFrame:
    """chrF (0-100) over character n-grams of the white-space-stripped
    strings; corpus sums per order, mean precision and recall over the orders
    present on both sides, F-beta."""
    g = _g(group_cols)
    strip = lambda c: F.regexp_replace(F.col(c), r"\s+", "")
    sums = _order_sums(df, keys, strip(pred), strip(ref), range(1, char_order + 1), g, per_key=False, char_level=True)
    return sums.select(*g, _chrf(char_order, beta).alias("chrf"))


def _chrf(char_order: int, beta: float, prefix: str | None = None) -> Column:
    """chrF from the order sums m{n}, t{n}, r{n} (with a prefix c: cm{n}, cth{n},
    ctr{n}): mean precision and recall over the orders present on both sides."""
    names = ("m{}", "t{}", "r{}") if prefix is None else (prefix + "m{}", prefix + "th{}", prefix + "tr{}")
    m, t, r_ = [[F.coalesce(F.col(x.format(k)), F.lit(0)) for k in range(1, char_order + 1)] for x in names]
    present = [(a > 0) & (b > 0) for a, b in zip(t, r_)]
    count = sum(F.when(e, 1).otherwise(0) for e in present)
    p = sum(F.when(e, a / b).otherwise(0.0) for e, a, b in zip(present, m, t)) / count
    r = sum(F.when(e, a / b).otherwise(0.0) for e, a, b in zip(present, m, r_)) / count
    b2 = beta * beta
    return F.when(count == 0, F.lit(0.0)).when(p + r == 0, F.lit(0.0)).otherwise((1 + b2) * p * r / (b2 * p + r) * 100.0)


def exact_match(df: DataFrame, pred: str = "pred", ref: str = "ref", group_cols=None) -> DataFrame:
    """Share of pairs whose strings are equal."""
    g = _g(group_cols)
    return df.groupBy(*g).agg(
        F.avg((F.col(pred) == F.col(ref)).cast("double")).alias("exact_match"),
        F.count("*").alias("n_pairs"))


def token_edit_distance_col(a: Column, b: Column) -> Column:
    """E5 per row: unit-cost edit distance between two token arrays."""
    return lcs_and_distance(a, b)["distance"]


def token_edit_distance(df: DataFrame, keys: Sequence[str], pred: str = "pred", ref: str = "ref",
                        tokenizer: Tokenizer = ws_tokens) -> DataFrame:
    """E5: per pair edit distance and the similarity 1 - d / max(len)."""
    t = df.select(*keys, tokenizer(F.col(pred)).alias("h"), tokenizer(F.col(ref)).alias("r"))
    t = t.select(*keys, token_edit_distance_col(F.col("h"), F.col("r")).alias("d"), F.greatest(F.size("h"), F.size("r")).alias("mx"))
    return t.select(*keys, F.col("d").alias("edit_distance"),
                    F.when(F.col("mx") == 0, F.lit(1.0)).otherwise(1 - F.col("d") / F.col("mx")).alias("similarity"))


def edit_similarity(df: DataFrame, keys: Sequence[str], pred: str = "pred", ref: str = "ref",
                    tokenizer: Tokenizer = ws_tokens, group_cols=None) -> DataFrame:
    """Mean normalised similarity (the reference calls it a distance)."""
    g = _g(group_cols)
    rows = token_edit_distance(df, list(keys) + [c for c in g if c not in keys], pred, ref, tokenizer)
    return rows.groupBy(*g).agg(F.avg("similarity").alias("edit_similarity"),
                                F.sum("edit_distance").alias("edit_distance_total"))


def meteor_exact(df: DataFrame, keys: Sequence[str], pred: str = "pred", ref: str = "ref",
                 tokenizer: Tokenizer = ws_tokens, alpha: float = METEOR_ALPHA,
                 beta: float = METEOR_BETA, gamma: float = METEOR_GAMMA,
                 group_cols=None, per_row: bool = True) -> DataFrame:
    """METEOR with the exact-match stage only, mean over pairs.

    Alignment: walking the hypothesis from its end, each word takes the last
    still-free equal word of the reference, i.e. the k-th-from-last occurrence
    of a word on one side is aligned with the k-th-from-last on the other.
    That is an equi-join on (pair, word, k).  Chunks are runs of matches
    adjacent on both sides (`lag` over the pair, ordered by hypothesis
    position)."""
    g = _g(group_cols)
    kk = g + [k for k in keys if k not in g]
    base = df.select(*kk, tokenizer(F.lower(F.col(pred))).alias("h"),
                     tokenizer(F.lower(F.col(ref))).alias("r"))
    if per_row:
        # The alignment of a pair needs only that pair: computed in its row
        # (Arrow batches), so the plan has no exchange before the final mean.
        scored = base.select(*kk, F.size("h").alias("hl"), F.size("r").alias("rl"),
                             alignment(F.col("h"), F.col("r")).alias("_a")) \
            .select(*kk, "hl", "rl", F.col("_a.m").alias("m"), F.col("_a.chunks").alias("chunks"))
        return _meteor_score(scored, g, alpha, beta, gamma)

    def side(arr, pos_name):
        e = base.select(*kk, F.posexplode(arr).alias(pos_name, "_w"))
        w = Window.partitionBy(*kk, "_w").orderBy(F.col(pos_name).desc())
        return e.withColumn("_occ", F.row_number().over(w))

    m = side("h", "hp").join(side("r", "rp"), kk + ["_w", "_occ"])
    wl = Window.partitionBy(*kk).orderBy("hp")
    starts = m.select(*kk, "hp", "rp",
                      F.when((F.lag("hp").over(wl) == F.col("hp") - 1) &
                             (F.lag("rp").over(wl) == F.col("rp") - 1), 0).otherwise(1).alias("new_chunk"))
    per = starts.groupBy(*kk).agg(F.count("*").alias("m"), F.sum("new_chunk").alias("chunks"))
    scored = base.select(*kk, F.size("h").alias("hl"), F.size("r").alias("rl")) \
        .join(per, kk, "left")
    return _meteor_score(scored, g, alpha, beta, gamma)


def _meteor_score(scored: DataFrame, g, alpha, beta, gamma) -> DataFrame:
    m_, hl, rl = F.coalesce(F.col("m"), F.lit(0)), F.col("hl"), F.col("rl")
    p, r = m_ / hl, m_ / rl
    fmean = p * r / (alpha * p + (1 - alpha) * r)
    pen = gamma * F.pow(F.col("chunks") / m_, beta)
    s = F.when((m_ == 0) | (hl == 0) | (rl == 0), F.lit(0.0)).otherwise((1 - pen) * fmean)
    return scored.select(*g, s.alias("meteor")).groupBy(*g).agg(F.avg("meteor").alias("meteor"))


def light_stem(word: Column) -> Column:
    """Plural endings taken off (the three rules of the S stemmer)."""
    return F.when(word.rlike("ies$") & ~word.rlike("[ea]ies$"), F.regexp_replace(word, "ies$", "y")) \
        .when(word.rlike("es$") & ~word.rlike("[aeo]es$"), F.regexp_replace(word, "s$", "")) \
        .when(word.rlike("s$") & ~word.rlike("[us]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def meteor_staged(df: DataFrame, keys: Sequence[str], pred: str = "pred", ref: str = "ref",
                  tokenizer: Tokenizer = ws_tokens, stemmer: Callable[[Column], Column] = light_stem,
                  alpha: float = METEOR_ALPHA, beta: float = METEOR_BETA, gamma: float = METEOR_GAMMA, group_cols=None) -> DataFrame:
    """E7 in stages: equal words, then equal stems among the words left over, in
    the alignment with the fewest chunks; mean over pairs."""
    g = _g(group_cols)
    kk = g + [k for k in keys if k not in g]
    base = df.select(*kk, tokenizer(F.lower(F.col(pred))).alias("h"), tokenizer(F.lower(F.col(ref))).alias("r"))
    base = base.select("*", F.transform("h", stemmer).alias("hs"), F.transform("r", stemmer).alias("rs"))
    scored = base.select(*kk, F.size("h").alias("hl"), F.size("r").alias("rl"),
                         staged(F.col("h"), F.col("r"), F.col("hs"), F.col("rs")).alias("_a")) \
        .select(*kk, "hl", "rl", F.col("_a.m").alias("m"), F.col("_a.chunks").alias("chunks"))
    return _meteor_score(scored, g, alpha, beta, gamma)


def rouge_l(df: DataFrame, keys: Sequence[str], pred: str = "pred", ref: str = "ref",
            tokenizer: Tokenizer = ws_tokens, group_cols=None) -> DataFrame:
    """ROUGE-L F1 from the token LCS, plain mean over pairs."""
    g = _g(group_cols)
    kk = g + [k for k in keys if k not in g]
    t = df.select(*kk, tokenizer(F.col(pred)).alias("h"), tokenizer(F.col(ref)).alias("r"))
    t = t.withColumn("l", lcs(F.col("h"), F.col("r")))
    p = F.col("l") / F.size("h")
    r = F.col("l") / F.size("r")
    f1 = F.when((F.col("l") == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return t.select(*g, "l", f1.alias("f")).groupBy(*g).agg(
        F.avg("f").alias("rouge_l"), F.sum("l").alias("lcs_total"))


def _poisson_thresholds() -> list[str]:
    """Distribution function of Poisson(1) as 8-digit hex numbers: a uniform hex
    number counts as many as there are values at or below it."""
    out, p, total = [], math.exp(-1.0), 0.0
    for k in range(20):
        total += p
        p /= k + 1
        edge = int(total * 2 ** 32)
        if edge >= 2 ** 32 - 1:
            break
        out.append(f"{edge:08x}")
    return out


POISSON_HEX = tuple(_poisson_thresholds())


def rouge_l_bootstrap(df: DataFrame, keys: Sequence[str], pred: str = "pred", ref: str = "ref",
                      tokenizer: Tokenizer = ws_tokens, group_cols=None, replicates: int = BOOTSTRAP_REPLICATES,
                      seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """E8, aggregated as the metric's library does it: bootstrap the mean of the
    pairs' F1 and report the median of the replicates, with an interval.

    Poisson bootstrap: in every replicate a pair counts a Poisson(1) number of
    times, read off a hash of its key, the seed and the replicate, so the result
    is reproducible, does not depend on the partitioning, and needs one grouped
    aggregate whose state is a sum and a weight per (group, replicate)."""
    g = _g(group_cols)
    kk = g + [k for k in keys if k not in g]
    t = df.select(*kk, tokenizer(F.col(pred)).alias("h"), tokenizer(F.col(ref)).alias("r"))
    t = t.select(*kk, lcs(F.col("h"), F.col("r")).alias("l"), F.size("h").alias("nh"), F.size("r").alias("nr"))
    f1 = F.when(F.col("l") == 0, F.lit(0.0)).otherwise(2 * F.col("l") / (F.col("nh") + F.col("nr")))
    one = t.select(*g, F.concat_ws("-", *[F.col(k).cast("string") for k in keys]).alias("_key"), f1.alias("f")).where("f IS NOT NULL")
    # One digest gives the hex numbers of four replicates.
    many = one.select(*g, "_key", "f", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1))).alias("_four"))
    many = many.select(*g, "f", "_four", F.md5(F.concat_ws("-", "_key", F.lit(str(seed)), F.col("_four").cast("string"))).alias("_hex"))
    many = many.select(*g, "f", "_hex", F.inline(F.array(*[
        F.struct((F.col("_four") * 4 + i).alias("replicate"), F.substring("_hex", 8 * i + 1, 8).alias("_u")) for i in range(4)])))
    weight = sum(F.when(F.col("_u") >= x, 1).otherwise(0) for x in POISSON_HEX)
    sums = many.where(F.col("replicate") < replicates).groupBy(*g, "replicate").agg(
        F.sum(weight).alias("w"), F.sum(weight * F.col("f")).alias("wf"))
    means = sums.where("w > 0").select(*g, (F.col("wf") / F.col("w")).alias("mean"))
    edges = F.percentile("mean", F.array(*[F.lit(x) for x in ((1 - confidence) / 2, 0.5, (1 + confidence) / 2)]))
    out = means.groupBy(*g).agg(edges.alias("e"), F.count(F.lit(1)).alias("n_replicates"))
    return out.select(*g, F.col("e")[1].alias("rouge_l_mid"), F.col("e")[0].alias("rouge_l_low"), F.col("e")[2].alias("rouge_l_high"), "n_replicates")


# ----------------------------------------------------------------------- losses

def log_softmax_at_target(dist: DataFrame, row_col: str = "vec_id", token_col: str = "token",
                          logit_col: str = "logit", target_col: str = "target") -> DataFrame:
    """Per row: log-probability of the target token under softmax(logits).

    The max-shift window and the sum share the partitioning on `row_col`, so
    the plan has a single exchange."""
    w = Window.partitionBy(row_col)
    shifted = dist.withColumn("mx", F.max(logit_col).over(w))
    per = shifted.groupBy(row_col, target_col).agg(
        (F.first("mx") + F.log(F.sum(F.exp(F.col(logit_col) - F.col("mx"))))).alias("lse"),
        F.max(F.when(F.col(token_col) == F.col(target_col), F.col(logit_col))).alias("lt"))
    return per.select(row_col, target_col, (F.col("lt") - F.col("lse")).alias("logprob"))


def masked_nll(dist: DataFrame, pad_id: int | None = 0, row_col: str = "vec_id",
               group_cols=None) -> DataFrame:
    """Mean negative log-likelihood of the targets, pad targets ignored."""
    g = _g(group_cols)
    lp = log_softmax_at_target(dist, row_col)
    if pad_id is not None:
        lp = lp.filter(F.col("target") != pad_id)
    return lp.groupBy(*g).agg(F.avg(-F.col("logprob")).alias("nll"),
                              F.count("*").alias("n_tokens"))


# ------------------------------------------------------------ suites

SUITE_METRICS = ("bleu", "chrf", "exact_match", "leven_dist", "meteor", "rouge", "tst_loss")


def metric_suite(pr: DataFrame, keys: Sequence[str], group_col: str, loss: DataFrame,
                 pred: str = "pred", ref: str = "ref", tokenizer: Tokenizer = ws_tokens,
                 max_order: int = BLEU_MAX_ORDER, char_order: int = CHRF_CHAR_ORDER,
                 beta: float = CHRF_BETA, alpha: float = METEOR_ALPHA,
                 m_beta: float = METEOR_BETA, gamma: float = METEOR_GAMMA,
                 mix: str | None = "mix") -> DataFrame:
    """One record of 7 named values per group (length class) and one over
    all groups (`mix`), long form `(length, metric, name, value)` with name =
    metric_length.

    One pass: every pair's statistics for all six text metrics (clipped n-gram
    counts, character n-gram counts, METEOR alignment, LCS, edit distance,
    equality) are computed in a single projection of its row, then ONE grouped
    aggregate sums them per class -- the pairs are read and tokenized once and
    the only shuffle of scores carries a few numbers per class and task.
    `loss` holds a row's loss by `keys`; it is averaged per class."""
    g = group_col
    strip = lambda c: F.regexp_replace(F.col(c), r"\s+", "")
    pr = pr.join(loss.select(*keys, F.col("loss").alias("_loss")), list(keys), "left")
    t = pr.select(g, "_loss", tokenizer(F.col(pred)).alias("h"), tokenizer(F.col(ref)).alias("r"),
                  tokenizer(F.lower(F.col(pred))).alias("hl_"), tokenizer(F.lower(F.col(ref))).alias("rl_"),
                  strip(pred).alias("hs"), strip(ref).alias("rs"),
                  (F.col(pred) == F.col(ref)).cast("double").alias("em"))
    # LCS, edit distance and alignment first, so that only numbers travel on.
    t = t.select(g, "em", "_loss", "h", "r", "hs", "rs", F.size("hl_").alias("mh"), F.size("rl_").alias("mr"),
                 F.size("h").alias("nh"), F.size("r").alias("nr"),
                 pair_scores(F.col("h"), F.col("r"), F.col("hl_"), F.col("rl_")).alias("ps"))
    t = with_ngram_stats(t, F.col("h"), F.col("r"), range(1, max_order + 1), "b").drop("h", "r")
    row = with_ngram_stats(t, F.col("hs"), F.col("rs"), range(1, char_order + 1), "c", char_level=True).drop("hs", "rs")
    # Per-pair scores that are averaged.
    mx = F.greatest(F.col("nh"), F.col("nr"))
    sim = F.when(mx == 0, F.lit(1.0)).otherwise(1 - F.col("ps.distance") / mx)
    l = F.col("ps.lcs")
    pl, rl_ = l / F.col("nh"), l / F.col("nr")
    rouge = F.when(l == 0, F.lit(0.0)).otherwise(2 * pl * rl_ / (pl + rl_))
    m_ = F.col("ps.m")
    mp, mr = m_ / F.col("mh"), m_ / F.col("mr")
    fmean = mp * mr / (alpha * mp + (1 - alpha) * mr)
    met = F.when((m_ == 0) | (F.col("mh") == 0) | (F.col("mr") == 0), F.lit(0.0)).otherwise(
        (1 - gamma * F.pow(F.col("ps.chunks") / m_, m_beta)) * fmean)
    orders = [("b", n) for n in range(1, max_order + 1)] + [("c", n) for n in range(1, char_order + 1)]
    one = row.select(g, F.col("_loss").alias("tst_loss"), F.col("em").alias("exact_match"), sim.alias("leven_dist"), met.alias("meteor"),
                     rouge.alias("rouge"), *[F.col(f"{k}{n}.{x}").alias(f"{k}{x}{n}") for k, n in orders for x in ("m", "th", "tr")])
    means, sums = ["tst_loss", "exact_match", "leven_dist", "meteor", "rouge"], [f"{k}{x}{n}" for k, n in orders for x in ("m", "th", "tr")]
    # Sums per group, then the record over all groups from those few rows.
    a = one.groupBy(g).agg(*[F.sum(c).alias(c) for c in [*means, *sums]], *[F.count(c).alias(f"n_{c}") for c in means])
    if mix is not None:
        a = a.withColumn(g, F.explode(F.array(F.col(g), F.lit(mix)))).groupBy(g).agg(
            *[F.sum(c).alias(c) for c in [*means, *sums, *[f"n_{c}" for c in means]]])
    a = a.withColumns({c: F.when(F.col(f"n_{c}") > 0, F.col(c) / F.col(f"n_{c}")) for c in means})
    a = a.withColumns({"bleu": _bleu(max_order, "b")[0], "chrf": _chrf(char_order, beta, "c")})
    bleu, chrf = F.col("bleu"), F.col("chrf")
    wide = a.select(g, bleu.alias("bleu"), chrf.alias("chrf"), "exact_match", "leven_dist", "meteor", "rouge", "tst_loss")
    long = wide.select(g, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                             for m in SUITE_METRICS])))
    return long.select(g, "metric", F.concat_ws("_", F.col("metric"), F.col(g)).alias("name"), "value")


def metric_record_wide(suite: DataFrame, group_col: str) -> DataFrame:
    """E10 wide form: one row per group, one column per metric (pivot with
    the value list given, so no extra pass to find the columns)."""
    return suite.groupBy(group_col).pivot("metric", list(SUITE_METRICS)).agg(F.first("value"))


def result_rows(pr: DataFrame, keys: Sequence[str], train_type: Column, test_type: Column,
                loss: DataFrame | None = None, pred: str = "pred", ref: str = "ref",
                tokenizer: Tokenizer = ws_tokens) -> DataFrame:
    """The 8-column per-row result table, joined by row key (the
    reference zips by position).  `loss` is an optional keyed table."""
    t = pr.select(*keys, train_type.alias("train_type"), test_type.alias("test_type"),
                  tokenizer(F.col("input")).alias("input"), tokenizer(F.col(ref)).alias("reference"),
                  tokenizer(F.col(pred)).alias("prediction"),
                  (F.col(pred) == F.col(ref)).alias("exact_match"))
    t = t.withColumn("_d", token_edit_distance_col(F.col("prediction"), F.col("reference")))
    mx = F.greatest(F.size("prediction"), F.size("reference"))
    t = t.withColumn("levenshtein_distance", F.when(mx == 0, F.lit(1.0)).otherwise(1 - F.col("_d") / mx)).drop("_d")
    if loss is not None:
        t = t.join(loss.select(*keys, "loss"), list(keys), "left")
    else:
        t = t.withColumn("loss", F.lit(None).cast("double"))
    return t.select(*keys, "train_type", "test_type", "input", "reference", "prediction", "loss",
                    "exact_match", "levenshtein_distance")


def train_test_matrix(rows: DataFrame) -> DataFrame:
    """Aggregate of the stacked result rows per (train_type, test_type)."""
    return rows.groupBy("train_type", "test_type").agg(
        F.count("*").alias("n_rows"),
        F.avg(F.col("exact_match").cast("double")).alias("exact_match"),
        F.avg("levenshtein_distance").alias("leven_dist"))

def matrix_margins(rows: DataFrame) -> DataFrame:
    """E12 with margins: the matrix, each train and test type over all others, and
    the grand total in one `cube`.  `level` is the grouping id: 0 a cell, 1 a train
    type over all test types, 2 a test type over all train types, 3 all."""
    return rows.cube("train_type", "test_type").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_rows"),
        F.avg(F.col("exact_match").cast("double")).alias("exact_match"),
        F.avg("levenshtein_distance").alias("leven_dist"))


# ---------------------------------------------------------- step log

def epoch_rollup(log: DataFrame) -> DataFrame:
    """Per (run, epoch, metric) the batch-size-weighted mean of the step
    values, plus the step count and the last step's value."""
    return log.groupBy("run", "epoch", "metric").agg(
        (F.sum(F.col("value") * F.col("batch_size")) / F.sum("batch_size")).alias("epoch_value"),
        F.count("*").alias("n_steps"),
        F.max_by("value", "step").alias("last_value"))


def top_checkpoints(rollup: DataFrame, monitor: str, k: int = 5) -> DataFrame:
    """The k epochs with the lowest monitored value per run (window group
    limit), their labels, and which one is best."""
    v = rollup.filter(F.col("metric") == monitor).select("run", "epoch", F.col("epoch_value").alias("val_loss"))
    w = Window.partitionBy("run").orderBy("val_loss", "epoch")
    top = v.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    label = F.format_string("checkpoint-%02d-%.2f", F.col("epoch").cast("int"), F.col("val_loss").cast("double"))
    return top.select("run", F.col("rank").cast("int").alias("rank"), "epoch", "val_loss",
                      label.alias("label"), (F.col("rank") == 1).alias("is_best"))
