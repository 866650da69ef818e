"""Operator 4: robust multivariate outliers, in DataFrame operations only.

Each text (words `[^\\x20\\x09-\\x0D]+`) gets counts, and from them a vector of
four transformed statistics: the log of the mean word length, and the square
roots of the shares of symbols, of repeated lines and of words in repeated
3-word windows.  For every language and source the minimum covariance
determinant estimate of centre and scatter is found by concentration steps:
from the coordinates' medians and median deviations, take the `COVERED` part
of the rows with the smallest Mahalanobis distance, estimate anew from them,
and again.  The scatter is scaled so that this part's distance has its
chi-square value, and `FLOOR`, a very small variance, is added to each
coordinate against singular scatter.  Most texts have no symbols or repeated
lines at all, so the covered part's scatter is zero or next to it there: a
coordinate with less than `LEAST` gets `LEAST`, one step of that statistic.
A row whose squared distance exceeds the chi-square value of `TAIL` is
rejected: with nothing repeated at the centre, from a share of 18 % of repeated
lines, or of words in repeated windows, alone.

Rows of fewer than `MIN_WORDS` words, or with more than half their words in
repeated windows, have failed the base rule: they are not kept and take no part
in the estimates.  Sources with fewer than `MIN_ROWS` other rows of a language
are estimated together per language, and languages that then still have too
few together; if those are too few as well there is no verdict against them.
A null language or source is a value like any other.  Null, empty and blank
texts have 0 everywhere and fail the base rule.  Repeated rows count as often
as they occur and get equal verdicts.  Long texts are counted whole.

All estimates are grouped sums and histograms with partial aggregation, so a
source with a third of all rows is summed where its rows lie.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, words_of

MIN_WORDS = 50
REPEAT_PERCENT = 50
COVERED = 0.75
STEPS = 4
MIN_ROWS = 50
TAIL = 0.001
#: Variance added to each coordinate, against singular scatter only.
FLOOR = (1e-6,) * 4
#: Variance of a coordinate in which the covered rows (nearly) all agree.
LEAST = (0.05 ** 2, 0.05 ** 2, 0.10 ** 2, 0.10 ** 2)
P = len(FLOOR)
#: Distinct repeated windows up to which a text's windows are looked up in
#: their list; beyond it windows are sorted with their places.  Equal results.
LISTED = 64

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def chi_square(tail: float, p: int = P) -> float:
    """The value that a chi-square variable of `p` (even) degrees exceeds
    with probability `tail`."""
    def beyond(x):
        return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beyond(mid) > tail else (lo, mid)
    return hi


def _covered(places: Column) -> Column:
    """Words covered by 3-word windows at these sorted places."""
    each = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1), p + 3) - p))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` (without its text) with n_words, word_chars, n_symbols, n_lines,
    n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [c for c in docs.columns if c != text_col]
    no_space = F.translate(text, _SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, _SPACES, "") != "")
    a = docs.select(*keep, F.length(no_space).cast("long").alias("word_chars"),
                    (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    lines.alias("_l"), words_of(F.col(text_col)).alias("_w"))
    window = F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(*[F.element_at("_w", i + k) for k in range(3)]))
    a = a.select(*keep, "word_chars", "n_symbols", F.size("_w").cast("long").alias("n_words"), F.size("_l").cast("long").alias("n_lines"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                 F.when(F.size("_w") > 2, window).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    base = [*keep, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    a = a.select(*base, "_h", F.sort_array("_h").alias("_s"))
    twice = F.filter("_s", lambda x, i: F.get(F.col("_s"), i - 1) == x)
    a = a.select(*base, "_h", F.array_distinct(F.filter(twice, lambda x: x.isNotNull())).alias("_d"))
    listed = F.filter(F.transform("_h", lambda h, i: F.when(F.array_contains("_d", h), i)), lambda i: i.isNotNull())
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    a = a.select(*base, F.size("_d").alias("_n"), F.when((F.size("_d") > 0) & (F.size("_d") <= LISTED), listed).alias("_p"),
                 F.when(F.size("_d") > LISTED, pairs).alias("_z"))
    same = F.filter("_z", lambda z, i: (F.get(F.col("_z"), i - 1)["h"] == z["h"]) | (F.get(F.col("_z"), i + 1)["h"] == z["h"]))
    a = a.select(*base, F.when(F.col("_n") > LISTED, F.sort_array(F.transform(same, lambda z: z["i"]))).otherwise(F.col("_p")).alias("_p"))
    return a.select(*base, F.coalesce(_covered(F.col("_p")), F.lit(0)).cast("long").alias("n_repeat_words"))


def statistics() -> list[Column]:
    """The vector of a row with the columns of `counts`."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
            F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            F.sqrt(F.col("n_repeat_words") / n)]


def _groups(rows: DataFrame) -> DataFrame:
    """`rows` (lang, source, used) with their group `g`, null without one."""
    per = rows.where("used").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("pool", F.sum(F.when(F.col("n") < MIN_ROWS, F.col("n"))).over(Window.partitionBy("lang")))
    per = stored(per.withColumn("g", F.when(F.col("n") >= MIN_ROWS, F.to_json(F.array("lang", "source")))
                                .when(F.col("pool") >= MIN_ROWS, F.to_json(F.array("lang")))))
    rest = per.where("g IS NULL").agg(F.sum("n").alias("rest"))  # one row
    per = per.crossJoin(F.broadcast(rest)).select("lang", "source", F.when(F.col("g").isNull() & (F.col("rest") >= MIN_ROWS), F.lit("[]"))
                                                  .otherwise(F.col("g")).alias("g"))
    return rows.join(per, ["lang", "source"], "left")


def _medians(rows: DataFrame, value: list[Column], width: float = 1 / 512) -> DataFrame:
    """(g, v1..vP): each coordinate's median per group, to half a bin."""
    each = rows.select("g", F.posexplode(F.array(*value)).alias("k", "v"))
    bins = each.groupBy("g", "k", F.floor(F.col("v") / width).alias("b")).count()
    w = Window.partitionBy("g", "k")
    bins = bins.withColumn("upto", F.sum("count").over(w.orderBy("b"))).withColumn("all", F.sum("count").over(w))
    mid = bins.where("2 * upto >= all").groupBy("g", "k").agg(((F.min("b") + 0.5) * width).alias("v"))
    return mid.groupBy("g").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k + 1}") for k in range(P)])


def _distance() -> Column:
    """Squared Mahalanobis distance of x1..xP from centre m1..mP under the
    scatter's Cholesky factor l11, l21, l22, ..."""
    y: list[Column] = []
    for i in range(P):
        behind = sum((F.col(f"l{i + 1}{j + 1}") * y[j] for j in range(i)), F.lit(0.0))
        y.append((F.col(f"x{i + 1}") - F.col(f"m{i + 1}") - behind) / F.col(f"l{i + 1}{i + 1}"))
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _least(variance: Column, i: int) -> Column:
    """A coordinate's variance; only the diagonal grows, so the scatter stays
    positive definite."""
    return F.greatest(variance, F.lit(LEAST[i])) + FLOOR[i]


def _factor(est: DataFrame) -> DataFrame:
    """(g, m.., c..) with the Cholesky factor of c (the floor is in it)."""
    for i in range(P):
        for j in range(i + 1):
            done = sum((F.col(f"l{i + 1}{k + 1}") * F.col(f"l{j + 1}{k + 1}") for k in range(j)), F.lit(0.0))
            rest = F.col(f"c{i + 1}{j + 1}") - done
            cell = F.sqrt(F.greatest(rest, F.lit(FLOOR[i]))) if i == j else rest / F.col(f"l{j + 1}{j + 1}")
            est = est.withColumn(f"l{i + 1}{j + 1}", cell)
    cells = [f"l{i + 1}{j + 1}" for i in range(P) for j in range(i + 1)]
    return stored(est.select("g", *[f"m{i + 1}" for i in range(P)], *cells))


_PER_LOG = 64  # bins of the distance per power of two


def _nearest(rows: DataFrame, est: DataFrame) -> DataFrame:
    """`rows` with their distance `d` and `q`: the least bin bound of their
    group's distances that covers COVERED of its rows."""
    far = rows.join(est, "g").withColumn("d", _distance()).withColumn(
        "b", F.ceil(F.log2(F.greatest(F.col("d"), F.lit(1e-9))) * _PER_LOG))
    bins = far.groupBy("g", "b").count()
    w = Window.partitionBy("g")
    bins = bins.withColumn("upto", F.sum("count").over(w.orderBy("b"))).withColumn("all", F.sum("count").over(w))
    bound = bins.where(F.col("upto") >= COVERED * F.col("all")).groupBy("g").agg(F.min("b").alias("q"))
    return far.join(bound, "g")


def estimates(rows: DataFrame) -> DataFrame:
    """(g, m1..mP, l11..lPP) per group of the rows (g, x1..xP)."""
    x = [F.col(f"x{k + 1}") for k in range(P)]
    centre = stored(_medians(rows, x))
    spread = _medians(rows.join(centre, "g"), [F.abs(x[k] - F.col(f"v{k + 1}")) for k in range(P)])
    start = centre.toDF("g", *[f"m{k + 1}" for k in range(P)]).join(spread, "g")
    cells = []
    for i in range(P):
        for j in range(i + 1):
            cells.append((_least(F.pow(1.4826 * F.col(f"v{i + 1}"), 2), i) if i == j else F.lit(0.0)).alias(f"c{i + 1}{j + 1}"))
    est = _factor(start.select("g", *[f"m{k + 1}" for k in range(P)], *cells))
    for step in range(STEPS):
        near = _nearest(rows, est).where("b <= q")
        ks = [(i, j) for i in range(P) for j in range(i + 1)]
        sums = near.groupBy("g").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(x[i] - F.col(f"m{i + 1}")).alias(f"s{i + 1}") for i in range(P)],
            *[F.sum((x[i] - F.col(f"m{i + 1}")) * (x[j] - F.col(f"m{j + 1}"))).alias(f"s{i + 1}{j + 1}") for i, j in ks],
            *[F.first(f"m{i + 1}").alias(f"o{i + 1}") for i in range(P)])
        mean = [F.col(f"s{i + 1}") / F.col("n") for i in range(P)]
        est = _factor(sums.select("g", *[(F.col(f"o{i + 1}") + mean[i]).alias(f"m{i + 1}") for i in range(P)],
                                  *[(_least(c, i) if i == j else c).alias(f"c{i + 1}{j + 1}") for i, j in ks
                                    for c in [F.col(f"s{i + 1}{j + 1}") / F.col("n") - mean[i] * mean[j]]]))
    return est


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """Per row of `docs`: the id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance (squared, scaled; null where there
    is none) and kept."""
    null = F.lit("\x00")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), null).alias("lang"),
                         F.coalesce(F.col(source_col).cast("string"), null).alias("source"), F.col(text_col).alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = counts(source).withColumn("base_failed", failed).withColumn("used", ~failed)
    rows = stored(rows.select("*", *[v.alias(f"x{k + 1}") for k, v in enumerate(statistics())]))
    rows = stored(_groups(rows))
    x = [f"x{k + 1}" for k in range(P)]
    used = rows.where("used AND g IS NOT NULL").select("g", *x)
    est = estimates(used)
    # The covered part's distance, set against its chi-square value; never below 1.
    scale = _nearest(used, est).groupBy("g").agg(F.greatest(F.pow(F.lit(2.0), F.max("q") / _PER_LOG) / chi_square(1 - COVERED), F.lit(1.0)).alias("scale"))
    est = stored(est.join(scale, "g"))
    out = rows.join(est, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("scale")))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi_square(tail))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "distance", kept.alias("kept"))
