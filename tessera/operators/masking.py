"""Span finding, masking and length binning (M1-M9)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import line_start_offsets
from tessera.functions.joins import broadcast_if_small

# Fixed values.
MASK_TOKEN = "<MASK>"
QUARTILES = (0.25, 0.5, 0.75)
# Corpus length class per quartile bin 0..3 (our definition: the lower half is
# short, the third quartile medium, the top quartile long).
LENGTH_CLASS_BY_BIN = ("short", "short", "medium", "long")
# Size classes of masked units and their average token lengths.
SIZE_CLASS_AVG = (("simple", 11), ("medium", 19), ("complex", 45))


# --------------------------------------------------------------------- M5/M6/M7

def length_quantiles(df: DataFrame, value_col: str, probs=QUARTILES,
                     exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """One row: `edges` = quantiles of `value_col` (linear interpolation).

    The exact `percentile` aggregate keeps a value -> count map (partial + final
    aggregation), so its memory is bounded by the number of *distinct* values,
    e.g. at most the longest text for token counts.  For unbounded distinct
    values use `exact=False` (`percentile_approx`, fixed-size sketch)."""
    p = F.array(*[F.lit(float(x)) for x in probs])
    agg = (F.percentile(F.col(value_col).cast("double"), p) if exact
           else F.percentile_approx(F.col(value_col).cast("double"), p, accuracy).cast("array<double>"))
    return df.agg(agg.alias("edges"))


def selected_quantiles(df: DataFrame, value_col: str, probs=QUARTILES, buckets: int = 1024) -> DataFrame:
    """M5 for values of any number: exact quantiles (linear interpolation) without
    one map of all distinct values.

    Distributed selection: each pass counts the values in `buckets` equal parts of
    the intervals that hold a wanted rank, with the least and largest value of
    each, and goes on inside the parts that hold the ranks.  A pass shuffles and
    returns at most `buckets` rows per interval; as the ends of an interval are
    values that fall into different parts, every pass narrows it.  Nulls and NaN
    are left out; without values `edges` is null."""
    from tessera.session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    x = df.select(F.col(value_col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).checkpoint(eager=True)
    n, least, most = x.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return spark.createDataFrame([(None,)], "edges array<double>")
    at = [float(p) * (n - 1) for p in probs]
    found: dict = {}
    todo = {r: (least, most, 0) for p in at for r in (math.floor(p), math.ceil(p))}  # rank -> interval, values below it
    while todo:
        for r in [r for r, (lo, hi, _) in todo.items() if lo == hi]:
            found[r] = todo.pop(r)[0]
        spans = sorted({(lo, hi) for lo, hi, _ in todo.values()})
        if not spans:
            break
        # Halves where the width of an interval is not finite.
        by = [0.5 if math.isinf(hi - lo) else 1.0 for lo, hi in spans]
        part = [F.struct(F.lit(i).alias("i"), F.least(F.lit(buckets - 1), F.floor(
            (F.col("x") * c - lo * c) / (hi * c - lo * c) * buckets)).cast("int").alias("b")) for i, ((lo, hi), c) in enumerate(zip(spans, by))]
        inside = F.coalesce(*[F.when(F.col("x").between(lo, hi), p) for (lo, hi), p in zip(spans, part)])
        rows = x.select("x", inside.alias("p")).where("p IS NOT NULL").groupBy("p").agg(
            F.count("x").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r, (lo, hi, below) in todo.items():
            for row in sorted((y for y in rows if y["p"]["i"] == spans.index((lo, hi))), key=lambda y: y["p"]["b"]):
                if r < below + row["c"]:
                    todo[r] = (row["lo"], row["hi"], below)
                    break
                below += row["c"]
    edges = [found[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * found[math.floor(p)] + (p - math.floor(p)) * found[math.ceil(p)]
             for p in at]
    return spark.createDataFrame([(edges,)], "edges array<double>")


def length_bins(df: DataFrame, value_col: str, bin_col: str = "bin", probs=QUARTILES,
                exact: bool = True) -> DataFrame:
    """Bin = number of edges <= value (np.digitize, right=False).

    The edges are a single row (proven size bound), joined by broadcast."""
    return bins_of(df, value_col, length_quantiles(df, value_col, probs, exact), bin_col)


def bins_of(df: DataFrame, value_col: str, edges: DataFrame, bin_col: str = "bin") -> DataFrame:
    """M6 for given edges (one row)."""
    joined = df.crossJoin(broadcast_if_small(edges, row_bound=1))
    b = F.aggregate(F.col("edges"), F.lit(0),
                    lambda acc, e: acc + F.when(F.col(value_col) >= e, 1).otherwise(0))
    return joined.withColumn(bin_col, b.cast("int")).drop("edges")


def length_class_of_bin(bin_col: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LENGTH_CLASS_BY_BIN]), bin_col + 1)


def bucket_of_bin(bin_col: Column, compat: bool = True) -> Column:
    """M7.  compat=True keeps the routing where bins 0 and 3 both go to `lg`."""
    if compat:
        return (F.when(bin_col == 1, F.lit("sm")).when(bin_col == 2, F.lit("md"))
                .otherwise(F.lit("lg")))
    return (F.when(bin_col <= 1, F.lit("sm")).when(bin_col == 2, F.lit("md"))
            .otherwise(F.lit("lg")))


# ------------------------------------------------------------- M1-M4 (per row)
#
# Spans, masked prompts and the nested task lists are computed inside each
# document row with higher-order functions: no explode/regroup, so no shuffle.
# The flat task view is `inline` of the nested array.

def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its lines and their 0-based start offsets."""
    d = docs.select(key, text, F.split(F.col(text), "\n", -1).alias("lines"))
    return d.withColumn("offs", line_start_offsets(F.col("lines")))


def _line_structs(lines: Column, offs: Column) -> Column:
    return F.transform(F.arrays_zip(lines.alias("line"), offs.alias("start")),
                       lambda z, i: F.struct(i.cast("long").alias("line_no"),
                                             z["start"].alias("start"),
                                             F.length(z["line"]).cast("long").alias("span_len"),
                                             z["line"].alias("line")))


def line_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """M1 (line finder): every line as a span (start offset, length)."""
    t = line_table(docs, key, text)
    return t.select(key, F.inline(_line_structs(F.col("lines"), F.col("offs"))))


def span_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """M2: (row, column) -> character offset = start of the row + column; the
    column here is the first non-blank character of each line."""
    spans = line_spans(docs, key, text)
    col = (F.length("line") - F.length(F.ltrim("line"))).cast("long")
    return spans.select(key, "line_no", col.alias("col"), (F.col("start") + col).alias("offset"))


def mask_text(text: Column, start: Column, length: Column, mask: str = MASK_TOKEN) -> Column:
    """M3: text with [start, start+length) replaced by the mask token."""
    return F.concat(F.substr(text, F.lit(1), start), F.lit(mask), F.substr(text, start + length + 1))


def solution_text(text: Column, start: Column, length: Column) -> Column:
    return F.substr(text, start + 1, length)


def nested_tasks(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 mask: str = MASK_TOKEN, digest: bool = False) -> DataFrame:
    """M3 + M4: per document, the list of (line_no, masked_prompt, solution)
    for every non-empty line, in line order.  `digest=True` keeps the md5 of
    the masked prompt instead of the prompt (each prompt is a whole document)."""
    t = line_table(docs, key, text)
    spans = F.filter(_line_structs(F.col("lines"), F.col("offs")), lambda s: s["span_len"] > 0)
    tx = F.col(text)

    def task(s):
        m = mask_text(tx, s["start"], s["span_len"], mask)
        return F.struct(s["line_no"].alias("line_no"),
                        (F.md5(m) if digest else m).alias("masked_md5" if digest else "masked_prompt"),
                        solution_text(tx, s["start"], s["span_len"]).alias("solution"))
    return t.select(key, F.transform(spans, task).alias("tasks"))


def mask_spans(docs: DataFrame, key: str = "doc_id", text: str = "text",
               mask: str = MASK_TOKEN, digest: bool = False, keep_text: bool = False) -> DataFrame:
    """M3 flat view: one row per masked line; `keep_text` keeps the text too.

    The spans are generated first and each masked prompt is built in its own
    output row, so a long document never materialises all of its masked
    copies in one nested value."""
    t = line_table(docs, key, text)
    spans = F.filter(_line_structs(F.col("lines"), F.col("offs")), lambda s: s["span_len"] > 0)
    ex = t.select(key, text, F.inline(spans))
    tx = F.col(text)
    m = mask_text(tx, F.col("start"), F.col("span_len"), mask)
    return ex.select(key, *([text] if keep_text else []), "line_no",
                     (F.md5(m) if digest else m).alias("masked_md5" if digest else "masked_prompt"),
                     solution_text(tx, F.col("start"), F.col("span_len")).alias("solution"))


def code_blocks(docs: DataFrame, key: str = "doc_id", code: str = "code", keep_text: bool = False) -> DataFrame:
    """M1 (code-block finder): every nested block as a span, in pre-order:
    `(key, block_no, start, span_len)`; no Python and no shuffle."""
    from tessera.functions.blocks import block_spans, code_tokens, logical_lines
    kept = [key, *([code] if keep_text else [])]
    # Each step is a column of its own, so that it is evaluated once.
    t = docs.select(*kept, code_tokens(F.col(code)).alias("_t"))
    t = t.select(*kept, logical_lines(F.col("_t")).alias("_l"))
    t = t.select(*kept, F.posexplode(block_spans(F.col("_l"))).alias("_no", "_b"))
    return t.select(*kept, F.col("_no").cast("long").alias("block_no"), F.col("_b.start").alias("start"),
                    (F.col("_b.end") - F.col("_b.start")).alias("span_len"))


def block_tasks(docs: DataFrame, key: str = "doc_id", code: str = "code", mask: str = MASK_TOKEN, digest: bool = False) -> DataFrame:
    """M3 and M4 over code blocks: one task per nested block, the program with
    the block masked and the block as its solution (`digest`: md5 of both)."""
    t = code_blocks(docs, key, code, keep_text=True)
    masked = mask_text(F.col(code), F.col("start"), F.col("span_len"), mask)
    solution = solution_text(F.col(code), F.col("start"), F.col("span_len"))
    if digest:
        return t.select(key, "block_no", F.md5(masked).alias("masked_md5"), F.md5(solution).alias("solution_md5"))
    return t.select(key, "block_no", masked.alias("masked_prompt"), solution.alias("solution"))


# ------------------------------------------------------------------ M5-M7 rows

def span_token_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-empty line spans with their white-space token counts."""
    from tessera.functions.text import ws_tokens
    spans = line_spans(docs, key, text).filter(F.col("span_len") > 0)
    return spans.select(key, "line_no", F.size(ws_tokens("line")).cast("long").alias("n_tokens"))


# ------------------------------------------------------------------------- M8

def mask_by_class_wide(docs: DataFrame, key: str = "doc_id", text: str = "text",
                       classes=SIZE_CLASS_AVG, mask: str = MASK_TOKEN) -> DataFrame:
    """M8: for each size class, the non-empty line whose token count is
    nearest to the class average (ties: the earlier line), masked.  Wide
    layout `{size}_line_no, {size}_n_tokens, {size}_input, {size}_target`,
    computed per row with `array_min` over structs (no shuffle)."""
    from tessera.functions.text import ws_tokens
    t = line_table(docs, key, text)
    spans = F.filter(_line_structs(F.col("lines"), F.col("offs")), lambda s: s["span_len"] > 0)
    t = t.select(key, text, F.transform(spans, lambda s: F.struct(
        s["line_no"].alias("line_no"), s["start"].alias("start"), s["span_len"].alias("span_len"),
        F.size(ws_tokens(s["line"])).cast("long").alias("n_tokens"))).alias("spans"))
    def nearest(avg):
        return lambda s: F.struct(
            F.abs(s["n_tokens"] - F.lit(avg)).alias("d"), s["line_no"].alias("line_no"),
            s["start"].alias("start"), s["span_len"].alias("span_len"), s["n_tokens"].alias("n_tokens"))
    # Materialise each class's choice once, then cut the text from it.
    t = t.select(key, text, *[F.array_min(F.transform(F.col("spans"), nearest(avg))).alias(f"_b_{name}")
                              for name, avg in classes])
    cols = [F.col(key)]
    tx = F.col(text)
    for name, _ in classes:
        best = F.col(f"_b_{name}")
        cols.append(F.struct(best["line_no"].alias("line_no"), best["n_tokens"].alias("n_tokens"),
                             mask_text(tx, best["start"], best["span_len"], mask).alias("input"),
                             solution_text(tx, best["start"], best["span_len"]).alias("target"))
                    .alias(f"_{name}"))
    w = t.select(*cols)
    flat = [F.col(key)]
    for name, _ in classes:
        for f in ("line_no", "n_tokens", "input", "target"):
            flat.append(F.col(f"_{name}.{f}").alias(f"{name}_{f}"))
    return w.select(*flat)
