"""Completion candidates and functional outcomes.

Candidate fan-out is per row (`explode(sequence(...))`); outcome aggregation
is keyed by task with partial aggregation; the best candidate per task is a
`max_by` aggregate, and only one candidate's own outcomes are a list.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.blocks import well_nested
from tessera.functions.code import parses_col
from tessera.functions.stats import pass_at_k_col
from tessera.functions.joins import bounded, broadcast_bounded, broadcast_if_small
from tessera.session import ensure_checkpoint_dir

# The first-block separators (a newline followed by one of
# these words or characters), the pass@k list and the nucleus threshold.
FIRST_BLOCK_SEPARATORS = r"\nclass|\ndef|\n#|\n@|\nprint|\nif"
PASS_AT_K = (1, 10, 100)
TOP_P = 0.9


def prefix_candidates(df: DataFrame, key: Sequence[str], tokens: Column,
                      joiner: str = " ") -> DataFrame:
    """Every prefix 1..n of the predicted tokens, decoded (joined).

    `sequence(1, 0)` counts down in Spark, so empty predictions yield none."""
    base = df.select(*key, tokens.alias("_t"))
    k = F.explode(F.when(F.size("_t") > 0, F.sequence(F.lit(1), F.size("_t"))))
    return base.select(*key, "_t", k.alias("k")).select(
        *key, F.col("k").cast("int").alias("k"), F.array_join(F.slice("_t", 1, F.col("k")), joiner).alias("candidate"))


def fill_mask(code: Column, candidate: Column, mask: str) -> Column:
    """The candidate in place of every occurrence of the mask token.  The
    mask is an explicit argument (the reference's default never matched)."""
    return F.replace(code, F.lit(mask), candidate)


def balanced(c: Column, pairs: Sequence[tuple[str, str]] = (("(", ")"), ("[", "]"), ("{", "}"))) -> Column:
    """C3 native predicate: equal numbers of opening and closing brackets.

    The candidate is bound once: a filter repeats the expression that makes it
    wherever the predicate names it.  ASCII brackets are counted in bytes, which
    needs no pass over the text for its length."""
    def one(x):
        cond = None
        for o, cl in pairs:
            size = F.octet_length if (o + cl).isascii() else F.length
            e = (size(x) - size(F.replace(x, F.lit(o), F.lit("")))) == (size(x) - size(F.replace(x, F.lit(cl), F.lit(""))))
            cond = e if cond is None else cond & e
        return cond
    return F.element_at(F.transform(F.array(c), one), 1)


def valid_candidates(df: DataFrame, candidate: str = "candidate", cheap_filter: Column | None = None) -> DataFrame:
    """Keep candidates that parse as Python.  Native filters run first
    (brackets reduced in order, quotes closed, then the caller's); Catalyst
    does not reorder predicates around a Python UDF by cost."""
    df = nested_candidates(df, candidate)
    if cheap_filter is not None:
        df = df.filter(cheap_filter)
    return df.filter(parses_col(F.col(candidate)))


def nested_candidates(df: DataFrame, candidate: str = "candidate") -> DataFrame:
    """C3, native: keep candidates whose brackets reduce to nothing on a stack, in
    order and outside strings and comments, and whose quotes are closed."""
    return df.filter(well_nested(F.col(candidate)))


def first_block(prompt: Column, completion: Column, separators: str = FIRST_BLOCK_SEPARATORS) -> Column:
    """C4: drop the prompt from the completion, cut at the first separator,
    strip trailing white space, put the prompt back in front."""
    rest = F.replace(completion, prompt, F.lit(""))
    head = F.element_at(F.split(rest, separators, -1), 1)
    return F.concat(prompt, F.regexp_replace(head, r"\s+$", ""))


def fanout_candidates(df: DataFrame, key: Sequence[str], prompt: str, samples: DataFrame,
                      sample_tokens: Callable[[], Column],
                      separators: str = FIRST_BLOCK_SEPARATORS, joiner: str = " ") -> DataFrame:
    """Prompts x samples -> all prefixes of each sample -> first block.

    `samples` is a small axis table (a `sample` column plus whatever the
    sampler needs; bounded by the number of samples asked for) broadcast into
    the cross join.  `sample_tokens()` returns the predicted-token column of
    one (row, sample) and may read columns of both sides."""
    x = df.crossJoin(broadcast_bounded(samples))
    x = x.select(*key, prompt, "sample", sample_tokens().alias("_tok"))
    pc = prefix_candidates(x, [*key, prompt, "sample"], F.col("_tok"), joiner)
    completion = F.concat(F.col(prompt), F.lit(joiner), F.col("candidate"))
    return pc.select(*key, "sample", "k", first_block(F.col(prompt), completion, separators).alias("text"))


def test_programs(code: Column, assertion: Column) -> Column:
    """Completion, newline, assertion."""
    return F.concat_ws("\n", code, assertion)


def task_assertions(tasks: DataFrame) -> DataFrame:
    """Both assertion lists of each task, exploded and tagged easy/hard."""
    easy = tasks.select("task_id", F.lit("easy").alias("kind"),
                        F.posexplode("test_list").alias("assert_idx", "assertion"))
    hard = tasks.select("task_id", F.lit("hard").alias("kind"),
                        F.posexplode("challenge_test_list").alias("assert_idx", "assertion"))
    return easy.unionByName(hard)


def candidate_assertions(outcomes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every assertion of every candidate with its 0/1 outcome: the outcome
    table (task_id, candidate, kind, assert_idx, passed) meets the tasks'
    assertions by (task, kind, index).  A task may hold a third of all
    candidates, so the assertions are broadcast if their measured size allows;
    else it is a shuffle join on all three keys."""
    a = task_assertions(tasks)
    ensure_checkpoint_dir(a.sparkSession)
    a = a.checkpoint(eager=True)
    a = broadcast_if_small(a, row_bound=a.count())
    return outcomes.join(a, ["task_id", "kind", "assert_idx"]).select(
        "task_id", "candidate", "kind", F.col("assert_idx").cast("int").alias("assert_idx"),
        "assertion", F.col("passed").cast("int").alias("passed"))


def best_candidate(cand_asserts: DataFrame) -> DataFrame:
    """Per task and kind, the candidate with the most passed assertions;
    the first (lowest) candidate on ties.  Easy and hard are independent."""
    per = cand_asserts.groupBy("task_id", "kind", "candidate").agg(
        F.sum("passed").cast("long").alias("n_passed"),
        F.sort_array(F.collect_list(F.struct("assert_idx", "passed"))).alias("_o"))
    best = per.groupBy("task_id", "kind").agg(
        F.max_by(F.struct("candidate", "n_passed", "_o"),
                 F.struct(F.col("n_passed"), -F.col("candidate"))).alias("b"))
    return best.select("task_id", "kind", F.col("b.candidate").alias("best_candidate"),
                       F.col("b.n_passed").alias("n_passed"),
                       F.transform("b._o", lambda x: x["passed"]).alias("asserts"))


def best_or_zero(best: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every task; a task without candidates gets all-zero assertion lists
    and a null completion (left join + coalesce)."""
    e = best.filter(F.col("kind") == "easy").select(
        "task_id", F.col("asserts").alias("ea"), F.col("best_candidate").alias("easy_candidate"))
    h = best.filter(F.col("kind") == "hard").select(
        "task_id", F.col("asserts").alias("ha"), F.col("best_candidate").alias("hard_candidate"))
    t = tasks.join(e, "task_id", "left").join(h, "task_id", "left")
    return t.select(
        "task_id",
        F.coalesce("ea", F.array_repeat(F.lit(0), F.size("test_list"))).alias("easy_asserts"),
        F.coalesce("ha", F.array_repeat(F.lit(0), F.size("challenge_test_list"))).alias("hard_asserts"),
        "easy_candidate", "hard_candidate")


def assert_accuracy(results: DataFrame) -> DataFrame:
    """Accuracy over all assertions per kind; a kind with no assertion
    yields no row."""
    e = results.select(F.lit("easy").alias("kind"), F.explode("easy_asserts").alias("a"))
    h = results.select(F.lit("hard").alias("kind"), F.explode("hard_asserts").alias("a"))
    return e.unionByName(h).groupBy("kind").agg(
        F.avg(F.col("a").cast("double")).alias("accuracy"), F.count("*").alias("n_asserts"))


def uncompleted_count(results: DataFrame) -> DataFrame:
    """C11: number of tasks without a completion."""
    return results.agg(F.count_if(F.col("easy_candidate").isNull()).alias("n_uncompleted"),
                       F.count("*").alias("n_tasks"))


def pass_at_k(outcomes: DataFrame, task_col: str, pass_col: str, ks: Sequence[int] = PASS_AT_K,
              group_cols: Sequence[str] = ()) -> DataFrame:
    """Unbiased pass@k per task, 1 - prod_{i=n-c+1..n} (1 - k/i) (1 when
    n - c < k, 0 when c = 0), averaged per group; a k is reported only when
    every task of the group has n >= k."""
    g = list(group_cols)
    per = outcomes.groupBy(*g, task_col).agg(F.count("*").alias("n"),
                                             F.sum(F.col(pass_col).cast("long")).alias("c"))
    ks_df = bounded(outcomes.sparkSession.createDataFrame([(int(k),) for k in ks], "k int"), len(ks))
    x = per.crossJoin(broadcast_bounded(ks_df))
    n, c, k = F.col("n"), F.col("c"), F.col("k")
    # One row per (task, k) after a partial + final aggregate; the estimator
    # is k native terms per row, whatever the task's size.
    est = pass_at_k_col(n, c, k)
    return x.groupBy(*g, "k").agg(F.avg(est).alias("pass_at_k"), F.min("n").alias("_min_n")) \
            .filter(F.col("_min_n") >= F.col("k")).drop("_min_n")


def top_p_filter(dist: DataFrame, p: float = TOP_P, row_col: str = "vec_id",
                 token_col: str = "token", logit_col: str = "logit") -> DataFrame:
    """Softmax per row; keep tokens whose *preceding* cumulative
    probability (sorted by probability desc, then token) is <= p, so the top
    token is always kept.  Windows are per distribution row (bounded by the
    vocabulary), and share one partitioning."""
    w = Window.partitionBy(row_col)
    e = dist.withColumn("_e", F.exp(F.col(logit_col) - F.max(logit_col).over(w)))
    pr = e.withColumn("prob", F.col("_e") / F.sum("_e").over(w))
    wc = Window.partitionBy(row_col).orderBy(F.col("prob").desc(), F.col(token_col)) \
               .rowsBetween(Window.unboundedPreceding, -1)
    cum = pr.withColumn("cum_before", F.coalesce(F.sum("prob").over(wc), F.lit(0.0)))
    return cum.filter(F.col("cum_before") <= p).drop("_e", "cum_before")


def complete_batch(df: DataFrame, key: Sequence[str], text: str,
                   model_factory: Callable[[], Callable[[pd.Series], pd.Series]],
                   out_col: str = "completion") -> DataFrame:
    """Batch completion with a caller-supplied model.  The model is built
    once per Python worker (inside the iterator), fed Arrow batches of the
    text column, and returns an array<string> of predicted tokens per row."""
    k = list(key)
    schema = df.select(*k).schema.add(out_col, T.ArrayType(T.StringType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for pdf in batches:
            out = pdf[k].copy()
            out[out_col] = model(pdf[text])
            yield out
    return df.select(*k, text).mapInPandas(run, schema)


def tail_echo_model(n_tokens: int = 8):
    """A stand-in model for C16: predicts the last `n_tokens` white-space
    tokens of its prompt.  Real models plug in through `model_factory`."""
    def factory():
        def model(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [] if t is None else t.split()[-n_tokens:])
        return model
    return factory
