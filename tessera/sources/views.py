"""Derived views over the driver tables (the fixtures every operator runs on).

Each view is a lazy plan over the given tables, so its work grows with them.
The DuckDB oracle writes the same views in SQL (`tessera.plans.oracle`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arrays import line_start_offsets
from tessera.functions.text import word_count, ws_tokens
from tessera.sources.tables import read_table

# Fixed values of the fixtures.
SPLIT_TRAIN_BELOW = 8          # doc_id % 10 < 8 -> train, 8 -> validation, 9 -> test
CORRUPTION_PERIOD = 7          # prediction drops tokens whose 0-based index % period == 3
CORRUPTION_PHASE = 3
POSITION_TYPES = ("sinusoidal", "rotary", "alibi", "relative")  # sweep axis
CODE_DEPTHS = 4                # indentation levels of the code view
LOGIT_SCALE = 10.0             # dist: logits = 10 * embedding value


def docs_with_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + split + language (no length class: no quantile pass).

    Use this wherever the length class is not needed -- a cross join with the
    quantile edges cannot be pruned away, so `corpus` always pays that pass."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", "text", F.col("lang").alias("language"), "source", "n_chars",
        word_count("text").cast("long").alias("n_words"),
        F.when(F.col("doc_id") % 10 < SPLIT_TRAIN_BELOW, F.lit("train"))
         .when(F.col("doc_id") % 10 == SPLIT_TRAIN_BELOW, F.lit("validation"))
         .otherwise(F.lit("test")).alias("split"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + split + language + length class (quartile bins of word count)."""
    from tessera.operators.masking import length_bins, length_class_of_bin

    base = docs_with_split(spark, sf_dir)
    binned = length_bins(base, "n_words", bin_col="length_bin")
    return binned.withColumn("length", length_class_of_bin(F.col("length_bin"))).drop("length_bin")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn followed directly by an assistant turn -> (input, target).

    Written as an equi-join on (conv_id, turn) rather than `lag` over a
    conversation window: the join key is unique per row, so one giant
    conversation spreads over all tasks instead of landing in one."""
    conv = read_table(spark, sf_dir, "conversations")
    asst = conv.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("target"))
    user = conv.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("input"))
    return asst.join(user, ["conv_id", "turn"]).select("conv_id", "turn", "input", "target")


def corrupt(tokens, period: int = CORRUPTION_PERIOD, phase: int = CORRUPTION_PHASE):
    return F.filter(tokens, lambda x, i: i % period != phase)


def pred_ref(spark: SparkSession, sf_dir: str, period: int = CORRUPTION_PERIOD) -> DataFrame:
    """Predictions and references (whole targets) keyed by (conv_id, turn)."""
    p = pairs(spark, sf_dir).select("conv_id", "turn", "input", ws_tokens("target").alias("toks"))
    return p.select("conv_id", "turn", "input",
                    F.array_join(corrupt(F.col("toks"), period), " ").alias("pred"),
                    F.array_join(F.col("toks"), " ").alias("ref"))


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with its 0-based character offset."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.split("text", "\n", -1).alias("lines"))
    with_off = docs.select("doc_id", "text", "lines",
                           line_start_offsets(F.col("lines")).alias("offs"))
    return with_off.select(
        "doc_id", "text",
        F.posexplode(F.arrays_zip(F.col("lines").alias("line"), F.col("offs").alias("off")))
         .alias("pos", "z")).select(
        "doc_id", "text", F.col("pos").cast("long").alias("line_no"),
        F.col("z.line").alias("line"), F.col("z.off").alias("start"),
        F.length(F.col("z.line")).cast("long").alias("span_len"))


def code_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as code: every line becomes a compound statement's header, as deep
    as its word count says, with the line as its comment; every third spans two
    lines inside a bracket."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))

    def header(line, k):
        n = word_count(line)
        return F.concat(F.repeat(F.lit("    "), (n % CODE_DEPTHS).cast("int")), F.lit("if f("), n.cast("string"),
                        F.when(n % 3 == 0, F.lit(",\n")).otherwise(F.lit(", ")), k.cast("string"), F.lit("): # "), line)
    return docs.select("doc_id", F.array_join(F.transform("lines", header), "\n").alias("code"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate x outcome table: task = source, candidate = doc_id,
    easy outcome = quality, hard outcome = 1 - toxic."""
    labels = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return labels.join(docs, "doc_id").select(
        F.col("source").alias("task_id"), F.col("doc_id").alias("candidate"),
        F.col("quality").cast("int").alias("easy_pass"),
        (1 - F.col("toxic")).cast("int").alias("hard_pass"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every assertion for every candidate: (task_id, candidate,
    kind, assert_idx, passed).  Easy: quality, at least 1,000 characters; hard:
    not toxic, quality, English."""
    labels = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    held = (("easy", 0, F.col("quality") == 1), ("easy", 1, F.col("n_chars") >= 1000),
            ("hard", 0, F.col("toxic") == 0), ("hard", 1, F.col("quality") == 1), ("hard", 2, F.col("lang") == "en"))
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("assert_idx"),
                              F.coalesce(c, F.lit(False)).cast("int").alias("passed")) for kind, i, c in held])
    return labels.join(docs, "doc_id").select(F.col("source").alias("task_id"), F.col("doc_id").alias("candidate"), F.inline(each))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task table: every source of `documents`, plus two tasks that have no
    candidate (they exercise the no-completion path).  Each task carries two
    easy and three hard assertions."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("source").alias("task_id")).distinct()
    extra = docs.sparkSession.createDataFrame([("no_candidate_1",), ("no_candidate_2",)], "task_id string")

    def asserts(*names):
        return F.array(*[F.concat(F.lit(f"assert {n}("), F.col("task_id"), F.lit(")")) for n in names])
    return docs.unionByName(extra).select(
        "task_id", asserts("easy", "easy_long").alias("test_list"),
        asserts("hard", "hard_quality", "hard_en").alias("challenge_test_list"))


def dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token distribution table: one row per (vec_id, token) with a logit."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", F.col("label").alias("target"),
                      F.posexplode("embedding").alias("token", "v")).select(
        "vec_id", F.col("token").cast("int").alias("token"),
        (F.lit(LOGIT_SCALE) * F.col("v").cast("double")).alias("logit"), "target")


def pair_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of each pair, keyed by (conv_id, turn): the negative log-likelihood
    of the distribution row whose id is the conversation's."""
    from tessera.operators.metrics import log_softmax_at_target

    lp = log_softmax_at_target(dist(spark, sf_dir))
    keys = pairs(spark, sf_dir).select("conv_id", "turn")
    return keys.join(lp, keys.conv_id == lp.vec_id).select("conv_id", "turn", (-F.col("logprob")).alias("loss"))


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log: run, epoch, step, metric, value, batch size."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        (F.col("user_id") % 4).alias("run"),
        F.dayofmonth("ts").alias("epoch"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("metric"),
        "value",
        (1 + F.col("event_id") % 8).alias("batch_size"))
