"""Registered queries (one per operator of the inventory that has a query)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as E
from tessera.plans.registry import register
from tessera.sources import views as V

PR_KEYS = ["conv_id", "turn"]


# ------------------------------------------------------------------ metrics E1-E9

@register("bleu_corpus")
def q_bleu_corpus(spark, sf):
    return E.bleu_corpus(V.pred_ref(spark, sf), PR_KEYS)


@register("bleu_macro_vs_corpus")
def q_bleu_macro_vs_corpus(spark, sf):
    return E.bleu_macro_vs_corpus(V.pred_ref(spark, sf), PR_KEYS)


@register("chrf_corpus")
def q_chrf_corpus(spark, sf):
    return E.chrf_corpus(V.pred_ref(spark, sf), PR_KEYS)


@register("exact_match")
def q_exact_match(spark, sf):
    return E.exact_match(V.pred_ref(spark, sf))


@register("token_edit_distance")
def q_token_edit_distance(spark, sf):
    return E.token_edit_distance(V.pred_ref(spark, sf), PR_KEYS)


@register("edit_similarity")
def q_edit_similarity(spark, sf):
    return E.edit_similarity(V.pred_ref(spark, sf), PR_KEYS)


@register("meteor_exact")
def q_meteor_exact(spark, sf):
    return E.meteor_exact(V.pred_ref(spark, sf), PR_KEYS)


@register("meteor_staged")
def q_meteor_staged(spark, sf):
    return E.meteor_staged(V.pred_ref(spark, sf), PR_KEYS)


@register("rouge_l")
def q_rouge_l(spark, sf):
    return E.rouge_l(V.pred_ref(spark, sf), PR_KEYS)


@register("rouge_l_bootstrap")
def q_rouge_l_bootstrap(spark, sf):
    return E.rouge_l_bootstrap(V.pred_ref(spark, sf), PR_KEYS)


@register("masked_nll")
def q_masked_nll(spark, sf):
    return E.masked_nll(V.dist(spark, sf), pad_id=0)


# =========================================================== shared plan pieces

from tessera.functions.text import ws_tokens  # noqa: E402
from tessera.operators import batching as B  # noqa: E402
from tessera.operators import candidates as C  # noqa: E402
from tessera.operators import explore as X  # noqa: E402
from tessera.operators import masking as M  # noqa: E402
from tessera.operators import sampling as P  # noqa: E402
from tessera.operators import tokenize as T  # noqa: E402
from tessera.sources.corpus_store import stored_corpus  # noqa: E402
from tessera.sources.tables import read_table  # noqa: E402
from tessera.functions.joins import bounded, bound_of, broadcast_bounded, broadcast_if_small  # noqa: E402

CORPUS_COLS = ["doc_id", "language", "length", "split", "n_words"]


def _materialise(df):
    """Cut the lineage of a reused intermediate with a reliable checkpoint in
    the shared checkpoint folder, so every branch that uses it reads the
    stored rows instead of re-running the plan behind it."""
    from tessera.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _vocab(spark, sf):
    """Word vocabulary (2^15 entries) from the training split + 5 added tokens,
    stored once (bounded by the vocabulary size) and read by every branch."""
    train = P.scan_split(V.docs_with_split(spark, sf), "train")
    counts = _materialise(T.token_counts(train, "text"))
    v = T.with_added_tokens(T.vocab_from_counts(counts, T.VOCAB_SIZE))
    return bounded(_materialise(v), bound_of(v))


def _ref_class(pr):
    """test_type / length class of each reference: quartile bins of its
    token count (bins 0,1 short; 2 medium; 3 long)."""
    t = pr.withColumn("_n", F.size(ws_tokens("ref")))
    return M.length_bins(t, "_n", "_bin").withColumn("length", M.length_class_of_bin(F.col("_bin"))) \
            .drop("_n", "_bin")


def _encoded_pairs(spark, sf):
    pr = V.pairs(spark, sf)
    vocab = _vocab(spark, sf)
    return T.encode_pairs(pr, PR_KEYS, vocab), vocab


def _padded(spark, sf):
    enc, vocab = _encoded_pairs(spark, sf)
    ids = broadcast_if_small(T.added_token_ids(vocab), row_bound=1)
    batched = B.batch_assign(enc, PR_KEYS, B.BATCH_SIZE).crossJoin(ids)
    return B.pad_batches(batched, ["batch_id"], F.col("pad_id")), vocab


# ================================================================ sources S1-S4

@register("scan_config")
def q_scan_config(spark, sf):
    return P.scan_config(stored_corpus(spark, sf), "en", "short").select(*CORPUS_COLS)


@register("scan_split")
def q_scan_split(spark, sf):
    return P.scan_split(stored_corpus(spark, sf), "test").select(*CORPUS_COLS)


@register("corpus_scan")
def q_corpus_scan(spark, sf):
    return P.corpus_scan(V.docs_with_split(spark, sf))


@register("scan_tasks")
def q_scan_tasks(spark, sf):
    return V.tasks(spark, sf)


# ============================================================== sampling P4-P9

@register("sample_exact")
def q_sample_exact(spark, sf):
    test = P.scan_split(V.docs_with_split(spark, sf), "test").select("doc_id", "split")
    return P.sample_exact(test, "doc_id", P.TEST_FRACTION, P.SEED)


@register("sample_aligned")
def q_sample_aligned(spark, sf):
    rows = V.docs_with_split(spark, sf).select("doc_id", "split")
    return P.sample_aligned(rows, "doc_id", P.TEST_FRACTION, P.SEED)


@register("sample_cap")
def q_sample_cap(spark, sf):
    c = stored_corpus(spark, sf).select("doc_id", "length")
    return P.sample_cap(c, "doc_id", 20, P.SEED, ["length"])


@register("limit_batches")
def q_limit_batches(spark, sf):
    test = P.scan_split(V.docs_with_split(spark, sf), "test").select("doc_id")
    return B.limit_batches(B.batch_assign(test, "doc_id"), 0.5).select("doc_id", "batch_id")


@register("head_rows")
def q_head_rows(spark, sf):
    return P.head_rows(stored_corpus(spark, sf).select(*CORPUS_COLS), "doc_id", 10)


@register("point_lookup")
def q_point_lookup(spark, sf):
    test = P.scan_split(V.docs_with_split(spark, sf), "test").select("doc_id", "n_words")
    return P.point_lookup(test, "doc_id", 0)


@register("unpivot_sizes")
def q_unpivot_sizes(spark, sf):
    wide = M.mask_by_class_wide(read_table(spark, sf, "documents"))
    sizes = [s for s, _ in M.SIZE_CLASS_AVG]
    return P.unpivot_sizes(wide, ["doc_id"], sizes, ["line_no", "n_tokens", "target"])


# ============================================================ tokenization T1-T13

@register("byte_alphabet")
def q_byte_alphabet(spark, sf):
    # The alphabet is a fixed 256-row dimension; joined with the observed
    # bytes of the corpus it reports how often each symbol occurs.
    docs = read_table(spark, sf, "documents")
    bytes_seen = docs.select(F.explode(F.split(F.hex(F.encode("text", "UTF-8")), "(?<=\\G..)")).alias("h")) \
        .filter(F.length("h") == 2).select(F.conv("h", 16, 10).cast("int").alias("byte")) \
        .groupBy("byte").agg(F.count("*").alias("n"))
    return T.byte_alphabet(spark).join(bytes_seen, "byte", "left").select(
        "byte", "code_point", "symbol", F.coalesce(F.col("n"), F.lit(0)).alias("n_occurrences"))


@register("pretokenize")
def q_pretokenize(spark, sf):
    return T.pretokenize(read_table(spark, sf, "documents"), ["doc_id"])


@register("word_counts")
def q_word_counts(spark, sf):
    return T.word_counts(P.corpus_scan(V.docs_with_split(spark, sf)), "original_method")


@register("bpe_pair_counts")
def q_bpe_pair_counts(spark, sf):
    from tessera.operators.bpe import pair_counts, word_types
    wc = T.word_counts(P.corpus_scan(V.docs_with_split(spark, sf)), "original_method")
    return pair_counts(word_types(wc))


@register("vocab_with_specials")
def q_vocab_with_specials(spark, sf):
    return _vocab(spark, sf)


@register("encode_input")
def q_encode_input(spark, sf):
    return T.encode_input(V.pairs(spark, sf), PR_KEYS, _vocab(spark, sf))


@register("frame_target")
def q_frame_target(spark, sf):
    p = V.pairs(spark, sf)
    return p.select(*PR_KEYS, F.concat(F.lit("<BOS>"), "target", F.lit("<EOS>")).alias("framed"))


@register("encode_labels")
def q_encode_labels(spark, sf):
    return T.encode_labels(V.pairs(spark, sf), PR_KEYS, _vocab(spark, sf))


@register("decode_ids")
def q_decode_ids(spark, sf):
    vocab = _vocab(spark, sf)
    lab = T.encode_labels(V.pairs(spark, sf), PR_KEYS, vocab)
    return T.decode_ids(lab, PR_KEYS, "labels", vocab)


@register("token_lengths")
def q_token_lengths(spark, sf):
    return T.token_lengths(V.pairs(spark, sf), PR_KEYS, ["input", "target"])


# =============================================================== batching B1-B7

@register("batch_assign")
def q_batch_assign(spark, sf):
    test = P.scan_split(V.docs_with_split(spark, sf), "test").select("doc_id")
    return B.batch_assign(test, "doc_id")


@register("batch_shuffled")
def q_batch_shuffled(spark, sf):
    train = P.scan_split(V.docs_with_split(spark, sf), "train").select("doc_id")
    return B.batch_shuffled(train, "doc_id", P.SEED, 0)


@register("pad_batches")
def q_pad_batches(spark, sf):
    padded, _ = _padded(spark, sf)
    return padded.select(*PR_KEYS, "batch_id", "input_ids", "attention_mask", "labels")


@register("nonpad_counts")
def q_nonpad_counts(spark, sf):
    padded, _ = _padded(spark, sf)
    return padded.select(
        *PR_KEYS, B.nonpad_count(F.col("input_ids"), F.col("pad_id")).cast("long").alias("n_input"),
        B.nonpad_count(F.col("labels"), F.col("pad_id")).cast("long").alias("n_labels"),
        F.size(F.filter(B.bool_mask(F.col("attention_mask")), lambda x: x)).cast("long").alias("n_mask"))


@register("batch_budget")
def q_batch_budget(spark, sf):
    padded, _ = _padded(spark, sf)
    return padded.groupBy("batch_id").agg(
        (F.max(B.nonpad_count(F.col("labels"), F.col("pad_id"))) - 1).cast("long").alias("budget"))


@register("batch_plan")
def q_batch_plan(spark, sf):
    return B.batch_plan(V.docs_with_split(spark, sf))


# ================================================================ masking M1-M9

@register("line_spans")
def q_line_spans(spark, sf):
    return M.line_spans(read_table(spark, sf, "documents")).select("doc_id", "line_no", "start", "span_len")


@register("block_spans")
def q_block_spans(spark, sf):
    """M1, nested blocks."""
    return M.code_blocks(V.code_docs(spark, sf))


@register("block_tasks")
def q_block_tasks(spark, sf):
    """M3 and M4 over nested blocks."""
    return M.block_tasks(V.code_docs(spark, sf), digest=True)


@register("span_offsets")
def q_span_offsets(spark, sf):
    return M.span_offsets(read_table(spark, sf, "documents"))


@register("mask_spans")
def q_mask_spans(spark, sf):
    return M.mask_spans(read_table(spark, sf, "documents"), digest=True)


@register("nested_tasks")
def q_nested_tasks(spark, sf):
    n = M.nested_tasks(read_table(spark, sf, "documents"), digest=True)
    return n.select("doc_id", F.transform("tasks", lambda t: t["line_no"]).alias("line_nos"),
                    F.transform("tasks", lambda t: t["masked_md5"]).alias("masked_md5s"),
                    F.transform("tasks", lambda t: t["solution"]).alias("solutions"))


@register("length_quantiles")
def q_length_quantiles(spark, sf):
    return M.length_quantiles(M.span_token_lengths(read_table(spark, sf, "documents")), "n_tokens")


@register("value_quantiles")
def q_value_quantiles(spark, sf):
    """M5 on values without bound: quartiles of prices by distributed selection."""
    return M.selected_quantiles(read_table(spark, sf, "lineitem"), "l_extendedprice")


@register("value_bins")
def q_value_bins(spark, sf):
    """M6 on the same edges: prices per quartile bin."""
    lines = read_table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("v"))
    edges = M.selected_quantiles(lines, "v")
    return M.bins_of(lines, "v", edges).groupBy("bin").agg(F.count("*").alias("n"))


@register("length_bins")
def q_length_bins(spark, sf):
    return M.length_bins(M.span_token_lengths(read_table(spark, sf, "documents")), "n_tokens")


@register("length_buckets")
def q_length_buckets(spark, sf):
    b = M.length_bins(M.span_token_lengths(read_table(spark, sf, "documents")), "n_tokens")
    return b.groupBy(M.bucket_of_bin(F.col("bin"), compat=True).alias("bucket")).agg(
        F.count("*").alias("n_spans"))


@register("mask_by_class")
def q_mask_by_class(spark, sf):
    wide = M.mask_by_class_wide(read_table(spark, sf, "documents"))
    sizes = [s for s, _ in M.SIZE_CLASS_AVG]
    long = P.unpivot_sizes(wide, ["doc_id"], sizes, ["line_no", "n_tokens", "input", "target"])
    return long.filter(F.col("line_no").isNotNull()).select(
        "doc_id", "size", "line_no", "n_tokens", F.md5("input").alias("input_md5"), "target")


@register("mix_lengths")
def q_mix_lengths(spark, sf):
    return P.mix_lengths(stored_corpus(spark, sf)).groupBy("config", "length").agg(F.count("*").alias("n_docs"))


# ============================================================= candidates C1-C16

def _pred_tokens(spark, sf):
    return V.pred_ref(spark, sf).select(*PR_KEYS, ws_tokens("pred").alias("ptok"))


@register("prefix_candidates")
def q_prefix_candidates(spark, sf):
    return C.prefix_candidates(_pred_tokens(spark, sf), PR_KEYS, F.col("ptok"))


@register("fill_mask")
def q_fill_mask(spark, sf):
    t = M.mask_spans(read_table(spark, sf, "documents").select("doc_id", "text"), keep_text=True)
    filled = C.fill_mask(F.col("masked_prompt"), F.col("solution"), M.MASK_TOKEN)
    return t.select("doc_id", "line_no", F.md5(filled).alias("filled_md5"), (filled == F.col("text")).alias("restored"))


@register("balanced_candidates")
def q_balanced_candidates(spark, sf):
    pc = C.prefix_candidates(_pred_tokens(spark, sf), PR_KEYS, F.col("ptok"))
    return pc.filter(C.balanced(F.col("candidate"))).select(*PR_KEYS, "k")


@register("nested_candidates")
def q_nested_candidates(spark, sf):
    """C3, order aware: candidates are the pieces of every page between two `>`."""
    pages = read_table(spark, sf, "pages").select("page_id", F.posexplode(F.split("html", ">", -1)).alias("k", "candidate"))
    return C.nested_candidates(pages).select("page_id", "k", F.md5("candidate").alias("candidate_md5"))


PROSE_SEPARATORS = r"\n\p{Lu}"


@register("first_block")
def q_first_block(spark, sf):
    p = V.pairs(spark, sf)
    completion = F.concat(F.col("input"), F.lit(" "), F.col("target"))
    return p.select(*PR_KEYS, C.first_block(F.col("input"), completion, PROSE_SEPARATORS).alias("block"))


def _samples(spark):
    return bounded(spark.createDataFrame([(0, 5), (1, 7), (2, 11)], "sample int, period int"), 3)


@register("fanout_candidates")
def q_fanout_candidates(spark, sf):
    pr = V.pred_ref(spark, sf).select(*PR_KEYS, "ref", F.concat(F.lit("Q"), F.col("conv_id").cast("string"),
                                                                F.lit(":")).alias("prompt"))
    # Three samples per prompt: the reference corrupted with periods 5, 7, 11.
    out = C.fanout_candidates(pr, PR_KEYS, "prompt", _samples(spark),
                              lambda: V.corrupt(ws_tokens("ref"), F.col("period")), PROSE_SEPARATORS)
    return out.select(*PR_KEYS, "sample", "k", F.md5("text").alias("text_md5"))


def _cand_asserts(spark, sf):
    return C.candidate_assertions(V.outcomes(spark, sf), V.tasks(spark, sf))


@register("test_programs")
def q_test_programs(spark, sf):
    ca = _cand_asserts(spark, sf)
    docs = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("candidate"), F.col("text").alias("code"))
    program = C.test_programs(F.col("code"), F.col("assertion"))  # the whole text
    return ca.join(docs, "candidate").select(
        "task_id", "candidate", "kind", "assert_idx", F.length(program).cast("long").alias("program_chars"),
        F.md5(program).alias("program_md5"))


@register("candidate_assertions")
def q_candidate_assertions(spark, sf):
    return _cand_asserts(spark, sf).drop("assertion")


@register("best_candidate")
def q_best_candidate(spark, sf):
    return C.best_candidate(_cand_asserts(spark, sf))


def _best_or_zero(spark, sf):
    return C.best_or_zero(C.best_candidate(_cand_asserts(spark, sf)), V.tasks(spark, sf))


@register("best_or_zero")
def q_best_or_zero(spark, sf):
    return _best_or_zero(spark, sf)


@register("assert_accuracy")
def q_assert_accuracy(spark, sf):
    return C.assert_accuracy(_best_or_zero(spark, sf))


@register("uncompleted_count")
def q_uncompleted_count(spark, sf):
    return C.uncompleted_count(_best_or_zero(spark, sf))


@register("pass_at_k")
def q_pass_at_k(spark, sf):
    return C.pass_at_k(V.attempts(spark, sf), "task_id", "easy_pass", (1, 5, 10, 100))


@register("pass_at_k_by_length")
def q_pass_at_k_by_length(spark, sf):
    """C12 per length class of the candidates."""
    length = stored_corpus(spark, sf).select(F.col("doc_id").alias("candidate"), "length")
    return C.pass_at_k(V.attempts(spark, sf).join(length, "candidate"), "task_id", "easy_pass", (1, 5, 10), ["length"])


@register("trim_eos")
def q_trim_eos(spark, sf):
    vocab = _vocab(spark, sf)
    lab = T.encode_labels(V.pairs(spark, sf), PR_KEYS, vocab).crossJoin(
        broadcast_if_small(T.added_token_ids(vocab), row_bound=1))
    return lab.select(*PR_KEYS, B.trim_eos(F.col("labels"), F.col("eos_id")).alias("trimmed"))


@register("trim_length")
def q_trim_length(spark, sf):
    padded, vocab = _padded(spark, sf)
    pred = T.encode_tokens(V.pred_ref(spark, sf), PR_KEYS, ws_tokens("pred"), vocab, T.DEC_MAX_LEN, "pred_ids")
    j = padded.join(pred, PR_KEYS)
    p, t = B.trim_length(F.col("pred_ids"), F.col("labels"), B.nonpad_count(F.col("labels"), F.col("pad_id")))
    return j.select(*PR_KEYS, p.alias("pred_trim"), t.alias("target_trim"))


@register("top_p_filter")
def q_top_p_filter(spark, sf):
    return C.top_p_filter(V.dist(spark, sf), C.TOP_P).select("vec_id", "token", "prob")


# ================================================================ metrics E10-E14

def _suite(spark, sf):
    return E.metric_suite(_ref_class(V.pred_ref(spark, sf)), PR_KEYS, "length", V.pair_loss(spark, sf))


@register("metric_suite")
def q_metric_suite(spark, sf):
    return _suite(spark, sf)


@register("result_rows")
def q_result_rows(spark, sf):
    pr = _ref_class(V.pred_ref(spark, sf))
    return E.result_rows(pr, PR_KEYS, F.lit(str(V.CORRUPTION_PERIOD)), F.col("length"), V.pair_loss(spark, sf))


@register("train_test_matrix")
def q_train_test_matrix(spark, sf):
    base = _ref_class(V.pairs(spark, sf).select(
        *PR_KEYS, "input", ws_tokens("target").alias("toks"))
        .withColumn("ref", F.array_join("toks", " ")))
    periods = bounded(spark.createDataFrame([(5,), (7,), (11,)], "period int"), 3)
    x = base.crossJoin(broadcast_bounded(periods)).withColumn(
        "pred", F.array_join(V.corrupt(F.col("toks"), F.col("period")), " "))
    rows = E.result_rows(x, [*PR_KEYS, "period"], F.col("period").cast("string"), F.col("length"))
    return E.train_test_matrix(rows)


@register("matrix_margins")
def q_matrix_margins(spark, sf):
    """Position types x length classes, with margins; the margin over the
    lengths is the `mix` run.  A position type's predictions drop tokens of
    another phase."""
    base = _ref_class(V.pairs(spark, sf).select(
        *PR_KEYS, "input", ws_tokens("target").alias("toks")).withColumn("ref", F.array_join("toks", " ")))
    axis = bounded(spark.createDataFrame(list(enumerate(V.POSITION_TYPES)), "phase int, position string"), len(V.POSITION_TYPES))
    x = base.crossJoin(broadcast_bounded(axis)).withColumn(
        "pred", F.array_join(V.corrupt(F.col("toks"), V.CORRUPTION_PERIOD, F.col("phase")), " "))
    rows = E.result_rows(x, [*PR_KEYS, "phase"], F.col("position"), F.col("length"))
    return E.matrix_margins(rows)


@register("epoch_rollup")
def q_epoch_rollup(spark, sf):
    return E.epoch_rollup(V.step_log(spark, sf))


@register("top_checkpoints")
def q_top_checkpoints(spark, sf):
    return E.top_checkpoints(E.epoch_rollup(V.step_log(spark, sf)), "error", 5)


# ============================================================ exploration X1-X5

def _doc_token_ids(spark, sf, group_cols=("split", "length", "language")):
    """Word-id occurrence counts of the document tokens per group, and the
    vocabulary -- both from ONE tokenization pass.

    Tokens are counted per (split, length, language, token) first (partial
    aggregation collapses repeats before anything moves).  The vocabulary is
    the top of the train rows of that same table, and the counts meet the
    broadcast vocabulary only as distinct (group, token) rows; unknown tokens
    fold into id 0.  The counted
    table is computed once: it is stored by a checkpoint and both branches
    read it."""
    g = list(group_cols)
    corpus = stored_corpus(spark, sf).filter(F.col("split").isin("train", "test"))
    per_tok = _materialise(
        corpus.select("split", "length", "language", F.explode(ws_tokens("text")).alias("token"))
        .groupBy("split", "length", "language", "token").agg(F.count("*").alias("c")))
    train_counts = _materialise(per_tok.filter(F.col("split") == "train").groupBy("token").agg(F.sum("c").alias("n")))
    v = T.with_added_tokens(T.vocab_from_counts(train_counts, T.VOCAB_SIZE))
    vocab = bounded(_materialise(v), bound_of(v))
    ids = per_tok.join(broadcast_bounded(vocab.select("token", "token_id"), vocab), "token", "left") \
        .select(*g, F.coalesce("token_id", F.lit(0)).alias("token_id"), "c")
    return ids, vocab


@register("token_freq")
def q_token_freq(spark, sf):
    ids, vocab = _doc_token_ids(spark, sf, ("split", "length"))
    return X.token_freq(ids, vocab, ["split", "length"], count_col="c")


@register("token_topk")
def q_token_topk(spark, sf):
    ids, vocab = _doc_token_ids(spark, sf, ("split", "length"))
    return X.token_topk(X.token_freq(ids, vocab, ["split", "length"], count_col="c"), vocab,
                        ["split", "length"], 10)


@register("js_distance")
def q_js_distance(spark, sf):
    ids, vocab = _doc_token_ids(spark, sf, ("language",))
    f = X.token_freq(ids, vocab, ["language"], count_col="c")
    return X.js_distance(f.filter(F.col("language") == "en"), f.filter(F.col("language") == "fr"))


@register("js_within_split")
def q_js_within_split(spark, sf):
    ids, vocab = _doc_token_ids(spark, sf, ("split", "length"))
    return X.js_pairs(X.token_freq(ids, vocab, ["split", "length"], count_col="c"), "split", "length",
                      within=True)


@register("js_cross_split")
def q_js_cross_split(spark, sf):
    ids, vocab = _doc_token_ids(spark, sf, ("split", "length"))
    return X.js_pairs(X.token_freq(ids, vocab, ["split", "length"], count_col="c"), "split", "length",
                      within=False)


# ===================================================================== BPE (T4)

def _train_word_counts(spark, sf):
    return T.word_counts(P.corpus_scan(V.docs_with_split(spark, sf)), "original_method")


#: The requested vocabulary less the byte alphabet and the added tokens.
BPE_MERGES = T.VOCAB_SIZE - 256 - len(T.SPECIAL_TOKENS + T.ADDED_TOKENS)


def _bpe(spark, sf):
    from tessera.operators.bpe import bpe_train, bpe_vocab
    merges = bpe_train(_train_word_counts(spark, sf), n_merges=BPE_MERGES, byte_level=True)
    return merges, bpe_vocab(T.byte_alphabet(spark), merges)


@register("bpe_train")
def q_bpe_train(spark, sf):
    return _bpe(spark, sf)[0]


@register("bpe_encode")
def q_bpe_encode(spark, sf):
    from tessera.operators.bpe import bpe_encode
    return bpe_encode(V.pairs(spark, sf), PR_KEYS, "input", *_bpe(spark, sf), max_len=T.ENC_MAX_LEN)


@register("bpe_labels")
def q_bpe_labels(spark, sf):
    """T9 with the learned tokenizer: the framed target, cut to the label limit."""
    from tessera.operators.bpe import bpe_encode
    framed = V.pairs(spark, sf).withColumn("framed", F.concat(F.lit("<BOS>"), "target", F.lit("<EOS>")))
    out = bpe_encode(framed, PR_KEYS, "framed", *_bpe(spark, sf), max_len=T.DEC_MAX_LEN)
    return out.withColumnRenamed("input_ids", "labels")


@register("bpe_decode")
def q_bpe_decode(spark, sf):
    """T11 with the learned tokenizer: encode and decode give the text back."""
    from tessera.operators.bpe import bpe_decode, bpe_encode
    merges, vocab = _bpe(spark, sf)
    return bpe_decode(bpe_encode(V.pairs(spark, sf), PR_KEYS, "input", merges, vocab), PR_KEYS, vocab)


# ============================================================ streaming E13

@register("epoch_rollup_stream")
def q_epoch_rollup_stream(spark, sf):
    """E13 driven by Structured Streaming over the events files."""
    from tessera.streaming.step_log import run_epoch_rollup
    return run_epoch_rollup(spark, f"{sf}/events.parquet")


@register("metric_record_wide")
def q_metric_record_wide(spark, sf):
    """E10 wide form: one row per length class, one column per metric."""
    return E.metric_record_wide(_suite(spark, sf), "length")


@register("metrics_json")
def q_metrics_json(spark, sf):
    """The JSON object written per length class and for the mix."""
    from tessera.sources.sinks import metrics_json
    suite = _suite(spark, sf)
    return metrics_json(suite.withColumn("value", F.round("value", 6)), "length")


# ================================================================ sinks S5-S9

def _sink_path(spark, name):
    import uuid
    from tessera.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("ledger_rollup")
def q_ledger_rollup(spark, sf):
    """A ledger of the training log (a project per run, an entry per epoch),
    written, read back and rolled up."""
    from tessera.sources import sinks as S
    ts = read_table(spark, sf, "events").select((F.col("user_id") % 4).alias("run"), F.date_trunc("second", "ts").alias("ts"))
    per = ts.groupBy("run", F.dayofmonth("ts").alias("epoch")).agg(F.max("ts").alias("timestamp"), F.count("*").alias("n"))
    text = {"experiment_id": F.col("epoch").cast("string"), "project_name": F.concat(F.lit("run "), "run")}
    number = {"duration": F.col("n") * 0.5, "emissions": F.col("n") * 0.25, "energy_consumed": F.col("n") * 2.0}
    cols = [(text | number | {"timestamp": F.col("timestamp")}).get(f.name, F.lit("-")).alias(f.name) for f in S.LEDGER_SCHEMA.fields]
    path = _sink_path(spark, "ledger")
    S.write_ledger(per.select(*cols), path)
    return S.ledger_rollup(S.read_ledger(spark, path)).select(
        "project_name", "n_runs", "duration", "emissions", "energy_consumed",
        F.unix_timestamp("first_run").alias("first_run"), F.unix_timestamp("last_run").alias("last_run"))


@register("vocab_store")
def q_vocab_store(spark, sf):
    """The word vocabulary, stored and loaded."""
    from tessera.sources import sinks as S
    path = _sink_path(spark, "vocab")
    S.save_vocab(_vocab(spark, sf), path)
    return S.load_vocab(spark, path)[0]


@register("results_csv")
def q_results_csv(spark, sf):
    """The result table, written as CSV and read back."""
    from tessera.sources import sinks as S
    rows = E.result_rows(_ref_class(V.pred_ref(spark, sf)), PR_KEYS, F.lit(str(V.CORRUPTION_PERIOD)), F.col("length"),
                         V.pair_loss(spark, sf))
    path = _sink_path(spark, "results")
    S.write_results_csv(rows, path)
    kinds = {"conv_id": "long", "turn": "long", "exact_match": "boolean", "loss": "double"}
    back = S.read_results_csv(spark, path)
    return back.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in ("conv_id", "turn", "train_type", "test_type", "loss", "exact_match")],
                       F.size(F.from_json("reference", "array<string>")).cast("long").alias("n_reference"))


@register("append_samples")
def q_append_samples(spark, sf):
    """Samples of two epochs appended to one table and read as one."""
    from tessera.sources import sinks as S
    path = _sink_path(spark, "samples")
    pr = V.pred_ref(spark, sf)
    for step in (0, 1):
        S.append_samples(pr.where(F.pmod("conv_id", F.lit(2)) == step)
                         .select("input", F.col("pred").alias("completion"), F.lit(step).alias("step")), path)
    return spark.read.parquet(path)
