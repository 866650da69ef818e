"""Invariants of the survey's test strategy, and property checks against
brute-force implementations on small fixtures."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from paths import SF001
from tessera.functions.lcs import edit_distance, lcs_length
from tessera.functions.ngrams import with_ngram_stats
from tessera.functions.text import tokens_as_string, ws_tokens
from tessera.operators import batching as B
from tessera.operators import bpe
from tessera.operators import masking as M
from tessera.operators import metrics as E
from tessera.operators import tokenize as T
from tessera.operators.ordering import with_row_index
from tessera.sources import views as V
from tessera.sources.tables import read_table


def _lcs_dp(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=70))
def test_lcs_bit_parallel_matches_dp(a, b):
    assert lcs_length(a, b) == _lcs_dp(a, b)


def _distance_dp(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=70), st.lists(st.sampled_from("abcde"), max_size=70))
def test_edit_distance_bit_parallel_matches_dp(a, b):
    assert edit_distance(a, b) == _distance_dp(a, b)


def test_edit_distance_of_long_texts(spark):
    """Over 63,000 distinct tokens a row, a shift and a few changes."""
    a = [f"t{i}" for i in range(66_000)]
    b = a[3:20_000] + ["x", "y"] + a[20_000:] + ["z"]
    b[100] = "changed"
    df = spark.createDataFrame([(1, " ".join(a), " ".join(b)), (2, "", "a b"), (3, "a", None)], "k int, pred string, ref string")
    got = {r["k"]: r["edit_distance"] for r in E.token_edit_distance(df, ["k"]).collect()}
    assert got == {1: 3 + 1 + 2 + 1, 2: 2, 3: None}


def test_clipped_counts_match_counters(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices("abc", k=rng.randint(0, 12))), " ".join(rng.choices("abcd", k=rng.randint(0, 12)))) for k in range(60)]
    rows += [(100, None, "a"), (101, "a b", None), (102, "", "")]
    df = spark.createDataFrame(rows, "k int, h string, r string")
    t = with_ngram_stats(df, ws_tokens("h"), ws_tokens("r"), (1, 2, 4), "g")
    t = with_ngram_stats(t, F.col("h"), F.col("r"), (1, 3, 6), "c", char_level=True)
    for x in t.collect():
        for name, orders, cut in (("g", (1, 2, 4), str.split), ("c", (1, 3, 6), list)):
            for n in orders:
                if x["h"] is None or x["r"] is None:
                    assert x[f"{name}{n}"] is None
                    continue
                h, r = [Counter(zip(*[cut(x[s])[i:] for i in range(n)])) for s in "hr"]
                assert tuple(x[f"{name}{n}"]) == (sum((h & r).values()), sum(h.values()), sum(r.values()))


def test_mask_then_fill_restores(spark):
    docs = read_table(spark, SF001, "documents")
    t = M.mask_spans(docs, digest=False).join(docs.select("doc_id", "text"), "doc_id")
    bad = t.filter(F.replace(F.col("masked_prompt"), F.lit(M.MASK_TOKEN), F.col("solution")) != F.col("text"))
    assert bad.count() == 0


def test_line_offsets_point_at_lines(spark):
    docs = read_table(spark, SF001, "documents")
    s = M.line_spans(docs).join(docs.select("doc_id", "text"), "doc_id")
    bad = s.filter(F.substr("text", F.col("start") + 1, F.col("span_len")) != F.col("line"))
    assert bad.count() == 0


def test_encoded_sizes_bounded(spark):
    pr = V.pairs(spark, SF001)
    train = V.corpus(spark, SF001).filter("split = 'train'")
    vocab = T.with_added_tokens(T.word_vocab(train, "text", 512))
    enc = T.encode_input(pr, ["conv_id", "turn"], vocab, max_len=16)
    lab = T.encode_labels(pr, ["conv_id", "turn"], vocab, max_len=12)
    assert enc.filter(F.size("input_ids") > 16).count() == 0
    assert enc.filter(F.size("attention_mask") != F.size("input_ids")).count() == 0
    assert lab.filter(F.size("labels") > 12).count() == 0
    assert enc.count() == pr.count() == lab.count()
    # the framing quirk: a long target loses its <EOS>
    ids = T.added_token_ids(vocab).collect()[0]
    firsts = lab.select(F.element_at("labels", 1).alias("f")).distinct().collect()
    assert [r["f"] for r in firsts] == [ids["bos_id"]]


def test_padding_shape(spark):
    pr = V.pairs(spark, SF001)
    train = V.corpus(spark, SF001).filter("split = 'train'")
    vocab = T.with_added_tokens(T.word_vocab(train, "text", 512))
    enc = T.encode_input(pr, ["conv_id", "turn"], vocab).join(
        T.encode_labels(pr, ["conv_id", "turn"], vocab), ["conv_id", "turn"])
    pad = T.added_token_ids(vocab).collect()[0]["pad_id"]
    b = B.pad_batches(B.batch_assign(enc, ["conv_id", "turn"], 8), ["batch_id"], pad)
    per = b.groupBy("batch_id").agg(F.count("*").alias("n"), F.collect_set(F.size("input_ids")).alias("w"),
                                    F.collect_set(F.size("labels")).alias("wl")).collect()
    for r in per:
        assert r["n"] <= 8 and len(r["w"]) == 1 and r["w"][0] % 8 == 0
        assert len(r["wl"]) == 1 and r["wl"][0] % 8 == 0


def test_row_index_matches_row_number(spark):
    df = read_table(spark, SF001, "documents").select("doc_id", "source")
    got = with_row_index(df, ["source", "doc_id"]).select("doc_id", "row_idx")
    exp = df.select("doc_id", (F.row_number().over(Window.orderBy("source", "doc_id")) - 1).alias("row_idx"))
    assert sorted(got.collect()) == sorted(exp.collect())
    g = with_row_index(df, ["doc_id"], ["source"]).select("doc_id", "row_idx")
    e = df.select("doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1)
                  .alias("row_idx"))
    assert sorted(g.collect()) == sorted(e.collect())


def _bpe_brute(words: Counter, n_merges: int):
    """Sequential BPE: most frequent adjacent pair, ties by (left, right)."""
    seqs = {w: list(w) for w in words}
    merges = []
    for _ in range(n_merges):
        pc = Counter()
        for w, c in words.items():
            s = seqs[w]
            for a, b in zip(s, s[1:]):
                pc[(a, b)] += c
        pc = {k: v for k, v in pc.items() if v >= 2}
        if not pc:
            break
        (a, b) = min(pc, key=lambda k: (-pc[k], k))
        merges.append((a, b, pc[(a, b)]))
        for w in seqs:
            s, out, i = seqs[w], [], 0
            while i < len(s):
                if i < len(s) - 1 and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            seqs[w] = out
    return merges


def test_bpe_exact_matches_brute_force(spark):
    docs = read_table(spark, SF001, "documents").limit(40)
    wc = T.word_counts(docs, "text")
    got = [(r["left"], r["right"], r["n"]) for r in bpe.bpe_train(wc, 12).orderBy("rank").collect()]
    words = Counter({r["word"]: r["n"] for r in wc.collect()})
    assert got == _bpe_brute(words, 12)


def test_bpe_several_merges_a_round_equal_one(spark):
    rng = random.Random(4)
    words = Counter("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(400))
    words.update({"aaaa": 60, "ababab": 50})
    wc = spark.createDataFrame(list(words.items()), "word string, n long")
    for per_round in (1, 64):
        got = [(r["left"], r["right"], r["n"]) for r in
               bpe.bpe_train(wc, 15, merges_per_round=per_round).orderBy("rank").collect()]
        assert got == _bpe_brute(words, 15)


@pytest.mark.parametrize("pool, fetch", [(200_000, 60_000), (40, 300), (30, 1)])
def test_bpe_to_the_last_merge(spark, monkeypatch, pool, fetch):
    """Until no pair is left, with every kind of round: a pool that has to be
    filled anew, words fetched or not, rows renewed, symbols made twice."""
    from tessera.operators import bpe_learner as L
    monkeypatch.setattr(L, "POOL", pool)
    monkeypatch.setattr(L, "FETCH", fetch)
    monkeypatch.setattr(L, "REBASE", 20)
    rng = random.Random(8)
    words = Counter("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(40))
    words.update({"aaaa": 60, "ababab": 50, "aaaaaaa": 7, "é🙂é🙂": 3})
    brute, seqs = [], {w: list(w) for w in words}
    while True:
        pc = Counter()
        for w, n in words.items():
            for p in zip(seqs[w], seqs[w][1:]):
                pc[p] += n
        if not pc:
            break
        a, b = min(pc, key=lambda k: (-pc[k], k))
        brute.append((a, b, pc[a, b]))
        seqs = {w: L.merged(s, a, b, a + b) for w, s in seqs.items()}
    wc = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(r["left"], r["right"], r["n"]) for r in bpe.bpe_train(wc, 10_000).orderBy("rank").collect()]
    assert got == brute


def test_bpe_rounds_take_many_merges(spark, monkeypatch):
    """Many distinct words whose frequent pairs share symbols: a round follows the
    merges round all pairs asked for, and the result is that of one at a time."""
    from tessera.operators import bpe_learner as L
    monkeypatch.setattr(L, "FETCH", 2000)
    rounds = []
    follow = L.Learner._round
    monkeypatch.setattr(L.Learner, "_round", lambda self, want: (rounds.append(want), follow(self, want)))
    rng = random.Random(3)
    words = Counter("".join(rng.choice("aabbcdeefgh") for _ in range(rng.randint(3, 11))) for _ in range(1500))
    wc = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(r["left"], r["right"], r["n"]) for r in bpe.bpe_train(wc, 120).orderBy("rank").collect()]
    assert got == _bpe_brute(words, 120)
    assert len(rounds) <= 24


def test_bpe_encoder_takes_the_lowest_rank_first():
    rng = random.Random(2)
    for _ in range(200):
        pieces, ranks = list("abc"), {}
        for rank in range(12):
            p = (rng.choice(pieces), rng.choice(pieces))
            if p not in ranks:
                ranks[p] = rank
                pieces.append("".join(p))
        word = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        brute = list(word)
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(brute, brute[1:])) if p in ranks]
            if not found:
                break
            i = min(found)[1]
            brute[i:i + 2] = ["".join(brute[i:i + 2])]
        assert bpe._apply_merges(word, ranks) == brute


def test_bpe_encoder_is_not_quadratic():
    import time
    ranks = {("a", "b"): 0, ("ab", "ab"): 1, ("abab", "abab"): 2, ("b", "a"): 3}
    start = time.perf_counter()
    out = bpe._apply_merges(list("ab" * 10_000), ranks)
    assert time.perf_counter() - start < 1 and out == ["abababab"] * 2500


def test_bpe_added_tokens_stay_whole_and_texts_come_back(spark):
    rows = [(1, "ab <MASK> x"), (2, "a<NEW_LINE>b  c\n<BOS>é 🙂"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "k int, text string")
    wc = T.word_counts(df.where("text IS NOT NULL"), "text")
    merges = bpe.bpe_train(wc, 5, byte_level=True)
    vocab = bpe.bpe_vocab(T.byte_alphabet(spark), merges)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    enc = bpe.bpe_encode(df, ["k"], "text", merges, vocab)
    got = {r["k"]: r["input_ids"] for r in enc.collect()}
    assert ids["<MASK>"] in got[1] and ids["<NEW_LINE>"] in got[2] and ids["<BOS>"] in got[2]
    back = {r["k"]: r["decoded"] for r in bpe.bpe_decode(enc, ["k"], vocab).collect()}
    assert [back[k] or "" for k, _ in rows] == [t or "" for _, t in rows]
    bare = {r["k"]: r["decoded"] for r in bpe.bpe_decode(enc, ["k"], vocab, skip_special=True).collect()}
    assert bare[1] == "ab  x" and bare[2] == "a<NEW_LINE>b  c\né 🙂"


def test_bpe_unknown_symbol_fails(spark):
    df = spark.createDataFrame([(1, "abc")], "k int, text string")
    merges = bpe.bpe_train(T.word_counts(df, "text"), 1, byte_level=True)
    vocab = bpe.bpe_vocab(T.byte_alphabet(spark), merges).where("token <> 'c'")
    with pytest.raises(Exception, match="KeyError"):
        bpe.bpe_encode(df, ["k"], "text", merges, vocab).collect()


def test_pass_at_k_of_huge_tasks(spark):
    from tessera.functions.stats import pass_at_k_col
    df = spark.createDataFrame([(10 ** 9, 10 ** 6, 10), (10 ** 10, 10 ** 7, 100), (5, 0, 3), (5, 4, 3)], "n long, c long, k int")
    got = [r[0] for r in df.select(pass_at_k_col(F.col("n"), F.col("c"), F.col("k"))).collect()]
    exact = []
    for n, c, k in ((10 ** 9, 10 ** 6, 10), (10 ** 10, 10 ** 7, 100)):
        p = Fraction(1)
        for j in range(k):
            p *= Fraction(n - c - j, n - j)
        exact.append(float(1 - p))
    assert got == pytest.approx([*exact, 0.0, 1.0], rel=1e-12)


def test_edit_distance_of_very_many_distinct_tokens(spark):
    from tessera.functions.text import token_code_point
    n = spark.range(1, 70_001)
    codes = n.select(token_code_point(F.col("id")).alias("c"))
    assert codes.distinct().count() == 70_000 and codes.where("c between 55296 and 57343").isEmpty()
    df = spark.createDataFrame([(1, "a b c d", "a x c")], "k int, pred string, ref string")
    shift = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(70_000)), lambda i: F.concat(F.lit("t"), i.cast("string"))), " ").alias("s"))
    row = shift.select(F.size(ws_tokens("s")).alias("n"), F.length(tokens_as_string(F.slice(ws_tokens("s"), 69_990, 11), ws_tokens("s"))).alias("m")).first()
    assert row["n"] == 70_000 and row["m"] == 11
    assert E.token_edit_distance(df, ["k"]).first()["edit_distance"] == 2


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tessera.session import ensure_checkpoint_dir
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf={}))


def test_bpe_encode_round_trip(spark):
    docs = read_table(spark, SF001, "documents").limit(30)
    wc = T.word_counts(docs, "text")
    merges = bpe.bpe_train(wc, 20, byte_level=True, merges_per_round=4)
    vocab = bpe.bpe_vocab(T.byte_alphabet(spark), merges)
    enc = bpe.bpe_encode(docs.select("doc_id", "text"), ["doc_id"], "text", merges, vocab)
    inv = {r["token_id"]: r["token"] for r in vocab.collect()}
    byte_of = {r["symbol"]: r["byte"] for r in T.byte_alphabet(spark).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in enc.collect():
        sym = "".join(inv[i] for i in r["input_ids"])
        assert bytes(byte_of[c] for c in sym).decode("utf-8") == texts[r["doc_id"]]


def test_pass_at_k_closed_form_matches_product():
    from tessera.functions.stats import pass_at_k_value

    def brute(n, c, k):
        if c == 0:
            return 0.0
        if n - c < k:
            return 1.0
        p = 1.0
        for i in range(n - c + 1, n + 1):
            p *= 1 - k / i
        return 1 - p
    for n in range(1, 300, 7):
        for c in range(0, n + 1, 3):
            for k in (1, 5, 10, 100):
                assert abs(pass_at_k_value(n, c, k) - brute(n, c, k)) < 1e-9


def test_preparation_is_idempotent(spark):
    from tessera.operators.sampling import skip_if_encoded
    calls = []

    def prepare(df):
        calls.append(1)
        return df.withColumn("input_ids", F.array(F.lit(1)))
    df = spark.createDataFrame([(1, "a b")], "k long, input string")
    once = skip_if_encoded(df, prepare)
    twice = skip_if_encoded(once, prepare)
    assert len(calls) == 1 and twice is once


def test_bpe_incremental_equals_recount(spark):
    docs = read_table(spark, SF001, "documents").limit(60)
    wc = T.word_counts(docs, "text")
    inc = bpe.bpe_train(wc, 20, byte_level=True).orderBy("rank").collect()
    full = bpe.bpe_train(wc, 20, byte_level=True, incremental=False).orderBy("rank").collect()
    assert inc == full


def test_bpe_matches_public_tokenizers_trainer(spark):
    """Byte-level merges of the Spark learner equal those of the public
    `tokenizers` BPE trainer on the same pre-tokens (test-only dependency)."""
    tk = pytest.importorskip("tokenizers")
    import json
    from tessera.functions.text import PRETOKEN_PATTERN
    docs = read_table(spark, SF001, "documents").orderBy("doc_id").limit(60)
    texts = [r["text"] for r in docs.collect()]
    tok = tk.Tokenizer(tk.models.BPE())
    tok.pre_tokenizer = tk.pre_tokenizers.Sequence([
        tk.pre_tokenizers.Split(tk.Regex(PRETOKEN_PATTERN), behavior="isolated"),
        tk.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    alphabet = tk.pre_tokenizers.ByteLevel.alphabet()
    n = 30
    trainer = tk.trainers.BpeTrainer(vocab_size=len(alphabet) + n, initial_alphabet=alphabet, show_progress=False)
    tok.train_from_iterator(texts, trainer)
    theirs = [tuple(m) if isinstance(m, list) else tuple(m.split(" "))
              for m in json.loads(tok.to_str())["model"]["merges"]][:n]
    wc = T.word_counts(docs, "text")
    ours = [(r["left"], r["right"]) for r in bpe.bpe_train(wc, n, byte_level=True).orderBy("rank").collect()]
    assert ours == theirs


def test_bpe_encode_matches_public_tokenizers(spark):
    """Token strings of the Arrow-batched BPE encoder equal those of the
    public `tokenizers` model built from the same merges."""
    tk = pytest.importorskip("tokenizers")
    from tessera.functions.text import PRETOKEN_PATTERN
    docs = read_table(spark, SF001, "documents").orderBy("doc_id").limit(40)
    wc = T.word_counts(docs, "text")
    merges = bpe.bpe_train(wc, 25, byte_level=True)
    vocab = bpe.bpe_vocab(T.byte_alphabet(spark), merges)
    vmap = {r["token"]: r["token_id"] for r in vocab.collect() if not r["special"] and r["token"] != "<NEW_LINE>"}
    mlist = [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]
    tok = tk.Tokenizer(tk.models.BPE(vocab=vmap, merges=mlist))
    tok.pre_tokenizer = tk.pre_tokenizers.Sequence([
        tk.pre_tokenizers.Split(tk.Regex(PRETOKEN_PATTERN), behavior="isolated"),
        tk.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    inv = {r["token_id"]: r["token"] for r in vocab.collect()}
    enc = bpe.bpe_encode(docs.select("doc_id", "text"), ["doc_id"], "text", merges, vocab).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in enc:
        assert [inv[i] for i in r["input_ids"]] == tok.encode(texts[r["doc_id"]]).tokens


def test_relational_and_per_row_metric_plans_agree(spark):
    from pyspark.sql import functions as F
    from tessera.functions.text import ws_tokens
    from tessera.operators import metrics as E
    pr = V.pred_ref(spark, SF001)
    keys = ["conv_id", "turn"]
    a = E.meteor_exact(pr, keys, per_row=True).collect()[0]["meteor"]
    b = E.meteor_exact(pr, keys, per_row=False).collect()[0]["meteor"]
    assert a == pytest.approx(b, abs=1e-12)
    for char_level, h, r, orders in ((False, ws_tokens("pred"), ws_tokens("ref"), range(1, 5)),
                                     (True, F.regexp_replace("pred", r"\s+", ""),
                                      F.regexp_replace("ref", r"\s+", ""), range(1, 7))):
        x = sorted(E._ngram_stats(pr, keys, h, r, orders, [], False, char_level, per_row=True).collect())
        y = sorted(E._ngram_stats(pr, keys, h, r, orders, [], False, char_level, per_row=False).collect())
        assert x == y


def test_selected_quantiles_equal_percentile(spark):
    """Ten million distinct values on a skewed scale, whose order is known; odd
    inputs, against the map-based aggregate."""
    n = 10_000_000
    value = lambda k: F.exp(k / 4e5) - 3
    df = spark.range(n).select(value(F.pmod(F.col("id") * 7919, F.lit(n))).alias("v"))
    got = M.selected_quantiles(df, "v", (0.0, 0.25, 0.5, 1.0)).first()["edges"]
    exact = []
    for p in (0.0, 0.25, 0.5, 1.0):
        at = p * (n - 1)
        lo, hi = [r[0] for r in spark.createDataFrame([(math.floor(at),), (math.ceil(at),)], "k long").select(value(F.col("k"))).collect()]
        exact.append(lo + (at - math.floor(at)) * (hi - lo))
    assert got == pytest.approx(exact, rel=1e-12)
    for values in ([5.0], [1.0, 2.0], [3.0] * 9, [-1.7e308, 0.0, 1.7e308], [1.0, 1.0, 1.0, 9.0, None, float("nan")], [5e-324, 0.0, 1.0]):
        t = spark.createDataFrame([(v,) for v in values], "v double")
        kept = [v for v in values if v is not None and v == v]
        e = spark.createDataFrame([(v,) for v in kept], "v double").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5)))).first()[0]
        assert M.selected_quantiles(t, "v", (0.25, 0.5), buckets=3).first()["edges"] == e
    assert M.selected_quantiles(spark.createDataFrame([], "v double"), "v").first()["edges"] is None


def test_bootstrap_is_reproducible_and_holds_the_mean(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices("abcdef", k=8)), " ".join(rng.choices("abcdef", k=8))) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, pred string, ref string")
    one = E.rouge_l_bootstrap(df, ["k"], replicates=400).first()
    assert E.rouge_l_bootstrap(df.repartition(5, "pred"), ["k"], replicates=400).first() == pytest.approx(one, rel=1e-12)
    other = E.rouge_l_bootstrap(df, ["k"], replicates=400, seed=1).first()
    mean = E.rouge_l(df, ["k"]).first()["rouge_l"]
    assert other != one and one["n_replicates"] == 400
    for r in (one, other):
        assert r["rouge_l_low"] < mean < r["rouge_l_high"] and abs(r["rouge_l_mid"] - mean) < 0.01


def test_matrix_margins_add_up(spark):
    rows = spark.createDataFrame([("a", "x", True, 1.0), ("a", "y", False, 0.5), ("b", "x", True, 0.0)],
                                 "train_type string, test_type string, exact_match boolean, levenshtein_distance double")
    got = {(r["train_type"], r["test_type"], r["level"]): (r["n_rows"], r["leven_dist"]) for r in E.matrix_margins(rows).collect()}
    assert got[None, None, 3] == (3, 0.5) and got["a", None, 1] == (2, 0.75) and got[None, "x", 2] == (2, 0.5) and got["b", "x", 0] == (1, 0.0)
    assert len(got) == 3 + 2 + 2 + 1


def _fewest_chunks(h, r, stem):
    """(matches, chunks) by trying every alignment with all the exact and all the
    stem matches there can be."""
    from itertools import permutations, product
    ch, cr = Counter(h), Counter(r)
    exact = sum((ch & cr).values())
    lh, lr = Counter(), Counter()
    for w in ch:
        lh[stem(w)] += ch[w] - min(ch[w], cr[w])
    for w in cr:
        lr[stem(w)] += cr[w] - min(ch[w], cr[w])
    stems = sum((lh & lr).values())
    best = None
    options = [[None] + [j for j, v in enumerate(r) if v == w or stem(v) == stem(w)] for w in h]
    for pick in product(*options):
        js = [j for j in pick if j is not None]
        if len(set(js)) != len(js):
            continue
        same = sum(1 for w, j in zip(h, pick) if j is not None and r[j] == w)
        if same != exact or len(js) - same != stems:
            continue
        chunks, last = 0, -2
        for j in pick:
            if j is not None and j != last + 1:
                chunks += 1
            last = -2 if j is None else j
        best = chunks if best is None else min(best, chunks)
    return exact + stems, best or 0


def test_staged_alignment_has_the_fewest_chunks():
    from tessera.functions.alignment import staged_alignment
    rng = random.Random(5)
    stem = lambda w: w.rstrip("s")
    for _ in range(1500):
        h, r = [[rng.choice(["a", "b", "as", "bs", "c", "ass"]) for _ in range(rng.randint(0, 6))] for _ in range(2)]
        got = staged_alignment(h, r, [stem(w) for w in h], [stem(w) for w in r], beam=10 ** 6)
        assert got == _fewest_chunks(h, r, stem), (h, r)
    long = [rng.choice("abcdefghij") for _ in range(300)]
    m, chunks = staged_alignment(long, long[:100] + long[110:], long, long[:100] + long[110:])
    assert m == 290 and chunks <= 12  # two, were all alignments followed


def test_staged_alignment_makes_few_states(monkeypatch):
    """One word over and over has every free place as a partner in every state; only
    the states that the beam can take are made."""
    from tessera.functions import alignment
    made, plain = [], alignment._exact_step
    monkeypatch.setattr(alignment, "_exact_step", lambda *a: (made.append(0), plain(*a))[1])
    same = ["a"] * 200
    assert alignment.staged_alignment(same, same, same, same) == (200, 1)
    assert len(made) == 200
    levels = {c: [(0, -2, ())] if c == 0 else [(1 << i, i, ()) for i in range(63)] for c in (0, 1)}
    after = plain(levels, (1 << 200) - 1, 200, 200, alignment.BEAM)
    assert sum(map(len, after.values())) < 500  # 64 states with some 200 partners each


def test_meteor_staged(spark):
    df = spark.createDataFrame([(1, "the cats sat on the mats", "on the mat sat the cat"), (2, "", "a"), (3, "a b", "a b"), (4, "boxes", "box")],
                               "k int, pred string, ref string")
    one = {r["k"]: r["meteor"] for r in E.meteor_staged(df, [], group_cols=["k"]).collect()}
    exact = {r["k"]: r["meteor"] for r in E.meteor_exact(df, [], group_cols=["k"]).collect()}
    assert one[1] > exact[1] and one[2] == 0 and one[3] == exact[3] == pytest.approx(1 - 0.5 * (1 / 2) ** 3) and one[4] == 0
    words = ["ponies", "aies", "boxes", "does", "cats", "bus", "glass", "is"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(E.light_stem(F.col("w"))).collect()]
    assert got == ["pony", "aie", "boxe", "doe", "cat", "bus", "glass", "i"]
