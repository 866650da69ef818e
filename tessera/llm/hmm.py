"""Operator 8: text scores of a hidden Markov language model.

Tokens are words (`[^\\x20\\x09-\\x0D]+` after lower-casing A-Z), then one end.
Documents whose crc32(id as text) mod 5 is not 1 are learned from, all of them
and whole.

Word counts over the training tokens give the base: (c + 0.5) / (N + 0.5 (V + 1)).
The model's symbols are the `SYMBOLS` most frequent words, the end, and
`CLASSES` classes of all other words by their last two bytes.  States emit symbols;
a class's symbol is followed by the word within the class, with probability
(c + 0.5) / (n + 0.5 (v + 1)) from the counts of the class, unseen words
together being one further word.  Start, transition and emission probabilities
come from Baum-Welch: every partition adds up its expected counts, which are
summed over the partitions, block by block, into the next model.  Every round
runs over all training documents: `WARM_UP` rounds in any case, since the
likelihood hardly rises before the states have come apart, then up to `ROUNDS`
more for as long as one gains `GAIN` a token.  The texts are turned into symbols
once, into a table that is deleted when the rounds are done.

The score is the log10 likelihood of all tokens of a text by the scaled
forward recursion over its whole length, times the words within their classes.
Null and empty texts consist of the end only.  Repeated rows are scored each;
in training they count as often as they occur.  With no training document all
counts are 0 and the model knows classes only.

Counts of the `FREQUENT` most frequent words are broadcast (a bounded table);
those of other words are joined by word, each text's words summed first.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import scratch, stored

SYMBOLS = 1 << 14
CLASSES = 256
FREQUENT = 1 << 17
STATES = 8
WARM_UP = 4
ROUNDS = 6
GAIN = 0.01         # log10 likelihood a token
SMOOTH = 0.01
LONGEST = 64        # bytes of a word in the broadcast tables
FLUSH = 300_000     # words that a task counts before it hands them on
GROUP = 800_000     # tokens that run side by side
PART = 1024         # symbols in a row of expected counts


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c) over all texts; the end is the empty word."""
    def batches(it):
        from collections import Counter
        count: Counter = Counter()

        def out():
            ws = list(count)
            return pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), pa.array([count[w] for w in ws], pa.int64())], names=["word", "c"])

        for b in it:
            for t in b.column(0).to_pylist():
                count.update(tokens(t))
                count[b""] += 1
                if len(count) >= FLUSH:
                    yield out()
                    count.clear()
        yield out()

    return docs.select(text_col).mapInArrow(batches, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Symbols of words, counts of frequent words and sums per class."""

    def __init__(self, words: list[bytes], counts: list[int], ends: int, n: int, v: int, class_n: np.ndarray, class_v: np.ndarray):
        self.total, self.size, self.end_count = n, v, ends
        self.symbol = {w: i for i, w in enumerate(words[:SYMBOLS])}
        self.end = len(self.symbol)
        self.n_symbols = self.end + 1 + CLASSES
        self.packed = np.dtype("<u2" if self.n_symbols <= 1 << 16 else "<u4")
        self.log_count = {w: float(np.log10(c + 0.5)) for w, c in zip(words, counts)}
        self.log_class = np.log10(class_n + 0.5 * (class_v + 1))

    def start(self) -> None:
        """Arrays over the broadcast words; a last element stands for all others."""
        self.index = {w: i for i, w in enumerate(self.log_count)}
        first = self.end + 1
        self.symbol_of = np.array([i if i < self.end else first + word_class(w) for w, i in self.index.items()] + [0], np.int32)
        self.row_log = np.array([*self.log_count.values(), 0.0])
        self.row_inner = self.row_log.copy()  # of the words within their classes
        self.row_inner[:self.end] = 0
        self.row_inner[self.end:-1] -= self.log_class[self.symbol_of[self.end:-1] - first]

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, others, symbols): the words' places in the arrays (-1: not there),
        the places of those that are not there, the symbols and the end."""
        rows = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int32, len(words))
        out = np.empty(len(words) + 1, dtype=np.int32)
        out[:-1] = self.symbol_of[rows]
        out[-1] = self.end
        others = np.flatnonzero(rows < 0)
        if len(others):
            out[others] = [self.end + 1 + word_class(words[i]) for i in others.tolist()]
        return rows, others, out

    def encode(self, words: list[bytes]) -> np.ndarray:
        """A text's symbols and its end."""
        return self.look_up(words)[2]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded part of the stored table of counts."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                      F.coalesce(F.max(F.when(F.length("word") == 0, F.col("c"))), F.lit(0)).alias("ends")).first()
    top = counts.where(f"length(word) BETWEEN 1 AND {LONGEST}").orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    words, c = [bytes(r.word) for r in top], [r.c for r in top]
    tail = F.crc32(F.substring(F.col("word"), -2, 2)) % CLASSES
    by_class = counts.where("length(word) > 0").groupBy(tail.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:  # one row per class
        class_n[r.k], class_v[r.k] = r.n, r.v
    for w, k in zip(words[:SYMBOLS], c):
        class_n[word_class(w)] -= k
        class_v[word_class(w)] -= 1
    return Vocabulary(words, c, int(sums.ends), int(sums.n), int(sums.v), class_n, class_v)


def groups(lengths: np.ndarray):
    """Rows by falling length, cut where GROUP tokens are together."""
    order = np.argsort(-lengths, kind="stable")
    cut = np.cumsum(lengths[order]) // GROUP
    at = np.flatnonzero(np.diff(cut, prepend=-1))
    for lo, hi in zip(at, [*at[1:], len(order)]):
        yield order[lo:hi]


class Lockstep:
    """Sequences by falling length, laid out step by step."""

    def __init__(self, seqs: list[np.ndarray]):
        n = np.array([len(s) for s in seqs], dtype=np.int64)
        self.n_seqs = len(seqs)
        self.active = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")  # sequences at each step
        self.first = np.concatenate([[0], np.cumsum(self.active)])
        flat = np.concatenate(seqs)
        start = np.cumsum(n) - n
        step = np.repeat(np.arange(len(self.active)), self.active)
        rank = np.arange(self.first[-1]) - np.repeat(self.first[:-1], self.active)
        self.symbols = flat[start[rank] + step].astype(np.int64)
        self.rank = rank

    def forward(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: bool):
        """log10 likelihoods; with `keep` also the scaled forward variables."""
        e = emit[self.symbols]
        alpha = np.empty_like(e) if keep else None
        norm = np.empty(len(e), e.dtype)
        first = self.first.tolist()
        a = None
        for t, n in enumerate(self.active.tolist()):
            lo, hi = first[t], first[t + 1]
            a = (a[:n] @ move if t else start) * e[lo:hi]
            s = a.sum(axis=1)
            a /= s[:, None]
            norm[lo:hi] = s
            if keep:
                alpha[lo:hi] = a
        score = np.bincount(self.rank, np.log10(norm.astype(np.float64)), self.n_seqs)
        return score, alpha, norm, e

    def expected(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """Expected counts of starts, transitions and emissions; the sum of
        log10 likelihoods."""
        score, alpha, norm, e = self.forward(start, move, emit, True)
        k = len(start)
        pairs = np.zeros((k, k))
        first, active = self.first.tolist(), self.active.tolist()
        e /= norm[:, None]
        back = move.T.copy()
        beta = np.ones((active[-1], k), alpha.dtype)
        for t in range(len(active) - 1, -1, -1):
            lo, hi = first[t], first[t + 1]
            right = e[lo:hi] * beta
            alpha[lo:hi] *= beta  # the marginals take the forward variables' place
            if t:
                below = first[t - 1]
                pairs += alpha[below:below + active[t]].T @ right
                beta = np.ones((active[t - 1], k), alpha.dtype)
                np.matmul(right, back, out=beta[:active[t]])
        out = np.stack([np.bincount(self.symbols, alpha[:, j], len(emit)) for j in range(k)], axis=1)
        return alpha[:active[0]].sum(axis=0), pairs * move, out, float(score.sum())


class Parameters:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: symbols x states


def initial(vocab: Vocabulary, states: int, seed: int = 8) -> Parameters:
    """Frequencies, shaken differently in each state, and states that last: from
    a start without either the states need ten rounds to come apart."""
    rng = np.random.default_rng(seed)
    base = np.ones(vocab.n_symbols)
    for w, i in vocab.symbol.items():
        base[i] += 10 ** vocab.log_count[w]
    base[vocab.end] += vocab.end_count
    base[vocab.end + 1:] += 10 ** vocab.log_class
    emit = base[:, None] * (rng.gamma(0.2, 5, (vocab.n_symbols, states)) + 0.02)
    move = rng.uniform(0.5, 1.5, (states, states)) + 100 * np.eye(states)
    return Parameters(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _started(shared):
    v = shared.value
    if not hasattr(v, "index"):
        v.start()
    return v


def encoded(docs: DataFrame, text_col: str, vocab) -> DataFrame:
    """(symbols): every text's symbols and its end, as packed numbers."""
    def batches(it):
        v = _started(vocab)
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([v.encode(tokens(t)).astype(v.packed).tobytes() for t in b.column(0).to_pylist()], pa.binary())],
                                             names=["symbols"])

    return docs.select(text_col).mapInArrow(batches, "symbols binary")


def baum_welch(docs: DataFrame, text_col: str, vocab, params: Parameters) -> tuple[Parameters, float]:
    """One round over all texts of `docs`: the next model and the log10
    likelihood under this one."""
    return _round(encoded(docs, text_col, vocab), vocab, params)


def _round(symbols: DataFrame, vocab, params: Parameters) -> tuple[Parameters, float]:
    now = symbols.sparkSession.sparkContext.broadcast(params)
    n_symbols, states = params.emit.shape

    def batches(it):
        packed, p = vocab.value.packed, now.value
        model = [x.astype(np.float32) for x in (p.start, p.move, p.emit)]
        start, pairs, out, score = np.zeros(states), np.zeros((states, states)), np.zeros((n_symbols, states)), 0.0
        seen = False
        for b in it:
            seqs = [np.frombuffer(x, packed) for x in b.column(0).to_pylist()]
            for rows in groups(np.array([len(s) for s in seqs])):
                a, c, d, s = Lockstep([seqs[i] for i in rows]).expected(*model)
                start, pairs, out, score, seen = start + a, pairs + c, out + d, score + s, True
        if seen:
            head = np.concatenate([[score], start, pairs.ravel()])
            parts = [(-1, head.tobytes()), *((i, out[i * PART:(i + 1) * PART].tobytes()) for i in range(-(-n_symbols // PART)))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())],
                                             names=["part", "sums"])

    def add(it):
        total: dict[int, np.ndarray] = {}
        for b in it:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(x)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
                                             names=["part", "sums"])

    kind = "part int, sums binary"
    rows = symbols.mapInArrow(batches, kind).repartition(16, "part").mapInArrow(add, kind).collect()  # one model's size
    got = {r.part: np.frombuffer(r.sums) for r in rows}
    if not got:
        return params, 0.0
    head = got.pop(-1)
    emit = np.concatenate([got[i] for i in sorted(got)]).reshape(n_symbols, states) + SMOOTH
    start, move = head[1:1 + states] + SMOOTH, head[1 + states:].reshape(states, states) + SMOOTH
    return Parameters(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)), float(head[0])


def learn(train: DataFrame, id_col: str, text_col: str, states: int = STATES, warm_up: int = WARM_UP, rounds: int = ROUNDS):
    """(counts, vocabulary broadcast, parameters) from the training texts."""
    counts = stored(word_counts(train, text_col))
    vocab = vocabulary(counts)
    shared = train.sparkSession.sparkContext.broadcast(vocab)
    params = initial(vocab, states)
    with scratch(train.sparkSession):
        symbols = stored(encoded(train, text_col, shared))
        before = -np.inf
        for i in range(warm_up + rounds):
            params, like = _round(symbols, shared, params)
            if i > warm_up and like - before < GAIN * vocab.total:
                break
            before = like
    return counts, shared, params


def score(docs: DataFrame, counts: DataFrame, vocab, params: Parameters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: the id, n_tokens, n_known, train_tokens, base_score
    and score."""
    model = docs.sparkSession.sparkContext.broadcast(params)
    id_type = docs.schema[id_col].dataType.simpleString()

    def batches(it):
        v, p = _started(vocab), model.value
        end, first = float(np.log10(v.end_count + 0.5)), v.end + 1
        for b in it:
            keys, seqs, n_known, base, inner, rare, times = b.column(0), [], [], [], [], [], []
            for t in b.column(1).to_pylist():  # one text's words at a time, each looked up once
                ws = tokens(t)
                rows, others, symbols = v.look_up(ws)
                other: dict[bytes, int] = {}
                for i in others.tolist():
                    other[ws[i]] = other.get(ws[i], 0) + 1
                seqs.append(symbols.astype(v.packed))
                base.append(float(v.row_log[rows].sum()) + end)
                inner.append(float(v.row_inner[rows].sum() - v.log_class[symbols[others] - first].sum()))
                n_known.append(len(rows) - len(others) + (v.end_count > 0))
                rare.append(list(other))
                times.append(list(other.values()))
            inner = np.array(inner)
            for some in groups(np.array([len(s) for s in seqs])):
                inner[some] += Lockstep([seqs[i] for i in some]).forward(p.start, p.move, p.emit, False)[0]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([len(s) for s in seqs], pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(inner, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                names=["id", "n_tokens", "n_known", "base", "inner", "rare", "times"])

    part = docs.select(id_col, text_col).mapInArrow(
        batches, f"id {id_type}, n_tokens long, n_known long, base double, inner double, rare array<binary>, times array<long>")
    part = stored(part.withColumn("row", F.monotonically_increasing_id()))
    each = part.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.times")
    found = each.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("logs"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("k"))
    v = vocab.value
    logs = F.coalesce("logs", F.lit(0.0))
    whole = float(np.log10(v.total + 0.5 * (v.size + 1)))
    return part.join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + logs - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("inner") + logs).alias("score"))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    train = docs.where(F.coalesce(remainder("doc_id") != 1, F.lit(True)))
    out = score(docs, *learn(train, "doc_id", "text"))
    return out.withColumn("held_out", F.coalesce(remainder("doc_id") == 1, F.lit(False))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
