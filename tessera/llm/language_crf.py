"""Operator 5: language identification with a linear-chain conditional random
field over words.

A word (`[^\\x20\\x09-\\x0D]+`) has features: prefixes and suffixes of up to
three characters, character 3-grams, and itself if the lexicon holds it.  Feature weights per language and transitions between the
languages of neighbouring words are learned from labelled documents whose
crc32(id as text) mod 5 is not 0.  At most `SAMPLE_DOCS` documents of a
language (those with the smallest hash of their id) with at most `SAMPLE_WORDS`
words each are learned from: the documented bound of the fit.  They are spliced
into sequences that switch language, so that switching has a learned price.

Prediction covers all words of every text, in sequences of up to `SEQUENCE`
words, by scaled forward-backward; it sees the text only.  The language with
the largest expected number of words with letters wins; the score is its share
of them.  A null text or one without letters is `und` with score 0, as is
everything if no document is labelled.  Ties go to the language that sorts
first.  Repeated rows get equal results; extra columns are left out.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import held, with_ids, words_of
from tessera.llm.wordhash import slabs

SAMPLE_DOCS = 250
SAMPLE_WORDS = 300
SEQUENCE = 128
TRAIN_SEQUENCE = 60
ROUNDS = 30
CACHED = 300_000
LONGEST = 40
UNKNOWN = "und"


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def features(word: str) -> list[str]:
    w = word.lower()
    out = ["=" + w] if len(w) <= LONGEST else []
    v = w[:LONGEST]  # 3-grams of a very long word: of its start
    out += ["p" + w[:1], "p" + w[:2], "p" + w[:3], "s" + w[-1:], "s" + w[-2:], "s" + w[-3:]]
    return out + [v[i:i + 3] for i in range(len(v) - 2)]


class Model:
    """Weights per feature and transitions, and a bounded cache of words."""

    def __init__(self, langs: list[str], index: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.langs, self.index, self.weights, self.transitions = langs, index, weights, transitions

    def started(self) -> Model:
        """A copy with a cache of its own."""
        out = copy.copy(self)
        out.start()
        return out

    def start(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((CACHED + 1, len(self.langs)))
        self.letters = np.zeros(CACHED + 1, dtype=bool)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(scores per language, has letters) of each word."""
        if len(words) > CACHED:
            parts = [self.look_up(words[i:i + CACHED]) for i in range(0, len(words), CACHED)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        rows, given = self.rows, set(words)
        new = given - rows.keys()
        if len(rows) + len(new) > CACHED:
            rows.clear()
            new = given
        if new:
            self._put(list(new))
        at = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
        return self.table[at], self.letters[at]

    def _put(self, new: list[bytes]) -> None:
        texts = [w.decode("utf-8", "surrogatepass") for w in new]
        first = len(self.rows)
        self.rows.update(zip(new, range(first, first + len(new))))
        lettered = np.array([t.isalpha() or any(map(str.isalpha, t)) for t in texts], dtype=bool)
        get = self.index.get
        known = [[i for i in map(get, features(t)) if i is not None] if a else [] for t, a in zip(texts, lettered.tolist())]
        flat = np.fromiter((i for x in known for i in x), np.int64)
        owner = np.repeat(np.arange(len(new)), [len(x) for x in known])
        self.letters[first:first + len(new)] = lettered
        for k in range(len(self.langs)):
            self.table[first:first + len(new), k] = np.bincount(owner, self.weights[flat, k], len(new))


def posteriors(scores: np.ndarray, used: np.ndarray, transitions: np.ndarray) -> tuple:
    """Forward-backward over sequences of equal length side by side.

    scores (sequences, length, languages); used (sequences, length), true up
    to a sequence's end.  Gives the marginals, the expected transitions and the
    log of the partition functions."""
    b, t, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e = np.exp(scores - top)
    e[~used] = 1.0
    step = np.exp(transitions)
    alpha, norm = np.empty((t, b, k)), np.empty((t, b))
    a = np.full((b, k), 1.0 / k)
    for i in range(t):
        a = (a @ step if i else a) * e[:, i]
        norm[i] = a.sum(axis=1)
        a = a / norm[i][:, None]
        alpha[i] = a
    # Behind a sequence's end there is nothing: its norm there does not count.
    inside = used.T
    log_z = (np.where(inside, np.log(norm), 0.0)).sum(axis=0) + (top[:, :, 0] * used).sum(axis=1)
    marginal, pairs = np.zeros((b, t, k)), np.zeros((k, k))
    beta = np.ones((b, k))
    for i in range(t - 1, -1, -1):
        last = inside[i] if i == t - 1 else inside[i] & ~inside[i + 1]
        beta = np.where(last[:, None], 1.0, beta)
        g = alpha[i] * beta
        g /= g.sum(axis=1, keepdims=True)
        marginal[:, i] = g * inside[i][:, None]
        if i:
            right = e[:, i] * beta / norm[i][:, None]
            pairs += (alpha[i - 1] * inside[i][:, None]).T @ right * step
            beta = right @ step.T
    return marginal, pairs, log_z


def fit(sample: list[tuple[str, list[str]]], rounds: int = ROUNDS) -> Model | None:
    """Learn from (language, words) pairs by Adam on the log-likelihood."""
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    k, rng = len(langs), np.random.default_rng(5)
    pools = [[w for lang, ws in sample if lang == name for w in ws] for name in langs]
    place = [0] * k
    words: list[str] = []
    label: list[int] = []
    for _ in range(max(1, sum(map(len, pools)) // TRAIN_SEQUENCE)):  # splice: one to three stretches
        cuts = [0, *sorted(rng.integers(1, TRAIN_SEQUENCE, rng.integers(0, 3)).tolist()), TRAIN_SEQUENCE]
        for lo, hi in zip(cuts, cuts[1:]):
            y = int(rng.integers(k))
            for _ in range(hi - lo):
                words.append(pools[y][place[y] % len(pools[y])] if pools[y] else "")
                label.append(y)
                place[y] += 1
    names, token = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)
    per = [features(w) if any(map(str.isalpha, w)) else [] for w in names.tolist()]
    times: dict[str, int] = {}
    for fs in per:
        for f in fs:
            times[f] = times.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in times.items() if n > 1 or f[0] == "="))}
    ids = [[index[f] for f in fs if f in index] for fs in per]
    flat = np.array([i for x in ids for i in x], dtype=np.int64)
    owner = np.repeat(np.arange(len(names)), [len(x) for x in ids])
    y = np.array(label).reshape(-1, TRAIN_SEQUENCE)
    token = token.reshape(y.shape)
    used = np.ones(y.shape, dtype=bool)
    truth = np.eye(k)[y]
    held = np.zeros((k, k))
    np.add.at(held, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    w, tr = np.zeros((len(index), k)), np.zeros((k, k))
    m, v = [np.zeros_like(w), np.zeros_like(tr)], [np.zeros_like(w), np.zeros_like(tr)]
    for r in range(1, rounds + 1):
        emit = np.stack([np.bincount(owner, w[flat, j], len(names)) for j in range(k)], axis=1)
        marginal, pairs, _ = posteriors(emit[token], used, tr)
        miss = marginal - truth
        by_name = np.stack([np.bincount(token.ravel(), miss[:, :, j].ravel(), len(names)) for j in range(k)], axis=1)
        gw = np.stack([np.bincount(flat, by_name[owner, j], len(index)) for j in range(k)], axis=1) / len(y) + 1e-4 * w
        gt = (pairs - held) / len(y)
        for x, g, i in ((w, gw, 0), (tr, gt, 1)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            x -= 0.1 * (m[i] / (1 - 0.9 ** r)) / (np.sqrt(v[i] / (1 - 0.99 ** r)) + 1e-8)
    return Model(langs, index, w, tr)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on the bounded sample of labelled, not held-out rows of `docs`."""
    rows = docs.where((remainder(id_col) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = Window.partitionBy("lang").orderBy("h", "id")
    picked = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h")).withColumn(
        "r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_DOCS).select("id")
    source = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                         F.slice(words_of(F.col(text_col)), 1, SAMPLE_WORDS).alias("words"))
    got = with_ids(source, picked, "id").collect()  # SAMPLE_DOCS documents per language
    return fit(sorted((r.lang, r.words) for r in got))


def _label(model: Model, texts: list) -> tuple:
    """Marginals of all words one after the other, and first word of each text."""
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    n = np.array([len(x) for x in split], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    scores, letters = model.look_up([w for ws in split for w in ws])
    blocks = -(-n // SEQUENCE)
    row_of = np.concatenate([[0], np.cumsum(blocks)])
    within = np.arange(first[-1]) - np.repeat(first[:-1], n)
    row, col = np.repeat(row_of[:-1], n) + within // SEQUENCE, within % SEQUENCE
    used = np.zeros((row_of[-1], SEQUENCE), dtype=bool)
    used[row, col] = True
    grid = np.zeros((row_of[-1], SEQUENCE, len(model.langs)))
    grid[row, col] = scores
    marginal, _, _ = posteriors(grid, used, model.transitions)
    return marginal[row, col], letters, first


_SEGMENTS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", segments: bool = False) -> DataFrame:
    """One row per row of `docs`: the id, lang_pred, score, and with
    `segments` the runs of words of one language (words counted from 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def batches(it):
        model = shared.value and held(("language_crf", shared.value), shared.value.started)
        for b in it:
            texts = b.column(1).to_pylist()
            for lo, hi in slabs(texts, 1 << 20):
                pred, score, runs = [UNKNOWN] * (hi - lo), [0.0] * (hi - lo), [[]] * (hi - lo)
                if model is not None:
                    p, letters, first = _label(model, texts[lo:hi])
                    for i in range(hi - lo):
                        x, y = first[i], first[i + 1]
                        n = letters[x:y].sum()
                        if n:
                            share = p[x:y][letters[x:y]].sum(axis=0) / n
                            best = int(share.argmax())
                            pred[i], score[i] = model.langs[best], float(min(1.0, max(0.0, share[best])))
                        if segments and y > x:
                            lab = p[x:y].argmax(axis=1)
                            at = np.flatnonzero(np.diff(lab, prepend=-1))
                            runs[i] = [{"lang": model.langs[lab[s]], "first_word": int(s), "n_words": int(e - s)}
                                       for s, e in zip(at, [*at[1:], y - x])]
                cols = [b.column(0)[lo:hi], pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                names = [id_col, "lang_pred", "score"]
                if segments:
                    cols, names = [*cols, pa.array(runs, _SEGMENTS)], [*names, "segments"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {id_type}, lang_pred string, score double"
    if segments:
        schema += ", segments array<struct<lang: string, first_word: long, n_words: long>>"
    return docs.select(id_col, text_col).mapInArrow(batches, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    out = predict(docs, learn(docs))
    return out.select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
