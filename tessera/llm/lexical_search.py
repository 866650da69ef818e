"""Operator 13: ranked lexical search by norm buckets.

Terms are the maximal runs of ASCII letters, digits and characters from U+0080
on, A-Z lower-cased.  A document's score for an item is the sum, over the
item's terms with repeats, of w * ((10^9 tf) div (1000 tf + 8 m)), with
w = floor(1000 ln((2N+2) / (2df+1))) and m = 25 + (75 n N) div L: the inner
product of the item's vector and the document's impact vector.  Both are taken
over the item terms only (no other coordinate can count) and their coordinates
are scaled by sqrt(w), which changes no product and lets frequent words weigh
little in the lengths.

Documents are range-partitioned and sorted by the length of that vector.  A task
goes through its range in buckets.  For an item and its threshold (the k-th best
score seen so far):

1. Cauchy-Schwarz drops the bucket, or its tail, where |item| * |document| is
   under the threshold.
2. The item's largest coordinates are taken until those left over cannot reach
   the threshold on their own, whatever the document; only documents with one
   of the coordinates taken remain.
3. Of those, the product over the taken coordinates plus the Cauchy-Schwarz
   bound of the rest must reach the threshold.
4. What is left is scored exactly in integers.

A task keeps k documents an item; the k best of all tasks follow.  Every task
starts from thresholds found on about SEED documents, chosen by a hash: any
documents give a valid lower bound of the k-th best score, so they only save
work and never decide a result.

Items are the query set: all of them meet all documents, in blocks of about
BLOCK_TERMS distinct (item, term) pairs, which bounds what is broadcast.

Rows of equal ids are documents (items) of their own.  Null and blank texts have
no terms and no place in a ranking.  Equal scores go by ascending doc_id, a null
one first.  Extra columns are left out.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import wordhash
from tessera.llm.common import stored

K = 10
BLOCK_TERMS = 4_000_000
SEED = 4096
BUCKET_ROWS = 4096
BUCKET_TERMS = 1 << 20
SLACK = 1e-9  # relative; bounds are doubles


def _packed(values, kind) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _item_terms(items: DataFrame) -> DataFrame:
    """(q, h, c): how often each item holds each term."""
    def batches(it):
        for b in it:
            hashes, first = wordhash.words(b.column(1).to_pylist(), wordhash.LETTERS)
            row = np.repeat(np.arange(b.num_rows), np.diff(first))
            pair, times = np.unique(np.stack([row, hashes.view(np.int64)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pair[0])), pa.array(pair[1]), pa.array(times, pa.int64())],
                                             names=["q", "h", "c"])

    return items.mapInArrow(batches, "q long, h long, c long")


def _document_terms(docs: DataFrame, shared, id_type: str) -> DataFrame:
    """(id, n, terms, tf) of every document with a term: the number of its terms
    with repeats, and the item terms among them as numbers of the vocabulary."""
    def batches(it):
        for b in it:
            texts = b.column(1).to_pylist()
            for lo, hi in wordhash.slabs(texts):
                hashes, first = wordhash.words(texts[lo:hi], wordhash.LETTERS)
                n = np.diff(first)
                voc = shared.value
                i = np.minimum(np.searchsorted(voc, hashes), len(voc) - 1)
                known = voc[i] == hashes
                row = np.repeat(np.arange(hi - lo), n)[known]
                key, tf = np.unique(row * len(voc) + i[known], return_counts=True)
                row, term = key // len(voc), (key % len(voc)).astype("<i4")
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                tf = tf.astype("<i4")
                has = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo).take(pa.array(has)), pa.array(n[has], pa.int64()),
                     pa.array([term[cut[x]:cut[x + 1]].tobytes() for x in has], pa.binary()),
                     pa.array([tf[cut[x]:cut[x + 1]].tobytes() for x in has], pa.binary())], names=["id", "n", "terms", "tf"])

    return docs.mapInArrow(batches, f"id {id_type}, n long, terms binary, tf binary")


def _frequencies(terms: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each item term (at most BLOCK_TERMS rows come back)."""
    def batches(it):
        df = np.zeros(size, dtype=np.int64)
        for b in it:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"), minlength=size)
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(df[t], pa.int64())], names=["t", "df"])

    out = np.zeros(size, dtype=np.int64)
    for r in terms.select("terms").mapInArrow(batches, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        out[r.t] = r.df
    return out


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def _impacts(terms: DataFrame, shared_weights, n_docs: int, n_terms: int, id_type: str) -> DataFrame:
    """(id, size, terms, impacts): the impact vectors with their lengths,
    those of length 0 left out."""
    def batches(it):
        w = shared_weights.value
        for b in it:
            t, tf = b.column(2).to_pylist(), b.column(3).to_pylist()
            many = np.array([len(x) // 4 for x in t], dtype=np.int64)
            term = np.frombuffer(b"".join(t), "<i4")
            f = np.frombuffer(b"".join(tf), "<i4").astype(np.int64)
            m = np.array([25 + 75 * n * n_docs // n_terms for n in b.column(1).to_pylist()], dtype=np.int64)
            impact = (1_000_000_000 * f) // (1000 * f + 8 * np.repeat(m, many))
            cut = np.concatenate([[0], np.cumsum(many)])
            square = np.concatenate([[0.0], np.cumsum(impact.astype(np.float64) ** 2 * w[term])])
            # Differences of sums lose digits; a bound must never be too low.
            size = np.sqrt(np.maximum(square[cut[1:]] - square[cut[:-1]], 0) + 1e-12 * square[-1])
            v = impact.astype("<i4")
            has = np.flatnonzero(many > 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(has)), pa.array(size[has]), b.column(2).take(pa.array(has)),
                 pa.array([v[cut[x]:cut[x + 1]].tobytes() for x in has], pa.binary())], names=["id", "size", "terms", "impacts"])

    return terms.mapInArrow(batches, f"id {id_type}, size double, terms binary, impacts binary")


class Items:
    """A block of items: per item its terms by falling scaled coordinate."""

    def __init__(self, q: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, floor: dict):
        self.weight = weight
        value = times * np.sqrt(weight[term].astype(np.float64))
        order = np.lexsort((-value, q))
        q, term, times, value = q[order], term[order], times[order], value[order]
        self.q, start = np.unique(q, return_index=True)
        stop = np.append(start[1:], len(q))
        self.term = [term[a:b] for a, b in zip(start, stop)]
        self.gain = [(times * weight[term])[a:b] for a, b in zip(start, stop)]  # of one unit of impact
        #: Length of the item's vector from each of its coordinates on.
        self.rest = [np.append(np.sqrt(np.cumsum(value[a:b][::-1] ** 2)[::-1]), 0.0) for a, b in zip(start, stop)]
        self.floor = [floor.get(int(x), 0) for x in self.q]


class Top:
    """The k best of one task, per item."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        self.rows: list[list] = [[] for _ in items.q]

    def least(self, i: int) -> int:
        """A score that the k-th best reaches in any case."""
        own = -self.rows[i][-1][0] if len(self.rows[i]) == self.k else 0
        return max(own, self.items.floor[i], 1)

    def add(self, i: int, scores: np.ndarray, ids: list) -> None:
        if len(scores) > self.k:  # ties of the k-th stay in
            keep = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            scores, ids = scores[keep], [ids[x] for x in keep]
        new = [(-int(s), d is not None, 0 if d is None else d) for s, d in zip(scores, ids)]
        self.rows[i] = sorted(self.rows[i] + new)[:self.k]


def search_bucket(items: Items, top: Top, ids: list, size: np.ndarray, many: np.ndarray, term: np.ndarray, impact: np.ndarray) -> int:
    """Takes the documents of one bucket, longest vector first, into `top`;
    returns how many (item, document) pairs were scored."""
    first = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(ids)), many)
    order = np.argsort(term, kind="stable")
    by_term, by_doc, by_impact = term[order], doc[order], impact[order]
    gain = np.zeros(len(items.weight), dtype=np.int64)
    scored = 0
    for i in range(len(items.q)):
        rest, terms, least = items.rest[i], items.term[i], top.least(i) * (1 - SLACK)
        live = int(np.searchsorted(-size, -least / rest[0], "right")) if rest[0] else 0  # 1: by length
        if not live:
            continue
        taken = int(np.searchsorted(-rest, -least / size[0], "right"))  # 2: the coordinates that are needed
        lo, hi = np.searchsorted(by_term, terms[:taken], "left"), np.searchsorted(by_term, terms[:taken], "right")
        found = hi - lo
        at = np.arange(found.sum()) + np.repeat(lo - np.cumsum(found) + found, found)
        d, v = by_doc[at], by_impact[at].astype(np.float64)
        part = np.bincount(d, weights=v * np.repeat(items.gain[i][:taken], found), minlength=len(ids))
        used = np.bincount(d, weights=v * v * np.repeat(items.weight[terms[:taken]], found), minlength=len(ids))
        left = np.sqrt(np.maximum(size * size - used, 0) + 1e-9 * size * size)
        pick = np.flatnonzero((part[:live] > 0) & (part[:live] + rest[min(taken, len(rest) - 1)] * left[:live] >= least))  # 3
        if not len(pick):
            continue
        gain[terms] = items.gain[i]
        n = many[pick]
        at = np.arange(n.sum()) + np.repeat(first[pick] - np.cumsum(n) + n, n)
        score = np.add.reduceat(gain[term[at]] * impact[at], np.cumsum(n) - n)  # 4; no picked row is empty
        gain[terms] = 0
        scored += len(pick)
        good = np.flatnonzero(score >= top.least(i))
        if len(good):
            top.add(i, score[good], [ids[x] for x in pick[good]])
    return scored


def _search(vectors: DataFrame, shared_items, k: int, id_type: str) -> DataFrame:
    """(q, id, score): every task's k best per item.  Rows come by falling
    length, within a task."""
    def batches(it):
        items = shared_items.value
        top, id_arrow = Top(items, k), None
        for b in it:
            id_arrow = b.column(0).type
            many = np.array([len(x) // 4 for x in b.column(2).to_pylist()], dtype=np.int64)
            lo, total = 0, np.cumsum(many)
            while lo < b.num_rows:
                before = total[lo - 1] if lo else 0
                hi = min(max(int(np.searchsorted(total, before + BUCKET_TERMS, "right")), lo + 1), lo + BUCKET_ROWS, b.num_rows)
                s = b.slice(lo, hi - lo)
                search_bucket(items, top, s.column(0).to_pylist(), s.column(1).to_numpy(), many[lo:hi],
                              np.frombuffer(b"".join(s.column(2).to_pylist()), "<i4"),
                              np.frombuffer(b"".join(s.column(3).to_pylist()), "<i4").astype(np.int64))
                lo = hi
        rows = [(int(items.q[i]), d if has else None, -s) for i, x in enumerate(top.rows) for s, has, d in x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_arrow),
                                              pa.array([r[2] for r in rows], pa.int64())], names=["q", "id", "score"])

    return vectors.mapInArrow(batches, f"q long, id {id_type}, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first()))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = stored(items.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item"), F.col(item_text_col).alias("text")))
    pairs = stored(_item_terms(named.select("q", "text")))
    n_blocks = -(-pairs.count() // BLOCK_TERMS)
    out = spark.createDataFrame([], f"q long, id {id_type}, score long, rank int")
    for block in range(n_blocks):
        mine = pairs.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block).toPandas()  # about BLOCK_TERMS rows
        if not len(mine):
            continue
        hashes = mine.h.to_numpy().view(np.uint64)
        voc = np.unique(hashes)
        terms = stored(_document_terms(source, sc.broadcast(voc), id_type))
        n_docs, n_terms = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        weight = term_weights(_frequencies(terms, len(voc)), n_docs)
        vectors = _impacts(terms, sc.broadcast(weight), n_docs, n_terms, id_type)
        part = (mine.q.to_numpy(), np.searchsorted(voc, hashes), mine.c.to_numpy(), weight)
        some = vectors.where(F.pmod(F.xxhash64("id", "terms"), F.lit(max(1, n_docs // SEED))) == 0)
        seen = _best(_search(some, sc.broadcast(Items(*part, {})), k, id_type), k).where(F.col("rank") == k)
        floor = {r.q: r.score for r in seen.select("q", "score").collect()}  # a number per item
        ranges = vectors.repartitionByRange(F.col("size").desc(), F.xxhash64("id", "terms")).sortWithinPartitions(F.col("size").desc())
        found = _best(_search(ranges, sc.broadcast(Items(*part, floor)), k, id_type), k)
        out = out.unionByName(stored(found.select("q", "id", "score", F.col("rank").cast("int"))))
    return out.join(named.select("q", F.col("item").alias("_item")), "q").select(
        F.col("_item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
