"""Operator 12: embedding near-duplicates by NN-descent.

Two vectors link when their cosine, in double precision, is THRESHOLD or more.

1. Start.  A table deals the vectors into cells of about CELL: the cell is the
   nearest of a few random pivots in each of several pivot sets (the pivots are
   drawn from a sample of about SAMPLE vectors; every vector is dealt).  A cell
   that got more than twice as many is split by a hash.  Inside a part all
   cosines are known: each vector gets its K nearest as neighbour list.  A list
   whose last entry is still a link is saturated; it is enlarged until the last
   one is not.  START tables with other pivots follow one another.
2. Balls.  Vectors within half the threshold's angle of a common centre link
   with each other for certain.  Each part draws such balls, densest centre
   first; centres that meet again in the next table are merged, and a member
   follows where its own angle allows it.  From then on a ball is one vertex, so
   thousands of near copies cost neither pairs nor long lists.
3. Refinement.  Neighbours of neighbours: two entries of one vertex's lists, from
   different tables, are candidates if 128-bit sketches of their vectors allow a
   link.  Candidates are verified in double precision.  Each new edge joins the
   lists of both ends and is joined with them again, until nothing is new.
4. Audit.  The links of about AUDIT vectors are counted against all vectors, in
   blocks.  Below RECALL further tables and refinements follow.

Edges between balls count for all members where the angles allow no doubt;
otherwise members are compared with the other centre, and what is then still in
doubt one by one.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, and so do vectors of different lengths.  Repeated ids are vectors
of their own; component_id is the smallest id of the component, null ids aside.
Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import split_join, stored, with_ids, without_ids
from tessera.llm.components import components

THRESHOLD = 0.9
K = 4
CELL = 1024
START = 2
SAMPLE = 2048
SETS = 256     # pivots in a set at most
AUDIT = 1024
RECALL = 0.98
SLACK = 1e-5   # for products in single precision
_BITS = 128


def _rows(vecs, double: bool) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    vecs = list(vecs)
    x = np.frombuffer(b"".join(vecs), "<f8" if double else "<f4").astype(np.float64).reshape(len(vecs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angle(cosine) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(dim, _BITS)).astype(np.float32)


def _sketches(u: np.ndarray) -> np.ndarray:
    return np.packbits(u.astype(np.float32) @ _planes(u.shape[1]) > 0, axis=1)


def keyed_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """(ids, vectors, double): (key, id) of every row; (key, dim, vec) of the
    vectors that can link.  The id is the key where it is unique."""
    kind = df.schema[vec_col].dataType.elementType.simpleString()
    double = kind != "float"
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>" if double else "array<float>").alias("v"))
    whole = df.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole and rows.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
        rows = rows.select(F.col("id").cast("long").alias("key"), "id", "v")
    else:
        rows = stored(rows.select(F.monotonically_increasing_id().alias("key"), "id", "v"))

    def batches(it):
        for b in it:
            v = b.column(1)
            many = np.diff(v.offsets.to_numpy())
            values = v.values.to_numpy(zero_copy_only=False)
            x = np.where(np.isfinite(values), values, np.nan)
            at = np.concatenate([[0], np.cumsum(many)]) + v.offsets[0].as_py()
            bad = np.concatenate([[0], np.cumsum(np.isnan(x))])
            some = np.concatenate([[0], np.cumsum(np.nan_to_num(x) != 0)])
            good = (many > 0) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            good &= ~np.asarray(v.is_null())
            pick = np.flatnonzero(good)
            x = x.astype("<f8" if double else "<f4")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pick)), pa.array(many[pick], pa.int32()),
                                              pa.array([x[at[i]:at[i + 1]].tobytes() for i in pick], pa.binary())], names=["key", "dim", "vec"])

    return rows.select("key", "id"), rows.select("key", "v").mapInArrow(batches, "key long, dim int, vec binary"), double


def _pivots(vectors: DataFrame, n: int, double: bool) -> dict:
    """A sample of about SAMPLE vectors by length, near copies taken out."""
    rows = vectors.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // SAMPLE))) == 0).select("dim", "vec").collect()
    out = {}
    for dim in {r.dim for r in rows}:
        u = _rows([r.vec for r in rows if r.dim == dim], double)
        near = np.tril(u @ u.T >= THRESHOLD, -1).any(axis=1)
        out[dim] = u[~near].astype(np.float32)
    return out


def _dealt(vectors: DataFrame, pivots, n: int, table: int, double: bool) -> DataFrame:
    """`vectors` with the cell and the part of it that each falls into."""
    cells = max(1, -(-n // CELL))
    sets = max(1, int(np.ceil(np.log(cells) / np.log(SETS))))
    size = int(np.ceil(cells ** (1 / sets)))

    def assign(it):
        drawn = {}
        for dim, p in pivots.value.items():
            order = np.random.default_rng([table, dim]).permutation(len(p))
            drawn[dim] = [p[order[i * size:(i + 1) * size]] for i in range(sets)]
        for b in it:
            dims = b.column(1).to_numpy()
            vec = b.column(2).to_pylist()
            cell = np.zeros(len(dims), dtype=np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                u = _rows([vec[i] for i in at], double).astype(np.float32)
                for p in drawn.get(int(dim), []):
                    if len(p):
                        cell[at] = cell[at] * size + np.argmax(u @ p.T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    dealt = vectors.mapInArrow(assign, fields + ", cell long")
    full = stored(dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 2 * CELL))
    full = F.broadcast(full) if full.count() <= 500_000 else full  # at most n / (2 CELL) rows
    part = F.pmod(F.xxhash64("key", F.lit(table)), F.ceil(F.coalesce("c", F.lit(1)) / CELL))
    return dealt.join(full, ["dim", "cell"], "left").withColumn("part", part).drop("c")


def draw_balls(s: np.ndarray, may: np.ndarray, half: float) -> np.ndarray:
    """Index of each row's centre (its own where it is in no ball): greedy,
    densest first, among the rows that may be in one."""
    near = (s >= np.cos(half) + SLACK) & may[:, None] & may[None, :]
    np.fill_diagonal(near, may)
    many = near.sum(axis=1)
    centre, free = np.arange(len(s)), np.ones(len(s), dtype=bool)
    for i in np.argsort(-many, kind="stable"):
        if many[i] < 2:
            break
        if free[i]:
            ball = near[i] & free
            if ball.sum() > 1:
                centre[ball] = i
                free[ball] = False
    return centre


def _neighbours(s: np.ndarray, link: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the k nearest rows of each, and of the linked ones where
    these are more: such a list is enlarged."""
    k = min(k, len(s) - 1)
    if k < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.repeat(np.arange(len(s)), k)
    b = np.concatenate([np.argpartition(-s[i:i + 512], k - 1, axis=1)[:, :k] for i in range(0, len(s), 512)]).ravel()
    full = np.flatnonzero(link.sum(axis=1) >= k)
    x, y = np.nonzero(link[full])
    return np.concatenate([a, full[x]]), np.concatenate([b, y])


def graph_part(keys: np.ndarray, u: np.ndarray, alpha: np.ndarray, all_rows: bool, theta: float, k: int = K) -> pd.DataFrame:
    """One part of a table: a row per vector with its centre and angle, and per
    vertex its lists (neighbours, their sketches and ball angles) and links."""
    w = u.astype(np.float32)
    s = w @ w.T
    may = np.ones(len(keys), dtype=bool) if all_rows else alpha > 0
    centre = draw_balls(s, may, theta / 2)
    angle = _angle((u * u[centre]).sum(axis=1))
    angle[centre == np.arange(len(keys))] = 0
    vertex = np.arange(len(keys))
    if all_rows:
        vertex = np.flatnonzero(centre == vertex)
        alpha = np.zeros(len(keys))
        np.maximum.at(alpha, centre, angle)
    s, a, key = s[np.ix_(vertex, vertex)], alpha[vertex], keys[vertex]
    np.fill_diagonal(s, -2)
    link = s >= np.cos(np.minimum(theta + a[:, None] + a[None, :], np.pi)) - SLACK
    x, y = _neighbours(s, link, k)
    pair = np.unique(np.concatenate([x * len(key) + y, y * len(key) + x]))
    x, y = pair // max(len(key), 1), pair % max(len(key), 1)
    cut = np.searchsorted(x, np.arange(len(key) + 1))
    marks, wide = _sketches(u[vertex]), np.ceil(a * 255 / np.pi).astype(np.uint8)
    near = [key[(link[i]) & (key > key[i])].astype("<i8").tobytes() for i in range(len(key))]
    out = pd.DataFrame({"v": keys, "centre": keys[centre], "angle": angle, "ids": None, "marks": None, "wide": None, "near": None})
    lists = [y[cut[i]:cut[i + 1]] for i in range(len(key))]
    for name, got in (("ids", [key[i].astype("<i8").tobytes() for i in lists]), ("marks", [marks[i].tobytes() for i in lists]),
                      ("wide", [wide[i].tobytes() for i in lists]), ("near", near)):
        column = np.full(len(keys), None, dtype=object)
        column[vertex] = got
        out[name] = column
    return out


_PART = "v long, centre long, angle double, ids binary, marks binary, wide binary, near binary"


def _table(vectors: DataFrame, pivots, n: int, table: int, double: bool, theta: float) -> DataFrame:
    """graph_part of every part; `vectors` has alpha for vertices, null for all rows."""
    first = "alpha" not in vectors.columns
    cols = ["key", "vec"] + ([] if first else ["alpha"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        alpha = np.zeros(len(g)) if first else g.alpha.to_numpy()
        return graph_part(g.key.to_numpy(), _rows(g.vec, double), alpha, first, theta)

    dealt = _dealt(vectors, pivots, n, table, double)
    return stored(dealt.groupBy("dim", "cell", "part").applyInPandas(run, _PART).withColumn("t", F.lit(table)))


def close_pairs(table: np.ndarray, ids: np.ndarray, marks: np.ndarray, wide: np.ndarray, theta: float) -> np.ndarray:
    """Pairs of entries of one vertex, of different tables, whose sketches allow
    a link: within three deviations of the bits that the largest angle changes."""
    share = np.minimum((theta + (wide[:, None] + wide[None, :].astype(np.float64)) * np.pi / 255) / np.pi, 0.5)
    limit = _BITS * share + 3 * np.sqrt(_BITS * share * (1 - share))
    words = marks.reshape(-1, _BITS // 8).copy().view("<u8")
    apart = sum(np.bitwise_count(words[:, None, i] ^ words[None, :, i]).astype(np.int64) for i in range(words.shape[1]))
    x, y = np.nonzero((apart <= limit) & (table[:, None] < table[None, :]) & (ids[:, None] != ids[None, :]))
    return np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])])


def _refined(lists: DataFrame, theta: float) -> DataFrame:
    """(a, b): the pairs known from the lists, and candidates among neighbours
    of neighbours."""
    def batches(it):
        v, rows = None, []

        def pairs():
            known = [np.frombuffer(r[4], "<i8") for r in rows]
            own = np.concatenate(known)
            out = [np.stack([np.full(len(own), v), own])] if len(own) else []
            if len(rows) > 1:
                many = [len(r[1]) // 8 for r in rows]
                out.append(close_pairs(np.repeat([r[5] for r in rows], many), np.frombuffer(b"".join(r[1] for r in rows), "<i8"),
                                       np.frombuffer(b"".join(r[2] for r in rows), np.uint8),
                                       np.frombuffer(b"".join(r[3] for r in rows), np.uint8), theta))
            return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((2, 0), np.int64)

        found = []
        for b in it:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[0] != v:
                    if rows:
                        found.append(pairs())
                    v, rows = row[0], []
                rows.append(row)
            if found:
                p = np.concatenate(found, axis=1)
                found = []
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])
        if rows:
            p = pairs()
            yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])

    rows = lists.where("ids IS NOT NULL").select("v", "ids", "marks", "wide", "near", "t")
    return rows.repartition("v").sortWithinPartitions("v").mapInArrow(batches, "a long, b long").distinct()


def _fetched(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """`pairs` (a, b, ...) with the vectors va and vb."""
    named = stored(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    vec = stored(with_ids(vectors.select("key", "dim", "vec"), named, "key"))
    return pairs.join(vec.toDF("a", "da", "va"), "a").join(vec.toDF("b", "db", "vb"), "b").where("da = db").drop("da", "db")


def _cosine(double: bool):
    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        dims = x.map(len).to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            out[at] = (_rows(x.iloc[at], double) * _rows(y.iloc[at], double)).sum(axis=1)
        return pd.Series(out)
    return cosine


class Graph:
    """The state of the descent: balls, and the verified edges between them."""

    def __init__(self, df: DataFrame, threshold: float, id_col: str, vec_col: str):
        self.threshold, self.theta = threshold, float(np.arccos(threshold))
        self.ids, self.vectors, self.double = keyed_vectors(df, id_col, vec_col)
        self.cosine = _cosine(self.double)
        self.n = self.vectors.count()
        self.pivots = df.sparkSession.sparkContext.broadcast(_pivots(self.vectors, self.n, self.double))
        first = _table(self.vectors, self.pivots, self.n, 0, self.double, self.theta)
        self.balls = first.select(F.col("v").alias("key"), "centre", "angle")
        self.lists, self.tables = first, 1
        self._size()
        self.edges = None

    def _size(self) -> None:
        """Members and angle of every ball of several; an angle above 0 marks one."""
        self.balls = stored(self.balls)
        self.many = stored(self.balls.groupBy("centre").agg(F.count(F.lit(1)).alias("size"),
            F.greatest(F.max("angle"), F.lit(1e-9)).alias("alpha")).where("size > 1"))  # above 0 for equal vectors too

    def vertices(self) -> DataFrame:
        """(key, dim, vec, alpha) of the centres; a vector in no ball is its own."""
        inner = self.balls.where("key <> centre").join(self.many.select(F.col("centre").alias("key")), "key", "left_anti")
        left = without_ids(self.vectors, stored(inner.select("key")), "key")
        alpha = self.many.select(F.col("centre").alias("key"), "alpha")
        alpha = F.broadcast(alpha) if self.many.count() <= 500_000 else alpha
        return left.join(alpha, "key", "left").fillna(0.0, ["alpha"])

    def add_table(self) -> None:
        t = _table(self.vertices(), self.pivots, self.n, self.tables, self.double, self.theta)
        self.tables += 1
        self.lists = self.lists.unionByName(t)
        self._merge(stored(t.where("v <> centre").select(F.col("v").alias("centre"), F.col("centre").alias("other"))))

    def _merge(self, moves: DataFrame) -> None:
        """Members of a ball follow its centre into another ball if their own
        angle to the new centre is within half the threshold's."""
        if moves.isEmpty():
            return
        sizes = moves.join(self.many.select("centre", "size"), "centre")
        moved = split_join(self.balls, sizes, ["centre"], "size", self.n)
        near = _fetched(self.vectors, moved.select(F.col("key").alias("a"), F.col("other").alias("b")))
        new = F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(F.acos(F.least(self.cosine("va", "vb"), F.lit(1.0))))
        follow = stored(near.select(F.col("a").alias("key"), F.col("b").alias("other"), new.alias("closer")).where(
            F.col("closer") <= self.theta / 2 - SLACK))
        self.balls = self.balls.join(follow, "key", "left").select(
            "key", F.coalesce("other", "centre").alias("centre"), F.coalesce("closer", "angle").alias("angle"))
        self._size()

    def _placed(self, pairs: DataFrame) -> DataFrame:
        """Pairs of vectors as pairs of their balls, a < b."""
        to = self.balls.where("key <> centre").select("key", "centre")
        p = pairs.join(to.toDF("a", "ca"), "a", "left").join(to.toDF("b", "cb"), "b", "left")
        p = p.select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")).where("x <> y")
        return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, cosine, close): close where the balls may hold a link."""
        alpha = self.many.select("centre", "alpha")
        rows = _fetched(self.vectors, pairs).join(alpha.toDF("a", "aa"), "a", "left").join(alpha.toDF("b", "ab"), "b", "left")
        rows = rows.fillna(0.0, ["aa", "ab"]).withColumn("cosine", self.cosine("va", "vb"))
        far = F.least(F.lit(self.theta) + F.col("aa") + F.col("ab"), F.lit(np.pi))
        single = (F.col("aa") == 0) & (F.col("ab") == 0)
        close = F.when(single, F.col("cosine") >= self.threshold).otherwise(F.col("cosine") >= F.cos(far) - SLACK)
        return stored(rows.select("a", "b", "cosine", close.alias("close")))

    def refine(self) -> None:
        """Neighbours-of-neighbours joins until no edge is new."""
        new = self._verified(stored(self._placed(stored(_refined(self.lists, self.theta)))))
        seen = new
        while True:
            fresh = new.where("close").select("a", "b")
            if fresh.isEmpty():
                break
            edges = seen.where("close").select("a", "b")
            around = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
            ends = fresh.unionByName(fresh.select(F.col("b").alias("a"), F.col("a").alias("b")))
            two = ends.toDF("m", "x").join(around.toDF("m", "y"), "m").where("x <> y")
            two = two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            new = self._verified(stored(two.join(seen.select("a", "b"), ["a", "b"], "left_anti")))
            seen = stored(seen.unionByName(new))
        self.edges = stored(seen.where("close").drop("close"))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(per, joined): (key, n_links) of every vector that can link; (a, b)
        of the balls that some link connects."""
        size = self.many.select("centre", "size", "alpha")
        e = self.edges.join(size.toDF("a", "sa", "aa"), "a", "left").join(size.toDF("b", "sb", "ab"), "b", "left")
        e = stored(e.fillna(1, ["sa", "sb"]).fillna(0.0, ["aa", "ab"]).withColumn("beta", F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0)))))
        single = (F.col("aa") == 0) & (F.col("ab") == 0)
        sure = single | (F.col("beta") + F.col("aa") + F.col("ab") <= self.theta - SLACK)
        both = e.select("a", "b", sure.alias("sure"), F.col("sb").alias("other"), F.col("ab").alias("wide")).unionByName(
            e.select(F.col("b").alias("a"), F.col("a").alias("b"), sure.alias("sure"), F.col("sa").alias("other"), F.col("aa").alias("wide")))
        per_ball = both.where("sure").groupBy(F.col("a").alias("centre")).agg(F.sum("other").alias("sure_links"))
        doubt = self._doubtful(stored(both.where("NOT sure").drop("sure")))
        own = self.many.select("centre", "size").join(per_ball, "centre", "full")
        own = stored(own.select("centre", F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("sure_links", F.lit(0)).alias("sure_links")))
        placed = split_join(self.balls, own, ["centre"], "size", self.n)
        alone = self.balls.join(placed.select("key"), "key", "left_anti").withColumns({"size": F.lit(1), "sure_links": F.lit(0)})
        extra = doubt.groupBy("key").agg(F.sum("n").alias("more"))
        per = placed.unionByName(alone.select(*placed.columns)).join(extra, "key", "left").select(
            "key", "centre", (F.col("size") - 1 + F.col("sure_links") + F.coalesce("more", F.lit(0))).alias("n_links"))
        joined = e.where(sure).select("a", "b").unionByName(doubt.where("n > 0").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        return per, joined

    def _doubtful(self, pairs: DataFrame) -> DataFrame:
        """(key, ca, cb, n): links of the members of ball a with those of b."""
        members = self.balls.select("key", F.col("centre").alias("ca"))
        x = pairs.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "other", "wide").join(members, "ca")
        x = _fetched(self.vectors, x.withColumnRenamed("key", "a").withColumn("b", F.col("cb")))
        angle = F.acos(F.least(F.greatest(self.cosine("va", "vb"), F.lit(-1.0)), F.lit(1.0)))
        x = stored(x.select("a", "ca", "cb", "other", "wide", self.cosine("va", "vb").alias("cosine"), angle.alias("gamma")))
        alone = F.col("wide") == 0
        yes = F.when(alone, F.col("cosine") >= self.threshold).otherwise(F.col("gamma") + F.col("wide") <= self.theta - SLACK)
        no = F.when(alone, F.col("cosine") < self.threshold).otherwise(F.col("gamma") - F.col("wide") > self.theta + SLACK)
        certain = x.where(yes).select(F.col("a").alias("key"), "ca", "cb", F.col("other").cast("long").alias("n"))
        open_ = x.where(~yes & ~no).select("a", "ca", "cb").join(self.balls.select(F.col("key").alias("b"), F.col("centre").alias("cb")), "cb")
        met = _fetched(self.vectors, stored(open_)).where(self.cosine("va", "vb") >= self.threshold)
        return stored(certain.unionByName(met.groupBy(F.col("a").alias("key"), "ca", "cb").agg(F.count(F.lit(1)).alias("n"))))

    def recall(self, per: DataFrame) -> float:
        """Share of the links of about AUDIT vectors that were found; counted
        against all vectors."""
        some = self.vectors.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(max(1, self.n // AUDIT))) == 0).collect()
        dims = {d: ([r.key for r in some if r.dim == d], _rows([r.vec for r in some if r.dim == d], self.double)) for d in {r.dim for r in some}}
        shared = self.vectors.sparkSession.sparkContext.broadcast(dims)
        double, threshold = self.double, self.threshold

        def count(it):
            total: dict = {}
            for b in it:
                dim, vec = b.column(1).to_numpy(), b.column(2).to_pylist()
                for d in np.unique(dim):
                    keys, u = shared.value.get(int(d), ([], None))
                    if keys:
                        got = (u @ _rows([vec[i] for i in np.flatnonzero(dim == d)], double).T >= threshold).sum(axis=1)
                        for k, c in zip(keys, got.tolist()):
                            total[k] = total.get(k, 0) + c
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["key", "c"])

        true = self.vectors.mapInArrow(count, "key long, c long").groupBy("key").agg((F.sum("c") - 1).alias("true"))
        got = true.join(per.select("key", "n_links"), "key").agg(F.sum("true"), F.sum(F.least("true", "n_links"))).first()
        return 1.0 if not got[0] else got[1] / got[0]


def descend(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[Graph, DataFrame, DataFrame, float]:
    """(graph, per, joined, recall): see Graph.links."""
    g = Graph(df, threshold, id_col, vec_col)
    while g.tables < START:
        g.add_table()
    while True:
        g.refine()
        per, joined = g.links()
        per, joined = stored(per), stored(joined)
        found = g.recall(per)
        if found >= RECALL:
            return g, per, joined, found
        g.add_table()


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    g, per, joined, _ = descend(df, threshold, id_col, vec_col)
    group = components(joined).select(F.col("node").alias("centre"), "component")
    # Only vectors with a link can be in a component of several.
    linked = stored(per.where("n_links > 0").join(g.ids, "key").join(group, "centre", "left").select(
        "key", "n_links", "id", F.coalesce("component", "centre").alias("component")))
    least = linked.groupBy("component").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    named = split_join(linked, least, ["component"], "size", g.n).select("key", "n_links", "least")
    out = g.ids.join(named, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
