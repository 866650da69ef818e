"""Operator 3: n-gram Jaccard join under several global token orders.

A text's set holds its distinct 5-word shingles (words `[^\\x20\\x09-\\x0D]+`
after lower-casing A-Z; with fewer words the whole sequence is one shingle;
without words, or without text, the set is empty and links with nothing).  Two
documents link when 100 * |intersection| >= 80 * |union|.

Texts with equal sets form a class with one representative, the smallest id;
only representatives are compared.  If n tokens are put in any fixed order,
two linked sets share one of their first n - ceil(0.8 n) + 1 tokens: the
prefix.  The join uses three orders.  All go from rare to frequent by counts
over all texts, held in a table of fixed size by a part of the token's hash,
and break ties by different hashes.  Candidates share a prefix token in the
first order (an equi-join, with length and positional filters) and must also
share as many as linked sets do in the second and in the third; what passes
all three is verified on the whole sets.

A token in the prefixes of more than `LARGE` representatives would give a
square of pairs.  Such representatives are first held against the smallest id
that has the token.  What these links and those of the small buckets connect
needs no further comparison: a large token whose representatives are all connected
is done.  Of the others, those stay that can share enough large tokens with one of
another component (see below).  They are dealt into blocks of about `BLOCK`, large
components into blocks of their own; two blocks that hold a common large token meet
once, unless both are of one component, are filtered by the same three orders and
verified with matrix products, and give only a spanning forest of links between
components, never the pairs.

Rows with the same id are taken as one document.  Rows with a null id keep a
null component.  Extra columns are left out.  Ties cannot matter: orders are
total and every link is found whatever the order.

Two linked sets share even more of their prefixes: if they must have `need`
tokens in common and their prefixes have px and py tokens, at least
min(px - x, py - y) + need tokens lie in both prefixes, under every order.  So a
pair of the first order is kept only if the tokens of small buckets that it shares
and the large tokens that either has make up that many: texts that have a shingle
in common by chance end there, before anything is read for them.  A pair that
shares no token of a small bucket shares so many large ones, and all of them come
after the first it shares: of a large bucket, only those are compared that still
have as many from that token on as a partner of some size there asks for.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm import wordhash
from tessera.llm.common import scratch, stored, with_ids, without_ids
from tessera.llm.components import components

WORDS = 5
PERCENT = 80
BINS = 1 << 20   # of the table of counts
PART = 1 << 14   # bins in a row of it
LARGE = 64
BLOCK = 256
_SEEDS = (np.uint64(0), np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B))


def shingle_sets(texts: list, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for lo, hi in wordhash.slabs(texts):
        h, first = wordhash.words(texts[lo:hi], wordhash.NON_SPACE)
        out += [np.unique(wordhash.shingles(h[first[i]:first[i + 1]], size)) for i in range(hi - lo)]
    return out


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def ordered(s: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """The set's tokens from first to last in one of the orders."""
    tie = wordhash.mix(s ^ _SEEDS[order])
    return s[np.lexsort((tie, level[(s & np.uint64(BINS - 1)).astype(np.int64)]))]


def prefix(s: np.ndarray, level: np.ndarray, order: int, percent: int) -> np.ndarray:
    return ordered(s, level, order)[:prefix_size(len(s), percent)]


def _classes_and_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: a document's id, set size and 128-bit set digest;
    and, from each task, parts of the table of counts."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n long, k1 long, k2 long, part int, counts binary"

    def batches(it):
        counts, kind = np.zeros(BINS, dtype=np.uint32), None
        for b in it:
            kind = b.column(0).type
            sets = shingle_sets(b.column(1).to_pylist())
            for s in sets:
                np.add.at(counts, (s & np.uint64(BINS - 1)).astype(np.int64), 1)
            k1 = [int(wordhash.mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            k2 = [int(wordhash.mix(s ^ _SEEDS[1]).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            none = pa.nulls(len(sets), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()),
                                              pa.array(k2, pa.int64()), none, pa.nulls(len(sets), pa.binary())],
                                             names=["id", "n", "k1", "k2", "part", "counts"])
        parts = [(i, counts[i * PART:(i + 1) * PART]) for i in range(BINS // PART)]
        parts = [(i, zlib.compress(c.astype("<u4").tobytes(), 1)) for i, c in parts if c.any()]
        if parts:
            nothing = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(parts), kind), nothing, nothing, nothing,
                 pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())],
                names=["id", "n", "k1", "k2", "part", "counts"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, schema)


def _levels(parts: DataFrame) -> np.ndarray:
    """The whole table, as levels of half a power of two: BINS bytes."""
    def add(it):
        total: dict[int, np.ndarray] = {}
        for b in it:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64)
        for i, c in total.items():
            level = np.floor(2 * np.log2(np.maximum(c, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "level"])

    level = np.zeros(BINS, dtype=np.uint8)
    rows = parts.repartition(BINS // PART, "part").mapInArrow(add, "part int, level binary").collect()  # BINS bytes in all
    for r in rows:
        level[r.part * PART:(r.part + 1) * PART] = np.frombuffer(r.level, np.uint8)
    return level


def _prefix_rows(docs: DataFrame, shared_level, percent: int) -> DataFrame:
    """(id, n, tokens): the prefix in the first order."""
    def batches(it):
        for b in it:
            sets = shingle_sets(b.column(1).to_pylist())
            tokens = [prefix(s, shared_level.value, 0, percent).astype(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array(tokens, pa.list_(pa.int64()))], names=["id", "n", "tokens"])

    return docs.mapInArrow(batches, f"id {docs.schema['id'].dataType.simpleString()}, n long, tokens array<long>")


def _filter_rows(docs: DataFrame, shared_level, percent: int) -> DataFrame:
    """(id, m, p2, p3): set size and the prefixes in the second and third
    order, as distinct 32-bit parts of the tokens."""
    def batches(it):
        for b in it:
            sets = shingle_sets(b.column(1).to_pylist())
            p = [[np.unique(prefix(s, shared_level.value, k, percent).astype(np.uint32)).view(np.int32) for s in sets] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                                              *[pa.array(x, pa.list_(pa.int32())) for x in p]], names=["id", "m", "p2", "p3"])

    return docs.mapInArrow(batches, f"id {docs.schema['id'].dataType.simpleString()}, m long, p2 array<int>, p3 array<int>")


def _need(x, y, percent: int):
    """The least intersection of linked sets of these sizes."""
    return (percent * (x + y) + 99 + percent) // (100 + percent)


def _least_shared(x: str, y: str, percent: int) -> str:
    """SQL: the least number of tokens in both prefixes of linked sets of these
    sizes, under every order; less than 1 where any would do."""
    return (f"(({percent} * ({x} + {y}) + {99 + percent}) div {100 + percent} + 1"
            f" - ({percent} * greatest({x}, {y}) + 99) div 100)")


def _shares_enough(p: str, q: str, percent: int) -> Column:
    """Whether two prefixes (32-bit parts) share what linked sets share.
    Tokens whose parts fall together are made up for."""
    px = F.col("am") - F.expr(f"({percent} * am + 99) div 100") + 1
    return F.size(F.array_intersect(p, q)) >= F.greatest(F.lit(1), F.expr(_least_shared("am", "bm", percent)) - (px - F.size(p)))


def _set_rows(docs: DataFrame) -> DataFrame:
    """(id, s): the whole set, as packed 64-bit numbers."""
    def batches(it):
        for b in it:
            sets = shingle_sets(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "s"])

    return docs.mapInArrow(batches, f"id {docs.schema['id'].dataType.simpleString()}, s binary")


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    i = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[i] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _overlaps(rows: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by matrix products over slices of the tokens."""
    n = np.array([len(r) for r in rows])
    tokens, column, times = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), n)
    keep = times[column] > 1  # a token of one row is in no intersection
    row, column = row[keep], np.cumsum(times > 1)[column[keep]] - 1
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(rows), len(rows)), dtype=np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(rows), width), dtype=np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def block_links(ids: list, sets: list[np.ndarray], level: np.ndarray, percent: int, groups: np.ndarray | None = None) -> list:
    """A spanning forest of the links among these rows, with `groups` of those
    between rows of different groups: rows that share prefix tokens in every order
    are verified on their sets."""
    n = np.array([len(x) for x in sets])
    may = (np.minimum.outer(n, n) * 100 >= percent * np.maximum.outer(n, n))
    p = np.array([prefix_size(int(x), percent) for x in n])
    least = np.minimum.outer(p - n, p - n) + _need(np.add.outer(n, n), 0, percent)
    for k in range(len(_SEEDS)):
        may &= _overlaps([prefix(x, level, k, percent) for x in sets]) >= np.maximum(least, 1)
    np.fill_diagonal(may, False)
    if groups is not None:
        may &= np.not_equal.outer(groups, groups)
    rows = np.flatnonzero(may.any(axis=1))
    if not len(rows):
        return []
    both = _overlaps([sets[i] for i in rows])
    size = n[rows]
    link = may[np.ix_(rows, rows)] & (100 * both >= percent * (np.add.outer(size, size) - both))
    seen, out = np.zeros(len(rows), dtype=bool), []
    for start in range(len(rows)):
        todo = [start] if not seen[start] else []
        seen[start] = True
        while todo:
            x = todo.pop()
            near = np.flatnonzero(link[x] & ~seen)
            seen[near] = True
            todo += near.tolist()
            out += [(ids[rows[x]], ids[rows[y]]) for y in near]
    return out


def _counted(pairs: DataFrame, after: DataFrame, percent: int) -> DataFrame:
    """(a, b): of `pairs`, (a, b, an, bn, s) with sizes and the number s of small
    tokens in both prefixes (stored), those that can share as many tokens as linked
    sets do.  `after` are the rows of large tokens."""
    least = _least_shared("an", "bn", percent)
    enough = pairs.where(f"s >= {least}").select("a", "b")
    many = after.groupBy("id").agg(F.max("k").alias("l"))
    more = pairs.where(f"s < {least}").join(many.toDF("a", "la"), "a").join(many.toDF("b", "lb"), "b")
    return enough.union(more.where(f"s + least(la, lb) >= {least}").select("a", "b")).distinct()


def _live(named: DataFrame, percent: int) -> DataFrame:
    """Those of `named`, (token, id, n, k, component), that can link with one of
    another component and of their token, and share no large token before it:
    both have k large tokens from there on.  Rows equal in token, n and k are judged
    as one, so a bucket counts by its sizes and not by its rows."""
    kinds = stored(named.groupBy("token", "n", "k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
    may = (f"x.token = y.token AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
           f" AND least(x.k, y.k) >= {_least_shared('x.n', 'y.n', percent)} AND least(x.lo, y.lo) < greatest(x.hi, y.hi)")
    live = kinds.alias("x").join(kinds.alias("y"), F.expr(may), "left_semi").select("token", "n", "k")
    return named.join(live, ["token", "n", "k"], "left_semi")


def _blocks(open_: DataFrame) -> DataFrame:
    """(id, component, block, whole) of the members of large buckets: `open_`, (token,
    id, component).  `whole` is the component of a block that has only one."""
    member = open_.groupBy("id", "component").agg(F.min("token").alias("token"))
    big = member.groupBy("component").agg(F.count(F.lit(1)).alias("m")).where(2 * F.col("m") > BLOCK)
    own = member.join(big, "component").select("id", "component", F.concat_ws(
        "/", F.lit("c"), "component", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK))).alias("block"), F.col("component").alias("whole"))
    rest = member.join(big, "component", "left_anti")
    count = rest.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    mixed = rest.join(count, "token").select("id", "component", F.concat_ws(
        "/", "token", F.pmod(F.xxhash64("component"), F.ceil(F.col("c") / BLOCK))).alias("block"))
    return own.unionByName(mixed, allowMissingColumns=True)


def _large_links(open_: DataFrame, rows: DataFrame, shared_level, percent: int) -> DataFrame:
    """Links between components among the documents of large buckets: `open_`,
    (token, id, component); `rows` are their sets."""
    kind = open_.schema["id"].dataType.simpleString()
    member = stored(_blocks(open_))
    held = stored(open_.select("token", "id").join(member, "id").select("token", "block", "whole").distinct())
    pairs = held.alias("x").join(held.alias("y"), F.expr(
        "x.token = y.token AND x.block <= y.block AND NOT coalesce(x.whole = y.whole, false)")).select(
        F.col("x.block").alias("i"), F.col("y.block").alias("j")).distinct()
    sides = stored(pairs.withColumn("pair", F.concat_ws("|", "i", "j")))
    wanted = sides.select("pair", F.col("i").alias("block")).union(sides.where("i <> j").select("pair", F.col("j").alias("block")))
    dealt = wanted.join(member, "block").join(rows, "id").select("pair", "id", "component", "s")

    def verify(g: pd.DataFrame) -> pd.DataFrame:
        links = block_links(g.id.tolist(), [np.frombuffer(x, np.uint64) for x in g.s], shared_level.value, percent, g.component.to_numpy())
        return pd.DataFrame({"a": [x for x, _ in links], "b": [y for _, y in links]}).astype({"a": g.id.dtype, "b": g.id.dtype})

    return dealt.groupBy("pair").applyInPandas(verify, f"a {kind}, b {kind}")  # two blocks at most


def join(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, links): (id, n, representative) of every row of `docs`, null
    representative for an empty set; and (a, b): verified links between
    representatives that connect all that links connect.  Both are stored."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with scratch(spark) as kept:
        with scratch(spark) as early:
            first = stored(_classes_and_counts(docs, id_col, text_col))
            level = spark.sparkContext.broadcast(_levels(first.where("part IS NOT NULL").select("part", "counts")))
            rows = first.where("part IS NULL").select("id", "n", "k1", "k2")
            keys = rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("id").alias("representative"))
            classes = kept.keep(early.keep(stored(rows.join(keys, ["n", "k1", "k2"], "left").select("id", "n", "representative"))))
        # Only representatives go on.
        chosen = without_ids(source.where("id IS NOT NULL"), classes.where("n = 0 OR id <> representative").select("id"), "id")
        tokens = _prefix_rows(chosen, level, percent).select("id", F.col("n").cast("int"), F.posexplode("tokens").alias("pos", "token"))
        counted = F.count(F.lit(1)).over(Window.partitionBy("token"))
        shared = stored(tokens.withColumn("c", counted).where("c > 1"))

        small, large = shared.where(F.col("c") <= LARGE), shared.where(F.col("c") > LARGE)
        need = f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent}"  # the least intersection of linked sets
        close = (f"x.id < y.id AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
                 f" AND least(x.pos, y.pos) + least(x.n - x.pos, y.n - y.pos) >= {need}")
        ab = [F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("an"), F.col("y.n").alias("bn")]
        both = small.alias("x").join(small.alias("y"), F.expr("x.token = y.token AND " + close)).select(*ab, F.lit(1).alias("s"))
        least = large.groupBy("token").agg(F.min(F.struct("id", "n", "pos")).alias("x"))
        led = large.alias("y").join(least, "token").where(F.expr(close)).select(*ab, F.lit(0).alias("s"))
        with scratch(spark) as early:
            # k: the large tokens of its prefix from this one on
            after = kept.keep(early.keep(stored(large.select("token", "id", "n", F.row_number().over(
                Window.partitionBy("id").orderBy(F.desc("pos"))).alias("k")))))
            met = stored(both.union(led).groupBy("a", "b", "an", "bn").agg(F.sum("s").alias("s")))
            pairs = stored(_counted(met, after, percent))
            links = kept.keep(early.keep(stored(_verified(source, pairs, level, percent))))
        if not after.isEmpty():
            with scratch(spark) as late:
                found = components(links).select(F.col("node").alias("id"), "component")
                named = after.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
                apart = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
                named = stored(named.join(apart.select("token"), "token", "left_semi"))
                open_ = stored(_live(named, percent).select("token", "id", "component"))
                sets = stored(_set_rows(with_ids(source, stored(open_.select("id").distinct()), "id")).dropDuplicates(["id"]))
                more = kept.keep(late.keep(stored(_large_links(open_, sets, level, percent))))
            links = links.union(more)
    return classes, links


def _verified(source: DataFrame, pairs: DataFrame, shared_level, percent: int) -> DataFrame:
    """The pairs (stored) that are links."""
    with scratch(pairs.sparkSession) as early:
        named = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        orders = stored(_filter_rows(with_ids(source, named, "id"), shared_level, percent).dropDuplicates(["id"]))
        passed = early.keep(stored(pairs.join(orders.toDF("a", "am", "a2", "a3"), "a").join(orders.toDF("b", "bm", "b2", "b3"), "b").where(
            _shares_enough("a2", "b2", percent) & _shares_enough("a3", "b3", percent)).select("a", "b")))
    named = stored(passed.select(F.col("a").alias("id")).union(passed.select("b")).distinct())
    sets = stored(_set_rows(with_ids(source, named, "id")).dropDuplicates(["id"]))

    @F.pandas_udf("boolean")
    def verified(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_linked(p, q, percent) for p, q in zip(x, y)], dtype=bool)

    return passed.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").where(verified("sa", "sb")).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: the id, n_shingles, component_id (smallest id
    reachable by links, its own included) and class_id (smallest id with an
    equal set, null for an empty one)."""
    classes, links = join(docs, percent, id_col, text_col)
    groups = components(links)
    out = classes.join(groups.select(F.col("node").alias("representative"), "component"), "representative", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.coalesce("component", "representative", "id").alias("component_id"),
                      F.col("representative").alias("class_id"))
