"""Operator 11: prefix trie of conversations, rolled up by centroid decomposition.

Every conversation c is rebuilt: the first h turns of conversation c - c % 5, then
its own turns after its first h, with h = crc32(decimal c) % 9.  The trie's nodes
are the distinct sequences of first d rebuilt turns; a node is named by its
smallest member conversation and its depth.

A prefix is told apart by a 128-bit digest: the exclusive or of the digests of
its (position, role, text), a running aggregate, so no text is kept or repeated.

Rollup (leaves and saved tokens of subtrees): the parent-edge forest is split by
centroids.  In a component with top t the centroid c is the deepest node that
holds more than half of the weight (a node weighs as many turns as its members
have there).  The total of c's side, c and what hangs below it, belongs to the
subtree sum of exactly the nodes on the path from c up to t, and is added to
them; then c is taken out, each branch below c and the rest above form
components of their own.  Any two nodes, one above the other, are parted by one
such c, so every node gets each descendant once; a component's weight halves
each time, so there are about log2(turns) levels, however deep the trie.

Components of more than LOCAL nodes are split by joins: paths come from the
turns of the centroid's own conversation, the nodes below it from the
conversations that pass through it.  Smaller ones go on in tasks that hold a
bounded number of nodes.  Joins on a node or conversation that holds more than a
SHARE-th of all rows broadcast that side (at most SHARE rows), so such rows stay
where they are.

Turns are ordered by number, null first; turns of one number by a digest of role
and text, and repeated rows all count.  Null role or text is the empty string.
Rows without conv_id are left out; an empty table has no node.  Extra columns
are left out.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.operators.ordering import with_row_index

HEADS = 5      # conversations that share their first turns
MOST_HEAD = 9  # h is below it
BLOCK = 4096   # turns of a conversation in one window
LOCAL = 1 << 14
SHARE = 1000
IDS = 512      # conversation ids in one piece of a digest's input

_KEY = ["d", "x1", "x2"]


def _split_join(left: DataFrame, right: DataFrame, keys: list, size: str, total: int) -> DataFrame:
    """Inner join with `right`, whose keys are unique and each stand for `size`
    rows of `total`.  Its hot rows are broadcast: fewer than SHARE of them."""
    hot = right.where(F.col(size) * SHARE > total)
    return left.join(F.broadcast(hot), keys).unionByName(
        left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(size) * SHARE <= total), keys))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): (c, d, t1, t2, bytes, size) of every rebuilt turn, d from
    1; (c, size) of every conversation, size its rebuilt turns."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.sha2(F.concat_ws("\u0000", F.length(role).cast("string"), role, text), 256)
    number = lambda at: F.conv(F.substring("_s", at, 15), 16, 10).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("_s"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.select("c", "turn", number(1).alias("t1"), number(16).alias("t2"), "bytes", F.monotonically_increasing_id().alias("_r"))
    own = with_row_index(rows, [F.col("turn").asc_nulls_first(), "t1", "t2", "_r"], ["c"], "pos").drop("turn", "_r")
    convs = own.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    convs = stored(convs.select("c", "n", (F.crc32(F.encode(F.col("c").cast("string"), "UTF-8")) % MOST_HEAD).alias("h"),
                                (F.col("c") - F.col("c") % HEADS).alias("base")))
    lead = convs.join(convs.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left")
    k = F.least("h", F.coalesce("base_n", F.lit(0)))
    lead = stored(lead.select("c", "n", "h", "base", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    total = convs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heads = own.where(F.col("pos") < MOST_HEAD - 1).withColumnRenamed("c", "base")
    head = lead.select("c", "h", "base", "size").join(heads, "base").where("pos < h")
    rest = _split_join(own, lead.select("c", "n", "h", "k", "size"), ["c"], "n", total).where("pos >= h")
    cols = ["t1", "t2", "bytes", "size"]
    turns = head.select("c", (F.col("pos") + 1).alias("d"), *cols).unionByName(
        rest.select("c", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("d"), *cols))
    return turns, lead.select("c", "size")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, d, x1, x2, p1, p2, bytes, size): every conversation's nodes, root
    included, with the digests of the prefix and of the one before it."""
    own = [F.xxhash64(F.lit(i), "d", "t1", "t2").alias(f"y{i}") for i in (1, 2)]
    block = F.floor((F.col("d") - 1) / BLOCK)
    rows = turns.select("c", "d", "bytes", "size", block.alias("block"), *own)
    here = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = stored(rows.withColumns({f"z{i}": F.bit_xor(f"y{i}").over(here) for i in (1, 2)}))
    long = rows.where(F.col("size") > BLOCK)
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = long.groupBy("c", "block").agg(*[F.bit_xor(f"y{i}").alias(f"s{i}") for i in (1, 2)])
    carry = sums.select("c", "block", *[F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    long = long.join(carry, ["c", "block"]).withColumns({f"z{i}": F.col(f"z{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
    rows = rows.where(F.col("size") <= BLOCK).unionByName(long.drop("b1", "b2"))
    rows = rows.select("c", "d", F.col("z1").alias("x1"), F.col("z2").alias("x2"), F.col("z1").bitwiseXOR(F.col("y1")).alias("p1"),
                       F.col("z2").bitwiseXOR(F.col("y2")).alias("p2"), "bytes", "size")
    none = F.lit(0).cast("long")
    root = convs.select("c", none.alias("d"), none.alias("x1"), none.alias("x2"), none.alias("p1"), none.alias("p2"), none.alias("bytes"), "size")
    return rows.unionByName(root)


def build(rows: DataFrame, total: int) -> DataFrame:
    """The nodes: m (smallest member), d, pm (m of the parent), n_convs,
    n_children, weight, saved (of the node alone), the digest, and how many
    conversations end here (n_ends; one_end the smallest)."""
    ends = F.col("d") == F.col("size")
    nodes = stored(rows.groupBy(*_KEY).agg(
        F.min("c").alias("m"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"), F.first("p1").alias("p1"),
        F.first("p2").alias("p2"), F.sum(F.col("size") - F.col("d") + 1).alias("weight"),
        F.count_if(ends).alias("n_ends"), F.min(F.when(ends, F.col("c"))).alias("one_end")))
    up = nodes.where("d > 0").withColumns({"d": F.col("d") - 1, "k1": F.col("x1"), "k2": F.col("x2"), "x1": F.col("p1"), "x2": F.col("p2")})
    parents = nodes.select(*_KEY, F.col("m").alias("pm"), F.col("n_convs").alias("pn"))
    named = _split_join(up, parents, _KEY, "pn", total).withColumns({"d": F.col("d") + 1, "x1": F.col("k1"), "x2": F.col("k2")})
    kept = ["m", "d", "n_convs", "bytes", "weight", "n_ends", "one_end", "x1", "x2"]
    named = named.select(*kept, "pm").unionByName(nodes.where("d = 0").select(*kept, F.lit(None).cast("long").alias("pm")))
    children = named.where("d > 0").groupBy(F.col("pm").alias("m"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"))
    return named.join(children, ["m", "d"], "left").select(
        *kept, "pm", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))


# ------------------------------------------------------- centroid decomposition

def split_components(top: list[int], parent: list[int], weight: list[int], leaves: list[int], saved: list[int]) -> tuple[list[int], list[int]]:
    """Subtree sums of `leaves` and `saved` in a forest of components: `top`
    holds the tops, `parent` each node's parent or -1."""
    children: list[list[int]] = [[] for _ in parent]
    for x, p in enumerate(parent):
        if p >= 0:
            children[p].append(x)
    weight, gone = list(weight), [False] * len(parent)
    sum_leaves, sum_saved = [0] * len(parent), [0] * len(parent)
    todo = list(top)
    while todo:
        t = c = todo.pop()
        half = weight[t]
        down = True
        while down:  # to the deepest node with more than half
            down = False
            for x in children[c]:
                if not gone[x] and 2 * weight[x] > half:
                    c, down = x, True
                    break
        a = b = 0
        side = [c]
        while side:
            x = side.pop()
            a, b = a + leaves[x], b + saved[x]
            side += [y for y in children[x] if not gone[y]]
        gone[c] = True
        todo += [x for x in children[c] if not gone[x]]
        if c != t:
            todo.append(t)
        x, w = c, weight[c]
        while True:
            sum_leaves[x] += a
            sum_saved[x] += b
            weight[x] -= w
            if x == t:
                break
            x = parent[x]
    return sum_leaves, sum_saved


def _local_sums(small: DataFrame, n_nodes: int) -> DataFrame:
    """(m, d, a, b): the rollup inside components of at most LOCAL nodes, dealt
    into bins of about LOCAL nodes."""
    bins = max(1, -(-n_nodes // LOCAL))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m, d, pm = g.m.tolist(), g.d.tolist(), g.pm.tolist()
        at = {x: i for i, x in enumerate(zip(m, d))}
        is_top = ((g.m == g.tm) & (g.d == g.td)).tolist()
        parent = [-1 if is_top[i] else at[int(pm[i]), d[i] - 1] for i in range(len(m))]
        a, b = split_components([i for i, x in enumerate(is_top) if x], parent, g.weight.tolist(), g.leaf.tolist(), g.saved.tolist())
        return pd.DataFrame({"m": m, "d": d, "a": a, "b": b}, dtype="int64")

    dealt = small.withColumn("bin", F.pmod(F.xxhash64("tm", "td"), F.lit(bins)))
    return dealt.groupBy("bin").applyInPandas(run, "m long, d long, a long, b long")


def _few(df: DataFrame, most: int) -> DataFrame:
    """`df`, stored, and broadcast where it has at most `most` rows."""
    df = stored(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def subtree_sums(nodes: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """(m, d, n_leaves, saved_tokens) of every node's subtree."""
    root = nodes.where("d = 0").select(F.col("m").alias("tm"), F.col("d").alias("td"))
    state = nodes.select("m", "d", "pm", "weight", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved")
    large = stored(state.join(F.broadcast(root), F.lit(True)))  # one component
    n_nodes = large.count()
    comp, paths = ["tm", "td"], None
    sums, small = [], []
    while True:
        sizes = large.groupBy(*comp).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("whole"))
        # Fewer than n_nodes / LOCAL of them.
        split = stored(sizes.where(F.col("n") > LOCAL))
        few = split.count() <= 200_000
        side = (lambda df: F.broadcast(df)) if few else (lambda df: df)
        small.append(large.join(side(split.select(*comp)), comp, "left_anti"))
        if split.isEmpty():
            break
        if paths is None:
            # The nodes along every conversation that names one: (c, d, o, po).
            naming = nodes.select(F.col("m").alias("c")).distinct()
            along = rows.select("c", *_KEY).join(naming, "c", "left_semi")
            named = nodes.select(*_KEY, F.col("m").alias("o"), F.col("pm").alias("po"), "n_convs")
            paths = stored(_split_join(along, named, _KEY, "n_convs", total).select("c", "d", "o", "po"))
        inside = large.join(side(split), comp)
        best = inside.where("2 * weight > whole").groupBy(*comp).agg(F.max_by(F.struct("m", "d", "weight"), "d").alias("x"))
        centroid = side(stored(best.select(*comp, F.col("x.m").alias("cm"), F.col("x.d").alias("cd"), F.col("x.weight").alias("cw"))))
        # Conversations that go on below a centroid, and the branch they take.
        branch = paths.join(centroid.select(*comp, "cm", "cd"), (F.col("po") == F.col("cm")) & (F.col("d") == F.col("cd") + 1)).select(
            *comp, F.col("c").alias("m"), F.col("o").alias("nm"), F.col("d").alias("nd"))
        placed = stored(inside.drop("n", "whole").join(centroid, comp).join(branch, [*comp, "m"], "left")
                        .withColumn("below", (F.col("d") > F.col("cd")) & F.col("nm").isNotNull())
                        .withColumn("is_c", (F.col("m") == F.col("cm")) & (F.col("d") == F.col("cd"))))
        side_sum = placed.where("below OR is_c").groupBy(*comp).agg(F.sum("leaf").alias("a"), F.sum("saved").alias("b"))
        found = side(stored(centroid.join(side_sum, comp)))
        path = stored(paths.join(found, (F.col("c") == F.col("cm")) & F.col("d").between(F.col("td"), F.col("cd"))).select(
            F.col("o").alias("m"), "d", "a", "b", "cw"))
        sums.append(path.select("m", "d", "a", "b"))
        left = placed.where("NOT is_c").join(path.select("m", "d", F.col("cw").alias("less")), ["m", "d"], "left")
        large = stored(left.select(
            "m", "d", "pm", (F.col("weight") - F.coalesce("less", F.lit(0))).alias("weight"), "leaf", "saved",
            F.when(F.col("below"), F.col("nm")).otherwise(F.col("tm")).alias("tm"),
            F.when(F.col("below"), F.col("nd")).otherwise(F.col("td")).alias("td")))
    rest = small[0]
    for s in small[1:]:
        rest = rest.unionByName(s)
    out = _local_sums(rest, n_nodes)
    for s in sums:
        out = out.unionByName(s)
    return out.groupBy("m", "d").agg(F.sum("a").alias("n_leaves"), F.sum("b").alias("saved_tokens"))


# ------------------------------------------------------------------- digests

def _id_pieces(ends: DataFrame) -> DataFrame:
    """(d, x1, x2, start, ids): the comma-joined ids of runs of up to IDS
    conversations of a node; rows come sorted."""
    def batches(it):
        open_key, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*open_key, ids[0])] + [pa.array([",".join(map(str, ids))])],
                                              names=[*_KEY, "start", "ids"])
        for b in it:
            for row in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if row[:3] != open_key or len(ids) == IDS:
                    if ids:
                        yield piece()
                    open_key, ids = row[:3], []
                ids.append(row[3])
        if ids:
            yield piece()

    return ends.orderBy(*_KEY, "c").mapInArrow(batches, "d long, x1 long, x2 long, start long, ids string")


def end_digests(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """(d, x1, x2, sha) of nodes at which several conversations end.  A
    node's ids pass one hash in order, as the digest is defined, in pieces; a
    task holds one batch of them at a time."""
    several = nodes.where("n_ends > 1").select(*_KEY, "n_convs")
    ends = _split_join(rows.where("d = size").select(*_KEY, "c"), several, _KEY, "n_convs", total).select(*_KEY, "c")

    def batches(it):
        open_key, sha = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in open_key] + [pa.array([sha.hexdigest()])], names=[*_KEY, "sha"])
        for b in it:
            for *key, ids in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if key != open_key:
                    if sha:
                        yield done()
                    open_key, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha:
            yield done()

    pieces = _id_pieces(ends).repartition(*_KEY).sortWithinPartitions(*_KEY, "start").select(*_KEY, "ids")
    return pieces.mapInArrow(batches, "d long, x1 long, x2 long, sha string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt_turns(conversations)
    rows = stored(prefixes(turns, convs))
    total = rows.count()
    nodes = stored(build(rows, total))
    sums = subtree_sums(nodes, rows, total)
    several = end_digests(rows, nodes, total)
    own = F.sha2(F.coalesce(F.col("one_end").cast("string"), F.lit("")), 256)
    return nodes.join(sums, ["m", "d"]).join(several, _KEY, "left").select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("pm").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", own).alias("ends_sha256"))
