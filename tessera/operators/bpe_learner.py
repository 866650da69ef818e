"""Byte-pair merges up to the full vocabulary size (T4).

The word types are dealt into shards: rows of a stored table that hold the
words' symbols as one array of numbers.  A round is a job or two, whatever it
merges; no worker keeps anything between them:

* The best pairs are asked for.  Every shard cuts out of its words what lies
  round an occurrence of one of them, with one more symbol on both sides; equal
  cuttings are added up, in the shard, then by a shuffle.  The driver gets FETCH
  cuttings or so; how many pairs a round asks for follows from that.
* The driver follows the merges on the cuttings, exactly as sequential BPE makes
  them (ties broken by count desc, left, right), for as long as the best pair is
  one whose occurrences it has all seen, with both neighbours: an asked one, or
  one made in this round.
* The shards take these merges, each word its lowest first, and are stored anew;
  words of one symbol go.

The cuttings of a word do not overlap, so what a merge changes is counted once.

The driver holds a pool: exact global counts of the pairs that rank above a
bound (POOL of them at most, taken by a histogram of counts; trimmed when new ones
have made it twice as large, at the end of a round).  A pair outside the pool can only lose occurrences, so it cannot come first as long as the best
pair of the pool ranks above the bound; else the pool is filled anew.  A merge
whose result is a symbol that was there before can raise old pairs: it ends its
round, and their counts are asked for again.

What is sent in a round is bounded by POOL, FETCH and the number of symbols; one
pair alone is followed whatever the number of its cuttings.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

POOL = 200_000
FETCH = 100_000
REBASE = 1   # merges after which the shards are stored anew, at the end of a round
SHARD_WORDS = 50_000

_LEFT, _RIGHT = -1, -2  # in a cutting: the word goes on there


def merged(word: list, a: int, b: int, new: int) -> list:
    """`word` with every non-overlapping (a, b), from the left, replaced."""
    out, i, n = [], 0, len(word)
    while i < n:
        if word[i] == a and i + 1 < n and word[i + 1] == b:
            out.append(new)
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


class Cuttings:
    """Parts of words with their counts and the index of their pairs."""

    def __init__(self, words: list, times: list):
        self.words, self.times = words, times
        self.index: dict = defaultdict(set)
        for i, w in enumerate(words):
            for p in zip(w, w[1:]):
                self.index[p].add(i)

    def whole(self, a: int, b: int) -> bool:
        """Whether both neighbours of all (a, b) are there."""
        for i in self.index.get((a, b), ()):
            w = self.words[i]
            if w[0] == _LEFT and w[1] == a and w[2] == b or w[-1] == _RIGHT and w[-3] == a and w[-2] == b:
                return False
        return True

    def merge(self, a: int, b: int, new: int) -> dict:
        """Merges (a, b); what the counts of pairs gain or lose."""
        change: dict = defaultdict(int)
        for i in self.index.pop((a, b), ()):
            old, n = self.words[i], self.times[i]
            word = self.words[i] = merged(old, a, b, new)
            before, after = list(zip(old, old[1:])), list(zip(word, word[1:]))
            for p in before:
                change[p] -= n
            for p in after:
                change[p] += n
            here, there = set(after), set(before)
            for p in here - there:
                self.index[p].add(i)
            for p in there - here:
                if p in self.index:
                    self.index[p].discard(i)
        return {p: n for p, n in change.items() if n}


class Pairs:
    """Pairs of symbols by their place in a list."""

    def __init__(self, pairs: list):
        both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        codes = both[:, 0] << 32 | both[:, 1]
        self.rank = np.argsort(codes)
        self.codes = codes[self.rank]
        self.left, self.right = (np.zeros(int(both.max(initial=0)) + 1, bool) for _ in range(2))
        self.left[both[:, 0]] = self.right[both[:, 1]] = True

    def find(self, sym: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, place) of the pairs in `sym`; `last` marks the ends of words."""
        more = int(sym.max(initial=0)) + 1 - len(self.left)
        if more > 0:
            self.left, self.right = np.pad(self.left, (0, more)), np.pad(self.right, (0, more))
        at = np.flatnonzero(self.left[sym[:-1]] & self.right[sym[1:]] & ~last[:-1])
        code = sym[at].astype(np.int64) << 32 | sym[at + 1]
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        ok = self.codes[place] == code
        return at[ok], self.rank[place[ok]]


class Shard:
    """Words as one array of symbols, with their lengths and counts."""

    def __init__(self, sym: np.ndarray, many: np.ndarray, times: np.ndarray):
        self.sym, self.many, self.times = sym, many, times

    def _ends(self) -> np.ndarray:
        last = np.zeros(len(self.sym), bool)
        last[np.cumsum(self.many) - 1] = True
        return last

    def pairs(self) -> pa.Table:
        """(a, b, n) of all pairs."""
        at = np.flatnonzero(~self._ends())
        n = np.repeat(self.times, self.many - 1)
        rows = pa.table({"a": self.sym[at], "b": self.sym[at + 1], "n": n})
        return rows.group_by(["a", "b"]).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])

    def merge(self, merges: list) -> "Shard":
        """After `merges`, one after the other; without words of one symbol."""
        if not merges or not len(self.sym):
            return self
        table, new = Pairs([m[:2] for m in merges]), np.array([m[2] for m in merges], dtype=np.int32)
        sym, word = self.sym.copy(), np.repeat(np.arange(len(self.many)), self.many)
        floor = np.full(len(self.many), -1, dtype=np.int64)  # last merge done on a word
        live, last = np.arange(len(sym)), self._ends()
        while len(live) > 1:
            at, rank = table.find(sym[live], last)
            on = word[live[at]]
            ok = rank > floor[on]
            at, rank, on = at[ok], rank[ok], on[ok]
            if not len(at):
                break
            first = np.flatnonzero(np.diff(on, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            floor[on[first]] = best
            lowest = rank == np.repeat(best, np.diff(first, append=len(on)))
            at, rank = at[lowest], rank[lowest]
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of one symbol: every other pair
            take = (np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0
            at, rank = at[take], rank[take]
            sym[live[at]], sym[live[at + 1]] = new[rank], -1
            touched = np.zeros(len(self.many), bool)
            touched[on[first]] = True
            live = live[touched[word[live]] & (sym[live] >= 0)]
            last = np.diff(word[live], append=-1) != 0
        many = np.bincount(word[sym >= 0], minlength=len(self.many))
        return Shard(sym[sym >= 0], many, self.times).long()

    def long(self) -> "Shard":
        """Without words of one symbol."""
        keep = self.many > 1
        return Shard(self.sym[np.repeat(keep, self.many)], self.many[keep], self.times[keep])

    def cuttings(self, table: Pairs) -> pa.Table:
        """(part, n): what lies round the pairs; a part is a number that tells which
        sides are open (1 left, 2 right) and the symbols."""
        last = self._ends()
        start = np.roll(last, 1)
        keep = np.zeros(len(self.sym), bool)
        at = table.find(self.sym, last)[0] if len(self.sym) > 1 else np.empty(0, dtype=np.int64)
        keep[at] = keep[at + 1] = True
        before, after = keep[:-1] & ~last[:-1], keep[1:] & ~last[:-1]
        keep[1:] |= before
        keep[:-1] |= after
        begin = np.flatnonzero(keep & (start | ~np.roll(keep, 1)))
        end = np.flatnonzero(keep & (last | ~np.roll(keep, -1))) + 1
        size = end - begin + 1
        head = np.cumsum(size) - size
        parts = np.empty(int(size.sum()), dtype=np.int32)
        parts[head] = ~start[begin] + 2 * ~last[end - 1]
        inner = np.ones(len(parts), bool)
        inner[head] = False
        parts[inner] = self.sym[keep]
        offsets = np.append(head, len(parts)) * 4
        part = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(parts)])
        n = self.times[np.searchsorted(np.cumsum(self.many), begin, side="right")]
        rows = pa.table({"part": part, "n": n}).group_by("part").aggregate([("n", "sum")])
        return pa.table({"part": rows["part"].cast(pa.binary()), "n": rows["n_sum"]})

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"sym": [self.sym.astype("<i4").tobytes()], "many": [self.many.astype("<i4").tobytes()],
                                           "times": [self.times.astype("<i8").tobytes()]})


_SHARD_ROWS = "sym binary, many binary, times binary"


def _shards(types: DataFrame, letters: np.ndarray | None) -> DataFrame:
    """Rows of shards of (word, n): a word's code points or, with `letters`, the
    code point that stands for each of its bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            words = batch.column("word")
            if letters is None:
                sym = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype="<i4")
                many = pc.utf8_length(words)
            else:
                sym = letters[np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), dtype=np.uint8)]
                many = pc.binary_length(words)
            held.append((sym, many.to_numpy(zero_copy_only=False).astype(np.int32),
                         batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)))
            if sum(len(h[2]) for h in held) >= SHARD_WORDS:
                yield Shard(*map(np.concatenate, zip(*held))).long().row()
                held = []
        if held:
            yield Shard(*map(np.concatenate, zip(*held))).long().row()

    return types.mapInArrow(pack, _SHARD_ROWS)


class Learner:
    def __init__(self, types: DataFrame, letters: np.ndarray | None, min_count: int, merges_per_round: int):
        self.spark = types.sparkSession
        self.folder = f"{ensure_checkpoint_dir(self.spark)}/bpe-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.merges: list[tuple[int, int, int]] = []  # (a, b, new)
        self.counts: list[int] = []
        self.based = 0
        slots = self.spark.sparkContext.defaultParallelism
        types = types.where("length(word) > 0").repartition(slots)  # a file each, whatever the counting left
        self.stored = self._store(_shards(types, letters))
        found = self._run(lambda s: pa.table({"c": np.unique(s.sym)}), "c int").distinct().collect()  # bounded by the alphabet
        points = sorted(r[0] for r in found)
        self.symbols = [chr(c) for c in points]
        self.number = {s: i for i, s in enumerate(self.symbols)}
        self.stored = self._store(self._run(lambda s: Shard(np.searchsorted(points, s.sym).astype(np.int32), s.many, s.times).row(), _SHARD_ROWS))
        self.min_count, self.asking = min_count, max(1, merges_per_round)
        self.pool: dict = {}
        self.heap: list = []
        self.bound: tuple | None = None

    # ------------------------------------------------------------ shard jobs

    def _store(self, df: DataFrame) -> DataFrame:
        """`df` as a table of the shared folder; the tables before it go."""
        path = f"{self.folder}-{len(self.paths)}"
        df.write.parquet(path)
        self._drop()
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _drop(self) -> None:
        for p in self.paths[-1:]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _run(self, work, schema: str) -> DataFrame:
        """The tables or batches that `work(shard)` gives, on every shard after all merges so far."""
        shared = self.spark.sparkContext.broadcast(self.merges[self.based:])
        names = [f.split()[0] for f in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("sym", "many", "times"))):
                    arrays = [np.frombuffer(x.as_buffer(), dtype=t) for x, t in zip(row, ("<i4", "<i4", "<i8"))]
                    out = work(Shard(*arrays).merge(shared.value))
                    yield from out.select(names).to_batches() if isinstance(out, pa.Table) else [out]
        return self.stored.mapInArrow(run, schema)

    def _rebase(self) -> None:
        """Stored rows with all merges applied."""
        self.stored = self._store(self._run(Shard.row, _SHARD_ROWS))
        self.based = len(self.merges)

    def _pair_counts(self) -> DataFrame:
        rows = self._run(Shard.pairs, "a int, b int, n long")
        return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))

    # ------------------------------------------------------------------ pool

    def _key(self, p: tuple, n: int) -> tuple:
        return (-n, self.symbols[p[0]], self.symbols[p[1]])

    def _put(self, p: tuple, n: int) -> None:
        key = self._key(p, n)
        if n < self.min_count or (self.bound is not None and key[:2] > self.bound):
            self.pool.pop(p, None)
        else:
            self.pool[p] = n
            heapq.heappush(self.heap, (*key, p))

    def _fill(self) -> None:
        """The best pairs, POOL of them at most (more only where one left
        symbol alone has more at the last count): a histogram of counts gives
        the last count, one of left symbols at that count the last symbol."""
        least = self.min_count
        pairs = self._pair_counts().where(F.col("n") >= least).checkpoint(eager=True)
        level = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log2("n") * 64)).cast("long")  # some thousands
        total, last = 0, None
        for r in sorted(pairs.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
            if total + r["count"] > POOL:
                last = r["level"]
                break
            total += r["count"]
        if last is None:
            kept, self.bound = pairs, None
        elif last >= 4096:
            kept = pairs.where(level > last) if total else pairs.where(level >= last)
            self.bound = (-int(kept.agg(F.min("n")).first()[0]), chr(0x10FFFF))
        else:
            by_left = {r["a"]: r["count"] for r in pairs.where(level == last).groupBy("a").count().collect()}
            taken, room = [], POOL - total
            for a in sorted(by_left, key=lambda x: self.symbols[x]):
                if taken and by_left[a] > room:
                    break
                taken.append(a)
                room -= by_left[a]
            left = self.spark.createDataFrame([(a,) for a in taken], "a int")
            kept = pairs.where(level > last).unionByName(pairs.where(level == last).join(F.broadcast(left), "a").select("a", "b", "n"))
            self.bound = (-last, self.symbols[taken[-1]])
        self.pool = {(r["a"], r["b"]): r["n"] for r in kept.collect()}
        self.heap = [(*self._key(p, n), p) for p, n in self.pool.items()]
        heapq.heapify(self.heap)

    def _trim(self) -> None:
        """The best POOL pairs stay, once new ones have made the pool twice as large."""
        if len(self.pool) > 2 * POOL or len(self.heap) > 8 * POOL:
            keys = sorted((*self._key(p, n), p) for p, n in self.pool.items())
            if len(keys) > POOL:
                self.bound = keys[POOL - 1][:2]
            self.heap = [k for k in keys if self.bound is None or k[:2] <= self.bound]  # sorted: a heap
            self.pool = {k[3]: -k[0] for k in self.heap}

    def _pop(self) -> tuple | None:
        while self.heap:
            n, _, _, p = heapq.heappop(self.heap)
            if self.pool.get(p) == -n:
                return p
        return None

    def _top(self, most: int) -> list:
        """Up to `most` best pairs, in order."""
        out, seen = [], set()
        while len(out) < most:
            p = self._pop()
            if p is None:
                break
            if p not in seen:
                seen.add(p)
                out.append(p)
        for p in out:
            heapq.heappush(self.heap, (*self._key(p, self.pool[p]), p))
        return out

    # ---------------------------------------------------------------- rounds

    def _symbol(self, p: tuple) -> tuple[int, bool]:
        """Number of the merged symbol, and whether it was there before."""
        text = self.symbols[p[0]] + self.symbols[p[1]]
        if text in self.number:
            return self.number[text], True
        self.number[text] = len(self.symbols)
        self.symbols.append(text)
        return self.number[text], False

    def _record(self, p: tuple, n: int) -> bool:
        new, old = self._symbol(p)
        self.merges.append((*p, new))
        self.counts.append(n)
        self.pool.pop(p, None)
        return old

    def _recount(self, symbol: int) -> None:
        """Exact counts of the pairs that hold a symbol."""
        rows = self._pair_counts().where((F.col("a") == symbol) | (F.col("b") == symbol)).collect()  # twice the symbols at most
        for p in [p for p in self.pool if symbol in p]:
            del self.pool[p]
        for a, b, n in rows:
            self._put((a, b), n)

    def _fetch(self) -> tuple[set, Cuttings]:
        """The next pairs to follow, as many as FETCH allows, and their cuttings."""
        while True:
            ask = self._top(self.asking)
            table = Pairs(ask)
            parts = self._run(lambda s: s.cuttings(table), "part binary, n long").groupBy("part").agg(F.sum("n").alias("n"))
            rows = (parts.limit(2 * FETCH + 1) if len(ask) > 1 else parts).toArrow()
            if rows.num_rows <= 2 * FETCH or len(ask) == 1:
                break
            self.asking = max(1, len(ask) // 4)
        self.asking = int(min(max(len(ask) * min(FETCH / max(rows.num_rows, 1), 2), 1), POOL))
        words = []
        for part in rows["part"].to_pylist():
            side, *word = np.frombuffer(part, dtype="<i4").tolist()
            words.append([_LEFT] * (side & 1) + word + [_RIGHT] * (side >> 1))
        return set(ask), Cuttings(words, rows["n"].to_pylist())

    def _round(self, want: int) -> None:
        """Follows the merges as far as the cuttings of the next pairs tell them."""
        asked, local = self._fetch()
        while want:
            p = self._pop()
            if p is None:
                return
            n = self.pool[p]
            if p not in asked or not local.whole(*p):
                heapq.heappush(self.heap, (*self._key(p, n), p))
                return
            old = self._record(p, n)
            new = self.merges[-1][2]
            change = local.merge(*self.merges[-1])
            want -= 1
            for q, m in change.items():
                if q in self.pool:
                    self._put(q, self.pool[q] + m)
                elif m > 0 and new in q and not old:
                    asked.add(q)  # all its occurrences are in the cuttings
                    self._put(q, m)
            if old:
                self._recount(new)  # shards apply the merges so far first
                return

    def learn(self, n_merges: int) -> list[tuple[str, str, int]]:
        self._fill()
        while len(self.merges) < n_merges:
            top = self._top(1)
            if not top or (self.bound is not None and self._key(top[0], self.pool[top[0]])[:2] > self.bound):
                if self.bound is None:
                    break
                self._fill()
                if not self.pool:
                    break
                continue
            self._round(n_merges - len(self.merges))
            self._trim()
            if len(self.merges) - self.based >= REBASE:
                self._rebase()
        self._drop()
        return [(self.symbols[a], self.symbols[b], n) for (a, b, _), n in zip(self.merges, self.counts)]
