"""Byte-pair-encoding vocabulary learning and encoding (T4, T7 BPE path).

Learning runs on the word-type table `(word, n)` -- one row per distinct
pre-token with its corpus count -- never on the corpus itself: the corpus pass
is the single distributed aggregate `word_counts` (T3).  Merges come out exactly
as sequential BPE gives them, ties broken by (count desc, left, right).
`bpe_learner` holds the rounds, in which the driver follows many merges on what
lies round the best pairs.
"""

from __future__ import annotations

import heapq
import re
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.joins import bound_of, bounded
from tessera.functions.text import chars, code_point_char, regex_tokens
from tessera.operators.tokenize import ADDED_TOKENS, PRETOKEN_PATTERN, SPECIAL_TOKENS
from tessera.session import ensure_checkpoint_dir

CHECKPOINT_EVERY = 8


def _byte_code_point(b: Column) -> Column:
    printable = b.between(33, 126) | b.between(161, 172) | b.between(174, 255)
    below = F.least(b, F.lit(33)) + F.greatest(F.least(b, F.lit(161)) - 127, F.lit(0)) \
        + F.greatest(F.least(b, F.lit(174)) - 173, F.lit(0))
    return F.when(printable, b).otherwise(F.lit(256) + below)


def byte_symbols(word: Column) -> Column:
    """The byte-level alphabet symbols of a word's UTF-8 bytes."""
    hx = F.split(F.hex(F.encode(word, "UTF-8")), "(?<=\\G..)")
    return F.transform(F.filter(hx, lambda h: F.length(h) == 2),
                       lambda h: code_point_char(_byte_code_point(F.conv(h, 16, 10).cast("int"))))


def _byte_symbol_list() -> list[str]:
    """The same alphabet on the Python side, by byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


# Symbols of a word are kept as one string joined by this separator (a
# control character that no alphabet symbol contains), so a merge is a single
# JVM regex replacement instead of an array rebuild.
SEP = "\u0001"


def word_types(word_counts: DataFrame, byte_level: bool = False) -> DataFrame:
    """`(word, n)` -> `(word, n, syms)`; characters or byte-level symbols,
    joined by SEP."""
    sym = byte_symbols(F.col("word")) if byte_level else chars(F.col("word"))
    return word_counts.select("word", "n", F.array_join(sym, SEP).alias("syms"))


def symbols(syms: Column) -> Column:
    return F.split(syms, SEP, -1)


def pair_counts(types: DataFrame) -> DataFrame:
    """Adjacent symbol pairs weighted by word count: `(left, right, n)`.

    Pairs are pulled out by one regex pass (a zero-width match at every
    symbol start capturing `symbol SEP symbol` in a look-ahead), counted
    with partial aggregation, and split into (left, right) after the
    aggregate.  Sorting the joined key orders pairs as (left, right), since
    SEP sorts below every symbol character."""
    pat = f"(?:^|{SEP})(?=([^{SEP}]+{SEP}[^{SEP}]+))"
    ex = types.select("n", F.explode(F.regexp_extract_all("syms", F.lit(pat), 1)).alias("p"))
    agg = ex.groupBy("p").agg(F.sum("n").cast("long").alias("n"))
    return agg.select(F.substring_index("p", SEP, 1).alias("left"),
                      F.substring_index("p", SEP, -1).alias("right"), "n")


def _java_replacement(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def merge_pair(syms: Column, left: str, right: str) -> Column:
    """Merge every non-overlapping (left, right), scanning left to right: a
    regex whose look-arounds pin both symbols to whole-symbol boundaries."""
    return F.regexp_replace(syms, F.lit(_pair_pattern(left, right)), F.lit(_java_replacement(left + right)))


def _sequential_prefix(rows: Sequence, limit: int) -> list[tuple[str, str, int]]:
    """The pairs at the top of the ranking `rows` that sequential BPE would
    merge one after the other: those before the first that shares a symbol
    with an earlier one or pairs a symbol with itself (its runs make new pairs
    of their own), as far as they count strictly more than it (without such a
    pair: than the last row, beyond which nothing is known)."""
    used: set = set()
    end = len(rows)
    for i, r in enumerate(rows):
        if r["left"] == r["right"] or {r["left"], r["right"]} & used:
            end = i
            break
        used |= {r["left"], r["right"]}
    floor = rows[min(end, len(rows) - 1)]["n"]
    out = [(r["left"], r["right"], int(r["n"])) for r in rows[:end] if r["n"] > floor]
    if not out:
        r = rows[0]
        out = [(r["left"], r["right"], int(r["n"]))]
    return out[:limit]


def _pair_pattern(left: str, right: str) -> str:
    return f"(?<=^|{SEP}){re.escape(left)}{SEP}{re.escape(right)}(?={SEP}|$)"


def bpe_train(word_counts: DataFrame, n_merges: int, byte_level: bool = False,
              merges_per_round: int = 64, min_count: int = 1, incremental: bool = True) -> DataFrame:
    """T4: learn up to `n_merges` merges (vocabulary size less the alphabet and
    added tokens); returns `(rank, left, right, n)`.  `merges_per_round` says how
    many pairs the first round asks for, without `incremental` how many a round
    may take; the result does not depend on it.

    incremental=True learns in rounds of many merges (`bpe_learner`).
    incremental=False counts all pairs anew each round, a plain form for small
    sizes: several of the best pairs at once where that is provably the same
    (see `_sequential_prefix`)."""
    spark = word_counts.sparkSession
    if incremental:
        from tessera.operators.bpe_learner import Learner
        letters = np.array([ord(c) for c in _byte_symbol_list()], dtype=np.int32) if byte_level else None
        merges = Learner(word_counts.select("word", "n"), letters, min_count, merges_per_round).learn(n_merges)
    else:
        merges = _recounted_merges(word_types(word_counts, byte_level), n_merges, merges_per_round, min_count)
    rows = [(i, l, r, n) for i, (l, r, n) in enumerate(merges)]
    return bounded(spark.createDataFrame(rows, "rank int, left string, right string, n long"), len(rows))


def _recounted_merges(types: DataFrame, n_merges: int, merges_per_round: int, min_count: int) -> list[tuple[str, str, int]]:
    ensure_checkpoint_dir(types.sparkSession)
    types = types.checkpoint(eager=True)
    merges: list[tuple[str, str, int]] = []
    rounds = 0
    while len(merges) < n_merges:
        want = min(merges_per_round, n_merges - len(merges))
        # Candidates for a round: the best few pairs, ordered by count then pair.
        cand = pair_counts(types).filter(F.col("n") >= min_count) \
            .orderBy(F.col("n").desc(), "left", "right").limit(want + 1).collect()
        if not cand:
            break
        picked = _sequential_prefix(cand, want)
        sym = F.col("syms")
        for left, right, _ in picked:
            sym = merge_pair(sym, left, right)
        types = types.select("word", "n", sym.alias("syms"))
        merges.extend(picked)
        rounds += 1
        if rounds % CHECKPOINT_EVERY == 0:
            types = types.checkpoint(eager=True)
    return merges


def bpe_vocab(alphabet: DataFrame, merges: DataFrame) -> DataFrame:
    """Vocabulary: alphabet symbols (ids by symbol order), then one id per
    merge in rank order, then the added tokens."""
    from pyspark.sql import Window
    base = alphabet.select(F.col("symbol").alias("token")).distinct()
    base = base.select("token", (F.row_number().over(Window.orderBy("token")) - 1).cast("int").alias("token_id"))
    nb = base.agg(F.count("*").alias("nb"))
    m = merges.crossJoin(nb).select(F.concat("left", "right").alias("token"),
                                    (F.col("nb") + F.col("rank")).cast("int").alias("token_id"))
    vocab = base.unionByName(m).withColumn("special", F.lit(False))
    mb = bound_of(merges)
    vocab = bounded(vocab, None if mb is None else 256 + mb)
    from tessera.operators.tokenize import with_added_tokens
    return with_added_tokens(vocab, SPECIAL_TOKENS, ADDED_TOKENS)


def _apply_merges(symbols: list, ranks: dict) -> list:
    """Standard BPE encoding of one word: again and again the adjacent pair of
    the lowest merge rank, the leftmost first, becomes one symbol.  The word is
    a linked list, its pairs lie in a heap: O(n log n)."""
    sym, n = list(symbols), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(sym, sym[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if sym[i] != left or j >= n or sym[j] != right:
            continue  # one of the two has been merged since
        sym[i], sym[j] = left + right, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (sym[i], sym[k]) in ranks:
                heapq.heappush(heap, (ranks[sym[i], sym[k]], i, sym[i], sym[k]))
        h = before[i]
        if h >= 0 and (sym[h], sym[i]) in ranks:
            heapq.heappush(heap, (ranks[sym[h], sym[i]], h, sym[h], sym[i]))
    return [s for s in sym if s is not None]


WORD_CACHE = 100_000  # words whose ids a worker keeps


def _pieces(text: Column, pattern: str, added: Sequence[str]) -> Column:
    """Pre-tokens; added tokens are cut out first and stay whole."""
    cut = "|".join(f"(?<={re.escape(t)})|(?={re.escape(t)})" for t in added)
    parts = F.split(text, cut, -1) if cut else F.array(text)
    split = F.transform(parts, lambda p: F.when(p.isin(*added), F.array(p)).otherwise(regex_tokens(p, pattern)) if added
                        else regex_tokens(p, pattern))
    return F.flatten(split)


def bpe_encode(df: DataFrame, key: Sequence[str], text: str, merges: DataFrame, vocab: DataFrame,
               pattern: str = PRETOKEN_PATTERN, max_len: int | None = None,
               added: Sequence[str] = SPECIAL_TOKENS + ADDED_TOKENS) -> DataFrame:
    """T7, T9 (BPE path): pre-tokenize natively, then apply the merges to each
    distinct word once per worker (a bounded cache), with the merge table
    broadcast (its size is the requested vocabulary size).  A symbol that the
    vocabulary lacks is an error.  Returns `input_ids` per row, cut to
    `max_len`; labels are the same over the framed target."""
    spark = df.sparkSession
    k = list(key)
    rank_rows = merges.select("rank", "left", "right").collect()  # bounded by the vocabulary size
    ranks = spark.sparkContext.broadcast({(r["left"], r["right"]): r["rank"] for r in rank_rows})
    tok_rows = vocab.select("token", "token_id").collect()        # bounded likewise
    ids = spark.sparkContext.broadcast({r["token"]: r["token_id"] for r in tok_rows})
    pieces = df.select(*k, _pieces(F.col(text), pattern, added).alias("_pieces"))
    schema = pieces.select(*k).schema.add("input_ids", T.ArrayType(T.IntegerType()))
    whole = frozenset(added)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rk, tid = ranks.value, ids.value
        sym = _byte_symbol_list()
        known: dict[str, list[int]] = {}

        def encode(word: str) -> list[int]:
            if word in whole:
                return [tid[word]]
            return [tid[s] for s in _apply_merges([sym[b] for b in word.encode()], rk)]

        for pdf in batches:
            out_ids = []
            for words in pdf["_pieces"]:
                row: list[int] = []
                for w in (words if words is not None else []):
                    if w not in known:
                        if len(known) >= WORD_CACHE:
                            known.clear()
                        known[w] = encode(w)
                    row += known[w]
                out_ids.append(row[:max_len] if max_len else row)
            out = pdf[k].copy()
            out["input_ids"] = out_ids
            yield out
    return pieces.mapInPandas(run, schema)


def bpe_decode(df: DataFrame, key: Sequence[str], vocab: DataFrame, ids: str = "input_ids", skip_special: bool = False) -> DataFrame:
    """T11 (BPE path): ids back to text.  Byte symbols become bytes, added
    tokens their own text; `skip_special` leaves the special tokens out.
    Returns `decoded` per row."""
    k = list(key)
    rows = vocab.select("token_id", "token", "special").collect()  # bounded by the vocabulary size
    added = set(SPECIAL_TOKENS + ADDED_TOKENS)
    byte_of = {c: b for b, c in enumerate(_byte_symbol_list())}
    table = {r["token_id"]: (b"" if skip_special and r["special"] else r["token"].encode()) if r["token"] in added
             else bytes(byte_of[c] for c in r["token"]) for r in rows}
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def decode(col: pd.Series) -> pd.Series:
        t = shared.value
        return col.map(lambda xs: None if xs is None else b"".join([t[x] for x in xs]).decode(errors="replace"))

    return df.select(*k, decode(F.col(ids)).alias("decoded"))
