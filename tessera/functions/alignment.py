"""METEOR's word alignment, and all Python-side scores of a pair in one function.

Words come as 64-bit hashes (`functions.lcs.token_hashes`), whole Arrow batches
at a time.
"""

from __future__ import annotations

from collections import Counter
from typing import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.lcs import edit_distance, lcs_length, token_hashes, token_masks

ALIGN_TYPE = T.StructType([T.StructField("m", T.LongType()), T.StructField("chunks", T.LongType())])
SCORES_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in ("lcs", "distance", "m", "chunks")])


def exact_alignment(h: Sequence, r: Sequence) -> tuple[int, int]:
    """Exact-stage alignment: walking the hypothesis from its end, each word
    takes the last still-free equal word of the reference (so the k-th-from-
    last occurrences pair up).  Returns (matches, chunks), chunks being runs
    adjacent on both sides in hypothesis order."""
    free: dict = {}
    for j, w in enumerate(r):
        free.setdefault(w, []).append(j)
    pairs = []
    for i in range(len(h) - 1, -1, -1):
        js = free.get(h[i])
        if js:
            pairs.append((i, js.pop()))
    pairs.reverse()
    chunks = 0
    prev = None
    for i, j in pairs:
        if prev is None or not (i == prev[0] + 1 and j == prev[1] + 1):
            chunks += 1
        prev = (i, j)
    return len(pairs), chunks


@F.pandas_udf(ALIGN_TYPE)
def _align_udf(h: pd.Series, r: pd.Series) -> pd.DataFrame:
    none = ()
    rows = [exact_alignment(none if a is None else a.tolist(), none if b is None else b.tolist()) for a, b in zip(h, r)]
    return pd.DataFrame(rows, columns=["m", "chunks"], dtype="int64")


def alignment(h: Column, r: Column) -> Column:
    """struct<m, chunks> of the exact-stage METEOR alignment of two arrays."""
    return _align_udf(token_hashes(h), token_hashes(r))


@F.pandas_udf(SCORES_TYPE)
def _scores_udf(h: pd.Series, r: pd.Series, hl: pd.Series, rl: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, x, y in zip(h, r, hl, rl):
        if a is None or b is None:
            rows.append((None,) * 4)
            continue
        a, b = a.tolist(), b.tolist()
        masks = token_masks(b)
        rows.append((lcs_length(a, b, masks), edit_distance(a, b, masks), *exact_alignment(x.tolist(), y.tolist())))
    return pd.DataFrame(rows, columns=["lcs", "distance", "m", "chunks"], dtype="Int64")


def pair_scores(h: Column, r: Column, h_lower: Column, r_lower: Column) -> Column:
    """struct<lcs, distance, m, chunks>: LCS and edit distance of the tokens, and
    the alignment of the lower-cased ones, in one pass over the pair."""
    return _scores_udf(token_hashes(h), token_hashes(r), token_hashes(h_lower), token_hashes(r_lower))


# ------------------------------------------------- staged, fewest chunks

BEAM = 64  # partial alignments that are followed at once


def _stage_needs(h, r, h_stem, r_stem) -> tuple[dict, dict]:
    """Matches that every alignment has: exact ones per word, then, of the words
    left over, stem matches per stem."""
    ch, cr = Counter(h), Counter(r)
    exact = {w: min(n, cr[w]) for w, n in ch.items() if w in cr}
    left: list[Counter] = [Counter(), Counter()]
    for side, count, words, stems in ((0, ch, h, h_stem), (1, cr, r, r_stem)):
        for w, s in dict(zip(words, stems)).items():
            left[side][s] += count[w] - exact.get(w, 0)
    return exact, {s: min(n, left[1][s]) for s, n in left[0].items() if min(n, left[1][s]) > 0}


def staged_alignment(h: Sequence, r: Sequence, h_stem: Sequence, r_stem: Sequence, beam: int = BEAM) -> tuple[int, int]:
    """(matches, chunks) of the alignment in two stages, equal words first and
    equal stems among those left over, that has the fewest chunks.

    The number of matches does not depend on the choice of partners, only the
    chunks do.  Hypothesis words are placed from left to right; what is left to
    place per word and stem keeps every partial alignment completable; the `beam`
    best of them go on (all of them, while there are no more): fewest chunks, then
    those that placed the word, then the lowest (used, last, to place).

    What is left of a word follows from the positions used, but for words whose
    stem is matched too; only those are counted in a state.  New states are made
    by rising chunks, as far as the beam takes them."""
    exact, stem = _stage_needs(h, r, h_stem, r_stem)
    total = sum(exact.values()) + sum(stem.values())
    if not total:
        return 0, 0
    place: dict = {}
    kin: dict = {}
    for j, (w, s) in enumerate(zip(r, r_stem)):
        place[w] = place.get(w, 0) | 1 << j
        kin.setdefault(s, []).append(j)
    ahead = Counter(h)          # occurrences from the current word on
    stem_of = dict(zip(h, h_stem)) if stem else {}
    counted = [w for w in exact if stem_of.get(w) in stem] if stem else []
    at = {("w", w): i for i, w in enumerate(counted)} | {("s", s): len(counted) + i for i, s in enumerate(stem)}
    members: dict = {s: [] for s in stem}
    for w in counted:
        members[stem_of[w]].append(at["w", w])
    stem_ahead = Counter(s for s in h_stem if s in stem)
    # chunks -> states (used, last partner, to place), each under its fewest chunks
    levels: dict = {0: {(0, -2, (*[exact[w] for w in counted], *stem.values()))}}
    for w, s in zip(h, h_stem):
        ahead[w] -= 1
        if s in stem:
            stem_ahead[s] -= 1
            after = _stem_step(levels, w, s, place, kin, r, at, members, ahead[w], stem_ahead[s])
        elif w in exact:
            after = _exact_step(levels, place[w], exact[w], ahead[w], beam)
        else:
            after = {c: [(used, -2, todo) for used, _, todo in states] for c, states in levels.items()}
        levels, seen = {}, set()
        for c in sorted(after):
            new = set(after[c]) - seen
            room = beam - len(seen)
            if len(new) > room:
                new = sorted(new, key=lambda x: (x[1] < 0, x))[:room]
            if new:
                levels[c] = new
                seen.update(new)
            if len(seen) >= beam:
                break
    return total, min(levels)


def _exact_step(levels: dict, here: int, most: int, ahead: int, beam: int) -> dict:
    """New states by chunks where a word has exact matches only: at `here`, `most`
    of them, with `ahead` more words to place.  Stops behind the chunks that fill
    the beam."""
    after: dict = {}
    open_: list = []  # states of the chunks before: every other partner begins a chunk
    distinct: set = set()
    for c in range(min(levels), max(levels) + 2):
        states = levels.get(c, ())
        out = after[c] = []
        for used, free, todo in open_:
            while free:
                bit = free & -free
                free ^= bit
                out.append((used | bit, bit.bit_length() - 1, todo))
        open_ = []
        for used, last, todo in states:
            taken = used & here
            left = most - taken.bit_count()
            if left <= ahead:
                out.append((used, -2, todo))
            if 0 < left <= ahead + 1:
                free = here ^ taken
                bit = 1 << last + 1 if last >= 0 else 0
                if free & bit:
                    out.append((used | bit, last + 1, todo))
                    free ^= bit
                open_.append((used, free, todo))
        distinct.update(out)
        if len(distinct) >= beam:
            break
    return after


def _stem_step(levels: dict, w, s, place: dict, kin: dict, r: Sequence, at: dict, members: dict, ahead: int, stem_ahead: int) -> dict:
    """New states by chunks where the word's stem is matched too."""
    after: dict = {}
    ew, es = at.get(("w", w)), at["s", s]

    def add(used, last, todo, chunks):
        """Only if what is still to be placed fits behind this word."""
        if ew is not None and todo[ew] > ahead:
            return
        if todo[es] + sum([todo[i] for i in members[s]]) > stem_ahead:
            return
        after.setdefault(chunks, []).append((used, last, todo))
    for chunks, states in levels.items():
        for used, last, todo in states:
            add(used, -2, todo, chunks)
            if ew is not None and todo[ew]:
                rest = todo[:ew] + (todo[ew] - 1,) + todo[ew + 1:]
                free = place[w] & ~used
                while free:
                    bit = free & -free
                    free ^= bit
                    j = bit.bit_length() - 1
                    add(used | bit, j, rest, chunks + (j != last + 1))
            if todo[es]:
                rest = todo[:es] + (todo[es] - 1,) + todo[es + 1:]
                for j in kin.get(s, ()):
                    v = at.get(("w", r[j]))
                    if used >> j & 1 or r[j] == w or v is not None and (place[r[j]] & ~used).bit_count() <= todo[v]:
                        continue  # taken, or kept for an equal word
                    add(used | 1 << j, j, rest, chunks + (j != last + 1))
    return after


@F.pandas_udf(ALIGN_TYPE)
def _staged_udf(h: pd.Series, r: pd.Series, hs: pd.Series, rs: pd.Series) -> pd.DataFrame:
    none = ()
    rows = [staged_alignment(*[none if x is None else x.tolist() for x in q]) for q in zip(h, r, hs, rs)]
    return pd.DataFrame(rows, columns=["m", "chunks"], dtype="int64")


def staged(h: Column, r: Column, h_stem: Column, r_stem: Column) -> Column:
    """struct<m, chunks> of the staged alignment of two arrays with their stems."""
    return _staged_udf(token_hashes(h), token_hashes(r), token_hashes(h_stem), token_hashes(r_stem))
