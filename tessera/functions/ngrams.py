"""Clipped n-gram statistics of (hypothesis, reference) pairs, in the JVM.

The statistics of a pair depend on that pair only, so they need no shuffle; all
is built-in array work on 64-bit hashes, so they need no Python either.

Spark has no multiset intersection.  Here both sides' n-gram hashes, shifted by
one bit that tells the side, are sorted together: equal n-grams then stand in one
run, hypothesis first.  The k-th occurrence on one side meets the k-th on the
other, so a hypothesis run followed by a reference run of the same n-gram gives
as many matches as the shorter of the two has members.  Only a few numbers per
pair and order go on to the aggregate.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import chars


def with_ngram_stats(df: DataFrame, hyp: Column, ref: Column, orders: Sequence[int], name: str,
                     char_level: bool = False) -> DataFrame:
    """`df` with `{name}{n}`: struct<m, th, tr> for every order n (1 and on): the
    clipped matches and each side's n-grams.  `hyp` and `ref` are token arrays, or
    strings when `char_level`.  Null arrays give null structs.

    Every step is a column of its own: a lambda that refers to an expression would
    evaluate it once per element."""
    keep = list(df.columns)
    orders = list(orders)
    top = max(orders)
    each = (lambda c: chars(c)) if char_level else (lambda c: c)
    t = df.select(*keep, *[F.transform(each(c), lambda x: F.xxhash64(x)).alias(f"{s}1") for s, c in (("_h", hyp), ("_r", ref))])
    for n in range(2, top + 1):  # an n-gram's hash: that of the one before, and the next token
        longer = [F.when(F.size(f"{s}{n - 1}") > 1, F.zip_with(F.slice(f"{s}{n - 1}", 1, F.size(f"{s}{n - 1}") - 1), F.slice(f"{s}1", n, F.size(f"{s}1")),
                                                              lambda a, b: F.xxhash64(a, b)))
                  .otherwise(F.slice(f"{s}{n - 1}", 1, 0)).alias(f"{s}{n}") for s in ("_h", "_r")]
        t = t.select("*", *longer)
    both = [F.sort_array(F.concat(F.transform(f"_h{n}", lambda x: F.shiftleft(x, 1)),
                                  F.transform(f"_r{n}", lambda x: F.shiftleft(x, 1).bitwiseOR(F.lit(1))))).alias(f"_s{n}") for n in orders]
    t = t.select(*keep, *[F.size(f"{s}{n}").cast("long").alias(f"{s}{n}") for n in orders for s in ("_h", "_r")], *both)

    def matches(n: int) -> Column:
        s = F.col(f"_s{n}")
        # From each member to the next: 0 the same, 1 from a hypothesis run to
        # the reference run of the same n-gram, else 2.
        mark = lambda a, b: F.when(a == b, 0).when((b - 1 == a) & (a.bitwiseAND(F.lit(1)) == 0), 1).otherwise(2)
        marks = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), mark)
        whole, side = 1 << 32, 1

        def step(state, m):
            """state: matches << 32 | members still to be met << 1 | reference side."""
            left = state.bitwiseAND(F.lit(whole - 2))
            again = F.when(state.bitwiseAND(F.lit(side)) == 0, state + 2).when(left > 0, state + (whole - 2)).otherwise(state)
            return F.when(m == 2, F.shiftleft(F.shiftright(state, 32), 32)).when(m == 1, state + (whole + side)).otherwise(again)
        return F.when(F.size(s) > 1, F.shiftright(F.aggregate(marks, F.lit(0).cast("long"), step), 32)).otherwise(F.lit(0).cast("long"))

    out = [F.when(F.col(f"_h{n}").isNotNull() & F.col(f"_r{n}").isNotNull(),
                  F.struct(matches(n).alias("m"), F.col(f"_h{n}").alias("th"), F.col(f"_r{n}").alias("tr"))).alias(f"{name}{n}") for n in orders]
    return t.select(*keep, *out)
