"""Operator 7: line dedup by an exact set-similarity join, in DataFrame
operations only.

A line (text between \\n) is the set of its distinct 5-word shingles, words
`[^\\x20\\x09-\\x0D]+` after lower-casing, compared as 64-bit hashes (every
word is hashed once, a shingle from the hashes of its words); lines of fewer
than 5 words are left alone.  Two lines match when the Jaccard
similarity of their sets is at least 0.8.  Lines are ordered by (document id,
line number); a line that matches any earlier one is removed, whether that one
stays or not.

Lines with the same words form a class, of which the first stays.  For the
others, the tokens of every class are ordered by rarity: first those that are
never frequent, then the frequent ones by their counts, ties by hash.  Matching
lines share a token among the first n - ceil(0.8 n) + 1 (prefix filter); what
remains behind the shared token must still reach the overlap (positional
filter) and the sizes must be close (length filter).  Candidates are verified
on the whole sets.

A passage that many classes hold shows in their first tokens by hash: classes
whose first token is common count all their tokens, those of more than
`FREQUENT` are the frequent ones, and every class with one in its prefix gets
its prefix anew.  Candidates come in two rounds, since one earlier match is
enough: first every class against the earliest of each of its buckets, then
only classes without a match so far against all earlier ones that share as
many prefix tokens as matching sets must.

Null and empty texts have no lines to remove and stay as they are.  Repeated
rows of a document are dealt with as one: of equal (id, line number) the lines
are equal too, and stay or go together.  Rows without an id, and rows of one id
with different texts, are texts of their own; those without an id come first.
Extra columns stay; names that begin with `line_dedup_` are reserved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, scratch, stored, with_ids, without_ids
from tessera.operators.ordering import with_row_index

WORDS = 5
PERCENT = 80
FREQUENT = 32
LINE_BITS = 26  # of the number of a line in its text, in the one number that stands for a line
_OWN = "line_dedup_"  # begins the names of columns that are added to a caller's


def _shingles(hashes: Column, size: int) -> Column:
    """Distinct hashes of the runs of `size` words, sorted, from the hashes of
    the words; none if there are fewer words."""
    each = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(F.size(hashes) >= size, F.sort_array(F.array_distinct(each))).otherwise(F.array().cast("array<bigint>"))


def _prefix(n: Column, percent: int) -> Column:
    return F.when(n > 0, n - F.ceil(n * percent / 100) + 1).otherwise(0).cast("int")


def _at() -> Column:
    line = F.when(F.col("line") < 1 << LINE_BITS, F.col("line")).otherwise(F.raise_error(F.lit("too many lines in one text")))
    return F.shiftleft("id", LINE_BITS) + line


def _lines(docs: DataFrame) -> DataFrame:
    """(id, line, text) of all lines."""
    return docs.select("id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def _words(line: Column) -> Column:
    """The words of a line in lower case; white space other than blanks is a blank."""
    low, rare = F.lower(line), "\t\x0b\x0c\r"
    odd = reduce(lambda x, y: x | y, [line.contains(c) for c in rare])
    return F.array_remove(F.split(F.when(odd, F.translate(low, rare, " " * len(rare))).otherwise(low), " "), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _sets(docs: DataFrame, at: DataFrame, size: int) -> DataFrame:
    """(at, tokens) of the lines in `at`."""
    at = stored(at.distinct())
    lines = _lines(with_ids(docs, at.select(F.shiftright("at", LINE_BITS).alias("id")), "id")).select(_at().alias("at"), "text")
    lines = with_ids(lines, at, "at").select("at", _hashes(_words(F.col("text"))).alias("hashes"))
    return stored(lines.select("at", _shingles(F.col("hashes"), size).alias("tokens")))


def _prefix_rows(sets: DataFrame) -> DataFrame:
    """A row for each prefix token: (at, n, pos, token)."""
    return sets.select("at", "n", F.posexplode("prefix").alias("pos", "token"))


def _by_rarity(docs: DataFrame, sets: DataFrame, size: int, percent: int, frequent: int) -> DataFrame:
    """Prefix rows under the order by rarity, of sets (at, n, prefix by hash)."""
    first = sets.select("at", F.col("prefix")[0].alias("token"))
    common = stored(first.groupBy("token").count().where(F.col("count") > frequent / 2).select("token"))
    touched = _sets(docs, with_ids(first, common, "token").select("at"), size)
    counts = stored(touched.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > frequent))
    again = stored(with_ids(_prefix_rows(sets), counts.select("token"), "token").select("at").distinct())
    whole = with_ids(touched, again, "at").unionByName(_sets(docs, again.join(touched, "at", "left_anti"), size))
    side = F.broadcast(counts) if counts.count() <= BROADCAST_IDS else counts
    often = whole.select("at", F.explode("tokens").alias("token")).join(side, "token").groupBy("at").agg(
        F.array_sort(F.collect_set(F.struct(F.col("count").alias("c"), "token")))["token"].alias("often"))  # one line's tokens
    n = F.size("tokens")
    new = whole.join(often, "at").select("at", n.alias("n"), F.slice(
        F.concat(F.array_except("tokens", "often"), "often"), 1, _prefix(n, percent)).alias("prefix"))
    return _prefix_rows(without_ids(sets, again, "at").unionByName(new))


def _need(percent: int, x: str, y: str) -> str:
    """The least intersection of matching sets of these sizes."""
    return f"(({percent} * ({x} + {y}) + {99 + percent}) div {100 + percent})"


def _similar_size(percent: int) -> str:
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"


def _close(percent: int) -> str:
    """Length and positional filter between prefix rows x and y."""
    return f"{_similar_size(percent)} AND least(x.pos, y.pos) + least(x.n - x.pos, y.n - y.pos) >= {_need(percent, 'x.n', 'y.n')}"


def _least_shared(percent: int) -> str:
    """Prefix tokens that matching sets of sizes m and n share at least: their
    prefixes leave out all but so many of the tokens they must have in common."""
    over = [f"({v} - (({percent} * {v} + 99) div 100) + 1) - {v}" for v in ("m", "n")]
    return f"greatest(1, least({over[0]}, {over[1]}) + {_need(percent, 'm', 'n')})"


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The later lines of the pairs (a earlier, b later) that match."""
    sets = _sets(docs, pairs.select(F.col("a").alias("at")).union(pairs.select("b")), size)
    whole = pairs.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return whole.where(100 * both >= percent * (F.size("ta") + F.size("tb") - both)).select(F.col("b").alias("at")).distinct()


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with a number per (id, text) that goes up with the id: the id itself
    where it is a unique whole number, else its place among the (id, text hash)."""
    whole = docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    ids, number = docs.select(F.col(id_col).alias("id")), f"{_OWN}no"
    if whole and ids.groupBy("id").count().where(
            f"count > 1 OR id IS NULL OR id NOT BETWEEN -{1 << 62 - LINE_BITS} AND {1 << 62 - LINE_BITS}").isEmpty():
        return docs.withColumn(number, F.col(id_col).cast("long"))
    own, key = f"{_OWN}id", f"{_OWN}key"
    keys = docs.select(F.col(id_col).alias(own), F.xxhash64(text_col).alias(key)).distinct()
    places = stored(with_row_index(keys, [F.col(own).asc_nulls_first(), key], index_col=number))
    side = F.broadcast(places) if places.count() <= BROADCAST_IDS else places
    return docs.join(side, docs[id_col].eqNullSafe(side[own]) & (F.xxhash64(docs[text_col]) == side[key])).drop(own, key)


def _gone(docs: DataFrame, size: int, percent: int, frequent: int) -> DataFrame:
    """(id, line) of the lines to remove of numbered texts (id, text)."""
    lines = _lines(docs).select(_at().alias("at"), _words(F.col("text")).alias("words"))
    lines = lines.select("at", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(7), "words").alias("k2"),
                         _hashes(F.col("words")).alias("hashes"))
    lines = lines.select("at", "k1", "k2", _shingles(F.col("hashes"), size).alias("tokens"))
    with scratch(docs.sparkSession) as kept:
        with scratch(docs.sparkSession) as early:
            # Short lines are filtered out behind the table: before it, their test would split every line twice.
            lines = stored(lines.select("at", "k1", "k2", F.size("tokens").alias("n"),
                                        F.slice("tokens", 1, _prefix(F.size("tokens"), percent)).alias("prefix"))).where("n > 0")
            first = stored(lines.groupBy("k1", "k2").agg(F.min("at").alias("at")))
            is_first = F.col("at") == F.col("first")
            classed = early.keep(stored(lines.join(first.withColumnRenamed("at", "first"), ["k1", "k2"]).select(
                "at", F.when(is_first, F.col("n")).alias("n"), F.when(is_first, F.col("prefix")).alias("prefix"))))
            copies, sets = classed.where("n IS NULL").select("at"), classed.where("n IS NOT NULL")
        with scratch(docs.sparkSession) as middle:
            rows = _by_rarity(docs, sets, size, percent, frequent)
            by_token = Window.partitionBy("token")
            held = middle.keep(stored(rows.withColumn("c", F.count(F.lit(1)).over(by_token)).withColumn(
                "x", F.min(F.struct("at", "n", "pos")).over(by_token)).where("c > 1")))
        leader = stored(held.alias("y").where(F.expr("x.at < y.at AND " + _close(percent))).select(
            F.col("x.at").alias("a"), F.col("y.at").alias("b")).distinct())
        found = stored(_verified(docs, leader, size, percent))

        # The others: every earlier class that shares as many prefix tokens as a match does.
        later = held.join(found, "at", "left_anti").select("token", "at", "n")
        shared = held.select("token", "at", "n").alias("x").join(later.alias("y"), F.expr(
            "x.token = y.token AND x.at < y.at AND " + _similar_size(percent))).groupBy(
            F.col("x.at").alias("a"), F.col("y.at").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.first("x.n").alias("m"), F.first("y.n").alias("n"))
        more = stored(shared.where("c >= " + _least_shared(percent)).select("a", "b").join(leader, ["a", "b"], "left_anti"))
        near = found.union(_verified(docs, more, size, percent))
        gone = kept.keep(stored(copies.union(near).distinct()))
    return gone.select(F.shiftright("at", LINE_BITS).alias("id"), F.col("at").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("line"))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
                    percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """(id, key, line) of the lines to remove, line numbers from 0; `key`, a hash
    of the text, tells rows of one id, or without one, apart."""
    no = F.col(f"{_OWN}no").alias("no")
    rows = _numbered(docs, id_col, text_col)
    gone = _gone(rows.select(no.alias("id"), F.col(text_col).alias("text")), size, percent, frequent)
    names = rows.select(no, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key")).distinct()
    return names.join(gone.withColumnRenamed("id", "no"), "no").select("id", "key", "line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
                percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """`docs` with the duplicate lines taken out of the text; all columns and
    rows stay.  `n_removed` says how many lines went (in place of a column of
    that name)."""
    no, out = f"{_OWN}no", f"{_OWN}gone"
    rows = _numbered(docs, id_col, text_col)
    gone = _gone(rows.select(F.col(no).alias("id"), F.col(text_col).alias("text")), size, percent, frequent)
    gone = stored(gone.groupBy(F.col("id").alias(no)).agg(F.collect_set("line").alias(out)))  # one text's lines
    size_of = gone.agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum(F.size(out)), F.lit(0)).alias("lines")).first()
    small = size_of.ids <= BROADCAST_IDS and size_of.lines <= 4 * BROADCAST_IDS
    rows = rows.join(F.broadcast(gone) if small else gone, no, "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.coalesce(F.array_contains(out, i), F.lit(False)))
    text = F.when(F.col(out).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n_removed = F.coalesce(F.size(out), F.lit(0)).cast("long")
    return rows.withColumn(text_col, text).withColumn("n_removed", n_removed).drop(no, out)
