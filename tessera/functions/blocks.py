"""Nested block spans and bracket reduction of source text, in the JVM.

A text is cut into tokens that tile it (strings, comments, brackets, colons, words,
line starts with their indentation, the rest).  One fold over the tokens joins
them to logical lines: a line end inside brackets, inside a string or behind a
backslash does not end one, and lines without a token (blank, comment) are none.
A second fold runs a stack automaton over the lines: a line that is indented
deeper than the compound-statement header before it opens a block; a line that
is indented less than an open block closes it.  A suite on its header's line is
a block too.  Both are built-in higher-order functions: no Python, no shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that head a compound statement.
HEADERS = ("if", "elif", "else", "for", "while", "with", "try", "except", "finally", "def", "class", "async", "match", "case")
TAB = 8  # a tab reaches the next multiple

_TOKEN = "|".join((
    r'"""[\s\S]*?"""', r"'''[\s\S]*?'''",
    r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"', r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'",
    r"#[^\n]*", r"\\\r?\n", r"\n[ \t\f]*", r"[ \t\f\r]+", r"[()\[\]{}]", r":=", r":", r"[A-Za-z_]\w*",
    r"""[^\s"'#()\[\]{}:\\A-Za-z_]+""", r"[\s\S]"))


def code_tokens(text: Column) -> Column:
    """The tokens of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _width(blank: Column) -> Column:
    """Column that a run of blanks reaches."""
    parts = F.split(blank, "\t", -1)
    return F.when(~F.contains(blank, F.lit("\t")), F.length(blank)).otherwise(
        F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.lit(0), lambda at, p: (F.floor((at + F.length(p)) / TAB).cast("int") + 1) * TAB)
        + F.length(F.element_at(parts, -1)))


_LINE = "array<struct<indent:int,start:bigint,end:bigint,header:boolean,suite:bigint>>"


def logical_lines(tokens: Column) -> Column:
    """array<struct<indent, start, end, header, suite>>: offsets in characters;
    header: the line ends in a compound statement's colon; suite: where the
    statements behind that colon start on the same line, or null."""
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    start = F.struct(
        zero.alias("pos"), F.lit(0).alias("depth"), F.lit(0).alias("indent"), none.alias("first"), zero.alias("end"),
        F.lit(0).alias("kind"),      # 0 other line, 1 headed by a keyword, 2 its colon seen
        F.lit(0).alias("n"), F.lit(0).alias("lambdas"), none.alias("suite"), F.array().cast(_LINE).alias("lines"))

    def line(s):
        return F.struct(s["indent"].alias("indent"), s["first"].alias("start"), s["end"].alias("end"),
                        ((s["kind"] == 2) & s["suite"].isNull()).alias("header"), s["suite"].alias("suite"))

    def ended(s):
        return F.when(s["first"].isNotNull(), F.concat(s["lines"], F.array(line(s)))).otherwise(s["lines"])

    def step(s, t):
        after = s["pos"] + F.length(t)
        c = F.substring(t, 1, 1)
        new_line = (c == "\n") & (s["depth"] == 0)
        blank = c.isin(" ", "\t", "\f", "\r", "#", "\\", "\n")
        colon = (t == ":") & (s["depth"] == 0)
        head = colon & (s["kind"] == 1) & (s["lambdas"] == 0)
        depth = F.when(t.isin("(", "[", "{"), s["depth"] + 1).when(t.isin(")", "]", "}"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        first_word = s["first"].isNull() & t.isin(*HEADERS)
        lambdas = F.when((s["depth"] == 0) & (t == "lambda"), s["lambdas"] + 1).when(colon & (s["lambdas"] > 0), s["lambdas"] - 1).otherwise(s["lambdas"])
        moved = F.struct(
            after.alias("pos"), F.lit(0).alias("depth"), _width(F.substring(t, 2, 1 << 30)).alias("indent"), none.alias("first"),
            s["end"].alias("end"), F.lit(0).alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("lambdas"), none.alias("suite"),
            ended(s).alias("lines"))
        # A first line has its indentation as a plain run of blanks.
        lead = (s["pos"] == 0) & c.isin(" ", "\t", "\f")
        skipped = F.struct(
            after.alias("pos"), s["depth"].alias("depth"), F.when(lead, _width(t)).otherwise(s["indent"]).alias("indent"),
            *[s[x].alias(x) for x in ("first", "end", "kind", "n", "lambdas", "suite", "lines")])
        taken = F.struct(
            after.alias("pos"), depth.alias("depth"), s["indent"].alias("indent"), F.coalesce(s["first"], s["pos"]).alias("first"), after.alias("end"),
            F.when(first_word, F.lit(1)).when(head, F.lit(2)).otherwise(s["kind"]).alias("kind"), (s["n"] + 1).alias("n"), lambdas.alias("lambdas"),
            F.when((s["kind"] == 2) & s["suite"].isNull(), s["pos"]).otherwise(s["suite"]).alias("suite"), s["lines"].alias("lines"))
        return F.when(new_line, moved).when(blank, skipped).otherwise(taken)

    return F.aggregate(tokens, start, step, ended)


def block_spans(lines: Column) -> Column:
    """array<struct<start, end>> of all blocks, in pre-order: a block runs from
    its first statement to the end of its last."""
    spans = "array<struct<start:bigint,end:bigint>>"
    start = F.struct(
        F.array().cast("array<struct<indent:int,start:bigint>>").alias("open"), F.lit(0).cast("bigint").alias("end"),
        F.lit(-1).alias("indent"), F.lit(False).alias("header"), F.array().cast(spans).alias("done"))

    def closed(s, blocks):
        return F.transform(blocks, lambda b: F.struct(b["start"].alias("start"), s["end"].alias("end")))

    def step(s, x):
        shut = F.filter(s["open"], lambda b: b["indent"] > x["indent"])
        kept = F.filter(s["open"], lambda b: b["indent"] <= x["indent"])
        opens = s["header"] & (x["indent"] > s["indent"])
        done = F.when(F.exists(s["open"], lambda b: b["indent"] > x["indent"]), F.concat(s["done"], closed(s, shut))).otherwise(s["done"])
        suite = F.array(F.struct(x["suite"].alias("start"), x["end"].alias("end")))
        return F.struct(
            F.when(opens, F.concat(kept, F.array(F.struct(x["indent"].alias("indent"), x["start"].alias("start"))))).otherwise(kept).alias("open"),
            x["end"].alias("end"), x["indent"].alias("indent"), x["header"].alias("header"),
            F.when(x["suite"].isNotNull(), F.concat(done, suite)).otherwise(done).alias("done"))

    found = F.aggregate(lines, start, step, lambda s: F.concat(s["done"], closed(s, s["open"])))
    # By start, the longer block first: pre-order.
    return F.transform(F.array_sort(F.transform(found, lambda b: F.struct(b["start"].alias("start"), (-b["end"]).alias("end")))),
                       lambda b: F.struct(b["start"].alias("start"), (-b["end"]).alias("end")))


def well_nested(text: Column, pairs: Sequence[str] = ("()", "[]", "{}"), quotes: bool = True) -> Column:
    """Whether the brackets of a text reduce to nothing on a stack, in order, and
    (`quotes`) no quote is left open.  Brackets in strings and comments do not
    count.  A necessary condition of valid code, far cheaper than a parser."""
    opening, closing = "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)
    tokens = code_tokens(text) if quotes else F.regexp_extract_all(text, F.lit(r"[\s\S]"), F.lit(0))
    marks = [*opening, *closing, *(("'", '"') if quotes else ())]
    seen = F.filter(tokens, lambda t: t.isin(*marks))  # a whole string is longer than its quote

    def step(stack, t):
        top = F.substring(stack, -1, 1)
        fits = F.lit(False)
        for o, c in pairs:
            fits = fits | ((t == c) & (top == o))
        # "!" is in no stack that can empty again.
        return F.when(t.isin(*opening), F.concat(stack, t)).when(fits, F.substring(stack, F.lit(1), F.length(stack) - 1)).otherwise(F.concat(stack, F.lit("!")))

    return F.aggregate(seen, F.lit(""), step) == ""
