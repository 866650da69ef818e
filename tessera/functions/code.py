"""Python-source helpers that need a parser (standard `ast` module only).

They run inside Arrow-batched pandas UDFs: a vectorised batch in, one parse
per text, a column out.  Use them after every cheap native filter.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Errors that mean "not valid source" (the reference catches SyntaxError only;
# NUL bytes raise ValueError, deep nesting RecursionError/MemoryError).
_PARSE_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError)


def parses(src: str) -> bool:
    try:
        ast.parse(src)
        return True
    except _PARSE_ERRORS:
        return False


def block_offsets(src: str) -> list[tuple[int, int]]:
    """Character spans of every indented block (the body of a compound
    statement), in pre-order of the syntax tree.  A block runs from the start
    of its first statement to the end of its last.  Parser columns are UTF-8
    byte offsets; they are converted to character offsets here."""
    try:
        tree = ast.parse(src)
    except _PARSE_ERRORS:
        return []
    lines = src.split("\n")
    starts = [0]
    for ln in lines[:-1]:
        starts.append(starts[-1] + len(ln) + 1)

    def offset(row: int, col_bytes: int) -> int:
        line = lines[row - 1]
        return starts[row - 1] + len(line.encode("utf-8")[:col_bytes].decode("utf-8", "ignore"))

    out: list[tuple[int, int]] = []

    def visit(node):
        for field in ("body", "orelse", "finalbody"):
            stmts = getattr(node, field, None)
            if isinstance(node, ast.Module) or not isinstance(stmts, list) or not stmts:
                continue
            if not all(hasattr(s, "lineno") for s in stmts):
                continue
            first, last = stmts[0], stmts[-1]
            out.append((offset(first.lineno, first.col_offset),
                        offset(last.end_lineno, last.end_col_offset)))
        for child in ast.iter_child_nodes(node):
            visit(child)
    visit(tree)
    return out


@F.pandas_udf(T.BooleanType())
def _parses_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else parses(x))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                        T.StructField("end", T.LongType())])))
def _blocks_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [] if x is None else [{"start": a, "end": b} for a, b in block_offsets(x)])


def parses_col(c: Column) -> Column:
    return _parses_udf(c)


def block_spans_col(c: Column) -> Column:
    return _blocks_udf(c)
