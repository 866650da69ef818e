"""Column-level helpers.  All of them are built-in Spark expressions (JVM side,
no Python per row); higher-order functions (`transform`, `filter`, `aggregate`)
are used for per-row array work so that nothing needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space token pattern and the published byte-level
# pre-token pattern.
WS_TOKEN_PATTERN = r"\S+"
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_tokens(c) -> Column:
    """White-space tokens (runs of non-space characters)."""
    return F.regexp_extract_all(col_(c), F.lit(WS_TOKEN_PATTERN), 0)


def regex_tokens(c, pattern: str = PRETOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(col_(c), F.lit(pattern), 0)


def ngrams(tokens, n: int) -> Column:
    """All contiguous n-grams of an array as arrays (empty when too short).

    `sequence(1, 0)` counts down in Spark, so the short case is guarded."""
    t = col_(tokens)
    return F.when(F.size(t) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                              lambda i: F.slice(t, i, n))
                  ).otherwise(F.array().cast("array<array<string>>"))


def chars(s) -> Column:
    """A string as an array of its characters (code points), in one pass."""
    return F.when(col_(s) == "", F.array().cast("array<string>")).otherwise(F.split(col_(s), ""))


def char_ngrams(char_array, n: int) -> Column:
    """All character n-grams, from a character array (see `chars`).

    Slicing an already materialised array is O(n) per gram; `substring` on the
    string would rescan it from the start for every gram."""
    t = col_(char_array)
    return F.when(F.size(t) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                              lambda i: F.array_join(F.slice(t, i, n), ""))
                  ).otherwise(F.array().cast("array<string>"))


#: Code points that stand for tokens: U+0100 upwards without the surrogates and
#: U+FEFF, which a UTF-32 decoder takes for a byte-order mark and drops.
TOKEN_CODE_POINTS = 0x110000 - 0x100 - 0x800 - 1


def code_point_char(n) -> Column:
    """One character for a code point outside the surrogate block.

    `chr` wraps at 256, so the UTF-32 decoding of the 8-hex-digit code is used."""
    return F.decode(F.unhex(F.lpad(F.hex(col_(n)), 8, "0")), "UTF-32")


def tokens_as_string(tokens, alphabet) -> Column:
    """Encode a token array as a string, one character per distinct token of
    ``alphabet`` (an array holding every token of the row).  A row with more
    distinct tokens than there are code points fails."""
    a = col_(alphabet)
    return F.array_join(F.transform(col_(tokens),
                                    lambda t: code_point_char(token_code_point(F.array_position(a, t)))), "")


def token_code_point(pos) -> Column:
    """1-based alphabet position -> code point: U+0100 upwards, skipping the
    surrogate block and U+FEFF."""
    n = col_(pos) + 255
    code = F.when(n >= 0xFEFF - 0x800, n + 0x801).when(n >= 0xD800, n + 0x800).otherwise(n)
    return F.when(col_(pos) > TOKEN_CODE_POINTS, F.raise_error(F.lit("too many distinct tokens in one row"))).otherwise(code)


def hash_order_key(seed, *cols) -> Column:
    """Deterministic pseudo-random order: md5 of the key and a seed."""
    parts = [col_(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("-", *parts, F.lit(str(seed))))


def word_count(c) -> Column:
    """Number of white-space tokens, counted without building the array."""
    return F.regexp_count(col_(c), F.lit(WS_TOKEN_PATTERN))
