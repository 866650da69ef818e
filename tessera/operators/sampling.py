"""Projections, filters and reproducible sampling.

Randomness is replaced by an md5-keyed order, so any engine gives the same
sample for the same seed.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import hash_order_key
from tessera.operators.ordering import with_row_index

# Fixed values.
LANGUAGES = ("de", "en", "es", "fr")
LENGTHS = ("short", "medium", "long", "mix")
SPLITS = ("train", "validation", "test")
SEED = 115
TEST_FRACTION = 0.1


# ----------------------------------------------------------------------- scans

def scan_config(corpus: DataFrame, language: str, length: str) -> DataFrame:
    """One (language, length) configuration.  Arguments are validated before
    the plan is built; `mix` is the union of all length classes.  The filters
    are plain column predicates, so on a `language=/length=` partitioned table
    they prune directories."""
    if language not in LANGUAGES:
        raise ValueError(f"unknown language {language!r}, known: {LANGUAGES}")
    if length not in LENGTHS:
        raise ValueError(f"unknown length class {length!r}, known: {LENGTHS}")
    out = corpus.filter(F.col("language") == language)
    if length != "mix":
        out = out.filter(F.col("length") == length)
    return out


def scan_split(corpus: DataFrame, split: str) -> DataFrame:
    """One split."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return corpus.filter(F.col("split") == split)


def corpus_scan(corpus: DataFrame, column: str = "text") -> DataFrame:
    """S3: the single column that trains the tokenizer (column pruning does
    the rest; the Arrow batch size plays the reference's chunk of 1,000)."""
    return scan_split(corpus, "train").select("doc_id", F.col(column).alias("original_method"))


def mix_lengths(corpus: DataFrame, classes: Sequence[str] = ("short", "medium", "long")) -> DataFrame:
    """M9: the mixed-length configuration: all of these length classes."""
    return corpus.filter(F.col("length").isin(*classes)).withColumn("config", F.lit("mix"))


def skip_if_encoded(df: DataFrame, prepare) -> DataFrame:
    """Preparation is idempotent -- skipped when `input_ids` exists."""
    return df if "input_ids" in df.columns else prepare(df)


# -------------------------------------------------------------------- sampling

def sample_exact(df: DataFrame, key: str, fraction: float = TEST_FRACTION, seed: int = SEED,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """Exactly floor(fraction * n) rows without replacement: the rows whose
    md5(key-seed) ranks lowest.  Ranks come from the distributed row index, so
    no task ever holds more than its partition."""
    h = hash_order_key(seed, key)
    idx = with_row_index(df.withColumn("_h", h), ["_h", key], group_cols,
                         index_col="_rank", total_col="_total")
    return idx.filter(F.col("_rank") < F.floor(F.col("_total") * F.lit(fraction))) \
              .drop("_h", "_rank", "_total")


def sample_cap(df: DataFrame, key: str, n: int, seed: int = SEED,
               group_cols: Sequence[str] = ()) -> DataFrame:
    """At most n rows per set (group), each set drawn with the same seed.

    `n` is a fixed cap, so `row_number() <= n` runs as a window group limit:
    each task keeps only its n best rows per group before the shuffle."""
    h = hash_order_key(seed, key)
    w = Window.partitionBy(*group_cols).orderBy(h, F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def sample_aligned(split_rows: DataFrame, key: str, fraction: float = TEST_FRACTION,
                   seed: int = SEED, split_col: str = "split", base_split: str = "test") -> DataFrame:
    """P5: the same selected positions applied to every split.

    Positions are 0-based row numbers by `key` within each split; the selected
    positions are drawn from the base split's range (md5 of position and seed),
    then every split keeps the rows at those positions (left-semi join).  A
    shorter split simply yields fewer rows."""
    indexed = with_row_index(split_rows, [key], [split_col], index_col="row_idx")
    base = indexed.filter(F.col(split_col) == base_split).select("row_idx")
    positions = sample_exact(base, "row_idx", fraction, seed).select("row_idx")
    return indexed.join(positions, "row_idx", "left_semi")


def head_rows(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first n rows by key (a top-k: TakeOrderedAndProject)."""
    return df.orderBy(key).limit(n)


def point_lookup(df: DataFrame, key: str, position: int) -> DataFrame:
    """The row at a 0-based position by key."""
    return with_row_index(df, [key]).filter(F.col("row_idx") == position)


def unpivot_sizes(wide: DataFrame, ids: Sequence[str], sizes: Sequence[str],
                  fields: Sequence[str]) -> DataFrame:
    """`{size}_{field}` columns -> one row per (id, size) with `fields`."""
    structs = [F.struct(F.lit(s).alias("size"), *[F.col(f"{s}_{f}").alias(f) for f in fields])
               for s in sizes]
    return wide.select(*ids, F.inline(F.array(*structs)))
