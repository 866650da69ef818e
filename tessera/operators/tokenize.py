"""Tokenization: byte alphabet, pre-tokens, word counts, vocabulary, encode,
frame, decode (T1-T13).

Vocabulary tables are `(token_id int, token string, special boolean)`.  A
vocabulary is bounded by its requested size (+5 added tokens), which is the
size bound that lets encode/decode broadcast it.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import PRETOKEN_PATTERN, code_point_char, regex_tokens, ws_tokens
from tessera.functions.joins import bounded, bound_of, broadcast_bounded, broadcast_if_small

# Added tokens, in the order they receive ids.
SPECIAL_TOKENS = ("<MASK>", "<PAD>", "<BOS>", "<EOS>")
ADDED_TOKENS = ("<NEW_LINE>",)
UNK_TOKEN = "<UNK>"
VOCAB_SIZE = 2 ** 15
ENC_MAX_LEN = 512
DEC_MAX_LEN = 128
# Printable byte ranges that map to themselves in the byte-level alphabet.
PRINTABLE_BYTE_RANGES = ((33, 126), (161, 172), (174, 255))


# ------------------------------------------------------------------------ T1

def byte_alphabet(spark: SparkSession) -> DataFrame:
    """256 rows: byte -> code point -> one-character symbol.  Printable bytes
    map to themselves; the other 68 take U+0100 onwards, in byte order."""
    b = F.col("id")
    printable = None
    for lo, hi in PRINTABLE_BYTE_RANGES:
        c = b.between(lo, hi)
        printable = c if printable is None else (printable | c)
    # Number of non-printable bytes below b (closed form over the ranges).
    below = F.least(b, F.lit(33))
    below = below + F.greatest(F.least(b, F.lit(161)) - 127, F.lit(0))
    below = below + F.greatest(F.least(b, F.lit(174)) - 173, F.lit(0))
    code = F.when(printable, b).otherwise(F.lit(256) + below)
    return spark.range(256).select(b.cast("int").alias("byte"), code.cast("int").alias("code_point"),
                                   code_point_char(code).alias("symbol"))


# ------------------------------------------------------------------ T2 / T3

def pretokenize(df: DataFrame, key: Sequence[str], text: str = "text",
                pattern: str = PRETOKEN_PATTERN) -> DataFrame:
    """Word pieces of each text, with their position."""
    return df.select(*key, F.posexplode(regex_tokens(F.col(text), pattern)).alias("pos", "piece")) \
             .withColumn("pos", F.col("pos").cast("long"))


def word_counts(df: DataFrame, text: str = "text", pattern: str = PRETOKEN_PATTERN) -> DataFrame:
    """Corpus word-type counts (partial + final hash aggregation; a hot
    word collapses to one row per task before the shuffle)."""
    return df.select(F.explode(regex_tokens(F.col(text), pattern)).alias("word")) \
             .groupBy("word").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ T5 / T6

def with_added_tokens(vocab: DataFrame, specials: Sequence[str] = SPECIAL_TOKENS,
                      added: Sequence[str] = ADDED_TOKENS) -> DataFrame:
    """T5: append the special and added tokens with ids from max(id) + 1."""
    spark = vocab.sparkSession
    rows = [(t, True, i) for i, t in enumerate(specials)] + \
           [(t, False, len(specials) + i) for i, t in enumerate(added)]
    extra = spark.createDataFrame(rows, "token string, special boolean, k int")
    base = vocab.agg(F.max("token_id").alias("mx"))
    extra = extra.crossJoin(base).select(
        (F.coalesce(F.col("mx"), F.lit(-1)) + 1 + F.col("k")).cast("int").alias("token_id"),
        "token", "special")
    out = vocab.select("token_id", "token", "special").unionByName(extra)
    b = bound_of(vocab)
    return bounded(out, None if b is None else b + len(rows))


def word_vocab(corpus_text: DataFrame, text: str = "text", vocab_size: int = VOCAB_SIZE,
               tokenizer=ws_tokens) -> DataFrame:
    """Word-level vocabulary of `vocab_size` entries: id 0 is `<UNK>`, ids
    1.. the most frequent tokens (count desc, then token).  The top-k is
    bounded by `vocab_size`, so the final ranking runs on that many rows."""
    return vocab_from_counts(token_counts(corpus_text, text, tokenizer), vocab_size)


def token_counts(corpus_text: DataFrame, text: str = "text", tokenizer=ws_tokens) -> DataFrame:
    """`(token, n)` over all texts."""
    return corpus_text.select(F.explode(tokenizer(F.col(text))).alias("token")) \
        .groupBy("token").agg(F.count("*").alias("n"))


def vocab_from_counts(counts: DataFrame, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """`(token, n)` (stored, as it is read twice) -> vocabulary: `<UNK>` = 0,
    then the top `vocab_size - 1` tokens by (n desc, token).

    The least count that is still in comes from a histogram of the counts
    (tokens per count: far fewer rows than tokens), so only tokens of at least
    that count are ranked, not every partition's own best."""
    per_count = counts.groupBy("n").agg(F.count("*").alias("k"))
    above = per_count.withColumn("upto", F.sum("k").over(Window.orderBy(F.col("n").desc())))
    cut = above.agg(F.coalesce(F.max(F.when(F.col("upto") >= vocab_size - 1, F.col("n"))), F.lit(0)).alias("cut"))
    kept = counts.crossJoin(broadcast_if_small(cut, row_bound=1)).where(F.col("n") >= F.col("cut")).select("token", "n")
    top = kept.orderBy(F.col("n").desc(), F.col("token")).limit(vocab_size - 1)
    # A window over at most `vocab_size` rows (after the top-k limit).
    ranked = top.select("token", F.row_number().over(
        Window.orderBy(F.col("n").desc(), F.col("token"))).cast("int").alias("token_id"))
    unk = counts.sparkSession.createDataFrame([(0, UNK_TOKEN)], "token_id int, token string")
    out = unk.unionByName(ranked.select("token_id", "token")).withColumn("special", F.lit(False))
    return bounded(out, vocab_size)


def vocab_size_check(vocab: DataFrame, requested: int, n_added: int = 5) -> None:
    """The vocabulary has exactly requested + added entries."""
    n = vocab.count()
    if n != requested + n_added:
        raise AssertionError(f"vocabulary has {n} entries, expected {requested + n_added}")


def added_token_ids(vocab: DataFrame) -> DataFrame:
    """One row with the ids of the added tokens (`mask_id, pad_id, bos_id,
    eos_id, new_line_id`), to be crossed (broadcast) into a plan."""
    names = {t: t.strip("<>").lower() + "_id" for t in SPECIAL_TOKENS + ADDED_TOKENS}
    return vocab.agg(*[F.max(F.when(F.col("token") == t, F.col("token_id"))).alias(n)
                       for t, n in names.items()])


# ------------------------------------------------------------------ T7-T11

def frame_tokens(tokens: Column, bos: str = "<BOS>", eos: str = "<EOS>") -> Column:
    """T8 at token level: <BOS> + tokens + <EOS>."""
    return F.concat(F.array(F.lit(bos)), tokens, F.array(F.lit(eos)))


def encode_tokens(df: DataFrame, key: Sequence[str], tokens: Column, vocab: DataFrame,
                  max_len: int, out_col: str = "input_ids") -> DataFrame:
    """Token arrays -> id arrays, truncated on the right to `max_len`.

    Truncation happens before the lookup (tokens map one-to-one to ids), so a
    row's exploded size is bounded by `max_len`.  The vocabulary is broadcast
    (bounded by its requested size); ids are regrouped per row in position
    order.  Unknown tokens take the `<UNK>` id (0)."""
    k = list(key)
    base = df.select(*k, F.slice(tokens, 1, max_len).alias("_t"))
    # explode_outer keeps rows with no tokens (they regroup to an empty array).
    ex = base.select(*k, F.posexplode_outer("_t").alias("_p", "token"))
    v = broadcast_bounded(vocab.select("token", "token_id"), vocab)
    looked = ex.join(v, "token", "left").select(
        *k, "_p", F.coalesce(F.col("token_id"), F.lit(0)).alias("token_id"))
    entry = F.when(F.col("_p").isNotNull(), F.struct("_p", "token_id"))
    grouped = looked.groupBy(*k).agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    return grouped.select(*k, F.transform(F.col("_s"), lambda s: s["token_id"]).alias(out_col))


def encode_columns(df: DataFrame, key: Sequence[str], specs: Sequence[tuple[str, Column, int]],
                   vocab: DataFrame) -> DataFrame:
    """Encode several token columns of the same rows in one pass: one explode
    tagged by column, one broadcast lookup, one regroup by row key (instead of
    one shuffle per column plus a join).  `specs` = (out_col, tokens, max_len)."""
    k = list(key)
    tagged = F.array(*[F.struct(F.lit(i).alias("c"), F.slice(tok, 1, mx).alias("t"))
                       for i, (_, tok, mx) in enumerate(specs)])
    base = df.select(*k, F.inline(tagged))
    ex = base.select(*k, "c", F.posexplode_outer("t").alias("_p", "token"))
    v = broadcast_bounded(vocab.select("token", "token_id"), vocab)
    looked = ex.join(v, "token", "left").select(
        *k, "c", "_p", F.coalesce(F.col("token_id"), F.lit(0)).alias("token_id"))
    aggs = []
    for i, (out, _, _) in enumerate(specs):
        entry = F.when((F.col("c") == i) & F.col("_p").isNotNull(), F.struct("_p", "token_id"))
        aggs.append(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["token_id"]).alias(out))
    return looked.groupBy(*k).agg(*aggs)


def encode_pairs(df: DataFrame, key: Sequence[str], vocab: DataFrame, input_col: str = "input",
                 target_col: str = "target", enc_max_len: int = ENC_MAX_LEN,
                 dec_max_len: int = DEC_MAX_LEN, tokenizer=ws_tokens) -> DataFrame:
    """T7-T10 for both sides at once: input_ids, attention_mask, labels."""
    enc = encode_columns(df, key, [("input_ids", tokenizer(F.col(input_col)), enc_max_len),
                                   ("labels", frame_tokens(tokenizer(F.col(target_col))), dec_max_len)],
                         vocab)
    return enc.select(*key, "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"),
                      "labels")


def encode_input(df: DataFrame, key: Sequence[str], vocab: DataFrame, text: str = "input",
                 max_len: int = ENC_MAX_LEN, tokenizer=ws_tokens) -> DataFrame:
    """T7 + T10: input_ids and an attention mask of ones."""
    enc = encode_tokens(df, key, tokenizer(F.col(text)), vocab, max_len, "input_ids")
    return enc.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def encode_labels(df: DataFrame, key: Sequence[str], vocab: DataFrame, text: str = "target",
                  max_len: int = DEC_MAX_LEN, tokenizer=ws_tokens) -> DataFrame:
    """T8 + T9: frame with <BOS>/<EOS>, then truncate to `max_len` -- a long
    target loses its <EOS>, as in the reference."""
    return encode_tokens(df, key, frame_tokens(tokenizer(F.col(text))), vocab, max_len, "labels")


def decode_ids(df: DataFrame, key: Sequence[str], ids: str, vocab: DataFrame,
               skip_special: bool = True, out_col: str = "text") -> DataFrame:
    """Ids -> tokens joined by a space, special ids dropped."""
    k = list(key)
    ex = df.select(*k, F.posexplode_outer(ids).alias("_p", "token_id"))
    v = vocab.filter(~F.col("special")) if skip_special else vocab
    looked = ex.join(broadcast_bounded(v.select("token_id", "token"), vocab), "token_id", "left")
    entry = F.when(F.col("token").isNotNull(), F.struct("_p", "token"))
    grouped = looked.groupBy(*k).agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    return grouped.select(*k, F.array_join(F.transform(F.col("_s"), lambda s: s["token"]), " ")
                          .alias(out_col))


def token_lengths(df: DataFrame, key: Sequence[str], cols: Sequence[str], tokenizer=ws_tokens) -> DataFrame:
    """Number of tokens of each text column."""
    return df.select(*key, *[F.size(tokenizer(F.col(c))).cast("long").alias(f"n_{c}_tokens") for c in cols])
