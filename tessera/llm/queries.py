"""The registered queries of this subpackage: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import prepare, table

QUERIES: dict = {}


def register(fn):
    @functools.wraps(fn)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = query
    return query


@register
def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.page_text import main_text
    return main_text(table(spark, sf_dir, "pages"))


@register
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@register
def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.outliers import verdicts
    return verdicts(table(spark, sf_dir, "documents"))


@register
def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_crf import identify
    return identify(table(spark, sf_dir, "documents"))


@register
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import read_pieces, token_counts
    return token_counts(table(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


@register
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import dedup_lines
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


@register
def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.hmm import scores
    return scores(table(spark, sf_dir, "documents"))


@register
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.byte_bpe import digests, encode_documents
    return digests(encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                    public_tokenizers.PATTERN))


@register
def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.surrogates import replace_entities
    out = replace_entities(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"))


@register
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.prefix_trie import trie
    return trie(table(spark, sf_dir, "conversations"))


@register
def op12_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.nn_descent import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@register
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lexical_search import rank
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
