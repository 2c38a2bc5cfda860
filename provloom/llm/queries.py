"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, context_tree, embedding_dedup, exact_dedup, packing, sharding, simhash, substring_dedup, tokens, toxicity
from .common import table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), split_pattern())


def op2_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_to_shards(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), split_pattern())


def op8_fuse_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_texts(table(spark, sf_dir, "documents"))


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hierarchical_packing, op2_hypergeometric_sharding, op3_token_counts, op4_de_bruijn_dedup, op5_compression_toxicity, op6_hyperplane_dedup, op7_prefix_bpe, op8_fuse_filter_dedup, op9_context_tree_scores, op10_simhash_trie)}


#: XXH64, crc32-dealt draws, tokenizers and learned scores are beyond SQL; exact groups are not.
ORACLE_SQL = {
    "op8_fuse_filter_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
        ), g AS (
            SELECT doc_id, text_sha256, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op4_de_bruijn_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), win AS (
            SELECT doc_id, unnest(range(1, len(words) - 11)) AS p, words FROM w WHERE len(words) >= 13
        ), grams AS (
            SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS gram FROM win
        ), hit AS (
            SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY gram) AS first FROM grams) WHERE first < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS pos FROM hit
        ), each AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w
        ), kept AS (
            SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS text, count(*) AS n FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos WHERE g.pos IS NULL GROUP BY e.doc_id
        )
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
