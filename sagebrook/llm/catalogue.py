"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, html_text, language, language_model, minhash, mixing, pii, pipeline, prefix_trie, quality, token_alignment, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    """A file of the public tokenizers that are installed beside Python."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, _table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark, _table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark, _table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, _table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(spark, _table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark, _table(spark, sf_dir, "conversations"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_warc_archive": op3_warc_archive,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_source_mixing": op6_source_mixing,
    "op7_language": op7_language,
    "op8_pii": op8_pii,
    "op9_main_text": op9_main_text,
    "op10_decontamination": op10_decontamination,
    "op11_token_alignment": op11_token_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_language_model": op13_language_model,
    "pipeline": pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": minhash.NEAR_DUPLICATES_SQL,
    "op2_embedding_dedup": embedding_dedup.NEAR_DUPLICATES_SQL,
    "op3_warc_archive": warc.ROUND_TRIP_SQL,
    "op10_decontamination": decontaminate.CONTAINED_SQL,
    "op12_prefix_trie": prefix_trie.TRIE_SQL,
}
if pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = pipeline.ORACLE_SQL
