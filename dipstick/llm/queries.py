"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from dipstick.llm import (
    boilerplate,
    conversations,
    decontaminate,
    language_model,
    licences,
    main_text,
    mixing,
    packing,
    quality,
    simhash,
    sql,
    syncmers,
    token_counts,
    whitening,
)
from dipstick.session import fresh_path
from dipstick.sources.tables import table

# Where the public tokenizers lie; pass another path to the operators for other files.
TOKENIZERS = Path("/opt/tokenizers")


def tokenizer(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return str(TOKENIZERS / name)
    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    # A new cache for each run: every distinct text is encoded here.
    cache = fresh_path(spark, "token-counts")
    return token_counts.count_tokens(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), cache)


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("copies")


def op4_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op5_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.drop_site_lines(table(spark, folder, "documents"))


def op6_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(table(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).drop("n_lines", "n_shouted")


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(table(spark, folder, "conversations"))


def op13_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.compare_edited(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_main_text,
        op3_source_mix,
        op4_licence_scan,
        op5_site_lines,
        op6_lm_scores,
        op7_quality_rules,
        op8_decontaminate,
        op9_simhash_groups,
        op10_token_files,
        op11_embedding_whitening,
        op12_conversation_repair,
        op13_document_fingerprints,
    )
}
ORACLES: dict[str, str] = {"op3_source_mix": sql.SOURCE_MIX, "op4_licence_scan": sql.licence_scan(), "op5_site_lines": sql.SITE_LINES}
