"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import chat, codes, decontaminate, langid, media, mixing, search, sharding, simhash, substrings, tokenfile, tokens, warc


#: The tokenizer of the registered queries; every operator takes its path as a parameter.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_counts(_table(spark, sf_dir, "documents"), TOKENIZER)


def op2_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2(_table(spark, sf_dir, "documents"))


def op3_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op4(_table(spark, sf_dir, "documents"))


def op5_token_ids_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op5(_table(spark, sf_dir, "documents"), TOKENIZER)


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op8(_table(spark, sf_dir, "conversations"))


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op9(_table(spark, sf_dir, "documents"))


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op10(_table(spark, sf_dir, "documents"))


def op11_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.op11(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.op12(_table(spark, sf_dir, "embeddings"))


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op13(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_attribution": op1_token_attribution,
    "op2_simhash_near_dup": op2_simhash_near_dup,
    "op3_tiling_decontamination": op3_tiling_decontamination,
    "op4_audio_features": op4_audio_features,
    "op5_token_ids_rans": op5_token_ids_rans,
    "op6_systematic_mix": op6_systematic_mix,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_prefix_targets": op8_prefix_targets,
    "op9_minimax_shards": op9_minimax_shards,
    "op10_crf_language": op10_crf_language,
    "op11_maxscore_search": op11_maxscore_search,
    "op12_product_codes": op12_product_codes,
    "op13_warc_archives": op13_warc_archives,
}

ORACLE_SQL: dict[str, str] = {
    "op6_systematic_mix": mixing.OP6_SQL,
    "op8_prefix_targets": chat.OP8_SQL,
    "op11_maxscore_search": search.OP11_SQL,
    "op12_product_codes": codes.OP12_SQL,
    "op13_warc_archives": warc.OP13_SQL,
}
