"""The registered queries of this package, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessellis.llm import alignment, bpe, chat, decontamination, fim, html, jaccard, linededup, mixing, quality, repeats, sharding, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_slot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), "doc_id", sharding.shard_names())
    return placed.select("doc_id", "slot", "shard")


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(_table(spark, sf_dir, "documents"))


def op5_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(_table(spark, sf_dir, "pages"))


def op6_item_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.token_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment_digests(_table(spark, sf_dir, "documents"), one, public_tokenizers.PATTERN, two)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_shares(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_slot_table": op1_slot_table,
    "op2_perspectives": op2_perspectives,
    "op3_quality_rules": op3_quality_rules,
    "op4_repeated_strings": op4_repeated_strings,
    "op5_site_templates": op5_site_templates,
    "op6_item_containment": op6_item_containment,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc_archives": op8_warc_archives,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_source_mix": op12_source_mix,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_slot_table": sharding.ORACLE,
    "op2_perspectives": chat.ORACLE,
    "op6_item_containment": decontamination.ORACLE,
    "op8_warc_archives": warc.ORACLE,
    "op9_jaccard_join": jaccard.ORACLE,
    "op10_line_dedup": linededup.ORACLE,
    "op12_source_mix": mixing.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
