"""Queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import conversations, fertility, katz, media, merkle, mixing, packing, pieces, quality, sharding, simhash, substrings, urls
from ledgerspark.llm.common import table


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_held_out(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op4_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_shard_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(urls.labelled(table(spark, sf_dir, "pages")))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op11_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op13_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_katz_scores": op1_katz_scores,
        "op2_media_columns": op2_media_columns,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_quality_score": op4_quality_score,
        "op5_simhash_components": op5_simhash_components,
        "op6_fertility_rules": op6_fertility_rules,
        "op7_mix_sources": op7_mix_sources,
        "op8_shard_linked": op8_shard_linked,
        "op9_url_templates": op9_url_templates,
        "op10_piece_codec": op10_piece_codec,
        "op11_best_two_fit": op11_best_two_fit,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_repair_turns": op13_repair_turns,
    }
