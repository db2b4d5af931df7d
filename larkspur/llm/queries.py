"""The registered queries of this package: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, best_fit_packing, bpe, chat_tools, histogram_sharding, maxent_lm, minhash_dedup, mjpeg, quality_cnn, shared, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op2_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.link(chat_tools.exchanges(_table(spark, sf_dir, "conversations")), chat_tools.REPLY)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(_table(spark, sf_dir, "documents"))


def op6_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mjpeg.clips(mjpeg.films(_table(spark, sf_dir, "embeddings")))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose id is divisible by 20, searched among all rows."""
    return additive_ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sharding.shard(_table(spark, sf_dir, "documents"), ["source", "doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_tools": chat_tools.ORACLE}
