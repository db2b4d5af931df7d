"""The corpus pipeline: stages that turn documents into packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Each but the last returns the columns of documents.

Defined results, for all stages: an empty table gives an empty result; further columns go through all but the last, whatever their names; documents with null or
empty text end at the first stage; a null doc_id is an id, and ids that aren't integers are a TypeError; of rows that repeat one stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import best_fit_packing, minhash_dedup, quality_cnn, shared, substring_dedup


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, doesn't reject. Null and empty texts go; without labels of both kinds all others stay."""
    shared.short_batches(spark)
    return quality_cnn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least (doc_id, hash of text). Texts without words have no copies."""
    return minhash_dedup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier one, or they themselves, have. Documents of which no word is left go."""
    return substring_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which bytes of which document lie where in which sequence; all bytes of the documents that are left, each once."""
    return best_fit_packing.pack(docs)


STAGES = [("quality classifier", keep_good), ("MinHash near-dedup", drop_near_copies), ("substring dedup", cut_repeats), ("best-fit packing", pack)]

#: Training, sketches and matching in rounds have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of a folder, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths: list[str] = []
    for _, stage in STAGES[:-1]:
        docs, path = shared.store(stage(spark, docs, sf_dir))
        shared.discard(spark, *paths)
        paths = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
