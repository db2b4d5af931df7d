"""Intermediate results in the folder shared by the executors, checked broadcasts and partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null id; a row that has it as its id counts as one without.
NULL_ID = -(1 << 63)
BROADCAST_BYTES = 32 << 20
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; in local mode a folder of our own where neither is set."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where and (given := sc._jsc.sc().getCheckpointDir()).isDefined():
        where = given.get()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="larkspur-"))
        sc.setCheckpointDir(where)
    return where


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage ends there and survives the loss of executors."""
    return store(df, partition_by)[0]


def store(df: DataFrame, partition_by: str | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/larkspur-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)  # results that nobody discards end with the application
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate results that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2000 rows, so that long texts don't fill the memory of Python workers; a session with fewer keeps them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 2000:
        spark.conf.set(name, "2000")


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if so many rows of that size are few bytes; beyond that Spark joins by shuffling."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def buckets(spark: SparkSession, data_bytes: float, bucket_bytes: int = 32 << 20) -> int:
    """How many buckets hold so many bytes: as many as shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(data_bytes // bucket_bytes) + 1)


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def integer_id(df: DataFrame, name: str) -> Column:
    """The ids of a column as longs, ``NULL_ID`` for null."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"the ids in {name} must be integers, not {kind.simpleString()}")
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))
