"""Range sharding by histogram sort: splitters found by exact byte counts, then one exchange.

Keys are encoded as bytes that sort like the key columns, followed by a hash of the text that parts rows of equal keys. In each round, tasks
propose keys inside the open intervals of splitters, by a hash of the key at a rate that gives some for each interval, and count the exact bytes below
every probe; counts are added over the partitions and intervals narrow. A splitter is settled when a probe is within the
tolerance of its target or no key is left between its bounds; an interval that gave no key is asked at a higher rate. Rows then move once, straight to their shard.
Splitters that share an interval are kept as one range, so the driver's work for n shards grows as n log n. Unless told otherwise, shards have
``SHARD_BYTES`` of text, or more where there would be over ``MOST_SHARDS``, so that probes and splitters, which go to all tasks, have a bound.

Defined results: keys must be texts or integers, others are a TypeError; nulls in key columns sort first; a null text has no bytes; fully equal rows are never parted, so a shard can exceed the tolerance
by them only; an empty table has no rows; the shard column gets a free name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, free_name, store
from .words import mix

SHARD_BYTES, MOST_SHARDS, TOLERANCE, PROBES = 8 << 20, 20_000, 0.01, 8


def sortable(df: DataFrame, name: str) -> Column:
    """The column as hexadecimal digits that sort like its values, nulls first."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        code = F.concat(F.hex(F.encode(c, "UTF-8")), F.lit("!"))
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        code = F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    else:
        raise TypeError(f"can't shard by {name}: {kind.simpleString()}")
    return F.coalesce(F.concat(F.lit("1"), code), F.lit("0"))


def _keys(b: pa.RecordBatch) -> list[str]:
    return b.column("key").to_pylist()


def _propose(shared, seed: int):
    """Keys strictly inside the intervals (low, high, probability) that are shared, by the hash of a key; high '' has no end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals = shared.value
        lows, rates = [i[0] for i in intervals], np.array([i[2] for i in intervals])
        most = rates.max()
        salt = mix(np.array([seed + 1], np.uint64))
        for b in batches:
            chance = mix(b.column("hash").to_numpy().view(np.uint64) ^ salt) / 2.0**64
            maybe = np.flatnonzero(chance < most)
            out = []
            for key, c in zip(b.column("key").take(pa.array(maybe)).to_pylist(), chance[maybe], strict=True):
                k = bisect_left(lows, key) - 1
                if k >= 0 and c < rates[k] and (not intervals[k][1] or key < intervals[k][1]):
                    out.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["key"])

    return run


def _count(shared):
    """Bytes between neighbouring probes: (number of the probe that is the first above the keys, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = shared.value
        total = np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            np.add.at(total, [bisect_right(probes, k) for k in _keys(b)], b.column("bytes").to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "bytes"])

    return run


@dataclass
class Interval:
    """Bounds with the bytes below them, the splitters first to end that lie between, and how often it gave no key. Low '' has nothing below it; high '' has no end."""

    low: str
    low_bytes: int
    high: str
    high_bytes: int
    first: int
    end: int
    missed: int = 0


def narrowed(x: Interval, tried: list[str], below: np.ndarray, goals: np.ndarray, slack: float, chosen: list[str | None]) -> list[Interval]:
    """What is left open of an interval after probes inside it, with the bytes below each. Splitters that are settled are put in ``chosen``."""
    after = np.searchsorted(below, goals[x.first : x.end], "right")
    edges = np.append(np.flatnonzero(np.diff(after, prepend=-1)), len(after))
    out = []
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        k = int(after[a])
        low = (tried[k - 1], int(below[k - 1])) if k else (x.low, x.low_bytes)
        high = (tried[k], int(below[k])) if k < len(tried) else (x.high, x.high_bytes)
        a, z = a + x.first, z + x.first
        while a < z and low[0] and goals[a] - low[1] <= slack:
            chosen[a] = low[0]
            a += 1
        while a < z and high[0] and high[1] - goals[z - 1] <= slack:
            chosen[z - 1] = high[0]
            z -= 1
        if a < z:
            out.append(Interval(*low, *high, a, z))
    return out


def splitters(keyed: DataFrame, shards: int, total: int, rows: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[str]:
    """Keys that begin the second and later shards, from rows (key, hash, bytes)."""
    sc = keyed.sparkSession.sparkContext
    goals = np.array([total * i // shards for i in range(1, shards)], np.int64)
    chosen: list[str | None] = [None] * len(goals)
    slack, mean, seed = tolerance * total / max(1, shards), max(1.0, total / max(1, rows)), 0
    open_ = [Interval("", 0, "", total, 0, len(goals))] if len(goals) else []
    while open_:
        # few keys may have all the bytes of an interval that gave none, so its rate rises until all keys in it are proposed
        rates = [probes * (x.end - x.first) / max(1.0, (x.high_bytes - x.low_bytes) / mean) * 8.0**x.missed for x in open_]
        asked = sc.broadcast([(x.low, x.high, r) for x, r in zip(open_, rates, strict=True)])
        tried = sorted(r["key"] for r in keyed.mapInArrow(_propose(asked, seed), "key string").distinct().collect())
        asked.destroy()
        seed += 1
        below = np.zeros(len(tried) + 1, np.int64)
        if tried:
            given = sc.broadcast(tried)
            for r in keyed.mapInArrow(_count(given), "at long, bytes long").groupBy("at").agg(F.sum("bytes").alias("bytes")).collect():
                below[r["at"]] = r["bytes"]
            given.destroy()
        below = np.cumsum(below)
        left: list[Interval] = []
        for x, rate in zip(open_, rates, strict=True):
            a, z = bisect_right(tried, x.low), bisect_left(tried, x.high) if x.high else len(tried)
            if a < z:
                left += narrowed(x, tried[a:z], below[a:z], goals, slack, chosen)
            elif rate >= 1:  # no key lies between the bounds
                for i in range(x.first, x.end):
                    chosen[i] = x.low if not x.high or goals[i] - x.low_bytes <= x.high_bytes - goals[i] else x.high
            else:
                left.append(replace(x, missed=x.missed + 1))
        open_ = left
    return [c for c in chosen if c is not None]


def shard(docs: DataFrame, keys: list[str], shard_bytes: int | None = None, tolerance: float = TOLERANCE, text: str = "text", name: str = "shard") -> DataFrame:
    """The documents with the number of their shard; partition i holds shard i, sorted by the keys."""
    spark = docs.sparkSession
    key = free_name(docs, "shard_key")
    coded = docs.withColumn(key, F.concat(*[sortable(docs, k) for k in keys], F.lpad(F.hex(F.xxhash64(text)), 16, "0")))
    keyed, path = store(coded.select(F.col(key).alias("key"), F.xxhash64(key).alias("hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")))
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = max(1, -(-total // (shard_bytes or max(SHARD_BYTES, -(-total // MOST_SHARDS)))))
    cuts = spark.sparkContext.broadcast(splitters(keyed, shards, total, rows, tolerance) if shards > 1 else [])
    discard(spark, path)

    @F.arrow_udf("int")
    def number(column: pa.Array) -> pa.Array:
        return pa.array([bisect_right(cuts.value, k) for k in column.to_pylist()], pa.int32())

    out = free_name(docs, name)
    moved = coded.withColumn(out, number(F.col(key))).repartitionById(shards, F.col(out)).sortWithinPartitions(key)
    return moved.select(*docs.columns, out)
