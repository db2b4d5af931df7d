"""Operators on the order and number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..expr import quoted


def explode(df: DataFrame, names: list[str], outer: bool = True) -> DataFrame:
    """A row for each element, in one pass; several lists go side by side. Empty and null lists keep a row of nulls if ``outer``."""
    if len(names) == 1:
        f = F.explode_outer if outer else F.explode
        return df.select(*[f(quoted(c)).alias(c) if c == names[0] else quoted(c) for c in df.columns])
    zipped = F.arrays_zip(*[quoted(c).alias(f"_{k}") for k, c in enumerate(names)])
    long = df.select(*[quoted(c) for c in df.columns if c not in names], (F.explode_outer if outer else F.explode)(zipped).alias("__zipped"))
    return long.select(*[F.col("__zipped").getField(f"_{names.index(c)}").alias(c) if c in names else quoted(c) for c in df.columns])


SPLITS, LEVELS, SAMPLES = 16, 3, 4


def indexed(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """A first column with the place of each row in an ascending order with nulls first, from 0; without order the rows as they come.

    Rows are numbered within ranges of their keys, and the sizes of the ranges before, a row each, are added: no task sorts all rows, as under a
    window without keys. The borders, up to 16 to the power of 3, are a subquery over the keys with the least hashes, a bounded number; a row finds its range in three steps of 16. Nothing
    runs before the frame does."""
    keys = order or [F.monotonically_increasing_id()]
    keyed = df.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("__key"), *[quoted(c) for c in df.columns])
    picked = keyed.select("__key").orderBy(F.xxhash64("__key")).limit(SPLITS**LEVELS * SAMPLES)
    every = lambda n: lambda _, i: i % n == n - 1
    fine = picked.agg(F.array_sort(F.collect_list("__key")).alias("x")).select(F.filter("x", every(SAMPLES)).alias("x"))
    borders = fine.select(F.array(*[F.filter("x", every(SPLITS ** (LEVELS - k))) for k in range(1, LEVELS)], F.col("x")).alias("x"))
    # folded over the levels, so that no step is written out twice; never null, or the join below would look for nulls by finding the ranges once more
    within = lambda r, level: r * SPLITS + F.size(F.filter(F.slice(level, r * SPLITS + 1, SPLITS), lambda b: b <= F.col("__key")))
    ranged = keyed.withColumn("__borders", borders.scalar()).withColumn("__range", F.coalesce(F.aggregate("__borders", F.lit(0), within), F.lit(0))).drop("__borders")
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    placed = ranged.withColumn("__place", F.row_number().over(Window.partitionBy("__range").orderBy("__key")) - 1)
    # as many rows as ranges
    return placed.join(F.broadcast(offsets), "__range").select((F.col("__offset") + F.col("__place")).alias(name), *[quoted(c) for c in df.columns])


def from_end(df: DataFrame, back: int, length: int | None, order: list[Column]) -> DataFrame:
    """Rows that begin so many rows before the end."""
    place = indexed(df, "__at", order)
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    keep = F.col("__at") >= F.col("__total") - back
    if length is not None:
        keep &= F.col("__at") < F.col("__total") - back + length
    # the total is one row
    return place.crossJoin(F.broadcast(total)).filter(keep).select(*[quoted(c) for c in df.columns])
