"""As-of joins: each left row with the nearest right row at or before (or after) it, within its keys.

Both sides are united, sorted once by keys and time, and the last right row seen is carried along: one shuffle by the keys, no pairs. Without keys the rows are
parted into ranges of time, up to ``RANGES`` by quantiles, and the last right row of the ranges before goes to each range, a row for each."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import flat, quoted


RANGES = 200
#: Types that have quantiles.
_SPREAD = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _by(by: Any, by_left: Any, by_right: Any) -> tuple[list[str], list[str]]:
    both, left, right = flat([by]), flat([by_left]), flat([by_right])
    if both and (left or right):
        raise ValueError("`by` can't go with `by_left` or `by_right`")
    if both:
        return both, both
    if bool(left) != bool(right):
        raise ValueError("`by_left` and `by_right` must be specified together")
    if len(left) != len(right):
        raise ValueError("`by_left` and `by_right` must have the same length")
    return left, right


def asof(left: DataFrame, right: DataFrame, on: str | None, left_on: str | None, right_on: str | None, by: Any, by_left: Any, by_right: Any, strategy: str, suffix: str) -> DataFrame:
    """A left join. The right ``on`` column is dropped if it is given as ``on``, right ``by`` columns always; of right rows at the same time the last stays."""
    if on is not None and (left_on is not None or right_on is not None):
        raise ValueError("`on` can't go with `left_on` or `right_on`")
    if on is None and (left_on is None or right_on is None):
        raise ValueError("either `on`, or `left_on` and `right_on` must be specified")
    if strategy not in ("backward", "forward"):
        raise ValueError(f"unknown strategy {strategy!r}")
    lt, rt = (on, on) if on is not None else (left_on, right_on)
    lk, rk = _by(by, by_left, by_right)
    gone = set(rk) | ({rt} if on is not None else set())
    names = [f"k{i}" for i in range(len(lk))]
    none = lambda df: F.lit(None).cast(df.select(F.struct(*[quoted(c) for c in df.columns]).alias("x")).schema[0].dataType)
    a = left.select(quoted(lt).alias("t"), *[quoted(c).alias(n) for c, n in zip(lk, names, strict=True)], F.lit(1).alias("side"), F.struct(*[quoted(c) for c in left.columns]).alias("l"), none(right).alias("r"))
    b = right.filter(quoted(rt).isNotNull()).select(quoted(rt).alias("t"), *[quoted(c).alias(n) for c, n in zip(rk, names, strict=True)], F.lit(0).alias("side"), none(left).alias("l"), F.struct(*[quoted(c) for c in right.columns]).alias("r"))
    back = strategy == "backward"
    every = a.unionAll(b)
    ranged = not names and isinstance(every.schema["t"].dataType, _SPREAD)
    if ranged:
        borders = every.agg(F.percentile_approx("t", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("x")).scalar()
        place = F.size(F.filter("borders", lambda x: x <= F.col("t")))
        every = every.withColumn("borders", borders).withColumn("range", F.coalesce(place, F.lit(0)) * (1 if back else -1)).drop("borders")
    window = Window.partitionBy(*(names or ["range"] if ranged else names)).orderBy(F.col("t").asc_nulls_first() if back else F.col("t").desc_nulls_first(), "side").rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("r", F.last("r", ignorenulls=True).over(window)).filter("side = 1")
    if ranged:
        last = (F.max_by if back else F.min_by)("r", "t")
        ends = every.filter("side = 0").groupBy("range").agg(last.alias("end"))
        reached = every.select("range").distinct().join(ends, "range", "left")
        before = reached.select("range", F.last("end", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("end"))
        # as many rows as ranges
        found = found.join(F.broadcast(before), "range").withColumn("r", F.coalesce("r", "end"))
    keyed = F.col("t").isNotNull()
    for n in names:
        keyed &= F.col(n).isNotNull()
    cols = [F.col("l").getField(c).alias(c) for c in left.columns]
    cols += [F.when(keyed, F.col("r").getField(c)).alias(c + suffix if c in left.columns else c) for c in right.columns if c not in gone]
    return found.select(*cols)
