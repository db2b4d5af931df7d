"""Spark columns for functions whose results differ between engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import active, ensure


def divide(a: Column, b: Column) -> Column:
    """Division of doubles: by zero it gives an infinity or NaN."""
    a, b = a.cast("double"), b.cast("double")
    nothing = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, nothing).otherwise(F.try_divide(a, b))


def int_divide(a: Column, b: Column) -> Column:
    """Division of integers that drops the fraction."""
    return F.call_function("div", a, b)


def is_nan(a: Column) -> Column:
    """Null for null."""
    return F.when(a.isNotNull(), F.isnan(a))


def ln(a: Column) -> Column:
    """Minus infinity of zero."""
    return F.when(a == 0, float("-inf")).otherwise(F.ln(a))


def rounded(a: Column, decimals: int, even: bool) -> Column:
    """A double moved by a power of ten, rounded and moved back, as the SQL does it, not by its decimal text: 1.005 becomes 1.0, since 100 times it is 100.49999999999999. Halves go away from zero, or to the even neighbour."""
    x, power = a.cast("double"), F.lit(10.0 ** abs(decimals))
    moved = x * power if decimals >= 0 else x / power
    near = F.rint(moved)
    whole = near if even else F.when(F.abs(moved - near) == 0.5, moved + F.signum(moved) * 0.5).otherwise(near)
    # too large to be moved
    return F.when(F.abs(moved) < float("inf"), whole / power if decimals >= 0 else whole * power).otherwise(x)


def time_of(a: Column) -> Column:
    """The time of day of a timestamp."""
    ensure(active())
    return F.make_time(F.hour(a), F.minute(a), F.date_format(a, "ss.SSSSSS").cast("decimal(16,6)"))


def to_time(a: Column, pattern: str | None = None) -> Column:
    """A text as a time of day."""
    ensure(active())
    return F.to_time(a, F.lit(pattern)) if pattern else F.to_time(a)


def cast(a: Column, source: T.DataType | None, to: T.DataType) -> Column:
    """Doubles and decimals are rounded, not cut, on the way to integers; so are texts of numbers."""
    if isinstance(to, T.IntegralType):
        if isinstance(source, (T.DoubleType, T.FloatType)):
            return F.bround(a).cast(to)
        if isinstance(source, T.DecimalType):
            return F.round(a).cast(to)
        if isinstance(source, T.StringType):
            return F.bround(a.cast("double")).cast(to)
    if isinstance(to, T.TimeType):
        ensure(active())
        if isinstance(source, T.TimestampNTZType):
            return time_of(a)
        if isinstance(source, T.StringType):
            return to_time(a)
    return a.cast(to)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f mentions it; within a function of elements it would be computed again for each."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# lists


def numbers(a: Column) -> Column:
    return F.array_compact(a)


def list_sum(a: Column) -> Column:
    """Null for a list without values. Floats have to be cast to doubles before."""
    return once(numbers(a), lambda c: F.when(F.size(c) > 0, F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.get(c, F.lit(0)), lambda x, v: x + v)))


def list_mean(a: Column) -> Column:
    return once(numbers(a), lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda x, v: x + v) / F.size(c)))


def list_median(a: Column) -> Column:
    def make(c: Column) -> Column:
        n = F.size(c)
        low, high = F.get(c, ((n - 1) / 2).cast("int")), F.get(c, (n / 2).cast("int"))
        return F.when(n > 0, (low.cast("double") + high.cast("double")) / 2)

    return once(F.array_sort(numbers(a)), make)


def list_quantile_disc(a: Column, q: float) -> Column:
    """The least value whose share of the values up to it reaches q."""
    return once(F.array_sort(numbers(a)), lambda c: F.when(F.size(c) > 0, F.get(c, F.greatest(F.ceil(F.size(c) * F.lit(q)).cast("int") - 1, F.lit(0)))))


def list_var(a: Column, ddof: int) -> Column:
    """In one pass: count, mean and sum of squared differences are carried along."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(s: Column, v: Column) -> Column:
        n, delta = s["n"] + 1, v.cast("double") - s["mean"]
        return F.struct(n.alias("n"), (s["mean"] + delta / n).alias("mean"), (s["squares"] + delta * (v.cast("double") - s["mean"] - delta / n)).alias("squares"))

    d = min(ddof, 1)
    return F.aggregate(numbers(a), start, step, lambda s: F.when(s["n"] > d, s["squares"] / (s["n"] - d)))
