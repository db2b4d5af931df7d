"""More of the SQL function catalogue: aggregates of lists, parts of times, enums and structs, composed of Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar

Make = Callable[..., Column]


def _folded(f: Callable[[Column, Column], Column]) -> Make:
    """The elements of a list joined by f; null for a list without values."""

    def make(c: Column) -> Column:
        return F.when(F.size(c) > 0, F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.get(c, F.lit(0)), f))

    return lambda a: scalar.once(F.array_compact(a), make)


def _counts(c: Column) -> Column:
    """(number, minus the place of the first, value) of each distinct value of a list without nulls."""
    return F.transform(F.array_distinct(c), lambda v: F.struct(F.size(F.filter(c, lambda x: x == v)).alias("n"), (-F.array_position(c, v)).alias("at"), v.alias("v")))


def list_entropy(a: Column) -> Column:
    """In bits, of the shares of the distinct values."""

    def make(c: Column) -> Column:
        n = F.size(c).cast("double")
        return F.when(n > 0, F.aggregate(_counts(c), F.lit(0.0), lambda s, x: s - x["n"] / n * F.log2(x["n"] / n)))

    return scalar.once(F.array_compact(a), make)


def list_mode(a: Column) -> Column:
    """The most frequent value, the first of those."""
    return scalar.once(F.array_compact(a), lambda c: F.array_max(_counts(c)))["v"]


def list_mad(a: Column) -> Column:
    """The median distance from the median."""
    distances = lambda c: scalar.once(scalar.list_median(c), lambda m: F.transform(c, lambda x: F.abs(x - m)))
    return scalar.list_median(scalar.once(F.array_compact(a).cast("array<double>"), distances))


def list_sem(a: Column) -> Column:
    return scalar.once(a, lambda c: F.sqrt(scalar.list_var(c, 0)) / F.sqrt(F.size(F.array_compact(c))))


def _moments(a: Column, finish: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """finish(n, second, third, fourth): the number of values and the means of powers of their distances from the mean."""
    start = F.struct(*[F.lit(0.0).alias(k) for k in "xyz"])

    def step(s: Column, d: Column) -> Column:
        return F.struct((s["x"] + d * d).alias("x"), (s["y"] + d * d * d).alias("y"), (s["z"] + d * d * d * d).alias("z"))

    def make(c: Column) -> Column:
        n = F.size(c).cast("double")
        distances = scalar.once(scalar.list_mean(c), lambda mean: F.transform(c, lambda v: v - mean))
        return F.aggregate(distances, start, step, lambda s: finish(n, s["x"] / n, s["y"] / n, s["z"] / n))

    return scalar.once(F.array_compact(a).cast("array<double>"), make)


def list_skewness(a: Column) -> Column:
    """Adjusted for the sample; null for fewer than three values, NaN for equal ones."""
    out = lambda n, m2, m3, _: F.when(n > 2, F.when(m2 == 0, F.lit(float("nan"))).otherwise(F.sqrt(n * (n - 1)) / (n - 2) * m3 / F.when(m2 == 0, 1.0).otherwise(F.pow(m2, F.lit(1.5)))))
    return _moments(a, out)


def list_kurtosis(a: Column) -> Column:
    """Excess, adjusted for the sample; null for fewer than four values, NaN for equal ones."""

    def out(n: Column, m2: Column, _: Column, m4: Column) -> Column:
        safe = F.when(m2 == 0, 1.0).otherwise(m2)
        return F.when(n > 3, F.when(m2 == 0, F.lit(float("nan"))).otherwise((n - 1) * ((n + 1) * m4 / (safe * safe) - 3 * (n - 1)) / ((n - 2) * (n - 3))))

    return _moments(a, out)


def list_kurtosis_pop(a: Column) -> Column:
    out = lambda n, m2, _, m4: F.when(n > 1, F.when(m2 == 0, F.lit(float("nan"))).otherwise(m4 / F.when(m2 == 0, 1.0).otherwise(m2 * m2) - 3))
    return _moments(a, out)


def parse_formatted_bytes(a: Column) -> Column:
    """A number of bytes from texts as "1.5 KiB" or "2 MB"; null for others."""
    number, unit = F.regexp_extract(a, r"^\s*([0-9.]+)\s*([A-Za-z]*)\s*$", 1), F.lower(F.regexp_extract(a, r"^\s*([0-9.]+)\s*([A-Za-z]*)\s*$", 2))
    powers = {"": 1, "b": 1, "byte": 1, "bytes": 1}
    for k, letter in enumerate("kmgtp", 1):
        powers |= {letter: 1000**k, f"{letter}b": 1000**k, f"{letter}ib": 1024**k}
    factor = F.lit(None).cast("double")
    for name, p in powers.items():
        factor = F.when(unit == name, F.lit(float(p))).otherwise(factor)
    return F.floor(F.when(number != "", number).try_cast("double") * factor).cast("long")


def _uuid_millis(a: Column) -> Column:
    return F.conv(F.concat(F.substring(a, 1, 8), F.substring(a, 10, 4)), 16, 10).cast("long")


SCALARS: dict[str, Make] = {
    "list_bit_and": _folded(lambda x, v: x.bitwiseAND(v)), "list_bit_or": _folded(lambda x, v: x.bitwiseOR(v)), "list_bit_xor": _folded(lambda x, v: x.bitwiseXOR(v)), "list_entropy": list_entropy, "list_mode": list_mode,
    "list_mad": list_mad, "list_sem": list_sem, "list_skewness": list_skewness, "list_kurtosis": list_kurtosis, "list_kurtosis_pop": list_kurtosis_pop, "list_approx_count_distinct": lambda a: F.size(F.array_distinct(F.array_compact(a))),
    "list_element": lambda a, i: F.try_element_at(a, i.cast("int")), "array_to_string_comma_default": lambda a, sep=None: F.array_join(a.cast("array<string>"), ",") if sep is None else F.call_function("array_join", a.cast("array<string>"), sep),
    "generate_subscripts": lambda a, dim=None: F.explode(F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a)))), "regexp_split_to_table": lambda a, p: F.explode(F.split(a, p)), "from_binary": lambda a: F.conv(a, 2, 10).cast("long"),
    "days_in_month": lambda a: F.dayofmonth(F.last_day(a)), "timezone": lambda zone, a: F.to_utc_timestamp(a, zone), "timezone_minute": lambda a: F.floor((F.unix_micros(a.cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.to_utc_timestamp(a, F.current_timezone()))) / 60_000_000) % 60,
    "parse_formatted_bytes": parse_formatted_bytes, "uuid_extract_version": lambda a: F.conv(F.substring(a, 15, 1), 16, 10).cast("int"), "uuid_extract_timestamp": lambda a: F.when(F.substring(a, 15, 1) == "7", F.timestamp_millis(_uuid_millis(a))),
    "variant_extract": lambda a, path: F.call_function("try_variant_get", a, path, F.lit("variant")), "json_group_structure": lambda a: F.schema_of_json(a), "row": lambda *cs: F.struct(*cs), "error": lambda a: F.raise_error(a),
    "equi_width_bins": lambda lo, hi, n, nice=None: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: lo + (hi - lo) * k / n),
}


def enum_first(categories: list[str]) -> Any:
    from ..expr import as_expr

    return as_expr(categories[0])


def enum_last(categories: list[str]) -> Any:
    from ..expr import as_expr

    return as_expr(categories[-1])


def enum_range_boundary(start: str | None, end: str | None, categories: list[str]) -> Any:
    """The categories from start to end; None is the first or the last."""
    from ..expr import as_expr

    a = 0 if start is None else categories.index(start)
    return as_expr(categories[a : len(categories) if end is None else categories.index(end) + 1])


def struct_concat(*structs: Any) -> Any:
    """One struct with the fields of all."""
    from ..expr import as_expr

    first, *rest = map(as_expr, structs)

    def make(s: Any, *cs: Column) -> Column:
        return F.struct(*[c.getField(f.name).alias(f.name) for c in cs for f in s.type_of(c)])

    return first._typed(make, *rest)


def struct_extract_at(e: Any, place: int) -> Any:
    """The field at a place, from 1."""
    from ..expr import as_expr

    return as_expr(e)._typed(lambda s, a: a.getField(s.type_of(a)[place - 1].name))


def cast_to_type(e: Any, like: Any) -> Any:
    """A value cast to the type of another."""
    from ..expr import as_expr

    return as_expr(e)._typed(lambda s, a, b: scalar.cast(a, s.type_of(a), s.type_of(b)), like)


def histogram_exact(e: Any, bins: list[Any]) -> Any:
    """How often each of the given values occurs in a group, as a map; the rest under null's place, the key ``other``."""
    from ..expr import as_expr

    def make(a: Column) -> Column:
        counts = [F.count_if(a == b) for b in bins]
        rest = F.count_if(a.isNotNull() & ~a.isin(*bins))
        return F.map_from_arrays(F.array(*[F.lit(str(b)) for b in bins], F.lit("other")), F.array(*counts, rest))

    return as_expr(e)._agg(make)


def union_value(**member: Any) -> Any:
    """A union with one member: a struct of its tag and value."""
    from ..expr import as_expr

    ((name, value),) = member.items()
    return as_expr(value)._map(lambda a: F.struct(F.lit(name).alias("tag"), a.alias(name)))


def list_sum(a: Any) -> Expr:
    from ..expr import as_expr

    return as_expr(a).list.sum()


BUILDERS = {f.__name__: f for f in (enum_first, enum_last, enum_range_boundary, struct_concat, struct_extract_at, cast_to_type, histogram_exact, union_value, list_sum)} | {"array_sum": list_sum}
