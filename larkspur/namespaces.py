"""Functions of texts, lists, structs, names and times."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import Expr, Kind, Scope, as_expr, flat
from .functions import scalar
from .functions.formats import java_pattern, java_replacement, quoted


class _Namespace:
    def __init__(self, expr: Expr) -> None:
        self._e = expr

    def _map(self, f: Callable[..., Column], *args: Any) -> Expr:
        return self._e._map(f, *args)


@F.pandas_udf("string")
def _composed(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


class Str(_Namespace):
    def join(self, delimiter: str = "", *, ignore_nulls: bool = True) -> Expr:
        def make(a: Column, over: Any) -> Column:
            out = over.listagg(a) if delimiter == "" else F.array_join(over.collect_list(a), delimiter)
            some = F.when(over.count(a) > 0, out)
            return some if ignore_nulls else F.when(over.count_if(a.isNull()) == 0, some)

        return self._e._parts(make)

    def escape_regex(self) -> Expr:
        return self._map(lambda a: F.regexp_replace(a, r"([.^$*+?{}\[\]\\|()])", r"\\$1"))

    def to_uppercase(self) -> Expr:
        return self._map(F.upper)

    def to_lowercase(self) -> Expr:
        return self._map(F.lower)

    def len_chars(self) -> Expr:
        return self._map(F.char_length)

    def len_bytes(self) -> Expr:
        return self._map(F.octet_length)

    def contains(self, pattern: Any, *, literal: bool = False) -> Expr:
        return self._map(F.contains if literal else F.rlike, pattern)

    def starts_with(self, prefix: Any) -> Expr:
        return self._map(F.startswith, prefix)

    def ends_with(self, suffix: Any) -> Expr:
        return self._map(F.endswith, suffix)

    def replace(self, pattern: Any, value: Any, *, literal: bool = False, n: int = 1) -> Expr:
        """Nothing for n=0, all matches of a regular expression for n<0; else all occurrences of the literal pattern, n times over."""
        if n == 0:
            return self._e
        if n < 0:
            return self.replace_all(pattern, value, literal=literal)
        out = self._e
        for _ in range(n):
            out = out._map(F.replace, re.escape(pattern) if literal and isinstance(pattern, str) else pattern, value)
        return out

    def replace_all(self, pattern: Any, value: Any, *, literal: bool = False) -> Expr:
        if literal:
            return self._map(F.replace, pattern, value)
        return self._map(F.regexp_replace, pattern, java_replacement(value) if isinstance(value, str) else value)

    def _strip(self, f: Callable, characters: Any) -> Expr:
        return self._map(f) if characters is None else self._map(f, characters)

    def strip_chars(self, characters: Any = None) -> Expr:
        return self._strip(F.btrim, characters)

    def strip_chars_start(self, characters: Any = None) -> Expr:
        return self._strip(F.ltrim, characters)

    def strip_chars_end(self, characters: Any = None) -> Expr:
        return self._strip(F.rtrim, characters)

    def slice(self, offset: int, length: int | None = None) -> Expr:
        start = offset + 1 if offset >= 0 else offset
        return self._map(lambda a: F.substring(a, F.lit(start), F.lit(length) if length is not None else F.char_length(a)))

    def split(self, by: str) -> Expr:
        return self._map(lambda a: F.split(a, quoted(by), -1) if by else F.split(a, "", -1))

    def extract_all(self, pattern: Any) -> Expr:
        return self._map(lambda a, p: F.regexp_extract_all(a, p, F.lit(0)), pattern)

    def extract(self, pattern: str, group_index: int = 1) -> Expr:
        return self._map(lambda a: F.regexp_extract(a, pattern, group_index))

    def find(self, pattern: str, *, literal: bool = False) -> Expr:
        """The place of the first match, from 0; null without one."""

        def make(a: Column) -> Column:
            found = F.lit(pattern) if literal else F.regexp_extract(a, pattern, 0)
            there = F.contains(a, found) if literal else F.rlike(a, F.lit(pattern))
            return F.when(there, F.locate(pattern, a) - 1 if literal else F.call_function("locate", found, a) - 1)

        return self._map(make)

    def json_path_match(self, json_path: str) -> Expr:
        return self._map(lambda a: F.get_json_object(a, json_path))

    def to_date(self, format: str | None = None) -> Expr:  # noqa: A002
        return self._map(lambda a: F.to_date(a, java_pattern(format)) if format else F.to_date(a))

    def to_datetime(self, format: str | None = None) -> Expr:  # noqa: A002
        return self._map(lambda a: F.to_timestamp_ntz(a, F.lit(java_pattern(format))) if format else F.to_timestamp_ntz(a))

    def strptime(self, format: str) -> Expr:  # noqa: A002
        return self.to_datetime(format)

    def to_time(self, format: str | None = None) -> Expr:  # noqa: A002
        return self._map(lambda a: scalar.to_time(a, java_pattern(format) if format else None))

    def encode(self, encoding: str = "base64") -> Expr:
        if encoding not in ("base64", "hex"):
            raise ValueError("`encoding` must be 'base64' or 'hex'")
        return self._map(lambda a: F.base64(F.encode(a, "UTF-8")) if encoding == "base64" else F.lower(F.hex(F.encode(a, "UTF-8"))))

    def normalize(self) -> Expr:
        return self._map(_composed)

    def to_decimal(self, scale: int) -> Expr:
        return self._map(lambda a: a.cast(T.DecimalType(18, scale)))

    def count_matches(self, pattern: str, *, literal: bool = False) -> Expr:
        if literal:
            return self._map(lambda a: (F.char_length(a) - F.char_length(F.replace(a, F.lit(pattern), F.lit("")))) / len(pattern))
        return self._map(lambda a: F.size(F.regexp_extract_all(a, F.lit(pattern), F.lit(0))))

    def strip_prefix(self, prefix: Any) -> Expr:
        return self._map(lambda a, p: F.when(F.startswith(a, p), F.substring(a, F.char_length(p) + 1, F.char_length(a))).otherwise(a), prefix)

    def strip_suffix(self, suffix: Any) -> Expr:
        return self._map(lambda a, p: F.when(F.endswith(a, p), F.substring(a, F.lit(1), F.char_length(a) - F.char_length(p))).otherwise(a), suffix)

    def head(self, n: int) -> Expr:
        return self._map(lambda a: F.substring(a, F.lit(1), F.lit(n) if n >= 0 else F.char_length(a) + n))

    def tail(self, n: int) -> Expr:
        if n >= 0:
            return self._map(lambda a: F.right(a, F.lit(n)))
        return self._map(lambda a: F.substring(a, F.lit(1 - n), F.char_length(a)))

    def reverse(self) -> Expr:
        return self._map(F.reverse)

    def pad_start(self, length: int, fill_char: str = " ") -> Expr:
        return self._map(lambda a: F.lpad(a, length, fill_char))

    def pad_end(self, length: int, fill_char: str = " ") -> Expr:
        return self._map(lambda a: F.rpad(a, length, fill_char))

    def zfill(self, width: int) -> Expr:
        return self.pad_start(width, "0")

    def to_titlecase(self) -> Expr:
        """Each run of letters begins with a capital."""

        def make(a: Column) -> Column:
            parts = F.regexp_extract_all(F.lower(a), F.lit(r"[a-z]+|[^a-z]+"), F.lit(0))
            return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.char_length(x)))), "")

        return self._map(make)


class List(_Namespace):
    def _lambda(self, expr: Expr, f: Callable[[Column, Callable[[Column], Column]], Column]) -> Expr:
        within = as_expr(expr)

        def make(s: Scope) -> Column:
            return f(self._e.column(s), lambda x: within.column(replace(s, element=x)))

        return self._e._with(make)

    def eval(self, expr: Expr) -> Expr:
        return self._lambda(expr, F.transform)

    def filter(self, predicate: Expr) -> Expr:
        return self._lambda(predicate, F.filter)

    def drop_nulls(self) -> Expr:
        return self._map(F.array_compact)

    def contains(self, item: Any) -> Expr:
        return self._map(lambda a, v: F.when(a.isNotNull(), F.coalesce(F.array_contains(a, v), F.lit(False))), item)

    def all(self) -> Expr:
        return self._map(lambda a: F.when(F.size(F.array_compact(a)) > 0, F.forall(F.array_compact(a), lambda x: x)))

    def any(self) -> Expr:
        return self._map(lambda a: F.when(F.size(F.array_compact(a)) > 0, F.exists(F.array_compact(a), lambda x: x)))

    def len(self) -> Expr:
        return self._map(F.array_size)

    def unique(self) -> Expr:
        return self._map(lambda a: F.array_distinct(F.array_compact(a)))

    def reverse(self) -> Expr:
        return self._map(F.reverse)

    def sort(self, *, descending: bool = False, nulls_last: bool = False) -> Expr:
        def make(a: Column) -> Column:
            values = F.sort_array(F.array_compact(a), asc=not descending)
            nulls = F.filter(a, lambda x: x.isNull())
            return F.concat(values, nulls) if nulls_last else F.concat(nulls, values)

        return self._map(make)

    def first(self) -> Expr:
        return self._map(lambda a: F.get(a, F.lit(0)))

    def last(self) -> Expr:
        return self._map(lambda a: F.try_element_at(a, F.lit(-1)))

    def min(self) -> Expr:
        return self._map(F.array_min)

    def max(self) -> Expr:
        return self._map(F.array_max)

    def mean(self) -> Expr:
        return self._map(scalar.list_mean)

    def median(self) -> Expr:
        return self._map(scalar.list_median)

    def sum(self) -> Expr:
        """Floats are added as doubles."""

        def make(s: Scope, a: Column) -> Column:
            kind = s.type_of(a)
            return scalar.list_sum(a.cast("array<double>") if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else a)

        return self._e._typed(make)

    def std(self, ddof: int = 1) -> Expr:
        return self._map(lambda a: F.sqrt(scalar.list_var(a, ddof)))

    def var(self, ddof: int = 1) -> Expr:
        return self._map(lambda a: scalar.list_var(a, ddof))

    def get(self, index: int) -> Expr:
        return self._map(lambda a: F.try_element_at(a, F.lit(index + 1 if index >= 0 else index)))

    def join(self, separator: str, *, ignore_nulls: bool = True) -> Expr:
        if ignore_nulls:
            return self._map(lambda a: F.array_join(a, separator))
        return self._map(lambda a: F.when(~F.exists(a, lambda x: x.isNull()), F.array_join(a, separator)))

    def n_unique(self) -> Expr:
        return self._map(lambda a: F.size(F.array_distinct(F.array_compact(a))))

    def count_matches(self, element: Any) -> Expr:
        return self._map(lambda a, v: F.size(F.filter(a, lambda x: x == v)), element)


class Struct(_Namespace):
    def field(self, name: str) -> Expr:
        return self._e._with(lambda s: self._e.column(s).getField(name), root=name)

    def json_encode(self) -> Expr:
        return self._map(lambda a: F.to_json(a, {"ignoreNullFields": "false"}))

    def with_fields(self, *exprs: Any, **named_exprs: Any) -> Expr:
        given = [as_expr(e, True) for e in flat(exprs)] + [as_expr(v, True).alias(k) for k, v in named_exprs.items()]

        def make(s: Scope) -> Column:
            out = self._e.column(s)
            for e in given:
                for name, value in e.build(s):
                    out = out.withField(name, value)
            return out

        return self._e._with(make, *given)


class Name(_Namespace):
    def _renamed(self, f: Callable[[str], str] | None) -> Expr:
        e = self._e
        return Expr(e._make, e._root, e._kind, f, e._columns)

    def keep(self) -> Expr:
        return self._renamed(None)

    def map(self, function: Callable[[str], str]) -> Expr:
        return self._renamed(function)

    def prefix(self, prefix: str) -> Expr:
        return self._renamed(lambda n: prefix + n)

    def suffix(self, suffix: str) -> Expr:
        return self._renamed(lambda n: n + suffix)

    def to_lowercase(self) -> Expr:
        return self._renamed(str.lower)

    def to_uppercase(self) -> Expr:
        return self._renamed(str.upper)

    def replace(self, pattern: str, value: str, *, literal: bool = False) -> Expr:
        return self._renamed(lambda n: n.replace(pattern, value) if literal else re.sub(pattern, value, n))


_MICROS = 1_000_000


def _micros(a: Column) -> Column:
    return F.unix_micros(a.cast("timestamp_ntz").cast("timestamp"))


def _interval(by: str) -> Column:
    """"1mo2d" or SQL text as an interval."""
    units = {"y": "years", "q": "quarters", "mo": "months", "w": "weeks", "d": "days", "h": "hours", "m": "minutes", "s": "seconds", "ms": "milliseconds", "us": "microseconds"}
    short = re.fullmatch(r"-?(\d+(y|q|mo|w|d|h|ms|us|m|s))+", by)
    if not short:
        return F.expr(f"INTERVAL '{by}'")
    sign = -1 if by.startswith("-") else 1
    parts = [(sign * int(n), u) for n, u in re.findall(r"(\d+)(y|q|mo|w|d|h|ms|us|m|s)", by)]
    return F.expr("INTERVAL '" + " ".join(f"{n * 3 if u == 'q' else n} {'months' if u == 'q' else units[u]}" for n, u in parts) + "'")


class Dt(_Namespace):
    def millennium(self) -> Expr:
        return self._map(lambda a: F.ceil(F.year(a) / 1000))

    def century(self) -> Expr:
        return self._map(lambda a: F.ceil(F.year(a) / 100))

    def iso_year(self) -> Expr:
        return self._map(lambda a: F.extract(F.lit("YEAROFWEEK"), a))

    def weekday(self) -> Expr:
        return self._map(lambda a: F.weekday(a) + 1)

    def microsecond(self) -> Expr:
        return self._map(lambda a: F.pmod(_micros(a), F.lit(_MICROS)))

    def millisecond(self) -> Expr:
        return self._map(lambda a: F.floor(F.pmod(_micros(a), F.lit(_MICROS)) / 1000))

    def nanosecond(self) -> Expr:
        return self._map(lambda a: F.pmod(_micros(a), F.lit(_MICROS)) * 1000)

    def _same_time(self, day: Callable[[Column], Column]) -> Expr:
        def make(s: Scope, a: Column) -> Column:
            if isinstance(s.type_of(a), T.DateType):
                return day(a).cast("date")
            return day(a).cast("timestamp_ntz") + (a - F.date_trunc("day", a).cast("timestamp_ntz"))

        return self._e._typed(make)

    def month_start(self) -> Expr:
        return self._same_time(lambda a: F.date_trunc("month", a))

    def month_end(self) -> Expr:
        return self._same_time(F.last_day)

    def date(self) -> Expr:
        return self._map(lambda a: a.cast("date"))

    def time(self) -> Expr:
        return self._map(scalar.time_of)

    def to_string(self, format: str) -> Expr:  # noqa: A002
        return self._map(lambda a: F.date_format(a, java_pattern(format)))

    strftime = to_string

    def epoch(self, time_unit: str = "us") -> Expr:
        """Days and seconds are doubles; milliseconds are rounded."""
        f = {
            "ns": lambda a: _micros(a) * 1000,
            "us": _micros,
            "ms": lambda a: F.floor((_micros(a) + 500) / 1000),
            "s": lambda a: F.floor(_micros(a) / _MICROS).cast("double"),
            "d": lambda a: F.floor(_micros(a) / (_MICROS * 86400)).cast("double"),
        }.get(time_unit)
        if f is None:
            raise ValueError("`time_unit` must be one of 'ns', 'us', 'ms', 's', 'd'")
        return self._map(f)

    timestamp = epoch

    def truncate(self, every: str) -> Expr:
        """To the beginning of a part by name, as "month"; a timestamp without zone."""
        return self._map(lambda a: F.date_trunc(every, a).cast("timestamp_ntz"))

    round = truncate

    def offset_by(self, by: str) -> Expr:
        return self._map(lambda a: a + _interval(by))


for _name, _f in {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "ordinal_day": F.dayofyear, "hour": F.hour, "minute": F.minute, "second": F.second}.items():
    setattr(Dt, _name, (lambda f: lambda self: self._map(f))(_f))

__all__ = ["Dt", "Kind", "List", "Name", "Str", "Struct"]
