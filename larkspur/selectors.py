"""Columns chosen by type or name, with set algebra; always in the order of the frame, but ``by_name`` in the order given."""

from __future__ import annotations

import builtins
import re
from collections.abc import Callable

from pyspark.sql import types as T

from . import dtypes
from .expr import Expr, Kind, quoted

Choose = Callable[[T.StructType], list[str]]


class Selector(Expr):
    __slots__ = ()

    def __init__(self, choose: Choose) -> None:
        super().__init__(lambda s: quoted(s.name), "selector", Kind.ROW, None, choose)

    def _with_set(self, other: object, f: Callable[[str, set, set], bool], plain: Callable[[], Expr]) -> Expr:
        if not isinstance(other, Selector):
            return plain()
        return Selector(lambda schema: [n for n in schema.names if f(n, set(self._columns(schema)), set(other._columns(schema)))])

    def union(self, other: Selector) -> Expr:
        return self | other

    def intersection(self, other: Selector) -> Expr:
        return self & other

    def difference(self, other: Selector) -> Expr:
        return self - other

    def complement(self) -> Selector:
        return Selector(lambda schema: [n for n in schema.names if n not in set(self._columns(schema))])

    def __or__(self, other: object) -> Expr:
        return self._with_set(other, lambda n, a, b: n in a or n in b, lambda: self.or_(other))

    def __and__(self, other: object) -> Expr:
        return self._with_set(other, lambda n, a, b: n in a and n in b, lambda: self.and_(other))

    def __sub__(self, other: object) -> Expr:
        return self._with_set(other, lambda n, a, b: n in a and n not in b, lambda: self.sub(other))

    def __xor__(self, other: object) -> Expr:
        return self._with_set(other, lambda n, a, b: (n in a) != (n in b), lambda: self.xor(other))

    def __invert__(self) -> Selector:
        return self.complement()


def _types(test: Callable[[dtypes.DataType], bool]) -> Selector:
    return Selector(lambda schema: [f.name for f in schema if test(dtypes.from_spark(f.dataType, f.metadata))])


def _names(test: Callable[[str], bool]) -> Selector:
    return Selector(lambda schema: [n for n in schema.names if test(n)])


def by_dtype(*kinds: object) -> Selector:
    wanted = [k for kind in kinds for k in (kind if isinstance(kind, (builtins.list, tuple)) else [kind])]
    return _types(lambda d: any(d.name == k.__name__ if callable(k) and not isinstance(k, (dtypes.DataType, type)) else d == dtypes.of(k) for k in wanted))


def all() -> Selector:
    return _names(lambda _: True)


def numeric() -> Selector:
    return _types(dtypes.DataType.is_numeric)


def string() -> Selector:
    return _types(lambda d: d.name == "String")


def boolean() -> Selector:
    return _types(lambda d: d.name == "Boolean")


def float() -> Selector:
    return _types(dtypes.DataType.is_float)


def integer() -> Selector:
    return _types(dtypes.DataType.is_integer)


def signed_integer() -> Selector:
    return _types(dtypes.DataType.is_signed_integer)


def unsigned_integer() -> Selector:
    return _types(dtypes.DataType.is_unsigned_integer)


def temporal() -> Selector:
    return _types(dtypes.DataType.is_temporal)


def date() -> Selector:
    return _types(lambda d: d.name == "Date")


def datetime() -> Selector:
    return _types(lambda d: d.name in ("Datetime", "DatetimeTZ"))


def time() -> Selector:
    return _types(lambda d: d.name == "Time")


def duration() -> Selector:
    return _types(lambda d: d.name == "Duration")


def binary() -> Selector:
    return _types(lambda d: d.name == "Binary")


def enum() -> Selector:
    return _types(lambda d: d.name == "Enum")


def decimal() -> Selector:
    return _types(dtypes.DataType.is_decimal)


def nested() -> Selector:
    return _types(dtypes.DataType.is_nested)


def list() -> Selector:
    return _types(lambda d: d.name == "List")


def struct() -> Selector:
    return _types(lambda d: d.name == "Struct")


def matches(pattern: str) -> Selector:
    return _names(lambda n: re.search(pattern, n) is not None)


def by_name(*names: object) -> Selector:
    wanted = [n for name in names for n in ([name] if isinstance(name, str) else name)]
    return Selector(lambda schema: [n for n in wanted if n in schema.names])


def starts_with(*prefix: str) -> Selector:
    return _names(lambda n: n.startswith(prefix))


def ends_with(*suffix: str) -> Selector:
    return _names(lambda n: n.endswith(suffix))


def contains(*substring: str) -> Selector:
    return _names(lambda n: any(s in n for s in substring))
