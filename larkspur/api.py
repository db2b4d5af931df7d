"""Module-level functions: literals, aggregates of columns, horizontal functions and conditions."""

from __future__ import annotations

import builtins
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Expr, Kind, Scope, as_expr, col, flat, literal, quoted

__all__ = ["all", "all_horizontal", "any_horizontal", "coalesce", "col", "element", "len", "lit", "max", "max_horizontal", "mean", "mean_horizontal", "median", "min", "min_horizontal", "sum", "sum_horizontal", "when"]


def lit(value: Any) -> Expr:
    return literal(value)


def len() -> Expr:
    return Expr(lambda s: F.count(F.lit(1)), "len", Kind.SCALAR)


def all(exclude: Any = None) -> Expr:
    """Every column of the frame, but for those excluded."""
    gone = {e if isinstance(e, str) else e._root for e in flat([exclude])}
    return Expr(lambda s: quoted(s.name), "all", Kind.ROW, None, lambda schema: [n for n in schema.names if n not in gone])


def _columns(names: tuple) -> Expr:
    wanted = flat(names)
    return Expr(lambda s: quoted(s.name), wanted[0] if wanted else "all", Kind.ROW, None, lambda schema: wanted or schema.names)


def sum(*cols: Any) -> Expr:
    return _columns(cols).sum()


def mean(*cols: Any) -> Expr:
    return _columns(cols).mean()


def median(*cols: Any) -> Expr:
    return _columns(cols).median()


def min(*cols: Any) -> Expr:
    return _columns(cols).min()


def max(*cols: Any) -> Expr:
    return _columns(cols).max()


def _horizontal(exprs: tuple, f: Callable[[list[Column]], Column]) -> Expr:
    first, *rest = [as_expr(e, True) for e in flat(exprs)]
    return first._with(lambda s: f([c for e in (first, *rest) for _, c in e.build(s)]), *rest)


def coalesce(*exprs: Any) -> Expr:
    return _horizontal(exprs, lambda cs: F.coalesce(*cs))


def sum_horizontal(*exprs: Any) -> Expr:
    """Nulls count as 0, but a null in the first column makes the sum null."""
    return _horizontal(exprs, lambda cs: reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), cs))


def min_horizontal(*exprs: Any) -> Expr:
    return _horizontal(exprs, lambda cs: F.least(*cs) if cs[1:] else cs[0])


def max_horizontal(*exprs: Any) -> Expr:
    return _horizontal(exprs, lambda cs: F.greatest(*cs) if cs[1:] else cs[0])


def mean_horizontal(*exprs: Any) -> Expr:
    def make(cs: list[Column]) -> Column:
        total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cs])
        return F.try_divide(total.cast("double"), reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs]))

    return _horizontal(exprs, make)


def all_horizontal(*exprs: Any) -> Expr:
    return _horizontal(exprs, lambda cs: reduce(lambda a, b: a & b, cs))


def any_horizontal(*exprs: Any) -> Expr:
    return _horizontal(exprs, lambda cs: reduce(lambda a, b: a | b, cs))


def element() -> Expr:
    """The element of a list, within ``list.eval`` and ``list.filter``."""

    def make(s: Scope) -> Column:
        if s.element is None:
            raise ValueError("element() only has a meaning within list.eval and list.filter")
        return s.element

    return Expr(make, "element", Kind.ROW)


def _condition(predicates: tuple) -> Expr:
    first, *rest = [as_expr(p, True) for p in flat(predicates)]
    return first.and_(*rest) if rest else first


def when(*predicates: Any) -> When:
    return When((), _condition(predicates))


class When:
    def __init__(self, done: tuple[tuple[Expr, Expr], ...], condition: Expr) -> None:
        self._done, self._condition = done, condition

    def then(self, value: Any) -> Then:
        return Then((*self._done, (self._condition, as_expr(value))))


class Then:
    """Null where no condition holds, unless ``otherwise`` says more."""

    def __init__(self, done: tuple[tuple[Expr, Expr], ...]) -> None:
        self._done = done

    def when(self, *predicates: Any) -> When:
        return When(self._done, _condition(predicates))

    def otherwise(self, value: Any) -> Expr:
        return self._built(as_expr(value))

    def alias(self, name: str) -> Expr:
        return self._finish().alias(name)

    def _finish(self) -> Expr:
        return self._built(None)

    def _built(self, rest: Expr | None) -> Expr:
        parts = [e for pair in self._done for e in pair] + ([rest] if rest is not None else [])

        def make(s: Scope) -> Column:
            out = reduce(lambda f, p: f.when(p[0].column(s), p[1].column(s)), self._done, F)
            return out.otherwise(rest.column(s)) if rest is not None else out

        return Expr(make, "literal", builtins.max(e._kind for e in parts))
