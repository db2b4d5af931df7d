"""Column expressions: built lazily, once the frame and the window they are used in are known."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from enum import IntEnum
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dtypes
from .functions import scalar


class Kind(IntEnum):
    """What an expression gives: a value a row, one value, a value a row that needs other rows, or the distinct values."""

    LITERAL = 0
    SCALAR = 1
    ROW = 2
    WINDOW = 3
    UNIQUE = 4


@dataclass(frozen=True)
class Over:
    """The window that ``over`` gives to the functions within."""

    partition: tuple[Column, ...] = ()
    order: tuple[Column, ...] = ()
    given: bool = False

    def spec(self, start: int | None = None, end: int | None = None, order: Sequence[Column] | None = None) -> Any:
        """A window ordered as told, or by the rows as they come, with a frame of rows if there is one."""
        by = tuple(order) if order is not None else self.order or (F.monotonically_increasing_id(),)
        out = Window.partitionBy(*self.partition).orderBy(*by)
        return out.rowsBetween(start, end) if start is not None else out

    def whole(self) -> Any:
        out = Window.partitionBy(*self.partition)
        return out.orderBy(*self.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if self.order else out


@dataclass(frozen=True)
class Scope:
    """Where an expression is built: its frame, the column a multi-column expression stands for, the window, the element of a list."""

    df: DataFrame | None = None
    name: str | None = None
    over: Over = Over()
    element: Column | None = None

    def type_of(self, column: Column) -> T.DataType | None:
        """The column's type, where a frame is known."""
        if self.df is None or self.element is not None:
            return None
        return self.df.select(column.alias("x")).schema[0].dataType


Make = Callable[[Scope], Column]
START, END = Window.unboundedPreceding, Window.unboundedFollowing


def flat(values: Iterable[Any]) -> list[Any]:
    """Arguments, of which each may be a list or another iterable of arguments; None counts as nothing."""
    out: list[Any] = []
    for v in values:
        if v is None:
            continue
        if isinstance(v, (str, bytes, Expr, dict)) or not isinstance(v, Iterable):
            out.append(v)
        else:
            out.extend(v)
    return out


def as_expr(value: Any, as_col: bool = False) -> Expr:
    """An expression of a value; a string is a column's name where ``as_col``."""
    if isinstance(value, Expr):
        return value
    if isinstance(value, Column):
        return Expr(lambda s: value, "column", Kind.ROW)
    if hasattr(value, "_finish"):
        return value._finish()
    return named(value) if as_col and isinstance(value, str) else literal(value)


def literal(value: Any) -> Expr:
    def make(scope: Scope) -> Column:
        if isinstance(value, dict):
            return F.struct(*[F.lit(v).alias(k) for k, v in value.items()])
        if isinstance(value, (list, tuple)):
            return F.array(*[F.lit(v) for v in value])
        return F.lit(value)

    return Expr(make, "literal", Kind.LITERAL)


def named(name: str) -> Expr:
    return Expr(lambda s: quoted(name), name, Kind.ROW)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def nulls_placed(column: Column, descending: bool, nulls_last: bool) -> Column:
    if descending:
        return column.desc_nulls_last() if nulls_last else column.desc_nulls_first()
    return column.asc_nulls_last() if nulls_last else column.asc_nulls_first()


class Expr:
    """An expression. ``root`` is the name of the column it comes from; ``columns`` gives the columns that one of several columns stands for."""

    __slots__ = ("_columns", "_kind", "_make", "_rename", "_root")

    def __init__(self, make: Make, root: str, kind: Kind = Kind.ROW, rename: Callable[[str], str] | None = None, columns: Callable[[T.StructType], list[str]] | None = None) -> None:
        self._make, self._root, self._kind, self._rename, self._columns = make, root, kind, rename, columns

    def __repr__(self) -> str:
        return f"Expr({self._root})"

    # building

    def build(self, scope: Scope) -> list[tuple[str, Column]]:
        """The columns and their names."""
        names = [self._root] if self._columns is None else self._columns(scope.df.schema)
        rename = self._rename or (lambda n: n)
        return [(rename(n), self._make(replace(scope, name=n))) for n in names]

    def column(self, scope: Scope) -> Column:
        return self._make(scope)

    def _with(self, make: Make, *others: Expr, kind: Kind | None = None, root: str | None = None) -> Expr:
        many = next((e._columns for e in (self, *others) if e._columns), None)
        return Expr(make, root or self._root, kind if kind is not None else max([self._kind, *(o._kind for o in others)]), self._rename, many)

    def _map(self, f: Callable[..., Column], *args: Any, as_col: bool = False) -> Expr:
        """f over this and other columns."""
        rest = [as_expr(a, as_col) for a in args]
        return self._with(lambda s: f(self.column(s), *[r.column(s) for r in rest]), *rest)

    def _typed(self, f: Callable[..., Column], *args: Any) -> Expr:
        """f(scope, columns...)."""
        rest = [as_expr(a) for a in args]
        return self._with(lambda s: f(s, self.column(s), *[r.column(s) for r in rest]), *rest)

    def _agg(self, f: Callable[..., Column], *args: Any) -> Expr:
        """An aggregate: over the whole window where there is one."""
        rest = [as_expr(a, True) for a in args]

        def make(s: Scope) -> Column:
            inner = replace(s, over=Over())
            out = f(self.column(inner), *[r.column(inner) for r in rest])
            return _over_whole(out, s.over) if s.over.given else out

        return self._with(make, *rest, kind=Kind.SCALAR)

    def _window(self, f: Callable[[Scope, Column], Column]) -> Expr:
        return self._with(lambda s: f(s, self.column(replace(s, over=Over()))), kind=Kind.WINDOW)

    def pipe(self, f: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        return f(self, *args, **kwargs)

    # namespaces

    @property
    def str(self):
        from .namespaces import Str

        return Str(self)

    @property
    def list(self):
        from .namespaces import List

        return List(self)

    @property
    def arr(self):
        from .namespaces import List

        return List(self)

    @property
    def struct(self):
        from .namespaces import Struct

        return Struct(self)

    @property
    def name(self):
        from .namespaces import Name

        return Name(self)

    @property
    def dt(self):
        from .namespaces import Dt

        return Dt(self)

    # operators

    def add(self, other: Any) -> Expr:
        return self._map(lambda a, b: a + b, other)

    def sub(self, other: Any) -> Expr:
        return self._map(lambda a, b: a - b, other)

    def mul(self, other: Any) -> Expr:
        return self._map(lambda a, b: a * b, other)

    def truediv(self, other: Any) -> Expr:
        return self._map(scalar.divide, other)

    def floordiv(self, other: Any) -> Expr:
        """Integers lose the fraction; of other numbers it is the quotient as it is. Division by zero is an error."""

        def make(s: Scope, a: Column, b: Column) -> Column:
            if any(isinstance(t, (T.FractionalType,)) for t in (s.type_of(a), s.type_of(b))):
                return a.cast("double") / b.cast("double")
            return scalar.int_divide(a, b)

        return self._typed(make, other)

    def mod(self, other: Any) -> Expr:
        return self._map(lambda a, b: a % b, other)

    def pow(self, other: Any) -> Expr:
        return self._map(F.pow, other)

    def neg(self) -> Expr:
        return self._map(lambda a: -a)

    def abs(self) -> Expr:
        return self._map(F.abs)

    def eq(self, other: Any) -> Expr:
        return self._map(lambda a, b: a == b, other)

    def ne(self, other: Any) -> Expr:
        return self._map(lambda a, b: a != b, other)

    def lt(self, other: Any) -> Expr:
        return self._map(lambda a, b: a < b, other)

    def le(self, other: Any) -> Expr:
        return self._map(lambda a, b: a <= b, other)

    def gt(self, other: Any) -> Expr:
        return self._map(lambda a, b: a > b, other)

    def ge(self, other: Any) -> Expr:
        return self._map(lambda a, b: a >= b, other)

    def and_(self, *others: Any) -> Expr:
        return reduce(lambda x, y: x._map(lambda a, b: a & b, y), flat(others), self)

    def or_(self, *others: Any) -> Expr:
        return reduce(lambda x, y: x._map(lambda a, b: a | b, y), flat(others), self)

    def not_(self) -> Expr:
        return self._map(lambda a: ~a)

    def xor(self, other: Any) -> Expr:
        return self._typed(lambda s, a, b: a != b if isinstance(s.type_of(a), T.BooleanType) else a.bitwiseXOR(b), other)

    def _swapped(self, f: str, other: Any) -> Expr:
        return getattr(as_expr(other), f)(self)

    __add__, __sub__, __mul__, __truediv__, __floordiv__, __mod__, __pow__ = add, sub, mul, truediv, floordiv, mod, pow
    __neg__, __abs__, __invert__ = neg, abs, not_
    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = eq, ne, lt, le, gt, ge  # type: ignore[assignment]
    __and__, __or__, __xor__ = and_, or_, xor
    __hash__ = object.__hash__

    def __radd__(self, other: Any) -> Expr:
        return self._swapped("add", other)

    def __rsub__(self, other: Any) -> Expr:
        return self._swapped("sub", other)

    def __rmul__(self, other: Any) -> Expr:
        return self._swapped("mul", other)

    def __rtruediv__(self, other: Any) -> Expr:
        return self._swapped("truediv", other)

    def __rfloordiv__(self, other: Any) -> Expr:
        return self._swapped("floordiv", other)

    def __rmod__(self, other: Any) -> Expr:
        return self._swapped("mod", other)

    def __rpow__(self, other: Any) -> Expr:
        return self._swapped("pow", other)

    def __rand__(self, other: Any) -> Expr:
        return self._swapped("and_", other)

    def __ror__(self, other: Any) -> Expr:
        return self._swapped("or_", other)

    def __rxor__(self, other: Any) -> Expr:
        return self._swapped("xor", other)

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use & and | with brackets")

    def alias(self, name: str) -> Expr:
        return Expr(self._make, self._root, self._kind, lambda _: name, self._columns)

    # scalar functions

    def cast(self, dtype: Any) -> Expr:
        kind = dtypes.of(dtype)

        def make(s: Scope, a: Column) -> Column:
            return scalar.cast(a, s.type_of(a), kind.spark)

        return self._typed(make)

    def is_null(self) -> Expr:
        return self._map(F.isnull)

    def is_not_null(self) -> Expr:
        return self._map(F.isnotnull)

    def is_in(self, other: Any) -> Expr:
        values = [as_expr(v) for v in flat([other])]
        if not values:
            return self._map(lambda a: F.when(a.isNotNull(), False))
        return self._map(lambda a, *v: a.isin(*v), *values)

    def is_between(self, lower_bound: Any, upper_bound: Any, closed: str = "both") -> Expr:
        low = self.ge if closed in ("both", "left") else self.gt
        high = self.le if closed in ("both", "right") else self.lt
        return low(as_expr(lower_bound, True)).and_(high(as_expr(upper_bound, True)))

    def clip(self, lower_bound: Any = None, upper_bound: Any = None) -> Expr:
        out = self
        if lower_bound is not None:
            out = out._map(F.greatest, lower_bound)
        return out._map(F.least, upper_bound) if upper_bound is not None else out

    def is_close(self, other: Any, abs_tol: float = 1e-8, rel_tol: float = 1e-5, *, nans_equal: bool = False) -> Expr:
        def make(a: Column, b: Column) -> Column:
            near = F.abs(a - b) <= F.lit(abs_tol) + F.lit(rel_tol) * F.abs(b)
            return near | (F.isnan(a) & F.isnan(b)) if nans_equal else near

        return self._map(make, other)

    def is_nan(self) -> Expr:
        return self._map(scalar.is_nan)

    def is_not_nan(self) -> Expr:
        return self._map(lambda a: ~scalar.is_nan(a))

    def is_finite(self) -> Expr:
        return self._map(lambda a: ~scalar.is_nan(a) & (F.abs(a) < float("inf")))

    def is_infinite(self) -> Expr:
        return self._map(lambda a: F.abs(a) == float("inf"))

    def fill_nan(self, value: Any) -> Expr:
        return self._map(lambda a, v: F.when(F.isnan(a), v).otherwise(a), value)

    def hash(self, seed: int = 0) -> Expr:
        return self._map(lambda a: F.xxhash64(a, F.lit(seed)) if seed else F.xxhash64(a))

    def replace(self, old: Any, new: Any) -> Expr:
        return self._map(lambda a, o, n: F.when(a == o, n).otherwise(a), old, new)

    def repeat_by(self, by: Any) -> Expr:
        return self._map(lambda a, n: F.array_repeat(a, n.cast("int")), as_expr(by, True))

    def floor(self) -> Expr:
        return self._typed(lambda s, a: _kept(s, a, F.floor))

    def ceil(self) -> Expr:
        return self._typed(lambda s, a: _kept(s, a, F.ceil))

    def round(self, decimals: int = 0, *, mode: str = "half_to_even") -> Expr:
        if mode not in ("half_to_even", "half_away_from_zero"):
            raise ValueError(f"unknown rounding mode {mode!r}")
        even = mode == "half_to_even"

        def make(s: Scope, a: Column) -> Column:
            kind = s.type_of(a)
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                rounded = lambda x: scalar.rounded(x, decimals, even).cast(kind)
                # what is named several times is computed once in generated code, but not windows and functions of elements
                return scalar.once(a, rounded) if self._kind == Kind.WINDOW or " -> " in str(a) else rounded(a)
            return (F.bround if even else F.round)(a, decimals)

        return self._typed(make)

    def truncate(self, decimals: int = 0) -> Expr:
        return self._map(lambda a: F.signum(a) * F.floor(F.abs(a) * 10**decimals) / 10**decimals)

    def log(self, base: float = math.e) -> Expr:
        return self._map(lambda a: scalar.ln(a) if base == math.e else scalar.ln(a) / math.log(base))

    def log10(self) -> Expr:
        return self._map(lambda a: F.when(a == 0, float("-inf")).otherwise(F.log10(a)))

    def log1p(self) -> Expr:
        return self._map(lambda a: scalar.ln(a + 1))

    # window functions

    def shift(self, n: int = 1) -> Expr:
        return self._window(lambda s, a: F.lag(a, n).over(s.over.spec()) if n >= 0 else F.lead(a, -n).over(s.over.spec()))

    def diff(self) -> Expr:
        return self._window(lambda s, a: a - F.lag(a, 1).over(s.over.spec()))

    def pct_change(self, n: int = 1) -> Expr:
        return self._window(lambda s, a: scalar.divide(a, (F.lag(a, n) if n >= 0 else F.lead(a, -n)).over(s.over.spec())) - 1)

    def _cumulative(self, f: Callable[[Column], Column], reverse: bool) -> Expr:
        return self._window(lambda s, a: f(a).over(s.over.spec(0, END) if reverse else s.over.spec(START, 0)))

    def cum_count(self, *, reverse: bool = False) -> Expr:
        return self._cumulative(F.count, reverse)

    def cum_sum(self, *, reverse: bool = False) -> Expr:
        return self._cumulative(F.sum, reverse)

    def cum_prod(self, *, reverse: bool = False) -> Expr:
        return self._cumulative(F.product, reverse)

    def cum_min(self, *, reverse: bool = False) -> Expr:
        return self._cumulative(F.min, reverse)

    def cum_max(self, *, reverse: bool = False) -> Expr:
        return self._cumulative(F.max, reverse)

    def rank(self, method: str = "average", *, descending: bool = False) -> Expr:
        if method not in ("average", "min", "max", "dense", "ordinal"):
            raise ValueError(f"unknown ranking method {method!r}")

        def make(s: Scope, a: Column) -> Column:
            order = [nulls_placed(a, descending, False)]
            if method in ("dense", "ordinal"):
                tie = list(s.over.order) if method == "ordinal" else []
                return (F.dense_rank() if method == "dense" else F.row_number()).over(s.over.spec(order=order + tie))
            low = F.rank().over(s.over.spec(order=order))
            peers = F.count(F.lit(1)).over(Window.partitionBy(*s.over.partition, a))
            return low if method == "min" else low + peers - 1 if method == "max" else low + (peers - 1) / 2

        return self._window(make)

    def _rolling(self, f: Callable[[Column, Any], Column], window_size: int, min_samples: int | None, center: bool) -> Expr:
        before = window_size // 2 if center else window_size - 1

        def make(s: Scope, a: Column) -> Column:
            spec = s.over.spec(-before, window_size - 1 - before)
            return F.when(F.count(a).over(spec) >= (window_size if min_samples is None else min_samples), f(a, spec))

        return self._window(make)

    def rolling_max(self, window_size: int, min_samples: int | None = None, *, center: bool = False) -> Expr:
        return self._rolling(lambda a, w: F.max(a).over(w), window_size, min_samples, center)

    def rolling_min(self, window_size: int, min_samples: int | None = None, *, center: bool = False) -> Expr:
        return self._rolling(lambda a, w: F.min(a).over(w), window_size, min_samples, center)

    def rolling_mean(self, window_size: int, min_samples: int | None = None, *, center: bool = False) -> Expr:
        return self._rolling(lambda a, w: F.avg(a).over(w), window_size, min_samples, center)

    def rolling_sum(self, window_size: int, min_samples: int | None = None, *, center: bool = False) -> Expr:
        return self._rolling(lambda a, w: F.sum(a).over(w), window_size, min_samples, center)

    def rolling_median(self, window_size: int, min_samples: int | None = None, *, center: bool = False) -> Expr:
        return self._rolling(lambda a, w: scalar.list_median(F.collect_list(a).over(w)), window_size, min_samples, center)

    def rolling_std(self, window_size: int, min_samples: int | None = None, *, center: bool = False, ddof: int = 1) -> Expr:
        return self._rolling(lambda a, w: (F.stddev_samp if ddof else F.stddev_pop)(a).over(w), window_size, min_samples, center)

    def rolling_var(self, window_size: int, min_samples: int | None = None, *, center: bool = False, ddof: int = 1) -> Expr:
        return self._rolling(lambda a, w: (F.var_samp if ddof else F.var_pop)(a).over(w), window_size, min_samples, center)

    def forward_fill(self, limit: int | None = None) -> Expr:
        return self._window(lambda s, a: F.last(a, True).over(s.over.spec(START if limit is None else -limit, 0)))

    def backward_fill(self, limit: int | None = None) -> Expr:
        return self._window(lambda s, a: F.first(a, True).over(s.over.spec(0, END if limit is None else limit)))

    def fill_null(self, value: Any = None, strategy: str | None = None, limit: int | None = None) -> Expr:
        if value is not None and strategy is not None:
            raise ValueError("cannot specify both `value` and `strategy`")
        if value is None and strategy is None:
            raise ValueError("must specify either a fill `value` or `strategy`")
        if limit is not None and strategy not in ("forward", "backward"):
            raise ValueError("`limit` only goes with the strategies 'forward' and 'backward'")
        if limit is not None and limit < 0:
            raise ValueError("`limit` must not be negative")
        if value is not None:
            return self._map(lambda a, v: F.coalesce(a, v), value)
        if strategy == "forward":
            return self.forward_fill(limit)
        if strategy == "backward":
            return self.backward_fill(limit)
        if strategy in ("zero", "one"):
            return self._map(lambda a: F.coalesce(a, F.lit(int(strategy == "one"))))
        f = {"min": F.min, "max": F.max, "mean": F.avg}.get(strategy)
        if f is None:
            raise ValueError(f"unknown strategy {strategy!r}")

        def filled(s: Scope, a: Column) -> Column:
            if s.over.partition or s.df is None:
                return F.coalesce(a, f(a).over(Window.partitionBy(*s.over.partition)))
            return F.coalesce(a, s.df.agg(f(a).alias("x")).scalar())  # one value of the whole frame: no task needs all rows

        return self._window(filled)

    def is_duplicated(self) -> Expr:
        return self._window(lambda s, a: F.count(F.lit(1)).over(Window.partitionBy(*s.over.partition, a)) > 1)

    def is_unique(self) -> Expr:
        return self._window(lambda s, a: F.count(F.lit(1)).over(Window.partitionBy(*s.over.partition, a)) == 1)

    def is_first_distinct(self) -> Expr:
        return self._window(lambda s, a: F.row_number().over(replace(s.over, partition=(*s.over.partition, a)).spec()) == 1)

    def is_last_distinct(self) -> Expr:
        def make(s: Scope, a: Column) -> Column:
            spec = replace(s.over, partition=(*s.over.partition, a))
            return F.row_number().over(spec.spec()) == F.count(F.lit(1)).over(Window.partitionBy(*spec.partition))

        return self._window(make)

    def arg_sort(self, *, descending: bool = False, nulls_last: bool = False) -> Expr:
        return self._window(lambda s, a: F.row_number().over(s.over.spec(order=[nulls_placed(a, descending, nulls_last), *s.over.order])) - 1)

    def over(self, partition_by: Any = None, *more_exprs: Any, order_by: Any = None, descending: bool = False, nulls_last: bool = False) -> Expr:
        """Aggregates and window functions within work by partition, in the order given; nulls come first unless told otherwise."""
        keys = [as_expr(k, True) for k in flat([partition_by, *more_exprs])]
        order = [as_expr(k, True) for k in flat([order_by])]

        def make(s: Scope) -> Column:
            inner = replace(s, over=Over())
            by = tuple(nulls_placed(o.column(inner), descending, nulls_last) for o in order)
            return self.column(replace(s, over=Over(tuple(k.column(inner) for k in keys), by, True)))

        return self._with(make, kind=Kind.WINDOW)

    # aggregates

    def count(self) -> Expr:
        return self._agg(F.count)

    def len(self) -> Expr:
        return self._agg(lambda a: F.count(F.isnull(a)))

    def sum(self) -> Expr:
        return self._agg(F.sum)

    def mean(self) -> Expr:
        return self._agg(F.avg)

    def median(self) -> Expr:
        return self._agg(F.median)

    def min(self) -> Expr:
        return self._agg(F.min)

    def max(self) -> Expr:
        return self._agg(F.max)

    def first(self, *, ignore_nulls: bool = False) -> Expr:
        return self._agg(lambda a: F.first(a, ignore_nulls))

    def last(self) -> Expr:
        return self._agg(F.last)

    def mode(self) -> Expr:
        return self._agg(lambda a: F.mode(a, True))

    def approx_n_unique(self) -> Expr:
        return self._agg(F.approx_count_distinct)

    def product(self) -> Expr:
        return self._agg(F.product)

    def dot(self, other: Any) -> Expr:
        return self._agg(lambda a, b: F.sum(a * b), other)

    def max_by(self, by: Any) -> Expr:
        return self._agg(F.max_by, by)

    def min_by(self, by: Any) -> Expr:
        return self._agg(F.min_by, by)

    def implode(self) -> Expr:
        return self._agg(gathered)

    def unique(self) -> Expr:
        return Expr(self._make, self._root, Kind.UNIQUE, self._rename, self._columns)

    def bitwise_and(self) -> Expr:
        return self._agg(F.bit_and)

    def bitwise_or(self) -> Expr:
        return self._agg(F.bit_or)

    def bitwise_xor(self) -> Expr:
        return self._agg(F.bit_xor)

    def std(self, ddof: int = 1) -> Expr:
        return self._agg(F.stddev_samp if ddof else F.stddev_pop)

    def var(self, ddof: int = 1) -> Expr:
        return self._agg(F.var_samp if ddof else F.var_pop)

    def kurtosis(self, *, fisher: bool = True, bias: bool = True) -> Expr:
        def make(a: Column, over: Any) -> Column:
            n, g = over.count(a).cast("double"), over.kurtosis(a)
            out = g if bias else F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))
            return out if fisher else out + 3

        return self._parts(make)

    def skew(self, *, bias: bool = True) -> Expr:
        def make(a: Column, over: Any) -> Column:
            n = over.count(a).cast("double")
            return over.skewness(a) if bias else F.when(n > 2, over.skewness(a) * F.sqrt(n * (n - 1)) / (n - 2))

        return self._parts(make)

    def entropy(self, base: float = math.e, *, normalize: bool = True) -> Expr:
        def make(a: Column, over: Any) -> Column:
            each = over.sum(a * scalar.ln(a))
            if not normalize:
                return -each / math.log(base)
            return (F.log(over.sum(a)) - each / over.sum(a)) / math.log(base)

        return self._parts(make)

    def quantile(self, quantile: float, *, interpolation: bool = True) -> Expr:
        """Without interpolation, a column of numbers that doubles hold exactly has counts of its values merged; of anything else the values of a group are gathered."""
        if interpolation:
            return self._agg(lambda a: F.percentile(a, F.lit(quantile)))

        def make(s: Scope) -> Column:
            inner = replace(s, over=Over())
            a = self.column(inner)
            plain = s.name is not None and str(a) == str(quoted(s.name))
            kind = s.type_of(a) if plain else None
            if isinstance(kind, (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)):
                name = s.name.replace("`", "``")
                out = F.expr(f"percentile_disc({quantile!r}D) WITHIN GROUP (ORDER BY `{name}`)")
                return (_over_whole(out, s.over) if s.over.given else out).cast(kind)
            out = scalar.list_quantile_disc(F.collect_list(a), quantile)
            return _over_whole(out, s.over) if s.over.given else out

        return self._with(make, kind=Kind.SCALAR)

    def all(self) -> Expr:
        return self._agg(F.bool_and)

    def any(self) -> Expr:
        return self._agg(F.bool_or)

    def n_unique(self) -> Expr:
        def make(s: Scope) -> Column:
            a = self.column(replace(s, over=Over()))
            return F.size(_over_whole(F.collect_set(a), s.over)) if s.over.given else F.count_distinct(a)

        return self._with(make, kind=Kind.SCALAR)

    def null_count(self) -> Expr:
        return self._agg(lambda a: F.count_if(F.isnull(a)))

    def has_nulls(self) -> Expr:
        return self._agg(lambda a: F.bool_or(F.isnull(a)))

    def _parts(self, f: Callable[[Column, Any], Column]) -> Expr:
        """An expression of several aggregates ``g.name(column)``, each of which goes over the window where there is one."""

        def make(s: Scope) -> Column:
            return f(self.column(replace(s, over=Over())), _Aggregates(s.over))

        return self._with(make, kind=Kind.SCALAR)


class _Aggregates:
    def __init__(self, over: Over) -> None:
        self._over = over

    def __getattr__(self, name: str) -> Callable[[Column], Column]:
        f = getattr(F, name)
        return (lambda a: _over_whole(f(a), self._over)) if self._over.given else f


def _over_whole(out: Column, over: Over) -> Column:
    return out.over(over.whole())


def _kept(s: Scope, a: Column, f: Callable[[Column], Column]) -> Column:
    """floor and ceil keep doubles doubles."""
    kind = s.type_of(a)
    return f(a).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else f(a)


def gathered(a: Column) -> Column:
    """All values as a list, nulls too."""
    return F.transform(F.collect_list(F.struct(a.alias("v"))), lambda x: x["v"])


for _name, _f in {
    "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arctan": F.atan, "arccos": F.acos, "arccosh": F.acosh, "arcsin": F.asin,
    "arcsinh": F.asinh, "arctanh": F.atanh, "cot": F.cot, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "degrees": F.degrees, "radians": F.radians, "sign": F.signum,
}.items():
    setattr(Expr, _name, (lambda f: lambda self: self._map(f))(_f))


class Col:
    """``col("x")`` or ``col.x``."""

    def __call__(self, name: str) -> Expr:
        return named(name)

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("__"):
            raise AttributeError(name)
        return named(name)


col = Col()
