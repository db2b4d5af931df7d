"""The lazy frame: a Spark DataFrame with an expression API."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dtypes
from .expr import Expr, Kind, Scope, as_expr, flat, gathered, named, nulls_placed, quoted
from .operators import asof, joins, rows

PIVOT = {"first": F.first, "last": F.last, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "count": F.count, "len": F.count}


def _outputs(df: DataFrame, exprs: tuple, named_exprs: Mapping[str, Any]) -> list[tuple[Expr, str, Column]]:
    scope = Scope(df)
    out = []
    for e in flat(exprs):
        x = as_expr(e, True)
        out += [(x, n, c) for n, c in x.build(scope)]
    for name, e in named_exprs.items():
        x = as_expr(e, True)
        out += [(x, name, c) for _, c in x.build(scope)]
    return out


def _aliased(outputs: list[tuple[Expr, str, Column]]) -> list[Column]:
    return [c.alias(n) for _, n, c in outputs]


def _per_key(value: Any, n: int, what: str) -> list[bool]:
    if isinstance(value, bool):
        return [value] * n
    values = list(value)
    if len(values) != n:
        raise ValueError(f"the length of `{what}` ({len(values)}) does not match the length of `by` ({n})")
    return values


class LazyFrame:
    """A frame of named columns. Nothing runs before ``collect`` or a sink."""

    def __init__(self, data: Any, orient: str = "col") -> None:
        from .sources import create

        self._df: DataFrame = data if isinstance(data, DataFrame) else create.to_spark(data, orient)
        self._schema: dtypes.Schema | None = None

    def __repr__(self) -> str:
        return f"LazyFrame({', '.join(f'{n}: {t}' for n, t in self.schema.items())})"

    def _new(self, df: DataFrame) -> LazyFrame:
        return type(self)(df)

    @property
    def spark(self) -> SparkSession:
        return self._df.sparkSession

    def to_spark(self) -> DataFrame:
        return self._df

    # leaving

    def lazy(self) -> DataFrame:
        return self._df

    def collect(self) -> Any:
        """The rows as an Arrow table."""
        return self._df.toArrow()

    def to_pandas(self) -> Any:
        return self._df.toPandas()

    def sink_parquet(self, path: str, *, compression: str = "zstd", mode: str = "error") -> None:
        self._df.write.mode(mode).parquet(path, compression=compression)

    def sink_csv(self, path: str, *, separator: str = ",", include_header: bool = True, mode: str = "error") -> None:
        """Nested columns are written as JSON."""
        flat_ = [F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else quoted(f.name) for f in self._df.schema]
        self._df.select(*flat_).write.mode(mode).csv(path, sep=separator, header=include_header)

    def sink_ndjson(self, path: str, mode: str = "error") -> None:
        self._df.write.mode(mode).json(path, ignoreNullFields=False)

    def sink_orc(self, path: str, mode: str = "error") -> None:
        self._df.write.mode(mode).orc(path)

    # looking

    def sql_query(self) -> str:
        """The analysed logical plan as text; Spark has no SQL for it that could be run."""
        return self._df._jdf.queryExecution().analyzed().toString()

    def explain(self, kind: str = "standard") -> str:
        mode = {"standard": "simple", "analyze": "formatted"}.get(kind, kind)
        jvm = self.spark._jvm
        return jvm.PythonSQLUtils.explainString(self._df._jdf.queryExecution(), mode)

    def clone(self) -> LazyFrame:
        return self._new(self._df)

    @property
    def columns(self) -> list[str]:
        return self._df.columns

    @property
    def width(self) -> int:
        return len(self.columns)

    @property
    def schema(self) -> dtypes.Schema:
        if self._schema is None:
            self._schema = dtypes.Schema.from_struct(self._df.schema)
        return self._schema

    def collect_schema(self) -> dtypes.Schema:
        return self.schema

    def pipe(self, f: Any, *args: Any, **kwargs: Any) -> Any:
        return f(self, *args, **kwargs)

    # columns

    def select(self, *exprs: Any, **named_exprs: Any) -> LazyFrame:
        """A row if all expressions are aggregates, the distinct rows if all are ``unique``, else a row for each row."""
        outputs = _outputs(self._df, exprs, named_exprs)
        kinds = {e._kind for e, _, _ in outputs} - {Kind.LITERAL}
        if kinds == {Kind.SCALAR}:
            return self._new(self._df.agg(*_aliased(outputs)))
        out = self._df.select(*_aliased(outputs))
        return self._new(out.distinct() if kinds == {Kind.UNIQUE} else out)

    def with_columns(self, *exprs: Any, **named_exprs: Any) -> LazyFrame:
        """Columns added or replaced, in one projection. With an aggregate among them the rows are grouped by all columns, and it is one of each group."""
        outputs = _outputs(self._df, exprs, named_exprs)
        new = {n: c for _, n, c in outputs}
        if any(e._kind == Kind.SCALAR for e, _, _ in outputs):
            keys = [quoted(c).alias(c) for c in self.columns]
            grouped = self._df.groupBy(*keys).agg(*[c.alias(f"__new_{n}") for n, c in new.items()])
            return self._new(grouped.select(*[quoted(f"__new_{c}" if c in new else c).alias(c) for c in self.columns], *[quoted(f"__new_{n}").alias(n) for n in new if n not in self.columns]))
        kept = [(new.pop(c) if c in new else quoted(c)).alias(c) for c in self.columns]
        return self._new(self._df.select(*kept, *[c.alias(n) for n, c in new.items()]))

    def filter(self, *predicates: Any, **constraints: Any) -> LazyFrame:
        scope = Scope(self._df)
        given = [c for p in flat(predicates) for _, c in as_expr(p, True).build(scope)]
        given += [named(k).eq(v).column(scope) for k, v in constraints.items()]
        return self._new(self._df.filter(reduce(lambda a, b: a & b, given)) if given else self._df)

    def _names(self, given: tuple) -> list[str]:
        return [n for e in flat(given) for n in ([e] if isinstance(e, str) else [n for n, _ in e.build(Scope(self._df))])]

    def drop(self, *columns: Any) -> LazyFrame:
        gone = set(self._names(columns))
        return self._new(self._df.select(*[quoted(c) for c in self.columns if c not in gone]))

    def rename(self, mapping: Mapping[str, str]) -> LazyFrame:
        return self._new(self._df.withColumnsRenamed(dict(mapping)))

    def cast(self, types: Any) -> LazyFrame:
        wanted = dict(types) if isinstance(types, Mapping) else dict.fromkeys(self.columns, types)
        resolved: dict[str, Any] = {}
        for key, kind in wanted.items():
            if isinstance(key, str):
                resolved[key] = kind
            elif isinstance(key, Expr):
                resolved.update(dict.fromkeys(self._names((key,)), kind))
            else:
                resolved.update({n: kind for n, t in self.schema.items() if t == key})
        scope, out = Scope(self._df), []
        for c in self.columns:
            if c in resolved:
                kind = dtypes.of(resolved[c])
                out.append(named(c).cast(kind).column(scope).alias(c, metadata=dtypes.metadata_of(kind)))
            else:
                out.append(quoted(c))
        return self._new(self._df.select(*out))

    def drop_nulls(self, *subset: Any) -> LazyFrame:
        return self.filter([named(c).is_not_null() for c in self._names(subset) or self.columns])

    def drop_nans(self, *subset: Any) -> LazyFrame:
        """Rows where a column is NaN or null go; without subset all float columns count."""
        names = self._names(subset) or [f.name for f in self._df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        return self.filter([named(c).is_not_nan() for c in names])

    def _every(self, f: Any, only: Any = None) -> LazyFrame:
        scope = Scope(self._df)
        return self._new(self._df.select(*[(f(named(x.name)).column(scope) if only is None or isinstance(x.dataType, only) else quoted(x.name)).alias(x.name) for x in self._df.schema]))

    def fill_nan(self, value: Any) -> LazyFrame:
        return self._every(lambda e: e.fill_nan(value), (T.DoubleType, T.FloatType))

    def fill_null(self, value: Any = None, strategy: str | None = None, limit: int | None = None, *, order_by: Any = None) -> LazyFrame:
        return self._every(lambda e: _ordered(e.fill_null(value, strategy, limit), order_by))

    def shift(self, n: int = 1, *, fill_value: Any = None, order_by: Any = None) -> LazyFrame:
        def moved(e: Expr) -> Expr:
            out = _ordered(e.shift(n), order_by)
            return out if fill_value is None else out._map(F.coalesce, fill_value)

        return self._every(moved)

    def explode(self, *columns: Any) -> LazyFrame:
        return self._new(rows.explode(self._df, self._names(columns)))

    def unnest(self, *columns: Any) -> LazyFrame:
        """The fields of structs as columns, in their place; of a list its elements as rows."""
        names = self._names(columns)
        kinds = {f.name: f.dataType for f in self._df.schema}
        lists = [n for n in names if isinstance(kinds[n], T.ArrayType)]
        if lists:
            return self._new(rows.explode(self._df, lists, outer=False)).unnest(*[n for n in names if n not in lists]) if len(lists) < len(names) else self._new(rows.explode(self._df, lists, outer=False))
        out = [quoted(c) for c in self.columns if c not in names]
        out += [quoted(n).getField(f.name).alias(f.name) for n in names for f in kinds[n]]
        return self._new(self._df.select(*out))

    def unpivot(self, on: Any = None, index: Any = None, variable_name: str = "variable", value_name: str = "value") -> LazyFrame:
        """From wide to long; nulls have no row."""
        index_ = self._names((index,))
        on_ = self._names((on,)) or [c for c in self.columns if c not in index_]
        out = self._df.unpivot([quoted(c) for c in index_], [quoted(c) for c in on_], variable_name, value_name)
        return self._new(out.filter(quoted(value_name).isNotNull()))

    def pivot(self, on: Any, on_columns: Sequence[Any], index: Any = None, values: Any = None, aggregate_function: str = "first", *, maintain_order: bool = False, separator: str = "_") -> LazyFrame:
        on_, index_, values_ = self._names((on,)), self._names((index,)), self._names((values,))
        if not index_ and not values_:
            raise ValueError("`pivot` needs either `index` or `values` to be specified")
        if aggregate_function not in PIVOT:
            raise ValueError(f"unknown aggregate function {aggregate_function!r}")
        index_ = index_ or [c for c in self.columns if c not in on_ and c not in values_]
        values_ = values_ or [c for c in self.columns if c not in on_ and c not in index_]
        key = quoted(on_[0]) if len(on_) == 1 else F.concat_ws(separator, *[quoted(c).cast("string") for c in on_])
        f = PIVOT[aggregate_function]
        # one conditional aggregate a value and column: partial aggregation, no job to find the values, no shuffle by them
        cells = [f(F.when(key == F.lit(v), quoted(c)), True) if aggregate_function in ("first", "last") else f(F.when(key == F.lit(v), quoted(c))) for c in values_ for v in on_columns]
        names = [str(v) if len(values_) == 1 else f"{c}{separator}{v}" for c in values_ for v in on_columns]
        out = self._df.groupBy(*[quoted(c) for c in index_]).agg(*[c.alias(n) for c, n in zip(cells, names, strict=True)])
        return self._new(out.orderBy(*[quoted(c) for c in index_]) if maintain_order else out)

    # order and rows

    def with_row_index(self, name: str, *, order_by: Any) -> LazyFrame:
        by = [c for e in flat([order_by]) for _, c in as_expr(e, True).build(Scope(self._df))]
        return self._new(rows.indexed(self._df, name, by))

    def gather_every(self, n: int, offset: int = 0) -> LazyFrame:
        """Every n-th row, in the order of all columns."""
        out = rows.indexed(self._df, "__at", [quoted(c) for c in self.columns])
        return self._new(out.filter((F.col("__at") >= offset) & ((F.col("__at") - offset) % n == 0)).drop("__at"))

    def reverse(self) -> LazyFrame:
        """In the descending order of all columns."""
        return self._new(self._df.orderBy(*[quoted(c).desc_nulls_last() for c in self.columns]))

    def _sort_columns(self, by: tuple, descending: Any, nulls_last: Any) -> list[Column]:
        keys = [c for e in flat(by) for _, c in as_expr(e, True).build(Scope(self._df))]
        down, last = _per_key(descending, len(keys), "descending"), _per_key(nulls_last, len(keys), "nulls_last")
        del last  # nulls come last either way
        return [nulls_placed(k, d, True) for k, d in zip(keys, down, strict=True)]

    def sort(self, *by: Any, descending: Any = False, nulls_last: Any = False) -> LazyFrame:
        return self._new(self._df.orderBy(*self._sort_columns(by, descending, nulls_last)))

    def limit(self, n: int) -> LazyFrame:
        return self._new(self._df.limit(n))

    def head(self, n: int = 5) -> LazyFrame:
        return self.limit(n)

    def slice(self, offset: int, length: int | None = None, *, order_by: Any = None) -> LazyFrame:
        """Rows from an offset on; a negative one counts from the end."""
        if length is not None and length < 0:
            raise ValueError(f"negative slice lengths ({length}) are invalid for LazyFrame")
        df = self._df
        if order_by is not None:
            df = df.orderBy(*[c.asc_nulls_first() for e in flat([order_by]) for _, c in as_expr(e, True).build(Scope(df))])
        if offset >= 0:
            out = df.offset(offset) if offset else df
            return self._new(out if length is None else out.limit(length))
        if length == 0:
            return self.limit(0)
        return self._new(rows.from_end(self._df, -offset, length, [c for e in flat([order_by]) for _, c in as_expr(e, True).build(Scope(self._df))]))

    def tail(self, n: int = 5, *, order_by: Any = None) -> LazyFrame:
        if n < 0:
            raise ValueError("`n` must be greater than or equal to 0")
        return self.limit(0) if n == 0 else self.slice(-n, order_by=order_by)

    def first(self) -> LazyFrame:
        return self.limit(1)

    def last(self, *, order_by: Any = None) -> LazyFrame:
        return self.tail(1, order_by=order_by)

    def top_k(self, k: int, by: Any, *, reverse: Any = False) -> LazyFrame:
        keys = flat([by])
        down = [not r for r in _per_key(reverse, len(keys), "reverse")]
        return self._new(self._df.orderBy(*self._sort_columns((keys,), down, True)).limit(k))

    def bottom_k(self, k: int, by: Any, *, reverse: Any = False) -> LazyFrame:
        keys = flat([by])
        return self.top_k(k, keys, reverse=[not r for r in _per_key(reverse, len(keys), "reverse")])

    def unique(self, subset: Any = None, *, keep: str = "any", order_by: Any = None) -> LazyFrame:
        if keep not in ("any", "none", "first", "last"):
            raise ValueError(f"unknown keep strategy {keep!r}")
        names = self._names((subset,)) or self.columns
        if keep == "any":
            return self._new(self._df.dropDuplicates(names))
        keys = [quoted(c) for c in names]
        if keep == "none":
            mark = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        elif order_by is None:
            raise ValueError("`order_by` must be specified when `keep` is 'first' or 'last', since rows have no order of their own")
        else:
            by = [c for e in flat([order_by]) for _, c in as_expr(e, True).build(Scope(self._df))]
            mark = F.row_number().over(Window.partitionBy(*keys).orderBy(*[nulls_placed(c, keep == "last", keep == "last") for c in by]))
        return self._new(self._df.withColumn("__mark", mark).filter("__mark = 1").drop("__mark"))

    # groups

    def group_by(self, *keys: Any, drop_null_keys: bool = False, strategy: str | None = None) -> GroupBy:
        exprs = [as_expr(k, True) for k in flat(keys)]
        frame = self.filter([e.is_not_null() for e in exprs]) if drop_null_keys else self
        return GroupBy(frame, exprs, strategy)

    def group_by_all(self, *exprs: Any, **named_exprs: Any) -> LazyFrame:
        """Aggregates, grouped by all other expressions."""
        outputs = _outputs(self._df, exprs, named_exprs)
        aggs = [(n, c) for e, n, c in outputs if e._kind == Kind.SCALAR]
        keys = [(n, c) for e, n, c in outputs if e._kind != Kind.SCALAR]
        grouped = self._df.groupBy(*[c.alias(n) for n, c in keys])
        out = grouped.agg(*[c.alias(n) for n, c in aggs]) if aggs else self._df.select(*[c.alias(n) for n, c in keys]).distinct()
        return self._new(out.select(*[quoted(n) for _, n, _ in outputs]))

    def _aggregated(self, f: Any) -> LazyFrame:
        return self.select([f(named(c)) for c in self.columns])

    def count(self) -> LazyFrame:
        return self._aggregated(Expr.count)

    def sum(self) -> LazyFrame:
        return self._aggregated(Expr.sum)

    def mean(self) -> LazyFrame:
        return self._aggregated(Expr.mean)

    def median(self) -> LazyFrame:
        return self._aggregated(Expr.median)

    def min(self) -> LazyFrame:
        return self._aggregated(Expr.min)

    def max(self) -> LazyFrame:
        return self._aggregated(Expr.max)

    def std(self, ddof: int = 1) -> LazyFrame:
        return self._aggregated(lambda e: e.std(ddof))

    def var(self, ddof: int = 1) -> LazyFrame:
        return self._aggregated(lambda e: e.var(ddof))

    def null_count(self) -> LazyFrame:
        return self._aggregated(Expr.null_count)

    def quantile(self, quantile: float) -> LazyFrame:
        return self._aggregated(lambda e: e.quantile(quantile))

    def describe(self) -> LazyFrame:
        """A row each for count, mean, stddev, min, max and median, as texts for texts and doubles for numbers."""
        numbers = {f.name for f in self._df.schema if isinstance(f.dataType, T.NumericType)}
        measures = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max, "median": F.median}
        cells = []
        for m, f in measures.items():
            row = [F.lit(m).alias("aggr")]
            for c in self.columns:
                if c in numbers:
                    row.append(f(quoted(c)).cast("double").alias(c))
                else:
                    row.append((f(quoted(c)).cast("string") if m in ("count", "min", "max") else F.lit(None).cast("string")).alias(c))
            cells.append(F.struct(*row))
        return self._new(self._df.agg(F.array(*cells).alias("x")).select(F.inline("x")))

    # joins and sets

    def join(self, other: LazyFrame, on: Any = None, how: str = "inner", *, left_on: Any = None, right_on: Any = None, suffix: str = "_right", many: bool = False) -> LazyFrame:
        """With ``many``, keys that have many rows on both sides are joined in blocks by many tasks."""
        return self._new(joins.equi(self._df, other._df, on, how, left_on, right_on, suffix, many))

    def join_cross(self, other: LazyFrame, *, suffix: str = "_right") -> LazyFrame:
        return self._new(joins.cross(self._df, other._df, suffix))

    def join_where(self, other: LazyFrame, *predicates: Any, suffix: str = "_right") -> LazyFrame:
        """Pairs of rows for which the predicates hold; colliding columns of the other frame have the suffix in them."""
        renamed = other._df.withColumnsRenamed({c: c + suffix for c in other.columns if c in self.columns})
        both = self._df.crossJoin(renamed)
        return self._new(both.filter(reduce(lambda a, b: a & b, [c for p in flat(predicates) for _, c in as_expr(p, True).build(Scope(both))])))

    def join_asof(self, other: LazyFrame, *, left_on: str | None = None, right_on: str | None = None, on: str | None = None, by_left: Any = None, by_right: Any = None, by: Any = None, strategy: str = "backward", suffix: str = "_right") -> LazyFrame:
        return self._new(asof.asof(self._df, other._df, on, left_on, right_on, by, by_left, by_right, strategy, suffix))

    def union(self, other: LazyFrame) -> LazyFrame:
        """All rows of both, by position."""
        return self._new(self._df.unionAll(other._df))

    def intersect(self, other: LazyFrame) -> LazyFrame:
        return self._new(self._df.intersectAll(other._df))

    def except_(self, other: LazyFrame) -> LazyFrame:
        return self._new(self._df.exceptAll(other._df))

    def distinct(self) -> LazyFrame:
        return self._new(self._df.distinct())

    def map(self, function: Any, schema: Any) -> LazyFrame:
        """A Python function from pandas batches to pandas batches."""
        return self._new(self._df.mapInPandas(lambda batches: (function(b) for b in batches), schema))


def _ordered(e: Expr, order_by: Any) -> Expr:
    return e if order_by is None else e.over(order_by=order_by)


class GroupBy:
    def __init__(self, frame: LazyFrame, keys: Iterable[Expr], strategy: str | None) -> None:
        self._frame, self._keys, self._strategy = frame, list(keys), strategy
        if strategy not in (None, "ROLLUP", "CUBE"):
            raise ValueError(f"unknown grouping strategy {strategy!r}")
        self._built = [x for k in self._keys for x in k.build(Scope(frame._df))]
        self._rest = [c for c in frame.columns if c not in {n for n, _ in self._built}]

    def agg(self, *aggs: Any, **named_aggs: Any) -> LazyFrame:
        """Keys and aggregates; expressions of rows give lists, ``unique`` ones lists of distinct values."""
        df = self._frame._df
        outputs = []
        scope = Scope(df)
        for e, name in [(a, None) for a in flat(aggs)] + [(a, n) for n, a in named_aggs.items()]:
            x = as_expr(e, True)
            for n, c in x.build(scope):
                if x._columns is not None and n not in self._rest and x._rename is None:
                    continue
                if x._kind == Kind.UNIQUE:
                    c = F.array_distinct(gathered(c))
                elif x._kind > Kind.SCALAR:
                    c = gathered(c)
                outputs.append(c.alias(name or n))
        keys = [c.alias(n) for n, c in self._built]
        group = {"ROLLUP": df.rollup, "CUBE": df.cube}.get(self._strategy or "", df.groupBy)
        return self._frame._new(group(*keys).agg(*outputs) if outputs else df.select(*keys).distinct())

    def _each(self, f: Any) -> LazyFrame:
        return self.agg([f(named(c)) for c in self._rest])

    def len(self, name: str | None = None) -> LazyFrame:
        from .api import len as count

        return self.agg(count().alias(name or "len"))

    def all(self) -> LazyFrame:
        return self._each(Expr.implode)

    def sum(self) -> LazyFrame:
        return self._each(Expr.sum)

    def mean(self) -> LazyFrame:
        return self._each(Expr.mean)

    def median(self) -> LazyFrame:
        return self._each(Expr.median)

    def min(self) -> LazyFrame:
        return self._each(Expr.min)

    def max(self) -> LazyFrame:
        return self._each(Expr.max)

    def first(self) -> LazyFrame:
        return self._each(Expr.first)

    def last(self) -> LazyFrame:
        return self._each(Expr.last)

    def n_unique(self) -> LazyFrame:
        return self._each(Expr.n_unique)

    def quantile(self, quantile: float, *, interpolation: bool = True) -> LazyFrame:
        return self._each(lambda e: e.quantile(quantile, interpolation=interpolation))
