"""Joins with exact rules for the columns that come out."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import flat, quoted

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "semi": "left_semi", "anti": "left_anti"}


def keys_of(on: Any, left_on: Any, right_on: Any) -> tuple[list[str], list[str]]:
    both, left, right = flat([on]), flat([left_on]), flat([right_on])
    if both and (left or right):
        raise ValueError("`on` can't go with `left_on` or `right_on`")
    if both:
        return both, both
    if not left or not right:
        raise ValueError("either `on`, or `left_on` and `right_on` must be specified")
    if len(left) != len(right):
        raise ValueError("`left_on` and `right_on` must have the same length")
    return left, right


def side(alias: str, name: str) -> Column:
    return F.col(f"{alias}.`{name.replace('`', '``')}`")


#: Rows of a side in a block of a key that has many on both sides.
BLOCK = 2000


def _parted(left: DataFrame, right: DataFrame, lk: list[str], rk: list[str]) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Both sides' rows of the keys that have more pairs than a block holds, and their other rows.

    The former are placed in a grid of blocks for each key: ``__row`` is a block of left rows, which right rows are repeated for, ``__column`` one of right rows, which left rows are
    repeated for. Such a key has 2 x BLOCK rows on both sides together at least, so there are few of them. Equal rows stay in one block."""
    names = [f"__k{i}" for i in range(len(lk))]
    keyed = lambda df, keys: df.select(*[quoted(c).alias(n) for c, n in zip(keys, names, strict=True)]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    both = keyed(left, lk).withColumnRenamed("n", "__nl").join(keyed(right, rk).withColumnRenamed("n", "__nr"), names)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    many = F.broadcast(both.filter(F.col("__nl").cast("double") * F.col("__nr") > BLOCK * BLOCK).select(*names, blocks("__nl").alias("__rows"), blocks("__nr").alias("__columns")))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = lambda keys: reduce(lambda x, y: x & y, [quoted(c) == F.col(n) for c, n in zip(keys, names, strict=True)])

    def placed(df: DataFrame, keys: list[str], own: str, others: str, n_own: str, n_others: str) -> DataFrame:
        hashed = F.xxhash64(*[quoted(f.name) for f in df.schema if isinstance(f.dataType, T.AtomicType)] or [F.lit(0)])
        at, repeats = F.pmod(hashed, F.col(n_own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(n_others) - 1)).alias(others)
        # as many tasks as told: the rows that come in say little of those that go out, so they aren't to be put together by size
        return df.join(many, same(keys)).select(*[quoted(c) for c in df.columns], at, repeats).repartition(tasks, *[quoted(c) for c in keys], "__row", "__column")

    grid = placed(left, lk, "__row", "__column", "__rows", "__columns"), placed(right, rk, "__column", "__row", "__columns", "__rows")
    return grid, (left.join(many, same(lk), "left_anti"), right.join(many, same(rk), "left_anti"))


def equi(left: DataFrame, right: DataFrame, on: Any, how: str, left_on: Any, right_on: Any, suffix: str, many: bool = False) -> DataFrame:
    """Null keys never match. Columns: inner and left joins drop the right keys, outer joins keep all, right joins drop the left keys; others that collide get the suffix.

    ``many``: keys may have many rows on both sides; their pairs are spread over tasks in blocks, for which the keys are counted first."""
    if how not in HOW:
        raise ValueError(f"unknown join strategy {how!r}")
    lk, rk = keys_of(on, left_on, right_on)
    mine = left.columns
    if how in ("semi", "anti"):
        cols = [quoted(c) for c in mine]
    elif how in ("inner", "left"):
        cols = [side("lhs", c) for c in mine]
        cols += [side("rhs", c).alias(c + suffix if c in mine else c) for c in right.columns if c not in rk]
    elif how == "outer":
        cols = [side("lhs", c) for c in mine] + [side("rhs", c).alias(c + suffix if c in mine else c) for c in right.columns]
    else:
        cols = [side("lhs", c) for c in mine if c not in lk]
        cols += [side("rhs", c).alias(c + suffix if c in mine and c not in rk else c) for c in right.columns]

    def joined(a: DataFrame, b: DataFrame, kind: str, pairs: list[tuple[str, str]]) -> DataFrame:
        equal = reduce(lambda x, y: x & y, [side("lhs", x) == side("rhs", y) for x, y in pairs])
        return a.alias("lhs").join(b.alias("rhs"), equal, HOW[kind]).select(*cols)

    keys = list(zip(lk, rk, strict=True))
    if not many or how in ("semi", "anti"):
        return joined(left, right, how, keys)
    grid, others = _parted(left, right, lk, rk)
    # all rows of a key with a grid have partners
    return joined(*grid, "inner", [*keys, ("__row", "__row"), ("__column", "__column")]).unionAll(joined(*others, how, keys))


def cross(left: DataFrame, right: DataFrame, suffix: str) -> DataFrame:
    cols = [side("lhs", c) for c in left.columns] + [side("rhs", c).alias(c + suffix if c in left.columns else c) for c in right.columns]
    return left.alias("lhs").crossJoin(right.alias("rhs")).select(*cols)
