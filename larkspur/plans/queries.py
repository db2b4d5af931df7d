"""The registered queries of the frame and expression API, each on whole tables, and their SQL.

Results are rounded and cast so that both engines give equal values; orders that functions depend on are spelt out and total."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

import larkspur as lk
from larkspur import col, lit, selectors
from larkspur.functions import sql_functions as fn

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> lk.LazyFrame:
        return lk.LazyFrame(self._spark.read.parquet(f"{self._dir}/{name}.parquet"))


def _query(sql: str | None = None) -> Callable[[Callable[[Tables], lk.LazyFrame]], None]:
    """Register a plan under its function's name."""

    def register(f: Callable[[Tables], lk.LazyFrame]) -> None:
        name = f.__name__
        _queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir)).to_spark()
        if sql:
            _sql[name] = sql

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _long(e: lk.Expr, name: str) -> lk.Expr:
    return e.cast("Int64").alias(name)


# filters, projections, groups and joins


@_query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
    round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL""")
def pricing_summary(t: Tables) -> lk.LazyFrame:
    price = col("l_extendedprice") * (1 - col("l_discount"))
    return (
        t.lineitem.filter(col("l_shipdate") <= lit(datetime(2001, 9, 2)))
        .with_columns(price.alias("disc"), (price * (1 + col("l_tax"))).alias("charge"))
        .group_by("l_returnflag", "l_linestatus")
        .agg(
            col("l_quantity").sum().round(2, mode="half_away_from_zero").alias("sum_qty"), col("l_extendedprice").sum().round(2, mode="half_away_from_zero").alias("sum_base"),
            col("disc").sum().round(2, mode="half_away_from_zero").alias("sum_disc"), col("charge").sum().round(2, mode="half_away_from_zero").alias("sum_charge"),
            col("l_quantity").mean().round(4, mode="half_away_from_zero").alias("avg_qty"), col("l_discount").mean().round(6, mode="half_away_from_zero").alias("avg_disc"), lk.len().alias("n"),
        )
        .sort("l_returnflag", "l_linestatus")
    )


@_query("""
SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'F' GROUP BY ALL HAVING count(*) > 1""")
def revenue_by_nation(t: Tables) -> lk.LazyFrame:
    return (
        t.lineitem.join(t.orders.filter(o_orderstatus="F"), left_on="l_orderkey", right_on="o_orderkey")
        .join(t.customer, left_on="o_custkey", right_on="c_custkey")
        .join(t.nation, left_on="c_nationkey", right_on="n_nationkey")
        .join(t.region, left_on="n_regionkey", right_on="r_regionkey")
        .group_by("n_name", "r_name")
        .agg((col("l_extendedprice") * (1 - col("l_discount"))).sum().round(2, mode="half_away_from_zero").alias("revenue"), lk.len().alias("n"))
        .filter(col("n") > 1)
    )


def _sides(t: Tables) -> tuple[lk.LazyFrame, lk.LazyFrame]:
    left = t.customer.select(col("c_nationkey").alias("k"), col("c_acctbal").alias("v"), col("c_name").alias("name"))
    return left, t.supplier.filter(col("s_acctbal") > 3000).select(col("s_nationkey").alias("k"), col("s_acctbal").alias("v"), col("s_suppkey").alias("supp"))


_SIDES = """WITH a AS (SELECT c_nationkey AS k, c_acctbal AS v, c_name AS name FROM customer),
b AS (SELECT s_nationkey AS k, s_acctbal AS v, s_suppkey AS supp FROM supplier WHERE s_acctbal > 3000) """


@_query(_SIDES + "SELECT a.k, a.v, name, b.v AS v_right, supp FROM a JOIN b ON a.k = b.k")
def join_inner(t: Tables) -> lk.LazyFrame:
    a, b = _sides(t)
    return a.join(b, on="k", many=True)


@_query(_SIDES + "SELECT a.k, a.v, name, b.v AS v_right, supp FROM a LEFT JOIN b ON a.k = b.k")
def join_left(t: Tables) -> lk.LazyFrame:
    a, b = _sides(t)
    return a.join(b, on="k", how="left", many=True)


@_query(_SIDES + "SELECT a.v, name, b.k, b.v AS v_right, supp FROM a RIGHT JOIN b ON a.k = b.k")
def join_right(t: Tables) -> lk.LazyFrame:
    a, b = _sides(t)
    return a.join(b, on="k", how="right", many=True)


@_query(_SIDES + "SELECT a.k, a.v, name, b.k AS k_right, b.v AS v_right, supp FROM a FULL JOIN b ON a.k = b.k")
def join_outer(t: Tables) -> lk.LazyFrame:
    a, b = _sides(t)
    return a.join(b, on="k", how="outer", many=True)


@_query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_semi(t: Tables) -> lk.LazyFrame:
    return t.customer.join(t.orders.filter(col("o_totalprice") > 400000), left_on="c_custkey", right_on="o_custkey", how="semi")


@_query("SELECT * FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 400000)")
def join_anti(t: Tables) -> lk.LazyFrame:
    return t.customer.join(t.orders.filter(col("o_totalprice") > 400000), left_on="c_custkey", right_on="o_custkey", how="anti")


@_query("SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_right, b.n_name AS n_name_right, b.n_regionkey AS n_regionkey_right FROM nation a, nation b")
def join_cross(t: Tables) -> lk.LazyFrame:
    return t.nation.join_cross(t.nation)


@_query("SELECT s_suppkey, s_acctbal, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > n_regionkey * 1000 WHERE s_acctbal < 6000")
def join_where(t: Tables) -> lk.LazyFrame:
    pairs = t.supplier.join_where(t.nation, col("s_nationkey") == col("n_nationkey"), col("s_acctbal") > col("n_regionkey") * 1000)
    return pairs.filter(col("s_acctbal") < 6000).select("s_suppkey", "s_acctbal", "n_name")


def _events(t: Tables, kind: str) -> lk.LazyFrame:
    return t.events.filter(event_type=kind).select("event_id", "ts", "user_id", "value")


_ASOF = """WITH a AS (SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'view')
SELECT a.*, b.event_id AS event_id_right, b.value AS value_right FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts {} b.ts"""


@_query(_ASOF.format(">="))
def join_asof_backward(t: Tables) -> lk.LazyFrame:
    return _events(t, "purchase").join_asof(_events(t, "view"), on="ts", by="user_id")


@_query(_ASOF.format("<="))
def join_asof_forward(t: Tables) -> lk.LazyFrame:
    return _events(t, "purchase").join_asof(_events(t, "view"), on="ts", by="user_id", strategy="forward")


@_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def group_rollup(t: Tables) -> lk.LazyFrame:
    return t.orders.group_by("o_orderstatus", "o_orderpriority", strategy="ROLLUP").agg(lk.len().alias("n"), col("o_totalprice").max().alias("top"))


@_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def group_cube(t: Tables) -> lk.LazyFrame:
    return t.orders.group_by("o_orderstatus", "o_orderpriority", strategy="CUBE").agg(lk.len().alias("n"), col("o_totalprice").max().alias("top"))


@_query("SELECT year(o_orderdate)::INT AS y, o_orderstatus, min(o_totalprice) AS low FROM orders GROUP BY ALL")
def group_by_all(t: Tables) -> lk.LazyFrame:
    return t.orders.group_by_all(col("o_orderdate").dt.year().cast("Int32").alias("y"), "o_orderstatus", col("o_totalprice").min().alias("low"))


@_query("SELECT CASE WHEN l_tax > 0.02 THEN l_returnflag END AS flag, count(*) AS n FROM lineitem WHERE l_tax > 0.02 GROUP BY ALL")
def group_without_null_keys(t: Tables) -> lk.LazyFrame:
    keyed = t.lineitem.select(lk.when(col("l_tax") > 0.02).then(col("l_returnflag")).alias("flag"))
    return keyed.group_by("flag", drop_null_keys=True).len("n")


@_query("""
SELECT event_type, count(value) AS n, count(*) AS rows, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, median(value) AS median, min(value) AS low, max(value) AS high,
    round(stddev_samp(value), 6) AS std, round(stddev_pop(value), 6) AS std0, round(var_samp(value), 4) AS var, round(var_pop(value), 4) AS var0, round(kurtosis_pop(value), 4) AS kurt,
    round(skewness(value) / (sqrt(count(*) * (count(*) - 1.0)) / (count(*) - 2)), 4) AS skew, round(skewness(value), 4) AS skew_unbiased, round(quantile_cont(value, 0.9), 4) AS q90,
    quantile_disc(value, 0.9) AS q90_disc, count(DISTINCT user_id) AS users, max_by(event_id, value * 100000 + event_id) AS best, min_by(event_id, value * 100000 + event_id) AS worst,
    round(sum(value * user_id), 2) AS dot, bit_and(user_id) AS b_and, bit_or(user_id) AS b_or, bit_xor(user_id) AS b_xor, bool_and(value > 0) AS all_pos, bool_or(value > 90) AS any_big,
    (count(*) - count(nullif(user_id, 7)))::BIGINT AS nulls, bool_or(nullif(user_id, 7) IS NULL) AS has_nulls, round(ln(sum(value)) - sum(value * ln(value)) / sum(value), 4) AS entropy
FROM events GROUP BY ALL""")
def aggregates(t: Tables) -> lk.LazyFrame:
    v, u, half = col("value"), col("user_id"), "half_away_from_zero"
    score = v * 100000 + col("event_id")
    seven = lk.when(u != 7).then(u)._finish()
    return t.events.group_by("event_type").agg(
        v.count().alias("n"), v.len().alias("rows"), v.sum().round(2, mode=half).alias("total"), v.mean().round(4, mode=half).alias("mean"), v.median().alias("median"), v.min().alias("low"), v.max().alias("high"),
        v.std().round(6, mode=half).alias("std"), v.std(0).round(6, mode=half).alias("std0"), v.var().round(4, mode=half).alias("var"), v.var(0).round(4, mode=half).alias("var0"), v.kurtosis().round(4, mode=half).alias("kurt"),
        v.skew().round(4, mode=half).alias("skew"), v.skew(bias=False).round(4, mode=half).alias("skew_unbiased"), v.quantile(0.9).round(4, mode=half).alias("q90"), v.quantile(0.9, interpolation=False).alias("q90_disc"),
        u.n_unique().alias("users"), col("event_id").max_by(score).alias("best"), col("event_id").min_by(score).alias("worst"), v.dot(u).round(2, mode=half).alias("dot"),
        u.bitwise_and().alias("b_and"), u.bitwise_or().alias("b_or"), u.bitwise_xor().alias("b_xor"), (v > 0).all().alias("all_pos"), (v > 90).any().alias("any_big"),
        seven.null_count().alias("nulls"), seven.has_nulls().alias("has_nulls"), v.entropy().round(4, mode=half).alias("entropy"),
    )


@_query("""SELECT round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, median(c_acctbal) AS median, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) AS n,
round(product(1 + c_acctbal / 1e8), 6) AS product, mode(c_nationkey ORDER BY c_nationkey) IS NOT NULL AS has_mode, count(DISTINCT c_mktsegment) AS segments FROM customer""")
def whole_frame_aggregates(t: Tables) -> lk.LazyFrame:
    half, b = "half_away_from_zero", "c_acctbal"
    return t.customer.select(
        lk.sum(b).round(2, mode=half).alias("total"), lk.mean(b).round(4, mode=half).alias("mean"), lk.median(b).alias("median"), lk.min(b).alias("low"), lk.max(b).alias("high"), lk.len().alias("n"),
        (1 + col(b) / 1e8).product().round(6, mode=half).alias("product"), col("c_nationkey").mode().is_not_null().alias("has_mode"), col("c_mktsegment").n_unique().alias("segments"),
    )


@_query("""SELECT o_orderpriority, list_sort(list(o_orderkey)) AS keys, list_sort(list(DISTINCT o_orderstatus)) AS statuses FROM orders GROUP BY ALL""")
def group_to_lists(t: Tables) -> lk.LazyFrame:
    lists = t.orders.group_by("o_orderpriority").agg(col("o_orderkey").implode().alias("keys"), col("o_orderstatus").unique().alias("statuses"))
    return lists.select("o_orderpriority", col("keys").list.sort(), col("statuses").list.sort())


@_query("""SELECT c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal, max(c_custkey) AS top, list_aggregate(list(c_nationkey), 'max') AS nation FROM customer GROUP BY ALL""")
def group_shortcuts(t: Tables) -> lk.LazyFrame:
    g = t.customer.select("c_mktsegment", "c_acctbal", "c_custkey", "c_nationkey")
    total = g.select("c_mktsegment", "c_acctbal").group_by("c_mktsegment").sum().with_columns(col("c_acctbal").round(2, mode="half_away_from_zero"))
    top = g.select("c_mktsegment", col("c_custkey").alias("top")).group_by("c_mktsegment").max()
    every = g.select("c_mktsegment", col("c_nationkey").alias("nation")).group_by("c_mktsegment").all().with_columns(col("nation").list.max())
    return total.join(top, on="c_mktsegment").join(every, on="c_mktsegment")


@_query("""SELECT * FROM (VALUES ('count'), ('mean'), ('stddev'), ('min'), ('max'), ('median')) x(aggr) JOIN (
SELECT 'count' AS aggr, count(s_acctbal)::DOUBLE AS s_acctbal, count(s_name)::VARCHAR AS s_name FROM supplier UNION ALL SELECT 'mean', round(avg(s_acctbal), 4), NULL FROM supplier
UNION ALL SELECT 'stddev', round(stddev_samp(s_acctbal), 4), NULL FROM supplier UNION ALL SELECT 'min', min(s_acctbal), min(s_name) FROM supplier
UNION ALL SELECT 'max', max(s_acctbal), max(s_name) FROM supplier UNION ALL SELECT 'median', round(median(s_acctbal), 4), NULL FROM supplier) USING (aggr)""")
def describe(t: Tables) -> lk.LazyFrame:
    return t.supplier.select("s_acctbal", "s_name").describe().with_columns(col("s_acctbal").round(4, mode="half_away_from_zero"))


# windows


@_query("""
SELECT event_id, rank() OVER w + (count(*) OVER (PARTITION BY user_id, event_type) - 1) / 2.0::DOUBLE AS r_avg, (rank() OVER w)::BIGINT AS r_min,
    (rank() OVER w + count(*) OVER (PARTITION BY user_id, event_type) - 1)::BIGINT AS r_max, (dense_rank() OVER w)::BIGINT AS r_dense,
    (row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id))::BIGINT AS r_ord, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS sorted_at
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)""")
def ranks(t: Tables) -> lk.LazyFrame:
    kind, u = col("event_type"), "user_id"
    return t.events.select(
        "event_id", kind.rank().over(u).alias("r_avg"), _long(kind.rank("min").over(u), "r_min"), _long(kind.rank("max").over(u), "r_max"), _long(kind.rank("dense").over(u), "r_dense"),
        _long(col("value").rank("ordinal", descending=True).over(u, order_by="event_id"), "r_ord"), _long(col("event_id").arg_sort().over(u), "sorted_at"),
    )


@_query("""
SELECT event_id, lag(value) OVER w AS prev, lead(value, 2) OVER w AS ahead, round(value - lag(value) OVER w, 4) AS step, round(value / lag(value) OVER w - 1, 4) AS change,
    count(value) OVER u AS c_count, round(sum(value) OVER u, 2) AS c_sum, min(value) OVER u AS c_min, max(value) OVER u AS c_max, round(sum(value) OVER d, 2) AS c_back,
    round(avg(value) OVER (PARTITION BY user_id), 4) AS mean, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id), u AS (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def windows(t: Tables) -> lk.LazyFrame:
    v, half = col("value"), "half_away_from_zero"
    by = lambda e: e.over("user_id", order_by="event_id")
    return t.events.select(
        "event_id", by(v.shift()).alias("prev"), by(v.shift(-2)).alias("ahead"), by(v.diff()).round(4, mode=half).alias("step"), by(v.pct_change()).round(4, mode=half).alias("change"),
        by(v.cum_count()).alias("c_count"), by(v.cum_sum()).round(2, mode=half).alias("c_sum"), by(v.cum_min()).alias("c_min"), by(v.cum_max()).alias("c_max"), by(v.cum_sum(reverse=True)).round(2, mode=half).alias("c_back"),
        v.mean().over("user_id").round(4, mode=half).alias("mean"), by(col("event_id").first()).alias("first_id"),
    )


@_query("""
SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 4) END AS r_mean, CASE WHEN count(value) OVER w >= 3 THEN round(sum(value) OVER w, 4) END AS r_sum,
    CASE WHEN count(value) OVER w >= 1 THEN max(value) OVER w END AS r_max, CASE WHEN count(value) OVER w >= 3 THEN min(value) OVER w END AS r_min, CASE WHEN count(value) OVER w >= 3 THEN round(median(value) OVER w, 4) END AS r_med,
    CASE WHEN count(value) OVER w >= 3 THEN round(stddev_samp(value) OVER w, 4) END AS r_std, CASE WHEN count(value) OVER w >= 3 THEN round(var_pop(value) OVER w, 3) END AS r_var,
    CASE WHEN count(value) OVER c >= 4 THEN round(sum(value) OVER c, 4) END AS r_mid
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), c AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def rolling(t: Tables) -> lk.LazyFrame:
    v, half = col("value"), "half_away_from_zero"
    by = lambda e: e.over("user_id", order_by="event_id")
    return t.events.select(
        "event_id", by(v.rolling_mean(3)).round(4, mode=half).alias("r_mean"), by(v.rolling_sum(3)).round(4, mode=half).alias("r_sum"), by(v.rolling_max(3, 1)).alias("r_max"), by(v.rolling_min(3)).alias("r_min"),
        by(v.rolling_median(3)).round(4, mode=half).alias("r_med"), by(v.rolling_std(3)).round(4, mode=half).alias("r_std"), by(v.rolling_var(3, ddof=0)).round(3, mode=half).alias("r_var"),
        by(v.rolling_sum(4, center=True)).round(4, mode=half).alias("r_mid"),
    )


@_query("""
WITH x AS (SELECT event_id, user_id, CASE WHEN value > 30 THEN value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER w AS forward, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward,
    first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS backward1, coalesce(v, 0) AS zero, coalesce(v, -1.5) AS given, coalesce(v, min(v) OVER (PARTITION BY user_id)) AS low
FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fills(t: Tables) -> lk.LazyFrame:
    v = col("v")
    by = lambda e: e.over("user_id", order_by="event_id")
    frame = t.events.select("event_id", "user_id", lk.when(col("value") > 30).then(col("value")).alias("v"))
    return frame.select(
        "event_id", by(v.forward_fill()).alias("forward"), by(v.backward_fill()).alias("backward"), by(v.backward_fill(1)).alias("backward1"), v.fill_null(strategy="zero").alias("zero"),
        v.fill_null(-1.5).alias("given"), v.fill_null(strategy="min").over("user_id").alias("low"),
    )


@_query("""
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) > 1 AS dup, count(*) OVER (PARTITION BY o_custkey) = 1 AS uniq,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS is_first, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS is_last
FROM orders""")
def distinctness(t: Tables) -> lk.LazyFrame:
    c = col("o_custkey")
    return t.orders.select("o_orderkey", c.is_duplicated().alias("dup"), c.is_unique().alias("uniq"), c.is_first_distinct().over(order_by="o_orderkey").alias("is_first"), c.is_last_distinct().over(order_by="o_orderkey").alias("is_last"))


@_query("""SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2""")
def top_of_each_group(t: Tables) -> lk.LazyFrame:
    ranked = t.orders.with_columns(col("o_totalprice").rank("ordinal", descending=True).over("o_custkey", order_by="o_orderkey").alias("r"))
    return ranked.filter(col("r") <= 2).select("o_orderkey", "o_custkey", "o_totalprice")


# order, rows, duplicates


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(t: Tables) -> lk.LazyFrame:
    return t.orders.select("o_orderkey", "o_totalprice").top_k(20, ["o_totalprice", "o_orderkey"], reverse=[False, True])


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def bottom_k(t: Tables) -> lk.LazyFrame:
    return t.orders.select("o_orderkey", "o_totalprice").bottom_k(20, ["o_totalprice", "o_orderkey"])


@_query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey OFFSET 5 LIMIT 30")
def sort_and_slice(t: Tables) -> lk.LazyFrame:
    return t.customer.select("c_custkey", "c_acctbal").sort("c_acctbal", "c_custkey", descending=[True, False]).slice(5, 30)


@_query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey DESC LIMIT 7")
def tail(t: Tables) -> lk.LazyFrame:
    return t.customer.select("c_custkey", "c_acctbal").tail(7, order_by="c_custkey")


@_query("SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, c_custkey FROM customer")
def row_index(t: Tables) -> lk.LazyFrame:
    return t.customer.with_row_index("i", order_by=["c_acctbal", "c_custkey"]).select("i", "c_custkey")


@_query("SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) WHERE i >= 1 AND (i - 1) % 3 = 0")
def gather_every(t: Tables) -> lk.LazyFrame:
    return t.supplier.select("s_suppkey", "s_name").gather_every(3, 1)


@_query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey DESC, n_name DESC")
def reverse(t: Tables) -> lk.LazyFrame:
    return t.nation.select("n_nationkey", "n_name").reverse()


@_query("""SELECT 'any' AS kind, o_orderstatus AS a, NULL::BIGINT AS b FROM (SELECT DISTINCT o_orderstatus FROM orders)
UNION ALL SELECT 'first', o_orderstatus, min(o_orderkey) FROM orders GROUP BY ALL UNION ALL SELECT 'last', o_orderstatus, max(o_orderkey) FROM orders GROUP BY ALL
UNION ALL SELECT 'none', NULL, o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1""")
def unique_rows(t: Tables) -> lk.LazyFrame:
    o, s = t.orders, "o_orderstatus"
    out = o.select(s).unique().select(lit("any").alias("kind"), col(s).alias("a"), lit(None).cast("Int64").alias("b"))
    for keep in ("first", "last"):
        out = out.union(o.unique(s, keep=keep, order_by="o_orderkey").select(lit(keep).alias("kind"), col(s).alias("a"), col("o_orderkey").alias("b")))
    return out.union(o.unique("o_custkey", keep="none").select(lit("none").alias("kind"), lit(None).cast("String").alias("a"), col("o_custkey").alias("b")))


@_query("""SELECT 'union' AS kind, k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'distinct', k FROM (SELECT DISTINCT c_nationkey AS k FROM customer)""")
def set_operations(t: Tables) -> lk.LazyFrame:
    a, b = t.customer.select(col("c_nationkey").alias("k")), t.supplier.select(col("s_nationkey").alias("k"))
    parts = {"union": a.union(b), "intersect": a.intersect(b), "except": a.except_(b), "distinct": a.distinct()}
    first, *rest = [f.select(lit(k).alias("kind"), "k") for k, f in parts.items()]
    for r in rest:
        first = first.union(r)
    return first


# shapes


@_query("SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS BUILDING, count(*) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY FROM customer GROUP BY ALL")
def pivot(t: Tables) -> lk.LazyFrame:
    return t.customer.pivot("c_mktsegment", ["BUILDING", "MACHINERY"], index="c_nationkey", values="c_custkey", aggregate_function="count")


@_query("""SELECT l_orderkey, l_linenumber, variable, value FROM lineitem UNPIVOT (value FOR variable IN (l_discount, l_tax))""")
def unpivot(t: Tables) -> lk.LazyFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax").unpivot(["l_discount", "l_tax"], index=["l_orderkey", "l_linenumber"])


@_query("SELECT vec_id, label, round(unnest(embedding)::DOUBLE, 5) AS x FROM embeddings")
def explode(t: Tables) -> lk.LazyFrame:
    return t.embeddings.explode("embedding").select("vec_id", "label", col("embedding").cast("Float64").round(5, mode="half_away_from_zero").alias("x"))


@_query("SELECT c_custkey, c_name AS name, c_acctbal AS balance, to_json({'name': c_name, 'seg': c_mktsegment}) AS js, c_mktsegment AS seg FROM customer")
def structs(t: Tables) -> lk.LazyFrame:
    both = fn.struct_pack(name=col("c_name"), seg=col("c_mktsegment"))
    frame = t.customer.select("c_custkey", both.alias("s"), both.struct.json_encode().alias("js"), col("c_acctbal"))
    return frame.select("c_custkey", "js", col("s").struct.with_fields(balance=col("c_acctbal")).alias("s")).unnest("s")


# scalars


@_query("""
SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, round(l_quantity / l_linenumber, 6) AS b, (l_partkey // 7)::BIGINT AS c, l_partkey % 7 AS d, round(pow(l_quantity, 2), 2) AS e, -l_quantity AS f, abs(l_tax - 0.05) > 0.02 AS g,
    l_quantity BETWEEN 10 AND 20 AS h, l_quantity > 10 AND l_quantity <= 20 AS i, l_returnflag IN ('A', 'R') AS j, least(greatest(l_quantity, 5), 30) AS k, NOT (l_linestatus = 'F') OR l_tax = 0 AS l, xor(l_partkey, 5) AS m,
    CASE WHEN l_returnflag = 'A' THEN 'Z' ELSE l_returnflag END AS n, l_quantity::BIGINT AS o, round_even(l_extendedprice / 1000, 1) AS p, floor(l_discount * 10) AS q, ceil(l_discount * 10) AS r, l_quantity / 0 AS s
FROM lineitem""")
def scalars(t: Tables) -> lk.LazyFrame:
    q, tax, key, flag = col("l_quantity"), col("l_tax"), col("l_partkey"), col("l_returnflag")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", (q + tax).alias("a"), (q / col("l_linenumber")).round(6, mode="half_away_from_zero").alias("b"), _long(key // 7, "c"), (key % 7).alias("d"), (q**2).round(2).alias("e"), (-q).alias("f"), ((tax - 0.05).abs() > 0.02).alias("g"),
        q.is_between(10, 20).alias("h"), q.is_between(10, 20, "right").alias("i"), flag.is_in(["A", "R"]).alias("j"), q.clip(5, 30).alias("k"), (~(col("l_linestatus") == "F") | (tax == 0)).alias("l"), key.xor(5).alias("m"),
        flag.replace("A", "Z").alias("n"), _long(q, "o"), (col("l_extendedprice") / 1000).round(1).alias("p"), (col("l_discount") * 10).floor().alias("q"), (col("l_discount") * 10).ceil().alias("r"), (q / 0).alias("s"),
    )


@_query("""
SELECT event_id, round(sqrt(value), 6) AS a, round(cbrt(value), 6) AS b, round(ln(value), 6) AS c, round(log10(value), 6) AS d, round(ln(1 + value), 6) AS e, round(exp(value / 100), 6) AS f, round(sin(value), 6) AS g, round(cos(value), 6) AS h,
    round(tan(value / 100), 6) AS i, round(atan(value), 6) AS j, round(asin(value / 1000), 6) AS k, round(sinh(value / 100), 6) AS l, round(tanh(value), 6) AS m, round(degrees(value), 4) AS n, round(radians(value), 6) AS o, sign(value - 50)::INT AS p,
    round(log2(value), 6) AS q, round(cot(value), 4) AS r, ln(value - value) AS s
FROM events""")
def mathematics(t: Tables) -> lk.LazyFrame:
    v = col("value")
    made = {
        "a": v.sqrt(), "b": v.cbrt(), "c": v.log(), "d": v.log10(), "e": v.log1p(), "f": (v / 100).exp(), "g": v.sin(), "h": v.cos(), "i": (v / 100).tan(), "j": v.arctan(), "k": (v / 1000).arcsin(), "l": (v / 100).sinh(),
        "m": v.tanh(), "o": v.radians(), "q": fn.log2(v),
    }
    rounded = [e.round(6, mode="half_away_from_zero").alias(n) for n, e in made.items()]
    return t.events.select(
        "event_id", *rounded, v.degrees().round(4, mode="half_away_from_zero").alias("n"), (v - 50).sign().cast("Int32").alias("p"), v.cot().round(4, mode="half_away_from_zero").alias("r"), (v - v).log().alias("s")
    )


@_query("""
SELECT l_orderkey, l_linenumber, coalesce(nullif(l_tax, 0), l_discount) AS a, l_tax + coalesce(l_discount, 0) + coalesce(l_quantity, 0) AS b, least(l_tax, l_discount) AS c, greatest(l_tax, l_discount) AS d,
    round((l_tax + l_discount) / 2, 6) AS e, l_tax > 0 AND l_discount > 0 AS f, l_tax > 0 OR l_discount > 0 AS g, CASE WHEN l_tax > 0.05 THEN 'high' WHEN l_tax > 0 AND l_discount > 0 THEN 'both' ELSE 'low' END AS h
FROM lineitem""")
def horizontal(t: Tables) -> lk.LazyFrame:
    tax, disc = col("l_tax"), col("l_discount")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", lk.coalesce(lk.when(tax != 0).then(tax)._finish(), disc).alias("a"), lk.sum_horizontal(tax, disc, "l_quantity").alias("b"), lk.min_horizontal(tax, disc).alias("c"), lk.max_horizontal(tax, disc).alias("d"),
        lk.mean_horizontal(tax, disc).round(6, mode="half_away_from_zero").alias("e"), lk.all_horizontal(tax > 0, disc > 0).alias("f"), lk.any_horizontal(tax > 0, disc > 0).alias("g"),
        lk.when(tax > 0.05).then("high").when(tax > 0, disc > 0).then("both").otherwise("low").alias("h"),
    )


@_query("""
WITH x AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'NaN'::DOUBLE WHEN event_type = 'error' THEN 'Infinity'::DOUBLE WHEN event_type = 'click' THEN NULL ELSE value END AS v FROM events)
SELECT event_id, isnan(v) AS nan, NOT isnan(v) AS not_nan, isfinite(v) AS fin, isinf(v) AS inf, v IS NULL AS nul, v IS NOT NULL AS not_nul, CASE WHEN isnan(v) THEN 0 ELSE v END AS filled FROM x""")
def nulls_and_nans(t: Tables) -> lk.LazyFrame:
    kind, v = col("event_type"), col("v")
    made = lk.when(kind == "view").then(float("nan")).when(kind == "error").then(float("inf")).when(kind == "click").then(None).otherwise(col("value"))
    return t.events.select("event_id", made.alias("v")).select(
        "event_id", v.is_nan().alias("nan"), v.is_not_nan().alias("not_nan"), v.is_finite().alias("fin"), v.is_infinite().alias("inf"), v.is_null().alias("nul"), v.is_not_null().alias("not_nul"), v.fill_nan(0.0).alias("filled")
    )


@_query("""
SELECT p_partkey, upper(p_name) AS a, lower(p_type) AS b, length(p_name) AS c, strlen(p_name)::BIGINT AS d, contains(p_name, 'ring') AS e, regexp_matches(p_name, '^s.*g$') AS f, starts_with(p_name, 'small') AS g, ends_with(p_name, 'ring') AS h,
    replace(p_name, 'a', '4') AS i, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS j, trim(p_brand, 'B#') AS k, ltrim(p_brand, 'B') AS l, rtrim(p_brand, '0123456789') AS m, substring(p_name, 3, 4) AS n, string_split(p_name, ' ') AS o,
    regexp_extract_all(p_name, '[aeiou]') AS p, regexp_extract(p_brand, '#([0-9]+)', 1) AS q, CASE WHEN contains(p_name, 'i') THEN instr(p_name, 'i') - 1 END AS r, to_base64(p_name::BLOB) AS s, lower(hex(p_brand)) AS t,
    len(regexp_extract_all(p_name, '[a-f]')) AS u, p_name[1:3] AS v, right(p_name, 3) AS w, reverse(p_name) AS x, lpad(p_brand, 12, '*') AS y, rpad(p_brand, 12, '-') AS z
FROM part""")
def strings(t: Tables) -> lk.LazyFrame:
    n, b = col("p_name").str, col("p_brand").str
    return t.part.select(
        "p_partkey", n.to_uppercase().alias("a"), col("p_type").str.to_lowercase().alias("b"), _long(n.len_chars(), "c"), _long(n.len_bytes(), "d"), n.contains("ring", literal=True).alias("e"), n.contains("^s.*g$").alias("f"), n.starts_with("small").alias("g"),
        n.ends_with("ring").alias("h"), n.replace("a", "4").alias("i"), n.replace_all("([aeiou])", r"<\1>").alias("j"), b.strip_chars("B#").alias("k"), b.strip_chars_start("B").alias("l"), b.strip_chars_end("0123456789").alias("m"),
        n.slice(2, 4).alias("n"), n.split(" ").alias("o"), n.extract_all("[aeiou]").alias("p"), b.extract("#([0-9]+)").alias("q"), _long(n.find("i", literal=True), "r"), n.encode().alias("s"), b.encode("hex").alias("t"),
        _long(n.count_matches("[a-f]"), "u"), n.head(3).alias("v"), n.tail(3).alias("w"), n.reverse().alias("x"), b.pad_start(12, "*").alias("y"), b.pad_end(12, "-").alias("z"),
    )


@_query("""
SELECT c_custkey, lpad(c_custkey::VARCHAR, 9, '0') AS a, CASE WHEN starts_with(c_name, 'Customer#') THEN substring(c_name, 10) ELSE c_name END AS b, CASE WHEN ends_with(c_name, '0') THEN c_name[:-2] ELSE c_name END AS c,
    list_aggregate(list_transform(string_split(lower(c_mktsegment), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS d, substring(c_name, 4) AS e, c_name[:-4] AS f, c_acctbal::DECIMAL(18, 1) AS g, c_name AS h FROM customer""")
def strings_more(t: Tables) -> lk.LazyFrame:
    n = col("c_name").str
    return t.customer.select(
        "c_custkey", col("c_custkey").cast("String").str.zfill(9).alias("a"), n.strip_prefix("Customer#").alias("b"), n.strip_suffix("0").alias("c"), col("c_mktsegment").str.to_titlecase().alias("d"), n.tail(-3).alias("e"), n.head(-3).alias("f"),
        col("c_acctbal").cast("String").str.to_decimal(1).alias("g"), n.normalize().alias("h"),
    )


@_query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_paths(t: Tables) -> lk.LazyFrame:
    p = col("props").str
    return t.events.select("event_id", _long(p.json_path_match("$.k"), "k"), p.json_path_match("$.missing").alias("missing"))


@_query("""SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY ALL""")
def joined_texts(t: Tables) -> lk.LazyFrame:
    return t.nation.group_by("n_regionkey").agg(col("n_name").implode().alias("x")).select("n_regionkey", col("x").list.sort().list.join("|").alias("names"))


@_query("""
SELECT vec_id, len(embedding) AS a, round(list_min(embedding)::DOUBLE, 5) AS b, round(list_max(embedding)::DOUBLE, 5) AS c, round(list_sum(embedding)::DOUBLE, 3) AS d, round(list_avg(embedding)::DOUBLE, 4) AS e, round(embedding[1]::DOUBLE, 5) AS f,
    round(embedding[-1]::DOUBLE, 5) AS g, round(list_aggregate(embedding, 'median')::DOUBLE, 4) AS h, round(list_aggregate(embedding, 'stddev_samp')::DOUBLE, 4) AS i, len(list_filter(embedding, lambda x: x > 0)) AS j,
    list_transform(embedding[1:3], lambda x: round((x * 2)::DOUBLE, 4)) AS k, round(list_sort(embedding)[1]::DOUBLE, 5) AS l, list_contains(embedding, 5) AS m, len(list_distinct(embedding)) AS n, round(list_reverse(embedding)[1]::DOUBLE, 5) AS o, embedding[100] IS NULL AS p,
    list_bool_and(list_transform(embedding, lambda x: x < 1)) AS q, list_bool_or(list_transform(embedding, lambda x: x > 0.2)) AS r
FROM embeddings""")
def lists(t: Tables) -> lk.LazyFrame:
    e, half = col("embedding").list, "half_away_from_zero"
    r = lambda x, n, d=5: x.cast("Float64").round(d, mode=half).alias(n)
    x = lk.element()
    return t.embeddings.select(
        "vec_id", _long(e.len(), "a"), r(e.min(), "b"), r(e.max(), "c"), r(e.sum(), "d", 3), r(e.mean(), "e", 4), r(e.first(), "f"), r(e.last(), "g"), r(e.median(), "h", 4), r(e.std(), "i", 4), _long(e.filter(x > 0).list.len(), "j"),
        fn.list_slice(col("embedding"), 1, 3).list.eval((x * 2).cast("Float64").round(4, mode=half)).alias("k"), r(e.sort().list.get(0), "l"), e.contains(lit(5.0).cast("Float32")).alias("m"), _long(e.n_unique(), "n"), r(e.reverse().list.first(), "o"),
        e.get(99).is_null().alias("p"), e.eval(x < 1).list.all().alias("q"), e.eval(x > 0.2).list.any().alias("r"),
    )


@_query("""
SELECT event_id, year(ts)::BIGINT AS a, quarter(ts)::BIGINT AS b, month(ts)::BIGINT AS c, week(ts)::BIGINT AS d, isodow(ts)::BIGINT AS e, day(ts)::BIGINT AS f, dayofyear(ts)::BIGINT AS g, hour(ts)::BIGINT AS h, minute(ts)::BIGINT AS i, second(ts)::BIGINT AS j,
    (epoch_us(ts) % 1000000) AS k, (epoch_us(ts) % 1000000) // 1000 AS l, date_trunc('month', ts)::TIMESTAMP AS m, date_trunc('hour', ts)::TIMESTAMP AS n, ts::DATE AS o, strftime(ts, '%Y/%m/%d %H:%M') AS p, epoch_us(ts) AS q, epoch_ms(ts) AS r,
    ts + INTERVAL 3 DAY AS s, isoyear(ts)::BIGINT AS t, century(ts)::BIGINT AS u, millennium(ts)::BIGINT AS v, last_day(ts) + (ts - date_trunc('day', ts)) AS w, date_trunc('month', ts) + (ts - date_trunc('day', ts)) AS x, floor(epoch_us(ts) / 1e6) AS y,
    strptime(strftime(ts, '%d.%m.%Y'), '%d.%m.%Y') AS z
FROM events""")
def temporal(t: Tables) -> lk.LazyFrame:
    d = col("ts").dt
    parts = {"a": d.year(), "b": d.quarter(), "c": d.month(), "d": d.week(), "e": d.weekday(), "f": d.day(), "g": d.ordinal_day(), "h": d.hour(), "i": d.minute(), "j": d.second(), "k": d.microsecond(), "l": d.millisecond(), "t": d.iso_year(), "u": d.century(), "v": d.millennium()}
    return t.events.select(
        "event_id", *[_long(e, n) for n, e in parts.items()], d.truncate("month").alias("m"), d.truncate("hour").alias("n"), d.date().alias("o"), d.to_string("%Y/%m/%d %H:%M").alias("p"), d.epoch().alias("q"), d.epoch("ms").alias("r"), d.offset_by("3d").alias("s"),
        d.month_end().alias("w"), d.month_start().alias("x"), d.epoch("s").alias("y"), d.strftime("%d.%m.%Y").str.strptime("%d.%m.%Y").alias("z"),
    )


@_query("SELECT p_size, p_retailprice, p_partkey, p_name AS NAME_X, p_brand AS BRAND_X FROM part")
def selectors_and_names(t: Tables) -> lk.LazyFrame:
    texts = selectors.string() & (selectors.matches("name") | selectors.ends_with("brand"))
    return t.part.select(selectors.numeric(), texts.name.map(lambda n: n[2:].upper() + "_X"))


@_query("SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY ALL HAVING sum(o_totalprice) > 1000000")
def from_sql(t: Tables) -> lk.LazyFrame:
    return lk.from_query("SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders_in GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000", orders_in=t.orders)


@_query("""SELECT p_type, rows, round(mean, 4) AS mean FROM (SELECT p_type, count(*) AS rows, avg(p_retailprice) AS mean FROM part WHERE p_size IS NOT NULL AND p_size > 10 GROUP BY ALL) WHERE rows > 1""")
def renamed_and_cast(t: Tables) -> lk.LazyFrame:
    frame = t.part.drop_nulls("p_size").rename({"p_retailprice": "price"}).cast({"p_size": "Float64"}).filter(col("p_size") > 10).drop("p_name")
    return frame.group_by("p_type").agg(lk.len().alias("rows"), col("price").mean().round(4, mode="half_away_from_zero").alias("mean")).filter(col("rows") > 1)


# functions of the catalogue


@_query("""
SELECT p_partkey, md5(p_name) AS a, sha256(p_name) AS b, levenshtein(p_name, p_type) AS c, greatest(p_size, 20) AS d, gcd(p_size, 12)::BIGINT AS e, lcm(p_size, 12)::BIGINT AS f, round(gamma(p_size / 10.0 + 1), 4) AS g, even(p_size / 3.0)::DOUBLE AS h,
    hamming(lpad(p_name, 20, ' '), lpad(p_type, 20, ' ')) AS i, to_base(p_partkey, 16) AS j, url_encode(p_name) AS k, ascii(p_name) AS l, split_part(p_name, ' ', 2) AS m, bar(p_size, 0, 50, 10) IS NOT NULL AS n, round(jaccard(p_name, p_type), 4) AS o,
    strip_accents(p_name) AS p, format('{}-{}', p_brand, p_size) AS q, translate(p_name, 'abc', 'xyz') AS r, bit_count(p_size)::BIGINT AS s, round(jaro_winkler_similarity(p_name, p_type), 4) AS t, damerau_levenshtein(p_name, p_type) AS u
FROM part""")
def catalogue_scalars(t: Tables) -> lk.LazyFrame:
    name, kind, size = col("p_name"), col("p_type"), col("p_size")
    half = "half_away_from_zero"
    return t.part.select(
        "p_partkey", fn.md5(name).alias("a"), fn.sha256(name).alias("b"), _long(fn.levenshtein(name, kind), "c"), fn.greatest(size, 20).alias("d"), _long(fn.gcd(size, 12), "e"), _long(fn.lcm(size, 12), "f"), fn.gamma(size / 10.0 + 1).round(4, mode=half).alias("g"),
        fn.even(size / 3.0).cast("Float64").alias("h"), _long(fn.hamming(fn.lpad(name, 20, " "), fn.lpad(kind, 20, " ")), "i"), fn.to_base(col("p_partkey"), 16).alias("j"), fn.url_encode(name).alias("k"), fn.ascii(name).alias("l"),
        fn.split_part(name, " ", 2).alias("m"), fn.bar(size, 0, 50, 10).is_not_null().alias("n"), fn.jaccard(name, kind).round(4, mode=half).alias("o"), fn.strip_accents(name).alias("p"), fn.format("{}-{}", col("p_brand"), size).alias("q"),
        fn.translate(name, "abc", "xyz").alias("r"), _long(fn.bit_count(size), "s"), fn.jaro_winkler_similarity(name, kind).round(4, mode=half).alias("t"), _long(fn.damerau_levenshtein(name, kind), "u"),
    )


@_query("""
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS a, round(covar_pop(l_quantity, l_tax), 6) AS b, round(regr_slope(l_extendedprice, l_quantity), 4) AS c, round(geomean(l_quantity), 4) AS d, round(sem(l_quantity), 6) AS e,
    round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS f, mad(l_quantity) AS g, map_values(histogram(l_linenumber))::BIGINT[] AS h, round(entropy(l_linenumber), 6) AS i, count_if(l_tax = 0)::BIGINT AS j, arg_max(l_linenumber, l_orderkey * 10 + l_linenumber) AS k,
    round(favg(l_tax), 8) AS l
FROM lineitem GROUP BY ALL""")
def catalogue_aggregates(t: Tables) -> lk.LazyFrame:
    q, half, line = col("l_quantity"), "half_away_from_zero", col("l_linenumber")
    return t.lineitem.group_by("l_returnflag").agg(
        fn.corr(q, col("l_extendedprice")).round(6, mode=half).alias("a"), fn.covar_pop(q, col("l_tax")).round(6, mode=half).alias("b"), fn.regr_slope(col("l_extendedprice"), q).round(4, mode=half).alias("c"), fn.geomean(q).round(4, mode=half).alias("d"),
        fn.sem(q).round(6, mode=half).alias("e"), fn.weighted_avg(col("l_tax"), q).round(6, mode=half).alias("f"), fn.mad(q).alias("g"), fn.map_values(fn.histogram(line)).alias("h"), fn.entropy(line).round(6, mode=half).alias("i"),
        fn.count_if(col("l_tax") == 0).alias("j"), fn.arg_max(line, col("l_orderkey") * 10 + line).alias("k"), fn.favg(col("l_tax")).round(8, mode=half).alias("l"),
    )


@_query("""
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 4) AS a, round(list_distance(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 4) AS b, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS c,
    len(list_slice(embedding, 3, 9)) AS d, len(list_resize(embedding, 70)) AS e, len(list_intersect(embedding, list_reverse(embedding))) AS f, list_position(embedding, embedding[5]) AS g, len(list_concat(embedding, embedding)) AS h,
    list_has_any(embedding, embedding[1:2]) AS i, list_has_all(embedding, embedding[1:2]) AS j, round(list_reduce(embedding, lambda x, y: x + y)::DOUBLE, 3) AS k, range(2, 6) AS l, list_grade_up(embedding)[1] AS m
FROM embeddings""")
def catalogue_lists(t: Tables) -> lk.LazyFrame:
    e, half = col("embedding"), "half_away_from_zero"
    r = lambda x, n, d=4: x.cast("Float64").round(d, mode=half).alias(n)
    return t.embeddings.select(
        "vec_id", r(fn.list_cosine_similarity(e, e.list.reverse()), "a"), r(fn.list_distance(e, e.list.reverse()), "b"), r(fn.list_inner_product(e, e), "c"), _long(fn.list_slice(e, 3, 9).list.len(), "d"), _long(fn.list_resize(e, 70).list.len(), "e"),
        _long(fn.list_intersect(e, e.list.reverse()).list.len(), "f"), _long(fn.list_position(e, e.list.get(4)), "g"), _long(fn.list_concat(e, e).list.len(), "h"), fn.list_has_any(e, fn.list_slice(e, 1, 2)).alias("i"),
        fn.list_has_all(e, fn.list_slice(e, 1, 2)).alias("j"), r(fn.list_reduce(e, lambda x, y: x + y), "k", 3), fn.range(2, 6).cast("array<bigint>").alias("l"), _long(fn.list_grade_up(e).list.get(0), "m"),
    )


@_query("""
SELECT o_orderkey, dayname(o_orderdate)[1:3] AS a, dayofweek(o_orderdate)::BIGINT AS b, decade(o_orderdate)::BIGINT AS c, yearweek(o_orderdate)::BIGINT AS d, julian(o_orderdate)::DOUBLE AS e, date_diff('month', o_orderdate, TIMESTAMP '1999-03-01') AS f,
    date_diff('year', o_orderdate, TIMESTAMP '1999-03-01') AS g, make_date(year(o_orderdate), 1, 1) AS h, time_bucket(INTERVAL '7 days', o_orderdate)::TIMESTAMP AS i, o_orderdate + to_days(2) AS j, epoch(o_orderdate)::DOUBLE AS k, date_part('month', o_orderdate)::BIGINT AS l
FROM orders""")
def catalogue_dates(t: Tables) -> lk.LazyFrame:
    d, end = col("o_orderdate"), lit(datetime(1999, 3, 1))
    return t.orders.select(
        "o_orderkey", fn.dayname(d).str.head(3).alias("a"), _long(fn.dayofweek(d), "b"), _long(fn.decade(d), "c"), _long(fn.yearweek(d), "d"), fn.julian(d).alias("e"), _long(fn.date_diff("month", d, end), "f"), _long(fn.date_diff("year", d, end), "g"),
        fn.make_date(fn.year(d), 1, 1).alias("h"), fn.time_bucket("7 days", d).alias("i"), (d + fn.to_days(2)).alias("j"), fn.epoch(d).alias("k"), _long(fn.date_part("month", d), "l"),
    )


@_query("""
SELECT event_id, json_valid(props) AS a, json_extract(props, '$.k')::VARCHAR AS b, json_exists(props, '$.k') AS c, json_type(props) AS d, json_keys(props) AS e, json_array_length('[1,2,3]')::BIGINT AS f, json_merge_patch(props, '{"z":1}')::VARCHAR AS g,
    map_keys(MAP {event_type: value}) AS h, map_contains(MAP {event_type: value}, 'view') AS i, json_object('t', event_type)::VARCHAR AS j
FROM events""")
def catalogue_json_and_maps(t: Tables) -> lk.LazyFrame:
    p, m = col("props"), fn.map(fn.list_value(col("event_type")), fn.list_value(col("value")))
    return t.events.select(
        "event_id", fn.json_valid(p).alias("a"), fn.json_extract(p, "$.k").alias("b"), fn.json_exists(p, "$.k").alias("c"), fn.json_type(p).alias("d"), fn.json_keys(p).alias("e"), _long(fn.json_array_length("[1,2,3]"), "f"), fn.json_merge_patch(p, '{"z":1}').alias("g"),
        fn.map_keys(m).alias("h"), fn.map_contains(m, "view").alias("i"), fn.json_object(t=col("event_type")).alias("j"),
    )


@_query(
    "SELECT event_id, 'POINT (' || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || ' ' || user_id || ')' AS text, value AS x, CAST(user_id AS DOUBLE) AS y, round(sqrt(value * value + CAST(user_id AS DOUBLE) * user_id), 6) AS far FROM events"
)
def points(t: Tables) -> lk.LazyFrame:
    """Geometries as well-known binary; the oracle has no spatial functions loaded, so it works on the numbers."""
    p = fn.st_point(col("value"), col("user_id").cast("Float64"))
    far = fn.st_distance(p, fn.st_point(0.0, 0.0)).round(6, mode="half_away_from_zero")
    return t.events.select("event_id", fn.st_astext(p).alias("text"), fn.st_x(p).alias("x"), fn.st_y(p).alias("y"), far.alias("far"))
