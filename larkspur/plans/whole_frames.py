"""Registered queries of what works on whole frames: sources and sinks, aggregates of all columns, fills, selectors and names."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np

import larkspur as lk
from larkspur import col, dtypes, lit
from larkspur import selectors as cs
from larkspur.functions import sql_functions as fn

from .queries import Tables, _query


def _scratch(t: Tables, name: str) -> str:
    """A path in the folder that the cluster shares; in local mode a temporary one will do."""
    sc = t._spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or t._spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.gettempdir()
    return f"{where}/larkspur-{name}-{uuid.uuid4().hex}"


def _stacked(parts: dict[str, lk.LazyFrame], label: str = "what") -> lk.LazyFrame:
    """Frames of like columns one under another, with the name of each."""
    first, *rest = [f.select(lit(name).alias(label), lk.all()) for name, f in parts.items()]
    for f in rest:
        first = first.union(f)
    return first


def _rounded(f: lk.LazyFrame, digits: int = 3) -> lk.LazyFrame:
    return f.select(lk.all().cast("Float64").round(digits, mode="half_away_from_zero"))


_NUMBERS = ("o_custkey", "o_totalprice")
_FRAME = {
    "count": "count({c})", "sum": "sum({c})", "mean": "avg({c})", "median": "median({c})", "min": "min({c})", "max": "max({c})", "std": "stddev_samp({c})", "var": "var_samp({c})",
    "null_count": "count(*) FILTER (WHERE {c} IS NULL)", "quantile": "quantile_cont({c}, 0.3)",
}


@_query(" UNION ALL ".join(f"SELECT '{name}' AS what, " + ", ".join(f"round(CAST({sql.format(c=c)} AS DOUBLE), 3) AS {c}" for c in _NUMBERS) + " FROM orders" for name, sql in _FRAME.items()))
def frame_aggregates(t: Tables) -> lk.LazyFrame:
    f = t.orders.select(*_NUMBERS)
    return _stacked({name: _rounded(f.quantile(0.3) if name == "quantile" else getattr(f, name)()) for name in _FRAME})


_GROUPED = {"mean": "avg({c})", "median": "median({c})", "min": "min({c})", "n_unique": "count(DISTINCT {c})", "quantile": "quantile_cont({c}, 0.25)"}


@_query(" UNION ALL ".join(f"SELECT '{name}' AS what, o_orderstatus, " + ", ".join(f"round(CAST({sql.format(c=c)} AS DOUBLE), 3) AS {c}" for c in _NUMBERS) + " FROM orders GROUP BY o_orderstatus" for name, sql in _GROUPED.items()))
def group_aggregates(t: Tables) -> lk.LazyFrame:
    g = t.orders.select("o_orderstatus", *_NUMBERS).group_by("o_orderstatus")
    parts = {name: g.quantile(0.25) if name == "quantile" else getattr(g, name)() for name in _GROUPED}
    return _stacked({name: f.select("o_orderstatus", *[col(c).cast("Float64").round(3, mode="half_away_from_zero") for c in _NUMBERS]) for name, f in parts.items()})


@_query("SELECT 'first' AS what, s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT 'last', s_suppkey, s_name, s_acctbal FROM supplier")
def group_first_last(t: Tables) -> lk.LazyFrame:
    g = t.supplier.select("s_suppkey", "s_name", "s_acctbal").group_by("s_suppkey")
    return _stacked({"first": g.first(), "last": g.last()})


@_query("SELECT user_id, event_id, last_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id)) % 2 = 0 AS even FROM events")
def last_and_products(t: Tables) -> lk.LazyFrame:
    by = {"partition_by": "user_id", "order_by": "event_id"}
    return t.events.select("user_id", "event_id", col("event_id").last().over(**by).alias("last_id"), (lit(-1.0).cum_prod().over(**by) > 0).alias("even"))


@_query("SELECT user_id, count(DISTINCT event_type) AS kinds, true AS near, true AS hashed FROM events GROUP BY user_id")
def approximate_counts(t: Tables) -> lk.LazyFrame:
    g = t.events.with_columns(col("event_id").hash().alias("h")).group_by("user_id").agg(col("event_type").n_unique().alias("kinds"), col("event_type").approx_n_unique().alias("about"), lk.len().alias("n"), col("h").n_unique().alias("hashes"))
    return g.select("user_id", "kinds", (col("about") - col("kinds")).abs().le(col("kinds") * 0.2).alias("near"), (col("n") == col("hashes")).alias("hashed"))


_SPARSE = "SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE value END AS w FROM events"


def _sparse(t: Tables) -> lk.LazyFrame:
    return t.events.select(
        "event_id", "user_id", lk.when(col("event_id") % 3 != 0).then(col("value")).alias("v"), lk.when(col("event_id") % 5 == 0).then(lit(float("nan"))).otherwise(col("value")).alias("w")
    )


@_query(f"SELECT event_id, user_id, v, w FROM ({_SPARSE}) WHERE NOT isnan(w)")
def frame_drop_nans(t: Tables) -> lk.LazyFrame:
    return _sparse(t).drop_nans("w")


@_query(f"SELECT event_id, user_id, CASE WHEN isnan(v) THEN -1.5 ELSE v END AS v, CASE WHEN isnan(w) THEN -1.5 ELSE w END AS w FROM ({_SPARSE})")
def frame_fill_nan(t: Tables) -> lk.LazyFrame:
    return _sparse(t).fill_nan(-1.5)


@_query(
    f"WITH s AS (SELECT event_id, v FROM ({_SPARSE})) SELECT 'value' AS what, event_id, coalesce(v, 7) AS v FROM s UNION ALL SELECT 'zero', event_id, coalesce(v, 0) FROM s "
    "UNION ALL SELECT 'max', event_id, coalesce(v, (SELECT max(v) FROM s)) FROM s UNION ALL SELECT 'min', event_id, coalesce(v, (SELECT min(v) FROM s)) FROM s "
    "UNION ALL SELECT 'mean', event_id, round(coalesce(v, (SELECT avg(v) FROM s)), 4) FROM s"
)
def frame_fill_null(t: Tables) -> lk.LazyFrame:
    f = _sparse(t).select("event_id", "v")
    parts = {"value": f.fill_null(7), **{s: f.fill_null(strategy=s) for s in ("zero", "max", "min", "mean")}}
    parts["mean"] = parts["mean"].with_columns(col("v").round(4, mode="half_away_from_zero"))
    return _stacked(parts)


@_query("SELECT lag(n_nationkey, 2) OVER w AS n_nationkey, coalesce(lag(n_name, 2) OVER w, 'none') AS n_name FROM nation WINDOW w AS (ORDER BY n_nationkey, n_name)")
def frame_shift(t: Tables) -> lk.LazyFrame:
    f = t.nation.select("n_nationkey", "n_name")
    both = f.with_columns(col("n_nationkey").alias("place"))
    return both.select("n_nationkey", "n_name", "place").shift(2, order_by=["place", "n_name"]).select("n_nationkey", col("n_name").fill_null("none").alias("n_name"))


@_query(
    "(SELECT 'head' AS what, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL (SELECT 'limit', o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3) "
    "UNION ALL (SELECT 'first', o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1) UNION ALL (SELECT 'last', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1)"
)
def ends_of_frames(t: Tables) -> lk.LazyFrame:
    f = t.orders.select("o_orderkey")
    by = f.sort("o_orderkey")
    return _stacked({"head": by.head(), "limit": by.limit(3), "first": by.first(), "last": f.last(order_by="o_orderkey")})


_CURVES = {"arccos": "acos(d)", "arccosh": "acosh(d + 1)", "arcsinh": "asinh(d)", "arctanh": "atanh(d)", "cosh": "cosh(d)"}


@_query(
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({f}, 9) AS {n}" for n, f in _CURVES.items()) + ", trunc(l_extendedprice) AS cut, abs(l_quantity - l_quantity * 1.000001) <= 1e-8 + 1e-5 * l_quantity AS near, "
    "abs(l_tax - l_discount) <= 1e-8 + 1e-5 * abs(l_discount) AS equal FROM (SELECT *, l_discount AS d FROM lineitem)"
)
def curves(t: Tables) -> lk.LazyFrame:
    d = col.l_discount
    values = {"arccos": d.arccos(), "arccosh": (d + 1).arccosh(), "arcsinh": d.arcsinh(), "arctanh": d.arctanh(), "cosh": d.cosh()}
    return t.lineitem.select(
        col.l_orderkey, col.l_linenumber, *[e.round(9, mode="half_away_from_zero").alias(n) for n, e in values.items()],
        col.l_extendedprice.truncate().alias("cut"), col.l_quantity.is_close(col.l_quantity * 1.000001).alias("near"), col.l_tax.is_close(col.l_discount).alias("equal"),
    )


@_query(
    "SELECT c_custkey, c_name AS joined, list_transform(range(c_nationkey % 4), lambda x: c_mktsegment) AS repeated, '\\(' || c_name || '\\)\\.\\*\\[b\\]' AS escaped, "
    "make_date(1970 + c_nationkey, 1, 15) AS d, make_date(1970 + c_nationkey, 1, 15) AS e, 10 + c_nationkey % 10 AS hour, 10 + c_nationkey % 50 AS minute FROM customer"
)
def texts_and_times(t: Tables) -> lk.LazyFrame:
    joined = t.customer.group_by("c_custkey").agg(col("c_name").str.join("-").alias("joined"))
    k = col("c_nationkey")
    clock = fn.concat((10 + k % 10).cast("String"), lit(":"), (10 + k % 50).cast("String"), lit(":00")).str.to_time()
    year = (1970 + k).cast("String")
    return t.customer.join(joined, on="c_custkey").select(
        "c_custkey", "joined", col("c_mktsegment").repeat_by(k % 4).alias("repeated"), fn.concat(lit("("), col("c_name"), lit(").*[b]")).str.escape_regex().alias("escaped"),
        fn.concat(year, lit("-01-15")).str.to_date().alias("d"), fn.concat(lit("15/01/"), year).str.to_date("%d/%m/%Y").alias("e"),
        clock.dt.hour().alias("hour"), clock.dt.minute().alias("minute"),
    )


@_query(
    "SELECT event_id, extract(microsecond FROM ts) % 1000000 * 1000 AS nanos, extract(hour FROM ts) AS hour, extract(minute FROM ts) AS minute, user_id AS a, value AS b FROM events"
)
def times_and_fields(t: Tables) -> lk.LazyFrame:
    both = fn.named_struct(lit("a"), col("user_id"), lit("b"), col("value"))
    clock = col("ts").dt.time()
    return t.events.select("event_id", col("ts").dt.nanosecond().alias("nanos"), clock.dt.hour().alias("hour"), clock.dt.minute().alias("minute"), both.struct.field("a"), both.struct.field("b"))


@_query(
    "WITH l AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x < 0 THEN NULL ELSE CAST(floor(x * 20) AS INTEGER) END) AS e FROM embeddings) "
    "SELECT vec_id, len(list_filter(e, lambda x: x IS NOT NULL)) AS kept, list_sort(list_distinct(list_filter(e, lambda x: x IS NOT NULL))) AS kinds, round(list_var_samp(e), 9) AS spread, len(list_filter(e, lambda x: x = 1)) AS ones FROM l"
)
def list_measures(t: Tables) -> lk.LazyFrame:
    e = col("embedding").list.eval(lk.when(lk.element() >= 0).then((lk.element() * 20).floor().cast("Int32")))
    f = t.embeddings.select("vec_id", e.alias("e"))
    e = col("e").list
    return f.select("vec_id", e.drop_nulls().list.len().alias("kept"), e.unique().list.sort().alias("kinds"), e.var().round(9, mode="half_away_from_zero").alias("spread"), e.count_matches(1).alias("ones"))


@_query(
    'SELECT n_nationkey AS key, n_name AS p_n_name, n_name AS n_name_s, n_name AS "N_NAME", n_regionkey AS n_region, n_regionkey + 1 AS n_regionkey FROM nation'
)
def names_of_columns(t: Tables) -> lk.LazyFrame:
    name, region = col("n_name"), col("n_regionkey")
    return t.nation.rename({"n_nationkey": "KEY"}).select(
        col("KEY").name.to_lowercase(), name.name.prefix("p_"), name.name.suffix("_s"), name.name.to_uppercase(), region.name.replace("key$", ""), (region + 1).alias("other").name.keep()
    )


_KINDS = dtypes.Enum(["F", "O", "P"])


def _wide(t: Tables) -> lk.LazyFrame:
    k, at = col("o_custkey"), col("o_orderdate")
    return t.orders.select(
        col("o_orderkey").alias("id"), (col("o_totalprice") > 200000).alias("flag"), col("o_totalprice").alias("price"), (k % 100).alias("small"), at.dt.date().alias("day"), at.alias("at"), at.dt.time().alias("clock"),
        (at - at.dt.truncate("month")).alias("took"), col("o_orderstatus").cast("Binary").alias("raw"), col("o_orderstatus").alias("kind"), col("o_totalprice").alias("money"),
        fn.named_struct(lit("a"), k).alias("pair"), k.repeat_by(lit(2)).alias("two"), col("o_orderpriority").alias("text"),
    ).cast({"small": dtypes.UInt8, "kind": _KINDS, "money": dtypes.Decimal(14, 2)})


@_query(
    "SELECT o_orderkey AS integer_id, o_orderkey AS signed_id, CAST(o_custkey % 100 AS SMALLINT) AS integer_small, CAST(o_custkey % 100 AS SMALLINT) AS unsigned_small, o_totalprice > 200000 AS boolean_flag, o_totalprice AS float_price, "
    "CAST(o_orderdate AS DATE) AS date_day, o_orderstatus AS enum_kind, CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS DOUBLE) AS decimal_money, o_orderpriority AS starts_text, o_orderkey AS dtype_id, o_totalprice AS dtype_price, "
    "o_orderkey AS named_id, o_orderpriority AS contains_text, o_orderkey AS less_id, CAST(o_custkey % 100 AS SMALLINT) AS less_small, "
    + ", ".join(f"true AS {n}" for n in "temporal_day temporal_at temporal_clock temporal_took time_clock duration_took binary_raw nested_pair nested_two struct_pair rest_flag rest_price rest_raw rest_pair rest_two rest_money every_text every_kind".split())
    + " FROM orders"
)
def selectors_by_type(t: Tables) -> lk.LazyFrame:
    def chosen(prefix: str, e: lk.Expr, there: bool = False) -> lk.Expr:
        return (e.is_not_null() if there else e).name.prefix(prefix + "_")

    few = cs.all() - cs.by_name("id", "flag", "price", "small", "day", "at", "clock", "took", "raw", "money", "pair", "two")
    return _wide(t).select(
        chosen("integer", cs.integer()), chosen("signed", cs.signed_integer()), chosen("unsigned", cs.unsigned_integer()), chosen("boolean", cs.boolean()), chosen("float", cs.float()), chosen("date", cs.date()),
        chosen("enum", cs.enum()), chosen("decimal", cs.decimal().cast("Float64")), chosen("starts", cs.starts_with("te")), chosen("dtype", cs.by_dtype(dtypes.Int64, dtypes.Float64)), chosen("named", cs.by_name("id")),
        chosen("contains", cs.contains("ex")), chosen("less", cs.numeric().difference(cs.float() | cs.decimal())), chosen("temporal", cs.temporal(), True), chosen("time", cs.time(), True), chosen("duration", cs.duration(), True),
        chosen("binary", cs.binary(), True), chosen("nested", cs.nested(), True), chosen("struct", cs.struct(), True), chosen("rest", (cs.temporal() | cs.integer() | cs.string() | cs.enum()).complement(), True), chosen("every", few, True),
    )


@_query(
    "SELECT * FROM (VALUES ('dict', 1, 'x'), ('dict', 2, NULL), ('dicts', 3, 'y'), ('dicts', 4, 'z'), ('records', 5, 'u'), ('records', 6, 'v'), ('numpy', 7, '9'), ('numpy', 8, '10')) v(what, a, b) "
    "UNION ALL SELECT 'function', range, CAST(range + 1 AS VARCHAR) FROM range(4) UNION ALL SELECT 'table', r_regionkey, r_name FROM region UNION ALL SELECT 'frame', r_regionkey, r_name FROM region "
    "UNION ALL SELECT 'arrow', r_regionkey, r_name FROM region UNION ALL SELECT 'lazy', r_regionkey, r_name FROM region UNION ALL SELECT 'clone', r_regionkey, r_name FROM region UNION ALL SELECT 'pandas', r_regionkey, r_name FROM region"
)
def frames_of_many_sources(t: Tables) -> lk.LazyFrame:
    region = t.region.select("r_regionkey", "r_name")
    region.to_spark().createOrReplaceTempView("larkspur_region")
    numbers = lk.from_numpy(np.array([[7, 8], [9, 10]]))
    parts = {
        "dict": lk.from_dict({"a": [1, 2], "b": ["x", None]}), "dicts": lk.from_dicts([{"a": 3, "b": "y"}, {"a": 4, "b": "z"}]), "records": lk.from_records([[5, 6], ["u", "v"]]), "numpy": numbers,
        "function": lk.from_table_function("range(4)").select("id", (col("id") + 1).alias("next")), "table": lk.from_table("larkspur_region"), "frame": lk.from_df(region.to_spark()), "arrow": lk.LazyFrame(region.collect()),
        "lazy": lk.LazyFrame(region.lazy()), "clone": region.clone(), "pandas": region.map(lambda batch: batch, region.to_spark().schema),
    }
    alike = lambda f: f.select(*[col(c).cast(k).alias(n) for c, k, n in zip(f.columns, ("Int64", "String"), "ab", strict=True)])
    return _stacked({name: f.pipe(alike) for name, f in parts.items()})


@_query(
    "SELECT * FROM (VALUES ('schema', 'p_partkey', 'Int64'), ('schema', 'p_name', 'String'), ('schema', 'p_size', 'Int32'), ('schema', 'p_retailprice', 'Float64'), ('from_frame', 'p_partkey', 'Int64'), ('from_frame', 'p_name', 'String'), "
    "('from_frame', 'p_size', 'Int32'), ('from_frame', 'p_retailprice', 'Float64'), ('width', '4', 'true'), ('plan', 'parquet', 'true')) v(what, name, kind)"
)
def looking_at_frames(t: Tables) -> lk.LazyFrame:
    f = t.part.select("p_partkey", "p_name", "p_size", "p_retailprice")
    rows = [("schema", n, repr(k)) for n, k in f.collect_schema().items()]
    rows += [("from_frame", n, repr(k)) for n, k in dtypes.Schema.from_frame(f).items()]
    rows.append(("width", str(f.width), str(f.schema == f.collect_schema()).lower()))
    rows.append(("plan", "parquet", str("parquet" in f.explain() and "p_partkey" in f.sql_query()).lower()))
    return lk.from_dicts([dict(zip(("what", "name", "kind"), r, strict=True)) for r in rows])


@_query(" UNION ALL ".join(f"SELECT '{w}' AS what, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier" for w in ("parquet", "csv", "ndjson")))
def sinks_read_again(t: Tables) -> lk.LazyFrame:
    f = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    kinds = f.to_spark().schema
    paths = {k: _scratch(t, k) for k in ("parquet", "csv", "ndjson")}
    f.sink_parquet(paths["parquet"])
    f.sink_csv(paths["csv"], separator=";")
    f.sink_ndjson(paths["ndjson"])
    return _stacked({"parquet": lk.scan_parquet(paths["parquet"]), "csv": lk.scan_csv(paths["csv"], separator=";", schema=kinds), "ndjson": lk.scan_ndjson(paths["ndjson"], schema=kinds)})


@_query("SELECT l_orderkey, l_linenumber, l_quantity // 3.5 AS whole, l_extendedprice // l_quantity AS price, CAST(l_quantity AS INTEGER) // 7 AS sevens FROM lineitem")
def floor_division(t: Tables) -> lk.LazyFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", (col("l_quantity") // 3.5).alias("whole"), (col("l_extendedprice") // col("l_quantity")).alias("price"), (col("l_quantity").cast("Int32") // 7).alias("sevens"))


_NEAREST = "WITH a AS (SELECT event_id, ts, value FROM events WHERE event_type = 'purchase'), b AS (SELECT ts, max(value) AS seen FROM events WHERE event_type = 'view' GROUP BY ts) SELECT a.*, b.seen FROM a ASOF LEFT JOIN b ON a.ts {} b.ts"


def _sides(t: Tables) -> tuple[lk.LazyFrame, lk.LazyFrame]:
    kinds = t.events.filter(event_type="purchase").select("event_id", "ts", "value"), t.events.filter(event_type="view").group_by("ts").agg(col("value").max().alias("seen"))
    return kinds


@_query(_NEAREST.format(">="))
def asof_without_keys(t: Tables) -> lk.LazyFrame:
    a, b = _sides(t)
    return a.join_asof(b, on="ts")


@_query(_NEAREST.format("<="))
def asof_forward_without_keys(t: Tables) -> lk.LazyFrame:
    a, b = _sides(t)
    return a.join_asof(b, on="ts", strategy="forward")


@_query("SELECT l_returnflag, quantile_disc(l_quantity, 0.3) AS quantity, quantile_disc(l_linenumber, 0.7) AS line FROM lineitem GROUP BY l_returnflag")
def group_quantiles_of_values(t: Tables) -> lk.LazyFrame:
    return t.lineitem.group_by("l_returnflag").agg(col("l_quantity").quantile(0.3, interpolation=False).alias("quantity"), col("l_linenumber").quantile(0.7, interpolation=False).alias("line"))


_BINS = "list_transform(embedding, lambda x: CAST(floor(x * 12) AS BIGINT))"


@_query(
    f"SELECT vec_id, list_bit_and(e) AS a, list_bit_or(e) AS b, list_bit_xor(e) AS c, round(list_entropy(e), 9) AS d, round(list_mad(f), 9) AS n, round(list_sem(f), 9) AS g, round(list_skewness(f), 7) AS h, round(list_kurtosis(f), 7) AS i, "
    f"round(list_kurtosis_pop(f), 7) AS j, len(list_distinct(e)) AS k, e[3] AS l, list_mode(list_transform(e, lambda x: CASE WHEN x = e[1] THEN 0 ELSE x % 2 + 5 END)) AS m FROM (SELECT vec_id, {_BINS} AS e, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings)"
)
def catalogue_list_measures(t: Tables) -> lk.LazyFrame:
    e = col("embedding").list.eval((lk.element().cast("Float64") * 12).floor().cast("Int64"))
    f = t.embeddings.select("vec_id", e.alias("e"), col("embedding").list.eval(lk.element().cast("Float64")).alias("f"))
    e, f9 = col("e"), lambda x, n=9: x.round(n, mode="half_away_from_zero")
    f_ = col("f")
    kinds = fn.list_transform(e, lambda x: x)
    return f.with_columns(e.list.first().alias("one")).select(
        "vec_id", fn.list_bit_and(e).alias("a"), fn.list_bit_or(e).alias("b"), fn.list_bit_xor(e).alias("c"), f9(fn.list_entropy(e)).alias("d"), f9(fn.list_mad(f_)).alias("n"), f9(fn.list_sem(f_)).alias("g"), f9(fn.list_skewness(f_), 7).alias("h"),
        f9(fn.list_kurtosis(f_), 7).alias("i"), f9(fn.list_kurtosis_pop(f_), 7).alias("j"), fn.list_approx_count_distinct(e).cast("Int64").alias("k"), fn.list_element(e, 3).alias("l"),
        fn.list_mode(kinds.list.eval(lk.when(lk.element() == col("one")).then(0).otherwise(lk.element() % 2 + 5))).cast("Int64").alias("m"),
    )


@_query(
    "SELECT o_orderkey, day(last_day(o_orderdate)) AS days, 1024 * o_custkey AS size, o_custkey AS a, o_orderstatus AS b, o_custkey AS first, CAST(o_custkey AS VARCHAR) AS text, 'F' AS low, 'P' AS high, o_custkey AS v FROM orders"
)
def catalogue_leftovers(t: Tables) -> lk.LazyFrame:
    k, kinds = col("o_custkey"), ["F", "O", "P"]
    both = fn.struct_concat(fn.named_struct(lit("a"), k), fn.named_struct(lit("b"), col("o_orderstatus")))
    return t.orders.select(
        "o_orderkey", fn.days_in_month(col("o_orderdate")).alias("days"), fn.parse_formatted_bytes(fn.concat(k.cast("String"), lit(" KiB"))).alias("size"), both.struct.field("a").alias("a"), both.struct.field("b").alias("b"),
        fn.struct_extract_at(both, 1).alias("first"), fn.cast_to_type(k, lit("")).alias("text"), fn.enum_first(kinds).alias("low"), fn.enum_last(kinds).alias("high"), fn.union_value(v=k).struct.field("v").alias("v"),
    )


@_query("SELECT o_custkey % 10 AS g, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS rest FROM orders GROUP BY 1")
def catalogue_exact_histogram(t: Tables) -> lk.LazyFrame:
    h = t.orders.with_columns((col("o_custkey") % 10).alias("g")).group_by("g").agg(fn.histogram_exact(col("o_orderstatus"), ["F", "O"]).alias("h"))
    return h.select("g", *[fn.map_extract_value(col("h"), key).alias(name) for name, key in (("f", "F"), ("o", "O"), ("rest", "other"))])


@_query(
    "SELECT c_custkey, " + ", ".join(f"round({f}, 9) AS {n}" for n, f in {
        "a1": "abs(x)", "a2": "acos(u)", "a3": "asin(u)", "a4": "atan(x)", "a5": "atan2(x, 2.5)", "a6": "cbrt(x)", "a7": "cos(x)", "a8": "degrees(u)", "a9": "exp(u)", "b1": "radians(x)", "b2": "sin(x)", "b3": "sinh(u)", "b4": "tanh(u)", "b5": "sqrt(abs(x))", "b6": "tan(u)", "b7": "asinh(x)", "b8": "cot(u + 2)", "b9": "atanh(u / 2)",
    }.items())
    + ", ceil(x)::BIGINT AS c1, floor(x)::BIGINT AS c2, sign(x)::BIGINT AS c3, nullif(c_nationkey, 3) AS c4, round(x, 1) AS c5, factorial(c_nationkey % 15)::BIGINT AS c6 FROM (SELECT *, c_acctbal AS x, c_nationkey / 25.0 AS u FROM customer)"
)
def catalogue_numbers(t: Tables) -> lk.LazyFrame:
    x, u, k = col("c_acctbal"), col("c_nationkey").cast("Float64") / 25.0, col("c_nationkey")
    made = {
        "a1": fn.abs(x), "a2": fn.acos(u), "a3": fn.asin(u), "a4": fn.atan(x), "a5": fn.atan2(x, 2.5), "a6": fn.cbrt(x), "a7": fn.cos(x), "a8": fn.degrees(u), "a9": fn.exp(u), "b1": fn.radians(x), "b2": fn.sin(x), "b3": fn.sinh(u), "b4": fn.tanh(u),
        "b5": fn.sqrt(fn.abs(x)), "b6": fn.tan(u), "b7": fn.asinh(x), "b8": fn.cot(u + 2), "b9": fn.atanh(u / 2),
    }
    return t.customer.select(
        "c_custkey", *[e.round(9, mode="half_away_from_zero").alias(n) for n, e in made.items()],
        fn.ceil(x).cast("Int64").alias("c1"), fn.floor(x).cast("Int64").alias("c2"), fn.sign(x).cast("Int64").alias("c3"), fn.nullif(k, 3).alias("c4"), fn.round(x, 1).alias("c5"), fn.factorial(k % 15).alias("c6"),
    )


@_query(
    "SELECT p_partkey, ascii(s)::BIGINT AS a, bit_length(s)::BIGINT AS b, length(s)::BIGINT AS c, concat_ws('-', s, p_brand) AS d, contains(s, 'a') AS e, hex(s) AS f, instr(s, 'e')::BIGINT AS g, left(s, 3) AS h, right(s, 3) AS i, lower(s) AS j, upper(s) AS k, "
    "ltrim('  ' || s) AS l, rtrim(s || '  ') AS m, md5(s) AS n, position('e' IN s)::BIGINT AS o, printf('%s/%d', s, p_size) AS p, repeat(s, 2) AS q, replace(s, 'e', 'EE') AS r, reverse(s) AS t, substr(s, 2, 3) AS u, substring(s, 3, 2) AS v, "
    "translate(s, 'abe', 'xyz') AS w, sha1(s) AS x, strlen(s)::BIGINT AS y, regexp_extract(s, '([a-z]+)', 1) AS z FROM (SELECT *, p_name AS s FROM part)"
)
def catalogue_texts(t: Tables) -> lk.LazyFrame:
    s, size = col("p_name"), col("p_size")
    return t.part.select(
        "p_partkey", _long(fn.ascii(s), "a"), _long(fn.bit_length(s), "b"), _long(fn.length(s), "c"), fn.concat_ws("-", s, col("p_brand")).alias("d"), fn.contains(s, "a").alias("e"), fn.hex(s).alias("f"), _long(fn.instr(s, "e"), "g"),
        fn.left(s, 3).alias("h"), fn.right(s, 3).alias("i"), fn.lower(s).alias("j"), fn.upper(s).alias("k"), fn.ltrim(fn.concat(lit("  "), s)).alias("l"), fn.rtrim(fn.concat(s, lit("  "))).alias("m"), fn.md5(s).alias("n"),
        _long(fn.position("e", s), "o"), fn.printf("%s/%d", s, size).alias("p"), fn.repeat(s, 2).alias("q"), fn.replace(s, "e", "EE").alias("r"), fn.reverse(s).alias("t"), fn.substr(s, 2, 3).alias("u"), fn.substring(s, 3, 2).alias("v"),
        fn.translate(s, "abe", "xyz").alias("w"), fn.sha1(s).alias("x"), _long(fn.strlen(s), "y"), fn.regexp_extract(s, "([a-z]+)", 1).alias("z"),
    )


@_query(
    "SELECT o_orderkey, day(d)::BIGINT AS a, dayofmonth(d)::BIGINT AS b, dayofyear(d)::BIGINT AS c, hour(d)::BIGINT AS d, last_day(d) AS e, make_date(year(d), month(d), 1) AS f, minute(d)::BIGINT AS g, month(d)::BIGINT AS h, quarter(d)::BIGINT AS i, second(d)::BIGINT AS j, year(d)::BIGINT AS k, "
    "make_timestamp(year(d), 1, 2, 3, 4, 5.5) AS l, list_sort(list_intersect([o_custkey % 3, 1, 2], [1, 2, 5])) AS m, list_prepend(o_custkey, [1, 2]) AS n, map_keys(map_concat(MAP {o_orderstatus: 1}, MAP {'Z': 2})) AS o, "
    "map_values(MAP {o_orderstatus: o_custkey}) AS p, map_keys(map_from_entries([(o_orderstatus, 1)])) AS q, len(map_entries(MAP {o_orderstatus: 1}))::BIGINT AS r FROM (SELECT *, o_orderdate AS d FROM orders)"
)
def catalogue_times_and_lists(t: Tables) -> lk.LazyFrame:
    d, k, s = col("o_orderdate"), col("o_custkey"), col("o_orderstatus")
    one = lambda key, value: fn.map(fn.list_value(key), fn.list_value(value))
    pair = fn.list_value(fn.row(s, lit(1)))
    return t.orders.select(
        "o_orderkey", _long(fn.day(d), "a"), _long(fn.dayofmonth(d), "b"), _long(fn.dayofyear(d), "c"), _long(fn.hour(d), "d"), fn.last_day(d).alias("e"), fn.make_date(fn.year(d), fn.month(d), lit(1)).alias("f"), _long(fn.minute(d), "g"), _long(fn.month(d), "h"),
        _long(fn.quarter(d), "i"), _long(fn.second(d), "j"), _long(fn.year(d), "k"), fn.make_timestamp(fn.year(d), lit(1), lit(2), lit(3), lit(4), lit(5.5)).cast("timestamp_ntz").alias("l"),
        fn.list_sort(fn.list_intersect(fn.list_value(k % 3, lit(1), lit(2)), fn.list_value(lit(1), lit(2), lit(5)))).alias("m"), fn.list_prepend(fn.list_value(lit(1), lit(2)), k).alias("n"), fn.map_keys(fn.map_concat(one(s, lit(1)), one(lit("Z"), lit(2)))).alias("o"),
        fn.map_values(one(s, k)).alias("p"), fn.map_keys(fn.map_from_entries(pair)).alias("q"), _long(fn.array_length(fn.map_entries(one(s, lit(1)))), "r"),
    )


def _long(e: lk.Expr, name: str) -> lk.Expr:
    return e.cast("Int64").alias(name)
