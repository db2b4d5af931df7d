"""The SQL function catalogue, as functions of expressions.

``sql_functions.name(...)`` builds an expression; texts among the arguments are literals. Names that aren't given here are Spark's own
functions of that name. Functions whose results differ between engines are composed of Spark columns, so they stay in generated
code; the few that Spark can't express are vectorised pandas functions over Arrow batches."""

from __future__ import annotations

import functools
import hashlib
import json
import math
import struct
import unicodedata
from collections.abc import Callable
from decimal import Decimal
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import Expr, Kind, as_expr, gathered
from . import more, scalar, spatial
from .formats import java_pattern

Make = Callable[..., Column]

#: Other names of Spark functions, by kind.
SCALAR_NAMES = {
    "argmax": "max_by", "ceiling": "ceil", "cardinality": "size", "character_length": "char_length", "editdist3": "levenshtein", "ends_with": "endswith", "starts_with": "startswith", "prefix": "startswith", "suffix": "endswith", "from_base64": "unbase64",
    "from_hex": "unhex", "unbin": "unhex", "to_base64": "base64", "to_hex": "hex", "strlen": "octet_length", "strpos": "instr", "trim": "btrim", "lcase": "lower", "ucase": "upper", "isnan": "isnan", "is_nan": "isnan", "round_even": "bround", "roundbankers": "bround",
    "round_from_zero": "round", "array_length": "array_size", "list_length": "array_size", "array_append": "array_append", "list_append": "array_append", "array_push_back": "array_append", "list_prepend": "array_prepend", "array_push_front": "array_prepend",
    "list_reverse": "reverse", "array_reverse": "reverse", "list_intersect": "array_intersect", "list_zip": "arrays_zip", "array_zip": "arrays_zip", "list_value": "array", "array_value": "array", "list_pack": "array", "to_map": "map_from_arrays", "map": "map_from_arrays",
    "map_contains": "map_contains_key", "map_extract_value": "try_element_at", "element_at": "try_element_at", "epoch_ms": "unix_millis", "epoch_us": "unix_micros", "make_timestamptz": "make_timestamp_ltz", "to_timestamp": "timestamp_seconds", "week": "weekofyear",
    "weekofyear": "weekofyear", "json_array_length": "json_array_length", "json_extract_string": "get_json_object", "json_extract_path_text": "get_json_object", "row_to_json": "to_json", "array_to_json": "to_json", "json": "parse_json", "regexp_matches": "rlike",
    "string_split_regex": "split", "regexp_split_to_array": "split", "struct_pack_": "struct", "xor": "^", "fmod": "mod", "variant_typeof": "schema_of_variant", "today": "current_date", "get_current_timestamp": "now", "array_to_string": "array_join", "list_to_string": "array_join",
}
AGGREGATE_NAMES = {
    "all": "bool_and", "any": "bool_or", "arg_max": "max_by", "argmax": "max_by", "arg_min": "min_by", "argmin": "min_by", "arg_max_null": "max_by", "arg_min_null": "min_by", "mean": "avg", "favg": "avg", "fsum": "sum", "kahan_sum": "sum", "sumkahan": "sum", "sum_no_overflow": "sum",
    "stddev": "stddev_samp", "variance": "var_samp", "quantile_cont": "percentile", "kurtosis_pop": "kurtosis", "group_concat": "listagg", "string_agg": "listagg", "list": "collect_list", "approx_quantile": "percentile_approx", "reservoir_quantile": "percentile_approx",
    **{n: n for n in ("avg", "count", "count_if", "sum", "min", "max", "first", "last", "bool_and", "bool_or", "bit_and", "bit_or", "bit_xor", "corr", "covar_pop", "covar_samp", "stddev_pop", "stddev_samp", "var_pop", "var_samp", "regr_avgx", "regr_avgy", "regr_count", "regr_intercept", "regr_r2",
                      "regr_slope", "regr_sxx", "regr_sxy", "regr_syy", "median", "listagg", "approx_count_distinct", "max_by", "min_by", "grouping", "grouping_id", "approx_top_k")},
}


def _make(f: Make, args: tuple, kind: Kind | None = None, name: str = "literal") -> Expr:
    if not args:
        return Expr(lambda s: f(), name, kind or Kind.LITERAL)
    first, *rest = args
    e = as_expr(first)
    return e._agg(f, *map(as_expr, rest)) if kind == Kind.SCALAR else e._map(f, *rest)


def _called(name: str) -> Make:
    return lambda *cs: F.call_function(name, *cs)


def __getattr__(name: str) -> Callable[..., Expr]:
    if name.startswith("__"):
        raise AttributeError(name)
    bare = name.rstrip("_")
    if bare in more.BUILDERS:
        return more.BUILDERS[bare]
    if bare in AGGREGATES:
        return lambda *args: _make(AGGREGATES[bare], args, Kind.SCALAR)
    if bare in SCALARS:
        return lambda *args: _make(SCALARS[bare], args)
    if bare.startswith("array_") and "list_" + bare[6:] in SCALARS:
        return lambda *args: _make(SCALARS["list_" + bare[6:]], args)
    if bare in AGGREGATE_NAMES:
        return lambda *args: _make(_called(AGGREGATE_NAMES[bare]), args, Kind.SCALAR)
    if bare in SCALAR_NAMES:
        return lambda *args: _make(_called(SCALAR_NAMES[bare]), args)
    if not hasattr(F, bare):
        raise AttributeError(f"no SQL function {bare!r}")
    return lambda *args: _make(_called(bare), args)


# pandas functions


def _series(returns: str, f: Callable[..., Any]) -> Make:
    """A function of values, over pandas columns; null where an argument is null. Equal rows of a batch are computed once."""

    def values(*cs: pd.Series) -> pd.Series:
        missing = np.logical_or.reduce([c.isna().to_numpy() for c in cs])
        once = functools.cache(f)
        return pd.Series([None if m else once(*row) for m, row in zip(missing, zip(*cs, strict=True), strict=True)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return values(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return values(a, b)

    return lambda *cs: F.pandas_udf({1: one, 2: two}[len(cs)], returns)(*cs)


def damerau(a: str, b: str) -> int:
    """Edits with transpositions of neighbours, any number of edits of a part."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = np.full((len(a) + 2, len(b) + 2), far)
    d[1:, 1], d[1, 1:] = range(len(a) + 1), range(len(b) + 1)
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            d[i + 1, j + 1] = min(d[i, j] + (x != y), d[i + 1, j] + 1, d[i, j + 1] + 1, d[k, m] + i - k - 1 + 1 + j - m - 1)
        last[x] = i
    return int(d[-1, -1])


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (y for j, y in enumerate(b) if used[j]), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    s = jaro(a, b)
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return s + min(same, 4) * 0.1 * (1 - s) if s > 0.7 else s


def merge_patch(a: Any, b: Any) -> Any:
    """RFC 7396."""
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps on a bounded number of pairs: 64-bit numbers need fewer than 93."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), (p["x"] % F.when(p["y"] == 0, 1).otherwise(p["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda p: p["x"])


# columns


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def _numbers(a: Column) -> Column:
    return a.cast("array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_numbers(a), _numbers(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_numbers(a), _numbers(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (_norm(a) * _norm(b))


def _chars_differ(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def _char_sets(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _slice(a: Column, begin: Column, end: Column, step: Column | None = None) -> Column:
    """Elements from begin to end, both counted from 1, or from the end if negative."""
    n = F.size(a)
    place = lambda c: F.when(c < 0, n + c + 1).otherwise(c)
    lo, hi = F.greatest(place(begin), F.lit(1)), F.least(place(end), n)
    cut = F.when(hi >= lo, F.slice(a, lo, hi - lo + 1)).otherwise(F.slice(a, 1, 0))
    return cut if step is None else F.filter(cut, lambda x, i: i % step == 0)


def _resize(a: Column, n: Column, value: Column | None = None) -> Column:
    fill = F.array_repeat(value if value is not None else F.lit(None), F.greatest(n - F.size(a), F.lit(0)).cast("int"))
    return F.slice(F.concat(a, fill), F.lit(1), n.cast("int"))


def _grade(a: Column) -> Column:
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("v"), (i + 1).cast("long").alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def _bytes_size(a: Column, units: tuple[str, ...], base: int) -> Column:
    out = F.when(F.abs(a) < base, F.concat(a.cast("string"), F.lit(" " + units[0])))
    for k, u in enumerate(units[1:], 1):
        text = F.concat(F.format_string("%.1f", F.floor(a / base**k * 10) / 10), F.lit(" " + u))
        out = out.otherwise(text) if k == len(units) - 1 else out.when(F.abs(a) < base ** (k + 1), text)
    return out


_BINARY, _DECIMAL = ("bytes", "KiB", "MiB", "GiB", "TiB", "PiB"), ("bytes", "kB", "MB", "GB", "TB", "PB")


def _micros(a: Column) -> Column:
    return F.unix_micros(a.cast("timestamp_ntz").cast("timestamp"))


def _graphemes(a: Column) -> Column:
    return F.regexp_extract_all(a, F.lit(r"\X"), F.lit(0))


def _json_value(a: Column, path: Column) -> Column:
    return F.to_json(F.call_function("try_variant_get", F.try_parse_json(a), path, F.lit("variant")))


def _json_type(a: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(a))
    return (
        F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(kind == "STRING", "VARCHAR").when(kind == "BOOLEAN", "BOOLEAN").when(kind == "VOID", "NULL")
        .when(kind == "BIGINT", F.when(F.startswith(F.trim(a), F.lit("-")), "BIGINT").otherwise("UBIGINT")).otherwise("DOUBLE")
    )


def _even(a: Column) -> Column:
    away = lambda x: F.ceil(F.abs(x) / 2) * 2 * F.signum(x)
    return away(a.cast("double"))


def _base(n: Column, radix: Column, width: Column | None = None) -> Column:
    out = F.call_function("conv", n.cast("string"), F.lit(10), radix)
    return F.when(n == 0, F.lit("0")).otherwise(out) if width is None else F.lpad(out, width, F.lit("0"))


def _trunc(a: Column, digits: Column | None = None) -> Column:
    p = F.lit(1.0) if digits is None else F.pow(F.lit(10.0), digits)
    return F.signum(a) * F.floor(F.abs(a) * p) / p


def _skew(a: Column) -> Column:
    n = F.count(a).cast("double")
    return F.when(n > 2, F.skewness(a) * F.sqrt(n * (n - 1)) / (n - 2))


def _kurt(a: Column) -> Column:
    n = F.count(a).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(a) + 6))


def _of_group(returns: str, f: Callable[[np.ndarray], Any]) -> Make:
    """A function of all values of a group, nulls left out; null for none. One vectorised pass over each collected list."""

    def values(column: pa.Array) -> pa.Array:
        out = []
        for x in column:
            v = x.values.to_numpy(zero_copy_only=False)
            out.append(f(v) if len(v) else None)
        return pa.array(out, pa.float64())

    return lambda a: F.arrow_udf(values, returns)(F.collect_list(a))


def _entropy_of(values: np.ndarray) -> float:
    share = np.unique(values, return_counts=True)[1] / len(values)
    return float(-(share * np.log2(share)).sum())


_shannon = _of_group("double", _entropy_of)
_mad_double = _of_group("double", lambda v: float(np.median(np.abs(v - np.median(v)))))


def _mad(a: Column) -> Column:
    return _mad_double(a.cast("double"))


# texts of zeros and ones stand for bit strings, structs of a tag and all members for unions; geometries are in ``spatial``

SCALARS: dict[str, Make] = {
    # numbers
    "ln": scalar.ln, "log": lambda a: F.when(a == 0, float("-inf")).otherwise(F.log10(a)), "log10": lambda a: F.when(a == 0, float("-inf")).otherwise(F.log10(a)), "log2": lambda a: F.when(a == 0, float("-inf")).otherwise(F.log2(a)), "fdiv": lambda a, b: F.floor(scalar.divide(a, b)),
    "divide": scalar.int_divide, "trunc": _trunc, "even": _even, "gcd": _gcd, "greatest_common_divisor": _gcd, "lcm": lambda a, b: F.abs(a.cast("long") * b) / _gcd(a, b), "least_common_multiple": lambda a, b: F.abs(a.cast("long") * b) / _gcd(a, b),
    "gamma": _series("double", math.gamma), "lgamma": _series("double", math.lgamma), "nextafter": _series("double", math.nextafter), "signbit": lambda a: (a < 0) | (a.cast("string") == "-0.0"), "isfinite": lambda a: ~F.isnan(a) & (F.abs(a) < float("inf")),
    "is_finite": lambda a: ~F.isnan(a) & (F.abs(a) < float("inf")), "isinf": lambda a: F.abs(a) == float("inf"), "is_inf": lambda a: F.abs(a) == float("inf"), "bit_count": lambda a: F.bit_count(a), "xor": lambda a, b: a.bitwiseXOR(b), "to_base": _base, "bin": lambda a: F.bin(a), "to_binary": lambda a: F.bin(a),
    "md5_number": _series("string", lambda s: str(int.from_bytes(hashlib.md5(s.encode()).digest(), "little"))), "md5_number_lower": _series("decimal(20,0)", lambda s: Decimal(int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "little"))),
    "md5_number_upper": _series("decimal(20,0)", lambda s: Decimal(int.from_bytes(hashlib.md5(s.encode()).digest()[8:], "little"))), "constant_or_null": lambda v, *cs: F.when(F.size(F.array_compact(F.array(*cs))) == len(cs), v), "switch": lambda m, k: F.try_element_at(m, k),
    "bar": lambda a, lo, hi, w: F.concat(F.repeat(F.lit("█"), F.floor((a - lo) / (hi - lo) * w).cast("int")), F.repeat(F.lit(" "), (w - F.floor((a - lo) / (hi - lo) * w)).cast("int"))),
    "generate_series": lambda a, b, s=None: F.sequence(a, b) if s is None else F.sequence(a, b, s), "range": lambda a, b, s=None: F.when(b > a, F.sequence(a, b - 1) if s is None else F.sequence(a, b - 1, s)).otherwise(F.slice(F.sequence(a, a), 1, 0)),
    # texts
    "sha256": lambda a: F.sha2(a, 256), "decode": lambda a: F.decode(a, "UTF-8"), "encode": lambda a: F.encode(a, "UTF-8"), "chr": lambda a: F.decode(F.unhex(F.lpad(F.hex(a.cast("long")), 8, "0")), "UTF-32"), "unicode": lambda a: F.ascii(a), "ord": lambda a: F.ascii(a), "split": lambda a, b: F.split(a, F.concat(F.lit(r"\Q"), b, F.lit(r"\E")), F.lit(-1)),
    "string_split": lambda a, b: F.split(a, F.concat(F.lit(r"\Q"), b, F.lit(r"\E")), F.lit(-1)), "str_split": lambda a, b: F.split(a, F.concat(F.lit(r"\Q"), b, F.lit(r"\E")), F.lit(-1)), "string_to_array": lambda a, b: F.split(a, F.concat(F.lit(r"\Q"), b, F.lit(r"\E")), F.lit(-1)),
    "split_part": lambda a, d, k: F.when(k == 0, F.lit("")).otherwise(F.split_part(a, d, F.when(k == 0, 1).otherwise(k))), "url_encode": lambda a: F.replace(F.url_encode(a), F.lit("+"), F.lit("%20")), "url_decode": lambda a: F.url_decode(F.replace(a, F.lit("+"), F.lit("%2B"))),
    "regexp_escape": lambda a: F.regexp_replace(a, r"([.^$*+?{}\[\]\\|()])", r"\\$1"), "regexp_full_match": lambda a, p: F.rlike(a, F.concat(F.lit("^(?:"), p, F.lit(")$"))), "regexp_extract_all": lambda a, p, g=None: F.regexp_extract_all(a, p, F.lit(0) if g is None else g), "regexp_replace_first": lambda a, p, r: F.regexp_replace(a, F.concat(F.lit("^([\\s\\S]*?)"), p), F.concat(F.lit("$1"), r)),
    "hamming": _chars_differ, "mismatches": _chars_differ, "jaccard": _char_sets, "levenshtein": lambda a, b: F.levenshtein(a, b), "damerau_levenshtein": _series("long", damerau), "jaro_similarity": _series("double", jaro), "jaro_winkler_similarity": _series("double", jaro_winkler),
    "nfc_normalize": _series("string", lambda s: unicodedata.normalize("NFC", s)), "strip_accents": _series("string", lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))),
    "length_grapheme": lambda a: F.size(_graphemes(a)), "left_grapheme": lambda a, n: F.array_join(F.slice(_graphemes(a), F.lit(1), n), ""), "right_grapheme": lambda a, n: F.array_join(F.reverse(F.slice(F.reverse(_graphemes(a)), F.lit(1), n)), ""), "substring_grapheme": lambda a, s, n: F.array_join(F.slice(_graphemes(a), s, n), ""),
    "format_bytes": lambda a: _bytes_size(a, _BINARY, 1024), "formatreadablesize": lambda a: _bytes_size(a, _BINARY, 1024), "formatreadabledecimalsize": lambda a: _bytes_size(a, _DECIMAL, 1000), "parse_path": lambda a: F.split(a, "/"), "parse_filename": lambda a: F.element_at(F.split(a, "/"), -1),
    "parse_dirname": lambda a: F.get(F.split(a, "/"), F.lit(0)), "parse_dirpath": lambda a: F.regexp_replace(a, "/?[^/]*$", ""), "like_escape": lambda a, p, e: F.call_function("like", a, p, e), "ilike_escape": lambda a, p, e: F.call_function("ilike", a, p, e), "not_like_escape": lambda a, p, e: ~F.call_function("like", a, p, e),
    "not_ilike_escape": lambda a, p, e: ~F.call_function("ilike", a, p, e), "lpad": lambda a, n, p=None: F.lpad(a, n, F.lit(" ") if p is None else p), "rpad": lambda a, n, p=None: F.rpad(a, n, F.lit(" ") if p is None else p), "hash": lambda *cs: F.xxhash64(*cs),
    # lists
    "list_cosine_similarity": _cosine, "list_cosine_distance": lambda a, b: 1 - _cosine(a, b), "list_distance": _distance, "list_inner_product": _dot, "list_dot_product": _dot, "list_negative_inner_product": lambda a, b: -_dot(a, b), "list_negative_dot_product": lambda a, b: -_dot(a, b),
    "list_cross_product": lambda a, b: F.array(*[F.get(a, F.lit(i)) * F.get(b, F.lit(j)) - F.get(a, F.lit(j)) * F.get(b, F.lit(i)) for i, j in ((1, 2), (2, 0), (0, 1))]), "list_slice": _slice, "list_resize": _resize, "list_concat": lambda *cs: F.concat(*[F.coalesce(c, F.slice(cs[0], 1, 0)) for c in cs]),
    "list_cat": lambda *cs: F.concat(*[F.coalesce(c, F.slice(cs[0], 1, 0)) for c in cs]), "list_contains": lambda a, v: F.when(a.isNotNull(), F.coalesce(F.array_contains(a, v), F.lit(False))), "list_has": lambda a, v: F.when(a.isNotNull(), F.coalesce(F.array_contains(a, v), F.lit(False))),
    "list_has_any": lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False)), "list_has_all": lambda a, b: F.size(F.array_except(F.array_compact(b), a)) == 0, "list_position": lambda a, v: F.nullif(F.array_position(a, v), F.lit(0)), "list_indexof": lambda a, v: F.nullif(F.array_position(a, v), F.lit(0)),
    "list_distinct": lambda a: F.array_distinct(F.array_compact(a)), "list_unique": lambda a: F.size(F.array_distinct(F.array_compact(a))), "list_sort": lambda a: F.sort_array(a), "list_reverse_sort": lambda a: F.sort_array(a, False), "list_grade_up": _grade, "grade_up": _grade, "list_extract": lambda a, i: F.try_element_at(a, i.cast("int")), "list_select": lambda a, ix: F.transform(ix, lambda i: F.try_element_at(a, i.cast("int"))),
    "list_where": lambda a, m: F.transform(F.filter(F.arrays_zip(a.alias("v"), m.alias("m")), lambda z: z["m"]), lambda z: z["v"]), "list_pop_back": lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), "list_pop_front": lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), "flatten": lambda a: F.flatten(F.array_compact(a)),
    "list_sum": scalar.list_sum, "list_avg": scalar.list_mean, "list_mean": scalar.list_mean, "list_median": scalar.list_median, "list_min": lambda a: F.array_min(a), "list_max": lambda a: F.array_max(a), "list_var_samp": lambda a: scalar.list_var(a, 1), "list_var_pop": lambda a: scalar.list_var(a, 0), "list_stddev_samp": lambda a: F.sqrt(scalar.list_var(a, 1)),
    "list_stddev_pop": lambda a: F.sqrt(scalar.list_var(a, 0)), "list_count": lambda a: F.size(F.array_compact(a)), "list_first": lambda a: F.get(a, F.lit(0)), "list_last": lambda a: F.try_element_at(a, F.lit(-1)), "list_any_value": lambda a: F.get(F.array_compact(a), F.lit(0)), "list_product": lambda a: F.aggregate(F.array_compact(_numbers(a)), F.lit(1.0), lambda s, x: s * x),
    "list_bool_and": lambda a: F.when(F.size(F.array_compact(a)) > 0, F.forall(F.array_compact(a), lambda x: x)), "list_bool_or": lambda a: F.when(F.size(F.array_compact(a)) > 0, F.exists(F.array_compact(a), lambda x: x)), "list_string_agg": lambda a: F.array_join(a, ","),
    # times
    "dayofweek": lambda a: F.dayofweek(a) - 1, "weekday": lambda a: F.dayofweek(a) - 1, "isodow": lambda a: F.weekday(a) + 1, "isoyear": lambda a: F.extract(F.lit("YEAROFWEEK"), a), "decade": lambda a: F.floor(F.year(a) / 10), "century": lambda a: F.ceil(F.year(a) / 100), "millennium": lambda a: F.ceil(F.year(a) / 1000), "era": lambda a: F.when(F.year(a) > 0, 1).otherwise(0),
    "yearweek": lambda a: F.extract(F.lit("YEAROFWEEK"), a) * 100 + F.weekofyear(a), "julian": lambda a: F.unix_date(a.cast("date")) + 2440588 + F.pmod(_micros(a), F.lit(86_400_000_000)) / 86_400_000_000, "epoch": lambda a: _micros(a) / 1_000_000, "epoch_us": _micros, "epoch_ms": lambda a: F.floor(_micros(a) / 1000), "epoch_ns": lambda a: _micros(a) * 1000,
    "microsecond": lambda a: F.pmod(_micros(a), F.lit(60_000_000)), "millisecond": lambda a: F.floor(F.pmod(_micros(a), F.lit(60_000_000)) / 1000), "nanosecond": lambda a: F.pmod(_micros(a), F.lit(60_000_000)) * 1000, "dayname": lambda a: F.date_format(a, "EEEE"), "monthname": lambda a: F.date_format(a, "MMMM"),
    "make_timestamp_ms": lambda a: F.timestamp_millis(a), "make_timestamp_ns": lambda a: F.timestamp_micros((a / 1000).cast("long")), "timezone_hour": lambda a: F.floor((F.unix_micros(a.cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.to_utc_timestamp(a, F.current_timezone()))) / 3_600_000_000),
    "ago": lambda i: F.current_timestamp() - i, "age": lambda a, b=None: (a - b) if b is not None else F.current_timestamp() - a,
    **{f"to_{u}": (lambda k, m: lambda n: F.make_ym_interval(F.lit(0), (n * m).cast("int")))(u, m) for u, m in {"months": 1, "quarters": 3, "years": 12, "decades": 120, "centuries": 1200, "millennia": 12000}.items()},
    **{f"to_{u}": (lambda m: lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * F.lit(m)).cast("decimal(18,6)")))(m) for u, m in {"weeks": 604800, "days": 86400, "hours": 3600, "minutes": 60, "seconds": 1, "milliseconds": 0.001, "microseconds": 0.000001}.items()},
    # documents and maps
    "json_valid": lambda a: F.when(a.isNotNull(), F.try_parse_json(a).isNotNull()), "json_extract": _json_value, "json_extract_path": _json_value, "json_value": _json_value, "json_exists": lambda a, p: F.when(a.isNotNull(), F.call_function("try_variant_get", F.try_parse_json(a), p, F.lit("variant")).isNotNull()), "json_type": _json_type, "json_keys": lambda a: F.json_object_keys(a),
    "json_array": lambda *cs: F.to_json(F.array(*cs)), "json_quote": lambda a: F.to_json(a), "json_structure": lambda a: F.schema_of_json(a), "json_pretty": lambda a: F.to_json(F.try_parse_json(a), {"pretty": "true"}), "json_contains": _series("boolean", lambda a, b: _contained(json.loads(a), json.loads(b))),
    "json_merge_patch": _series("string", lambda a, b: json.dumps(merge_patch(json.loads(a), json.loads(b)), separators=(",", ":"), ensure_ascii=False)), "map_contains_entry": lambda m, k, v: F.map_contains_key(m, k) & (F.try_element_at(m, k) == v), "map_contains_value": lambda m, v: F.array_contains(F.map_values(m), v), "map_extract": lambda m, k: F.array_compact(F.array(F.try_element_at(m, k))),
    # bits and unions
    "bitstring": lambda s, n: F.lpad(s, n, "0"), "get_bit": lambda s, i: F.substring(s, i + 1, F.lit(1)).cast("int"), "set_bit": lambda s, i, v: F.overlay(s, v.cast("string"), i + 1, F.lit(1)), "bit_position": lambda sub, s: F.instr(s, sub), "union_tag": lambda u: u.getField("tag"), "union_extract": lambda u, t: F.call_function("get_json_object", F.to_json(u), F.concat(F.lit("$."), t)),
}

SCALARS |= more.SCALARS | spatial.SCALARS


def _contained(a: Any, b: Any) -> bool:
    """Whether b is a or anywhere in it; objects hold others with fewer keys."""
    if isinstance(a, dict):
        return isinstance(b, dict) and all(k in a and _contained(a[k], v) for k, v in b.items()) or any(_contained(v, b) for v in a.values())
    if isinstance(a, list):
        return isinstance(b, list) and all(any(_contained(x, y) for x in a) for y in b) or any(_contained(x, b) for x in a)
    return a == b


AGGREGATES: dict[str, Make] = {
    "any_value": lambda a: F.any_value(a, True), "implode": gathered, "array_agg": gathered, "product": lambda a: F.product(a), "geomean": lambda a: F.exp(F.avg(F.ln(a))), "geometric_mean": lambda a: F.exp(F.avg(F.ln(a))), "sem": lambda a: F.stddev_pop(a) / F.sqrt(F.count(a)), "wavg": lambda a, w: F.sum(a * w) / F.sum(w),
    "weighted_avg": lambda a, w: F.sum(a * w) / F.sum(w), "skewness": _skew, "kurtosis": _kurt, "kurtosis_samp": _kurt, "mad": _mad, "entropy": _shannon, "entropy_shannon": _shannon, "mode": lambda a: F.mode(a, True), "quantile_disc": lambda a, q: F.percentile(a, q), "bitstring_agg": lambda a: F.collect_set(a),
    "arg_max_nulls_last": lambda a, b: F.max_by(a, F.struct(b.isNotNull(), b)), "arg_min_nulls_last": lambda a, b: F.min_by(a, F.struct(b.isNull(), b)), "json_group_array": lambda a: F.to_json(gathered(a)), "json_group_object": lambda k, v: F.to_json(F.map_from_entries(F.collect_list(F.struct(k, v)))), "count_star": lambda: F.count(F.lit(1)),
}

AGGREGATES |= spatial.AGGREGATES


# functions with arguments that aren't columns


def format(template: str, *args: Any) -> Expr:  # noqa: A001
    """``{}`` stand for the arguments, as texts."""
    parts = template.split("{}")
    return _make(lambda *cs: F.concat(F.lit(parts[0]), *[x for c, p in zip(cs, parts[1:], strict=True) for x in (c.cast("string"), F.lit(p))]), args)


def _histogram(e: Any, gather: Callable[[Column], Column], kind: Kind | None) -> Expr:
    x = as_expr(e)

    def make(s: Any) -> Column:
        lists = gather(x.column(s))
        inner = s.df.select((lists if kind is None else F.array(x.column(s))).alias("x")).schema[0].dataType.elementType

        def values(column: pa.Array) -> pa.Array:
            out = []
            for row in column:
                pairs = pc.value_counts(row.values) if row.is_valid else None
                out.append(None if pairs is None else sorted((p["values"].as_py(), p["counts"].as_py()) for p in pairs))
            return pa.array(out, pa.map_(column.type.value_type, pa.int64()))

        return F.arrow_udf(values, T.MapType(inner, T.LongType()))(lists)

    return x._with(make, kind=kind)


def histogram(e: Any) -> Expr:
    """How often each value of a group occurs, as a map in the order of the values."""
    return _histogram(e, F.collect_list, Kind.SCALAR)


def list_histogram(e: Any) -> Expr:
    return _histogram(e, F.array_compact, None)


def struct_pack(**fields: Any) -> Expr:
    return _make(lambda *cs: F.struct(*[c.alias(n) for n, c in zip(fields, cs, strict=True)]), tuple(fields.values()))


def json_object(**fields: Any) -> Expr:
    return _make(lambda *cs: F.to_json(F.struct(*[c.alias(n) for n, c in zip(fields, cs, strict=True)]), {"ignoreNullFields": "false"}), tuple(fields.values()))


def struct_extract(e: Any, name: str) -> Expr:
    return as_expr(e).struct.field(name)


def struct_insert(e: Any, **fields: Any) -> Expr:
    return as_expr(e).struct.with_fields(**fields)


struct_update = struct_insert


def struct_keys(e: Any) -> Expr:
    return as_expr(e)._typed(lambda s, a: F.array(*[F.lit(f.name) for f in s.type_of(a)]))


def struct_values(e: Any) -> Expr:
    return as_expr(e)._typed(lambda s, a: F.array(*[a.getField(f.name) for f in s.type_of(a)]))


def struct_contains(e: Any, value: Any) -> Expr:
    return as_expr(e)._typed(lambda s, a, v: F.array_contains(F.array(*[a.getField(f.name) for f in s.type_of(a)]), v), value)


def struct_position(e: Any, value: Any) -> Expr:
    return as_expr(e)._typed(lambda s, a, v: F.nullif(F.array_position(F.array(*[a.getField(f.name) for f in s.type_of(a)]), v), F.lit(0)), value)


struct_has, struct_indexof = struct_contains, struct_position


def list_transform(e: Any, f: Callable[[Column], Column]) -> Expr:
    return _make(lambda a: F.transform(a, f), (e,))


def list_filter(e: Any, f: Callable[[Column], Column]) -> Expr:
    return _make(lambda a: F.filter(a, f), (e,))


def list_reduce(e: Any, f: Callable[[Column, Column], Column], initial: Any = None) -> Expr:
    if initial is not None:
        return _make(lambda a, i: F.aggregate(a, i, f), (e, initial))
    return _make(lambda a: F.reduce(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), f), (e,))


list_apply = apply = array_transform = array_apply = list_transform
array_reduce = list_reduce


def list_aggregate(e: Any, name: str) -> Expr:
    """An aggregate of a list's elements, by name."""
    return _make(SCALARS["list_" + {"avg": "mean"}.get(name, name)], (e,))


list_aggr = array_aggregate = array_aggr = list_aggregate


def date_diff(part: str, start: Any, end: Any) -> Expr:
    """How many borders of the part lie between."""
    if part in ("year", "quarter", "month", "decade", "century"):
        months = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200}[part]
        number = lambda a: F.floor((F.year(a) * 12 + F.month(a) - 1) / months)
    else:
        micros = {"week": 604_800, "day": 86_400, "hour": 3600, "minute": 60, "second": 1, "millisecond": 1e-3, "microsecond": 1e-6}[part] * 1_000_000
        shift = 3 * 86_400_000_000 if part == "week" else 0
        number = lambda a: F.floor((_micros(a) + shift) / micros)
    return _make(lambda a, b: (number(b) - number(a)).cast("long"), (start, end))


datediff = date_diff


def date_sub(part: str, start: Any, end: Any) -> Expr:
    """How many whole parts lie between."""
    return _make(lambda a, b: F.timestamp_diff(part, a, b), (start, end))


datesub = date_sub


def date_part(part: str, e: Any) -> Expr:
    return _make(lambda a: F.date_part(F.lit(part), a), (e,))


datepart = date_part


def date_trunc(part: str, e: Any) -> Expr:
    return _make(lambda a: F.date_trunc(part, a).cast("timestamp_ntz"), (e,))


def time_bucket(width: str, e: Any) -> Expr:
    """The beginning of the bucket of fixed width, as "7 days"; buckets are counted from Monday 2000-01-03."""
    n, unit = width.split()
    micros = int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}[unit.rstrip("s")] * 1_000_000
    origin = 946_857_600_000_000
    return _make(lambda a: F.timestamp_micros((F.floor((_micros(a) - origin) / micros) * micros + origin).cast("long")).cast("timestamp_ntz"), (e,))


def strptime(e: Any, pattern: str) -> Expr:
    return _make(lambda a: F.to_timestamp_ntz(a, F.lit(java_pattern(pattern))), (e,))


def try_strptime(e: Any, pattern: str) -> Expr:
    return _make(lambda a: F.try_to_timestamp(a, F.lit(java_pattern(pattern))).cast("timestamp_ntz"), (e,))


def strftime(e: Any, pattern: str) -> Expr:
    return _make(lambda a: F.date_format(a, java_pattern(pattern)), (e,))


def enum_code(e: Any, categories: list[str]) -> Expr:
    """The place of a value among its categories, from 0."""
    return _make(lambda a: F.array_position(F.array(*[F.lit(c) for c in categories]), a) - 1, (e,))


def enum_range(categories: list[str]) -> Expr:
    return as_expr(list(categories))


def regexp_extract_names(e: Any, pattern: str, names: list[str]) -> Expr:
    """The groups of a match as a struct."""
    return _make(lambda a: F.struct(*[F.regexp_extract(a, pattern, k).alias(n) for k, n in enumerate(names, 1)]), (e,))


def from_json(e: Any, schema: str) -> Expr:
    return _make(lambda a: F.from_json(a, schema), (e,))


def from_json_strict(e: Any, schema: str) -> Expr:
    return _make(lambda a: F.from_json(a, schema, {"mode": "FAILFAST"}), (e,))


json_transform, json_transform_strict = from_json, from_json_strict
