"""Larkspur: a lazy dataframe engine with an expression API, running on Spark."""

from . import dtypes, selectors
from .api import all, all_horizontal, any_horizontal, coalesce, col, element, len, lit, max, max_horizontal, mean, mean_horizontal, median, min, min_horizontal, sum, sum_horizontal, when
from .dtypes import Schema
from .expr import Expr
from .frame import GroupBy, LazyFrame
from .session import session
from .sources.create import from_df, from_dict, from_dicts, from_numpy, from_query, from_records, from_table, from_table_function, scan_csv, scan_ndjson, scan_orc, scan_parquet

__all__ = [
    "Expr", "GroupBy", "LazyFrame", "Schema", "all", "all_horizontal", "any_horizontal", "coalesce", "col", "dtypes", "element", "from_df", "from_dict", "from_dicts", "from_numpy", "from_query", "from_records",
    "from_table", "from_table_function", "len", "lit", "max", "max_horizontal", "mean", "mean_horizontal", "median", "min", "min_horizontal", "scan_csv", "scan_ndjson", "scan_orc", "scan_parquet", "selectors", "session", "sum", "sum_horizontal", "when",
]
