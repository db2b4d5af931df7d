"""Frames from Python data, tables, files and SQL."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from ..session import active


def _arrow(columns: Mapping[str, Iterable[Any]]) -> DataFrame:
    """Columns of unequal lengths are filled with nulls."""
    lists = {k: list(v) for k, v in columns.items()}
    longest = max(map(len, lists.values()), default=0)
    return _of_arrow(pa.table({k: pa.array(v + [None] * (longest - len(v))) for k, v in lists.items()}))


def _of_arrow(table: pa.Table) -> DataFrame:
    """Timestamps without a zone stay so."""
    return active().createDataFrame(table, schema=from_arrow_schema(table.schema, True))


def to_spark(data: Any, orient: str = "col") -> DataFrame:
    """A DataFrame of anything that holds rows or columns."""
    from ..frame import LazyFrame

    if isinstance(data, DataFrame):
        return data
    if isinstance(data, LazyFrame):
        return data.to_spark()
    if isinstance(data, pa.Table):
        return _of_arrow(data)
    if isinstance(data, Mapping):
        return _arrow(data)
    if isinstance(data, np.ndarray):
        return _numpy(data, orient)
    if type(data).__module__.split(".")[0] == "pandas":
        return active().createDataFrame(data)
    if isinstance(data, Iterable):
        return _records(list(data))
    raise TypeError(f"can't make a frame of {type(data).__name__}")


def _numpy(array: np.ndarray, orient: str) -> DataFrame:
    """Columns column_0, column_1, ...; of more than two dimensions the others become lists."""
    if orient not in ("col", "row"):
        raise ValueError("`orient` must be 'col' or 'row'")
    if array.ndim == 1:
        return _arrow({"column_0": array.tolist()})
    columns = array if orient == "col" else np.swapaxes(array, 0, 1)
    return _arrow({f"column_{k}": c.tolist() for k, c in enumerate(columns)})


def _records(records: Sequence[Any]) -> DataFrame:
    """Dicts are rows, inner sequences columns, scalars one column; the first dict's keys fix the columns."""
    if records and isinstance(records[0], Mapping):
        return _arrow({k: [r.get(k) for r in records] for k in records[0]})
    if records and isinstance(records[0], (list, tuple)):
        return _arrow({f"column_{k}": list(c) for k, c in enumerate(records)})
    return _arrow({"column_0": list(records)})


def from_query(query: str, **relations: Any) -> Any:
    """Spark SQL in which the names of the given frames stand in braces, or for tables."""
    from ..frame import LazyFrame

    frames = {k: to_spark(v) for k, v in relations.items()}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return LazyFrame(active().sql(query))


def from_table(table: str) -> Any:
    from ..frame import LazyFrame

    return LazyFrame(active().table(table))


def from_table_function(function: str) -> Any:
    """A table function with its arguments, as ``range(5)``."""
    from ..frame import LazyFrame

    return LazyFrame(active().sql(f"SELECT * FROM {function if '(' in function else function + '()'}"))


def from_df(df: Any) -> Any:
    from ..frame import LazyFrame

    return LazyFrame(to_spark(df))


def from_numpy(arr: np.ndarray, orient: str = "col") -> Any:
    from ..frame import LazyFrame

    return LazyFrame(_numpy(arr, orient))


def from_dict(mapping: Mapping[str, Iterable[Any]]) -> Any:
    from ..frame import LazyFrame

    return LazyFrame(_arrow(mapping))


def from_dicts(data: Sequence[Mapping[str, Any]]) -> Any:
    from ..frame import LazyFrame

    return LazyFrame(_records(list(data)))


def from_records(data: Iterable[Any]) -> Any:
    from ..frame import LazyFrame

    return LazyFrame(_records(list(data)))


def scan_parquet(path: str) -> Any:
    from ..frame import LazyFrame

    return LazyFrame(active().read.parquet(path))


def scan_csv(path: str, *, separator: str = ",", has_header: bool = True, schema: Any = None) -> Any:
    """Types are guessed, in a pass over the file, unless a schema is given."""
    from ..frame import LazyFrame

    reader = active().read.schema(schema) if schema else active().read.option("inferSchema", True)
    return LazyFrame(reader.csv(path, sep=separator, header=has_header))


def scan_ndjson(path: str, *, schema: Any = None) -> Any:
    from ..frame import LazyFrame

    return LazyFrame((active().read.schema(schema) if schema else active().read).json(path))


def scan_orc(path: str) -> Any:
    from ..frame import LazyFrame

    return LazyFrame(active().read.orc(path))
