"""Data types by name, their Spark types and class tests. What Spark can't tell apart is kept in the column's metadata."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import types as T

KEY = "larkspur.type"


@dataclass(frozen=True)
class DataType:
    """A type: ``name``, the Spark type it is kept in, and parameters."""

    name: str
    spark: T.DataType
    args: tuple = ()

    def __eq__(self, other: object) -> bool:
        if callable(other) and not isinstance(other, DataType):
            other = _bare(other)
            return self.name == other
        return isinstance(other, DataType) and (self.name, self.args) == (other.name, other.args)

    def __hash__(self) -> int:
        return hash((self.name, self.args))

    def __repr__(self) -> str:
        return f"{self.name}({', '.join(map(repr, self.args))})" if self.args else self.name

    def is_(self, other: object) -> bool:
        return self == other

    def is_signed_integer(self) -> bool:
        return self.name in ("Int8", "Int16", "Int32", "Int64", "Int128")

    def is_unsigned_integer(self) -> bool:
        return self.name in ("UInt8", "UInt16", "UInt32", "UInt64", "UInt128")

    def is_integer(self) -> bool:
        return self.is_signed_integer() or self.is_unsigned_integer()

    def is_float(self) -> bool:
        return self.name in ("Float32", "Float64")

    def is_decimal(self) -> bool:
        return self.name == "Decimal"

    def is_numeric(self) -> bool:
        return self.is_integer() or self.is_float() or self.name in ("Decimal", "Number", "UUID")

    def is_temporal(self) -> bool:
        return self.name in ("Date", "Datetime", "DatetimeTZ", "Time", "TimeTZ", "Duration")

    def is_nested(self) -> bool:
        return self.name in ("List", "Array", "Struct", "Map", "Union")


def _bare(kind: object) -> str:
    return getattr(kind, "__name__", "")


_i = T.IntegerType()
Boolean, String, Binary = DataType("Boolean", T.BooleanType()), DataType("String", T.StringType()), DataType("Binary", T.BinaryType())
Int8, Int16, Int32, Int64 = DataType("Int8", T.ByteType()), DataType("Int16", T.ShortType()), DataType("Int32", _i), DataType("Int64", T.LongType())
UInt8, UInt16, UInt32 = DataType("UInt8", T.ShortType()), DataType("UInt16", _i), DataType("UInt32", T.LongType())
UInt64, Int128, UInt128 = DataType("UInt64", T.DecimalType(20, 0)), DataType("Int128", T.DecimalType(38, 0)), DataType("UInt128", T.DecimalType(38, 0))
Number, UUID, Json, BitString, Geometry = DataType("Number", T.DecimalType(38, 0)), DataType("UUID", T.StringType()), DataType("Json", T.StringType()), DataType("BitString", T.StringType()), DataType("Geometry", T.BinaryType())
Float32, Float64, Date = DataType("Float32", T.FloatType()), DataType("Float64", T.DoubleType()), DataType("Date", T.DateType())
DatetimeTZ, TimeTZ, Duration = DataType("DatetimeTZ", T.TimestampType()), DataType("TimeTZ", T.StringType()), DataType("Duration", T.DayTimeIntervalType())
Time = DataType("Time", T.TimeType(6))


def Datetime(unit: str = "ns") -> DataType:  # noqa: N802
    """Kept in microseconds, whatever the unit."""
    if unit not in ("s", "ms", "us", "ns"):
        raise ValueError(f"unknown time unit {unit!r}")
    return DataType("Datetime", T.TimestampNTZType(), (unit,))


def Decimal(precision: int = 18, scale: int = 0) -> DataType:  # noqa: N802
    return DataType("Decimal", T.DecimalType(precision, scale), (precision, scale))


def Enum(categories: list[str]) -> DataType:  # noqa: N802
    return DataType("Enum", T.StringType(), tuple(categories))


def List(inner: DataType) -> DataType:  # noqa: N802
    return DataType("List", T.ArrayType(of(inner).spark), (of(inner),))


def Array(inner: DataType, size: int) -> DataType:  # noqa: N802
    return DataType("Array", T.ArrayType(of(inner).spark), (of(inner), size))


def Struct(fields: Mapping[str, DataType]) -> DataType:  # noqa: N802
    return DataType("Struct", T.StructType([T.StructField(k, of(v).spark) for k, v in fields.items()]), tuple((k, of(v)) for k, v in fields.items()))


def Map(key: DataType, value: DataType) -> DataType:  # noqa: N802
    return DataType("Map", T.MapType(of(key).spark, of(value).spark), (of(key), of(value)))


def Union(fields: Mapping[str, DataType]) -> DataType:  # noqa: N802
    """Kept as a struct of the tag and all members."""
    inner = [T.StructField("tag", T.StringType()), *(T.StructField(k, of(v).spark) for k, v in fields.items())]
    return DataType("Union", T.StructType(inner), tuple((k, of(v)) for k, v in fields.items()))


_PYTHON = {bool: Boolean, int: Int64, float: Float64, str: String, bytes: Binary}
_SIMPLE = {d.name: d for d in (Boolean, String, Binary, Int8, Int16, Int32, Int64, UInt8, UInt16, UInt32, UInt64, Int128, UInt128, Number, UUID, Json, BitString, Geometry, Float32, Float64, Date, DatetimeTZ, TimeTZ, Duration, Time)}


def of(kind: object) -> DataType:
    """A DataType from one of ours, a constructor without arguments, a Python type, a Spark type or a DDL string."""
    if isinstance(kind, DataType):
        return kind
    if kind in _PYTHON:
        return _PYTHON[kind]
    if isinstance(kind, T.DataType):
        return from_spark(kind)
    if isinstance(kind, str):
        return _SIMPLE.get(kind) or from_spark(T.StructType.fromDDL(f"x {kind}")[0].dataType)
    if kind in (Datetime, Decimal):
        return kind()
    raise TypeError(f"not a data type: {kind!r}")


def from_spark(kind: T.DataType, metadata: Mapping | None = None) -> DataType:
    """Our type of a Spark type; metadata tells what Spark's doesn't."""
    if metadata and KEY in metadata:
        name, *args = metadata[KEY]
        return Enum(args) if name == "Enum" else Array(from_spark(kind.elementType), int(args[0])) if name == "Array" else _SIMPLE[name]
    simple = {T.BooleanType: Boolean, T.StringType: String, T.BinaryType: Binary, T.ByteType: Int8, T.ShortType: Int16, T.IntegerType: Int32, T.LongType: Int64, T.FloatType: Float32, T.DoubleType: Float64, T.DateType: Date, T.TimestampType: DatetimeTZ, T.TimeType: Time, T.DayTimeIntervalType: Duration, T.YearMonthIntervalType: Duration, T.VariantType: Json}
    for k, v in simple.items():
        if isinstance(kind, k):
            return v
    if isinstance(kind, T.TimestampNTZType):
        return Datetime()
    if isinstance(kind, T.DecimalType):
        return Decimal(kind.precision, kind.scale)
    if isinstance(kind, T.ArrayType):
        return List(from_spark(kind.elementType))
    if isinstance(kind, T.StructType):
        return Struct({f.name: from_spark(f.dataType, f.metadata) for f in kind})
    if isinstance(kind, T.MapType):
        return Map(from_spark(kind.keyType), from_spark(kind.valueType))
    raise TypeError(f"no data type for {kind.simpleString()}")


def metadata_of(kind: DataType) -> dict:
    """What has to be kept beside the Spark type."""
    if kind.name in ("Enum",):
        return {KEY: ["Enum", *kind.args]}
    if kind.name == "Array":
        return {KEY: ["Array", str(kind.args[1])]}
    if kind.is_unsigned_integer() or kind.name in ("UUID", "Json", "BitString", "Geometry", "TimeTZ", "Int128", "Number"):
        return {KEY: [kind.name]}
    return {}


class Schema(dict):
    """Names and types of a frame's columns, in order."""

    @classmethod
    def from_struct(cls, struct: T.StructType) -> Schema:
        return cls({f.name: from_spark(f.dataType, f.metadata) for f in struct})

    @classmethod
    def from_frame(cls, frame: object) -> Schema:
        return cls(frame.schema)

    def names(self) -> list[str]:
        return list(self)

    def dtypes(self) -> list[DataType]:
        return list(self.values())
