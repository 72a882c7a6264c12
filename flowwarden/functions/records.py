"""Records as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.functions.times import iso


def json_value(value: Column, kind: T.DataType) -> Column:
    """A value whose JSON form every reader accepts.

    NaN and infinities, which JSON has no numbers for, become null; decimals become doubles; times and dates become ISO
    text; bytes become base64 text; arrays, maps (keys as text) and structs are converted inside.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.DecimalType):
        return value.cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso(value)
    if isinstance(kind, T.DateType):
        return value.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        values = F.transform_values(value, lambda _, x: json_value(x, kind.valueType))
        return F.transform_keys(values, lambda k, _: k.cast("string"))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[json_value(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def json_record(schema: T.StructType, columns: list[str] | None = None) -> Column:
    """One JSON object per row of the given (or all) columns; null fields are written as null."""
    fields = [f for f in schema.fields if columns is None or f.name in columns]
    return F.to_json(F.struct(*[json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]),
                     {"ignoreNullFields": "false"})
