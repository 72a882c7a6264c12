"""Missing values, types and column alignment of flow records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.schemas import (CATEGORICAL, LABELS, LEGACY_CATEGORICAL, LEGACY_NUMERIC, NUMERIC)

NULL_LABEL = "nan"  # what a missing category reads as in training data
UNKNOWN = "unknown"
NUMERIC_LOOKING = ("sTos", "dTos")  # categories stored as numbers: a gap is filled as a number first


def to_number(c: Column) -> Column:
    """Number or 0: text that is no number, NaN and null all become 0."""
    text = F.trim(c.cast("string"))
    # the JVM parser takes a type suffix ("5d"), which is not a number in a CSV
    suffixed = F.upper(F.right(text, F.lit(1))).isin("D", "F") & text.rlike("(?i)[0-9.][df]$")
    value = F.when(~F.coalesce(suffixed, F.lit(False)), text.try_cast("double"))
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def to_category(c: Column, null_label: str = NULL_LABEL) -> Column:
    return F.coalesce(c.cast("string"), F.lit(null_label))


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def fill_missing(df: DataFrame, null_label: str = NULL_LABEL) -> DataFrame:
    """Numeric nulls to 0, other non-label nulls to ``null_label``."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.coalesce(F.nanvl(q(f.name), F.lit(0)), F.lit(0)).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            out.append(F.coalesce(q(f.name), F.lit(0)).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType) and f.name not in LABELS:
            out.append(to_category(q(f.name), null_label).alias(f.name))
        else:
            out.append(q(f.name))
    return df.select(*out)


def clean_flows(df: DataFrame, null_label: str = NULL_LABEL, numeric: list[str] = NUMERIC,
                categorical: list[str] = CATEGORICAL, keep: tuple[str, ...] = ("traffic_class", "row_id", "file_name"),
                ) -> DataFrame:
    """One projection: numbers coerced, categories as text, remaining text filled, labels untouched."""
    out = []
    for f in df.schema.fields:
        name, column = f.name, q(f.name)
        if name in numeric:
            out.append(to_number(column).alias(name))
        elif name in categorical:
            gap = "0.0" if name in NUMERIC_LOOKING else null_label
            out.append(to_category(column, gap).alias(name))
        elif name in LABELS or name in keep:
            out.append(column)
        elif isinstance(f.dataType, T.NumericType):
            out.append(F.coalesce(column, F.lit(0)).cast(f.dataType).alias(name))
        elif isinstance(f.dataType, T.StringType):
            out.append(to_category(column, null_label).alias(name))
        else:
            out.append(column)
    return df.select(*out)


def clean_flows_legacy(df: DataFrame) -> DataFrame:
    """Earlier variant: missing categories are ``unknown``; ``Seq``, ``sTos`` and ``dTos`` are numbers."""
    return clean_flows(df, UNKNOWN, LEGACY_NUMERIC, LEGACY_CATEGORICAL)


def align(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Exactly ``columns`` in that order: missing ones filled, extra ones dropped."""
    present = set(df.columns)
    return df.select(*[q(c) if c in present else F.lit(fill).alias(c) for c in columns])


def non_empty_classes(df: DataFrame, group: str = "traffic_class") -> DataFrame:
    """Classes that hold rows, with their counts (an empty file contributes none)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
