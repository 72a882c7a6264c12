"""Array-of-double expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def all_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def finite_or(x: Column, fallback: float = 1e6) -> Column:
    """Replace NaN and infinities, the way distances are cleaned before averaging."""
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(fallback)).otherwise(x)
