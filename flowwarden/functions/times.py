"""Epoch, ISO and stamp conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyyMMdd_HHmmss"


def from_epoch(seconds: Column) -> Column:
    """Timestamp of a double of epoch seconds, to the microsecond."""
    return F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))


def to_epoch(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) / 1e6


def iso(at: Column) -> Column:
    """ISO text; the fraction is shown only when there is one."""
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))


def to_stamp(at: Column) -> Column:
    return F.date_format(at, STAMP)


def from_stamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(STAMP))


def display(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")
