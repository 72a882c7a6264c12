"""Newest-first listings, bounded histories, retention and running numbers.

Every bound here (last N, keep N) is the feature itself.  Top-N keys are found with a distributed top-N;
full rows are touched only for the keys that remain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.session import materialize

# Sizes of the kept histories and listings.
FLOW_HISTORY, ANALYSIS_HISTORY, QUESTION_HISTORY = 200, 50, 100
SHOWN_FLOWS, SHOWN_ANALYSES, SHOWN_QUESTIONS, SHOWN_ON_CONNECT = 20, 10, 20, 10
KEEP_DOCUMENTS, KEEP_LOGS = 1000, 100
STORED_ANALYSES, EVICTED_ANALYSES = 100, 50

_PART_BITS = 33  # monotonically_increasing_id: partition above, row within the partition below


def newest(df: DataFrame, order: str, row_id: str, n: int) -> DataFrame:
    """The n most recent rows, newest first; equal times keep the earlier id first."""
    return df.orderBy(F.col(order).desc(), F.col(row_id).asc()).limit(n)


def last_in_arrival_order(df: DataFrame, order: str, row_id: str, n: int) -> DataFrame:
    """The last n rows by arrival, shown oldest first."""
    return df.orderBy(F.col(order).desc(), F.col(row_id).desc()).limit(n).orderBy(order, row_id)


def newest_first(df: DataFrame, order: str, row_id: str) -> DataFrame:
    return df.orderBy(F.col(order).desc(), F.col(row_id).asc())


def keep_newest(df: DataFrame, order: str, row_id: str, n: int = KEEP_DOCUMENTS) -> DataFrame:
    """Retention by time: only the n newest rows stay."""
    keys = newest(df.select(order, row_id), order, row_id, n).select(row_id)
    return df.join(keys, row_id, "left_semi")


def retention_report(df: DataFrame, order: str, row_id: str, n: int = KEEP_DOCUMENTS) -> DataFrame:
    """Rows before, kept and removed, counted before anything is rewritten."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    kept = F.least(F.col("total"), F.lit(n).cast("bigint"))
    return total.select("total", kept.alias("kept"), (F.col("total") - kept).alias("removed"))


def evict_oldest(df: DataFrame, order: str, row_id: str, limit: int = STORED_ANALYSES,
                 drop: int = EVICTED_ANALYSES) -> DataFrame:
    """When more than ``limit`` rows are stored, remove the ``drop`` oldest."""
    if df.select(row_id).limit(limit + 1).count() <= limit:
        return df
    oldest = df.select(order, row_id).orderBy(order, row_id).limit(drop).select(row_id)
    return df.join(oldest, row_id, "left_anti")


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in ``order`` without sorting the table in one task.

    Rows are range-partitioned and sorted, written once, and each row's number is its position in its
    partition plus the counts of the partitions before it (one row per partition).  ``order`` must be unique.
    """
    cols = [F.col(c) for c in order]
    placed = materialize(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_part", F.shiftright("_at", _PART_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, within + F.col("_before") + F.lit(start)).drop("_part", "_at", "_before")
    )
