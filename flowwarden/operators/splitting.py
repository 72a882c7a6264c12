"""Index/test split, deterministic sampling and split summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowwarden.functions.hashing import digest, draw

SKETCH_ROWS = 50_000  # rows a task gathers beyond its sketch before it cuts them down


def is_test_row(group: Column, row_id: Column, test_frac: float = 0.5, seed: int = 42) -> Column:
    """Row-local split decision: a fixed draw per (group, id), so no shuffle and no shared state."""
    return draw(group, row_id, seed=seed) < F.lit(float(test_frac))


def split(df: DataFrame, group: str, row_id: str, test_frac: float = 0.5, seed: int = 42) -> DataFrame:
    """Add ``split`` = ``index`` or ``test``."""
    test = is_test_row(F.col(group), F.col(row_id), test_frac, seed)
    return df.withColumn("split", F.when(test, "test").otherwise("index"))


def split_counts(df: DataFrame, group: str) -> DataFrame:
    """Index, test and total rows per class, plus the grand total (class ``null``)."""
    side = F.col("split") == "index"
    return df.rollup(F.col(group).alias("traffic_class")).agg(
        F.count(F.when(side, 1)).alias("index_rows"),
        F.count(F.when(~side, 1)).alias("test_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def split_summary(counts: DataFrame, test_frac: float = 0.5, seed: int = 42, group: str = "attack_type",
                  source: str = "", output_dir: str = "") -> DataFrame:
    """One document: split settings, totals and counts per class.  ``counts`` as from :func:`split_counts`."""
    per_class = F.map_from_entries(F.collect_list(F.when(F.col("traffic_class").isNotNull(), F.struct(
        "traffic_class", F.struct(F.col("index_rows").alias("index"), F.col("test_rows").alias("test"),
                                  F.col("total_rows").alias("total"))))))  # one entry per class
    total = {n: F.max(F.when(F.col("traffic_class").isNull(), F.col(c))) for n, c in
             (("total", "total_rows"), ("index_total", "index_rows"), ("test_total", "test_rows"))}
    config = F.struct(F.lit(source).alias("input"), F.lit(output_dir).alias("output_dir"),
                      F.lit(test_frac).alias("test_frac"), F.lit(seed).alias("seed"), F.lit(group).alias("group"))
    return counts.agg(*[c.alias(n) for n, c in total.items()], per_class.alias("per_class")).select(
        config.alias("config"), F.struct("total", "index_total", "test_total", "per_class").alias("counts"))


def read_split_summary(spark: SparkSession, path: str) -> DataFrame:
    """Counts per class from a split summary document, in the shape of :func:`split_counts`."""
    entry = "struct<index: bigint, test: bigint, total: bigint>"
    schema = f"counts struct<total: bigint, index_total: bigint, test_total: bigint, per_class: map<string, {entry}>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = doc.select(F.explode("counts.per_class").alias("traffic_class", "c")).select(
        "traffic_class", F.col("c.index").alias("index_rows"), F.col("c.test").alias("test_rows"),
        F.col("c.total").alias("total_rows"))
    grand = doc.select(F.lit(None).cast("string").alias("traffic_class"), F.col("counts.index_total"),
                       F.col("counts.test_total"), F.col("counts.total"))
    return rows.union(grand)


def _smallest(keep: int):
    """Rows of the ``keep`` smallest ``(_h, _r)`` of each ``_g``, over everything a task reads."""

    def compact(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).sort_by([("_g", "ascending"), ("_h", "ascending"), ("_r", "ascending")])
        table = table.combine_chunks()
        codes = table.column("_g").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        position = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
        return table.take(pa.array(np.flatnonzero(position < keep))).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, kept = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                rows += batch.num_rows
            if rows > 2 * kept + SKETCH_ROWS:
                parts = [compact(parts)]
                rows = kept = parts[0].num_rows
        if parts:
            yield compact(parts)

    return run


def sample_per_group(df: DataFrame, group: str, row_id: str, size: int = 3000, seed: int = 42) -> DataFrame:
    """At most ``size`` rows per group without replacement, always the same ones: those of the smallest digests.

    Every map task keeps the ``size`` smallest of each group, the map tasks are merged in lanes, and only what is left is
    ranked; so neither the number of groups nor their sizes are needed beforehand, and no task receives a large group.  Rows of equal id take places of their own.
    Rows without a group are a group of their own; rows without an id come last in theirs.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # never null, and no group has that of null
    order = F.when(F.col(row_id).isNotNull(), digest(F.lit(str(seed)), F.col(row_id)))
    drawn = df.withColumns({"_h": order, "_g": key, "_r": F.col(row_id)})
    local = drawn.mapInArrow(_smallest(size), drawn.schema)
    # a map task's rows go to one lane; the tasks of a lane are merged before all lanes are
    lanes = 1 + math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = local.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(lanes))).repartition("_g", "_lane").drop("_lane")
    w = Window.partitionBy("_g").orderBy(F.asc_nulls_last("_h"), "_r")
    return (merged.mapInArrow(_smallest(size), drawn.schema).withColumn("_rank", F.row_number().over(w))
            .where(F.col("_rank") <= size).drop("_rank", "_h", "_g", "_r"))
