"""Profiles, coverage and health checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.functions.vectors import all_zero
from flowwarden.schemas import REQUIRED_COLUMNS
from flowwarden.sources import csv_records
from flowwarden.sources.flow_csv import list_csv_files, plain_path

SMALL = 100
FEW_FILES = 5


def status(rows: Column) -> Column:
    return F.when(rows == 0, "empty").when(rows < SMALL, "small").otherwise("ok")


def _plain_path(path: Column) -> Column:
    """A path with one slash after its scheme, as readers and the file listing differ in that."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def file_profile(spark: SparkSession, path: str, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """One row per CSV file: rows, columns, size, category, status, missing required columns.

    Rows are records as a CSV parser counts them: line breaks in quotes do not end one, blank lines are none.  One text
    scan that leaves one row per split; files without any line are kept through the (content-free) file listing.
    """
    per_file = csv_records.count_records(csv_records.read_splits(csv_records.scan_lines(spark, path)))
    names = F.transform(F.split("header", ","), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    counted = per_file.select(
        _plain_path(plain_path(F.col("file_path"))).alias("at"),
        F.greatest(F.col("records") - 1, F.lit(0)).alias("rows"), F.size(names).alias("columns"),
        F.slice(names, 1, 10).alias("sample_columns"),
        F.array_except(F.array(*[F.lit(c) for c in required]), names).alias("missing_columns"))
    listed = list_csv_files(spark, path).select(
        _plain_path(F.col("path")).alias("at"), "file_name", "size_mb", "category", "traffic_class")
    joined = listed.join(counted, "at", "left").drop("at").withColumns({
        "rows": F.coalesce("rows", F.lit(0)), "columns": F.coalesce("columns", F.lit(0))})
    return joined.withColumn("status", status(F.col("rows")))


def table_profile(tables: dict[str, DataFrame], required: list[str] = ()) -> DataFrame:
    """Rows, columns, status and missing required columns of named tables."""
    parts = []
    for name, df in tables.items():
        missing = [c for c in required if c not in df.columns]
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns"),
            status(F.col("rows")).alias("status"), F.lit(",".join(missing)).alias("missing_columns")))
    return reduce(DataFrame.unionAll, parts)


def category_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))


def coverage(expected: DataFrame, found: DataFrame, column: str = "traffic_class") -> DataFrame:
    """Each expected class with a flag whether the data holds it (compared without case)."""
    key = F.lower(F.col(column)).alias("_key")
    seen = found.select(key).distinct().withColumn("found", F.lit(True))
    return expected.select(column, key).join(seen, "_key", "left").select(
        column, F.coalesce("found", F.lit(False)).alias("found"))


def missing_classes(expected: DataFrame, found: DataFrame, column: str = "traffic_class") -> DataFrame:
    """Expected classes the data does not hold."""
    key = F.lower(F.col(column))
    return expected.withColumn("_key", key).join(
        found.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def vector_health(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return df.select(row_id, all_zero(v).alias("all_zero"), F.array_min(v).alias("smallest"),
                     F.array_max(v).alias("largest"))


def index_health(expected: DataFrame, vectors: DataFrame, group: str = "grp", column: str = "traffic_class") -> DataFrame:
    """Vectors per expected class and whether its index is ``ok`` or ``missing``."""
    counts = vectors.groupBy(F.col(group).alias(column)).agg(F.count(F.lit(1)).alias("vectors"))
    n = F.coalesce(F.col("vectors"), F.lit(0))
    return expected.select(column).join(counts, column, "left").select(
        column, n.alias("vectors"), F.when(n == 0, "missing").otherwise("ok").alias("status"))


def system_stats(flows: DataFrame, order: str = "ts", analyses: DataFrame | None = None) -> DataFrame:
    """Flows, seconds between first and last, flows per second (null when no time passed), stored analyses."""
    seconds = F.unix_micros(F.max(F.col(order).cast("timestamp"))) / 1e6 - F.unix_micros(
        F.min(F.col(order).cast("timestamp"))) / 1e6
    out = flows.agg(F.count(F.lit(1)).alias("flows"), seconds.alias("uptime_seconds"))
    out = out.withColumn("flows_per_second", F.when(
        (F.col("uptime_seconds") > 0) & (F.col("flows") > 0), F.col("flows") / F.col("uptime_seconds")))
    if analyses is None:
        return out
    return out.withColumn("stored_analyses", analyses.agg(F.count(F.lit(1))).scalar())
