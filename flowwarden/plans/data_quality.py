"""Data-quality report over a folder of flow CSVs and an optional reference index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.operators import quality
from flowwarden.plans.reference_index import ReferenceIndex
from flowwarden.sources.flow_csv import expected_classes


def data_quality_report(spark: SparkSession, path: str, ref: ReferenceIndex | None = None) -> dict[str, DataFrame]:
    """Named tables: files, categories, coverage, missing, summary and, with an index, index health."""
    files = quality.file_profile(spark, path)
    expected = expected_classes(spark)
    found = files.where(F.col("traffic_class").isNotNull() & (F.col("rows") > 0)).select("traffic_class")
    report = {
        "files": files,
        "categories": quality.category_counts(files),
        "coverage": quality.coverage(expected, found),
        "missing": quality.missing_classes(expected, found),
        "summary": files.agg(
            F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            (F.count(F.lit(1)) < quality.FEW_FILES).alias("few_files"),
            F.coalesce(F.bool_or(F.col("category") == "benign"), F.lit(False)).alias("has_benign")),
    }
    if ref is not None:
        report["index_health"] = quality.index_health(expected, ref.index.vectors)
        report["vector_health"] = quality.vector_health(ref.index.vectors, "row_id", "features").agg(
            F.count(F.when(F.col("all_zero"), 1)).alias("all_zero"), F.min("smallest").alias("smallest"),
            F.max("largest").alias("largest"))
    return report
