"""History table: append, load, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.schemas import HISTORY_DOCUMENT


def load(spark: SparkSession, path: str) -> DataFrame:
    """Stored documents; an absent table is an empty history."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if not exists:
        return spark.createDataFrame([], HISTORY_DOCUMENT)
    return spark.read.schema(HISTORY_DOCUMENT).option("recursiveFileLookup", True).parquet(path)


def append(docs: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Add documents.  With ``batch_id`` the batch owns a sub-folder, so a replayed batch replaces itself."""
    docs = docs.select(*HISTORY_DOCUMENT.names)
    if batch_id is None:
        docs.write.mode("append").parquet(path)
    else:
        docs.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def replace(docs: DataFrame, path: str) -> None:
    """Write a new table next to the old one; readers switch to ``path`` (Spark cannot overwrite its input)."""
    docs.select(*HISTORY_DOCUMENT.names).write.mode("overwrite").parquet(path)


def export_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_index").alias("index"), "text", "metadata")


def export_header(docs: DataFrame, model_name: str) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("total_documents")).select(
        "total_documents", F.lit(model_name).alias("model_name"), F.current_timestamp().alias("exported_at"))


def export(docs: DataFrame, path: str, model_name: str) -> None:
    """Header and rows as JSON in two sub-folders; rows stay distributed."""
    export_header(docs, model_name).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    export_rows(docs).write.mode("overwrite").json(f"{path}/documents")
