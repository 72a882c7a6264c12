"""Response log: one record per model request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.functions.responses import quality
from flowwarden.functions.text import shorten
from flowwarden.functions.times import from_stamp, to_stamp
from flowwarden.operators.recency import KEEP_LOGS, keep_newest
from flowwarden.schemas import ANALYSIS, RESPONSE_LOG

REPORTED = 10


def log_records(answers: DataFrame, request_type: str, at: str = "ts") -> DataFrame:
    """Log rows from ``flow_id, prompt, response, parsed_result`` and a time column."""
    return answers.select(
        to_stamp(F.col(at)).alias("timestamp"), F.lit(request_type).alias("request_type"), "flow_id",
        F.length("prompt").cast("bigint").alias("prompt_length"),
        F.length("response").cast("bigint").alias("response_length"),
        F.col("response").alias("full_response"), "parsed_result")


def logged_analysis(analysis: str = "analysis") -> Column:
    """An analysis as the log keeps it, with the time, model and method of its call."""
    seconds = F.round("inference_time", 6).cast("string").alias("inference_time")
    fields = [F.col(f"{analysis}.{f.name}").cast("string" if f.name == "risk_score" else f.dataType).alias(f.name)
              for f in ANALYSIS.fields]
    return F.struct(*fields, seconds, "model_name", to_stamp(F.col("analysis_timestamp")).alias("analysis_timestamp"),
                    "inference_method", F.length("response").cast("string").alias("full_response_length"))


def logged_answer() -> Column:
    """An answer to a question as the log keeps it."""
    return F.struct("question", "answer", F.col("flow_id").alias("original_analysis_id"), "response_source", "timestamp",
                    F.round("inference_time", 6).cast("string").alias("inference_time"))


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").partitionBy("request_type").json(path)


def read(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Both log layouts, with ``logged_at``, ``file_name`` and the request type (older files: analysis)."""
    df = (
        spark.read.schema(RESPONSE_LOG).option("multiLine", multi_line).option("recursiveFileLookup", multi_line)
        .option("pathGlobFilter", "*.json").json(path)
    )
    return df.select("*", F.col("_metadata.file_name").alias("file_name")).withColumns({
        "request_type": F.coalesce("request_type", F.lit("analysis")),
        "logged_at": from_stamp(F.col("timestamp"))})


def report(log: DataFrame, n: int = REPORTED, order: str = "timestamp", row_id: str = "file_name") -> DataFrame:
    """The n newest records with their quality flags and a one-line preview."""
    newest = log.orderBy(F.col(order).desc(), F.col(row_id).desc()).limit(n)
    flags = quality(F.col("full_response"), F.col("parsed_result.technical_analysis"))
    return newest.select(
        order, row_id, F.coalesce("response_length", F.lit(0)).alias("response_length"),
        F.coalesce("parsed_result.threat_level", F.lit("Unknown")).alias("threat_level"),
        F.length(F.coalesce("parsed_result.technical_analysis", F.lit(""))).alias("technical_length"),
        *[c.alias(name) for name, c in flags.items()],
        F.replace(shorten(F.coalesce("full_response", F.lit("")), 200), F.lit("\n"), F.lit(" ")).alias("preview"))


def retain(log: DataFrame, order: str = "timestamp", row_id: str = "file_name", keep: int = KEEP_LOGS) -> DataFrame:
    """Newest ``keep`` records by time."""
    return keep_newest(log, order, row_id, keep)


def model_stats(log: DataFrame) -> DataFrame:
    """Requests by kind, total and average inference time of analyses."""
    analysis = F.col("request_type") == "analysis"
    question = F.col("request_type") == "question"
    seconds = F.col("parsed_result.inference_time").cast("double")
    totals = log.agg(
        F.count(F.when(analysis, 1)).alias("total_analyses"), F.count(F.when(question, 1)).alias("total_questions"),
        F.coalesce(F.sum(F.when(analysis, seconds)), F.lit(0.0)).alias("total_inference_time"))
    return totals.withColumns({
        "total_requests": F.col("total_analyses") + F.col("total_questions"),
        "average_inference_time": F.col("total_inference_time") / F.greatest("total_analyses", F.lit(1))})
