"""Question admission, joining to analyses, ordering and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.functions.hashing import stable_id
from flowwarden.functions.models import GeneratorFactory, call
from flowwarden.functions.text import question_prompt
from flowwarden.session import materialize
from flowwarden.sources import response_log

# Reasons and the answer given without a model.
NO_QUESTION, NO_FLOW_ID = "Question is required", "Flow ID is required"
NO_ANALYSIS = "No analysis found for flow_id: "
NO_MODEL_ANSWER = (
    "LLM not available for question answering. The analysis shows this is a network security threat that "
    "requires immediate attention."
)
ANSWERED, FALLBACK_ANSWER, FAILED = "llm_question_answer", "fallback_answer", "error_fallback"
FALLBACK_SECONDS = 0.1
PRIORITY_QUESTION, PRIORITY_ANALYSIS = 0, 1


def trimmed(questions: DataFrame) -> DataFrame:
    # same blanks as a text strip: space, tab, line ends, vertical tab, form feed
    blanks = F.lit(" \t\n\r\x0b\x0c")
    return questions.withColumns({
        c: F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")), blanks) for c in ("question", "flow_id")})


def admitted(questions: DataFrame, analyses: DataFrame) -> DataFrame:
    """Questions with text and a known flow id, each with its ``analysis``.

    Of several analyses of one flow the newest counts, if ``analyses`` has a ``timestamp``.
    """
    good = trimmed(questions).where((F.col("question") != "") & (F.col("flow_id") != ""))
    flow = F.col("flow_id").cast("string").alias("flow_id")
    if "timestamp" in analyses.columns:
        known = analyses.groupBy(flow).agg(F.max_by("analysis", "timestamp").alias("analysis"))
    else:
        known = analyses.select(flow, "analysis")
    return good.join(known, "flow_id")


def rejected(questions: DataFrame, analyses: DataFrame) -> DataFrame:
    """Questions that cannot be asked, with the ``reason``."""
    q = trimmed(questions)
    empty = (F.col("question") == "") | (F.col("flow_id") == "")
    reason = F.when(F.col("question") == "", NO_QUESTION).otherwise(NO_FLOW_ID)
    known = analyses.select(F.col("flow_id").cast("string").alias("flow_id"))
    unknown = q.where(~empty).join(known, "flow_id", "left_anti").withColumn(
        "reason", F.concat(F.lit(NO_ANALYSIS), F.col("flow_id")))
    return q.where(empty).withColumn("reason", reason).unionByName(unknown)


def question_id(*columns: str):
    return stable_id("q", *[F.col(c) for c in columns])


def answer(admitted_questions: DataFrame, factory: GeneratorFactory | None = None, attempts: int = 3) -> DataFrame:
    """Add ``prompt``, ``answer``, ``response_source``, ``inference_time`` and ``error``; without a model a fixed answer."""
    q = admitted_questions.withColumn("prompt", question_prompt(F.col("analysis"), F.col("question")))
    if factory is None:
        return q.withColumns({"answer": F.lit(NO_MODEL_ANSWER), "response_source": F.lit(FALLBACK_ANSWER),
                              "inference_time": F.lit(FALLBACK_SECONDS), "error": F.lit(False)})
    q = q.withColumn("_call", call(F.col("prompt"), factory, attempts=attempts))
    failed = F.col("_call.answer").isNull()
    return q.withColumns({
        "response_source": F.when(failed, FAILED).otherwise(ANSWERED), "inference_time": F.col("_call.seconds"),
        "error": failed, "model_error": F.col("_call.error"),
        "answer": F.coalesce("_call.answer", F.lit("Error processing question: model call failed"))}).drop("_call")


def answer_questions(questions: DataFrame, analyses: DataFrame, factory: GeneratorFactory | None = None,
                     log_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Payloads of the admitted questions, and the rejected ones with their reason.

    Answers of a model are written once, and with ``log_path`` every request is appended to the response log.
    """
    answers = answer(admitted(questions, analyses), factory)
    if factory is not None:
        answers = materialize(answers, "question-answers")
    if log_path is not None:
        logged = answers.withColumns({"parsed_result": response_log.logged_answer(), "response": F.col("answer"),
                                      "logged": F.current_timestamp()})
        response_log.append(response_log.log_records(logged, "question", "logged"), log_path)
    return payload(answers), rejected(questions, analyses)


def payload(answers: DataFrame) -> DataFrame:
    """The record shown to the requester, with the ``requester_id`` of the question if it carries one."""
    requester = [c for c in ("requester_id",) if c in answers.columns]
    return answers.select(
        "question_id", "flow_id", "question", "answer", "timestamp", *requester,
        F.coalesce("inference_time", F.lit(0.0)).alias("inference_time"), F.coalesce("error", F.lit(False)).alias("error"))


def available(analyses: DataFrame) -> DataFrame:
    """Analyses that can be asked about, newest first; absent fields read ``Unknown``."""
    unknown = F.lit("Unknown")
    return analyses.select(
        "flow_id", F.coalesce("analysis.attack_vector", unknown).alias("attack_type"),
        F.coalesce("analysis.threat_level", unknown).alias("threat_level"),
        F.coalesce(F.col("timestamp").cast("string"), unknown).alias("timestamp"),
        F.coalesce("analysis.rag_assisted", F.lit(False)).alias("rag_assisted"),
    ).orderBy(F.col("timestamp").desc(), "flow_id")
