"""Streaming analysis and question answering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from flowwarden.functions.models import (EmbedderFactory, GeneratorFactory, hashing_embedder, template_generator)
from flowwarden.operators import history, questions
from flowwarden.plans.analyze import analyze_threats, ingest_analyses
from flowwarden.session import materialize, scoped_tables
from flowwarden.sources import history_store
from flowwarden.streaming.intake import start_batches, write_batch, written_batch


def search_view(stored: DataFrame) -> DataFrame:
    """History table in the search contract."""
    return stored.select("doc_index", "text", F.col("metadata.attack_type").alias("attack_type"), "ts", "embedding")


def analysis_stream(threats: DataFrame, history_path: str, results_path: str, checkpoint: str,
                    embedder: EmbedderFactory = hashing_embedder, generator: GeneratorFactory = template_generator,
                    available_now: bool = False, log_path: str | None = None) -> StreamingQuery:
    """Analyse each batch of threats with the history so far, then make the new analyses searchable.

    ``threats`` carries the flow fields, ``flow_id``, ``attack_type`` and ``ts``.  A batch owns its output
    folders, so a replayed batch sees and writes what it did the first time; results that a batch has written before it
    failed are read again instead of asking the model twice.  The history is searched in blocks as it is stored, a
    folder per batch, so nothing is rebuilt when a batch is added.  To hold analyses while questions are served, feed this
    stream from :func:`flowwarden.streaming.stateful.serve`.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scoped_tables(spark):
            stored = _before(spark, history_path, batch_id)
            done = written_batch(spark, results_path, batch_id)
            if done is None:
                write_batch(analyze_threats(batch, search_view(stored), embedder=embedder, generator=generator,
                                            log_path=log_path), results_path, batch_id)
                done = written_batch(spark, results_path, batch_id)
            history_store.append(ingest_analyses(done, stored, "ts", embedder), history_path, batch_id)

    return start_batches(threats, body, checkpoint, available_now)


def _before(spark, path: str, batch_id: int) -> DataFrame:
    """Documents of earlier batches only."""
    stored = history_store.load(spark, path)
    if not stored.inputFiles():
        return stored
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).try_cast("bigint")
    return stored.where(folder.isNull() | (folder < batch_id))


def question_stream(asked: DataFrame, analyses: DataFrame | Callable[[SparkSession], DataFrame], path: str,
                    checkpoint: str, generator: GeneratorFactory | None = None,
                    available_now: bool = False, log_path: str | None = None) -> StreamingQuery:
    """Answer questions about stored analyses; rejects are written with their reason.

    Runs as its own query, so questions never wait for analyses.  Give ``analyses`` as a function of the session
    where the table grows: it is called for every batch, whereas a frame lists its files only once.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        with scoped_tables(batch.sparkSession):
            asked_ = materialize(batch, "questions")
            known = analyses(batch.sparkSession) if callable(analyses) else analyses
            answers, rejects = questions.answer_questions(asked_, known, generator, log_path)
            write_batch(answers, f"{path}/answers", batch_id)
            write_batch(rejects, f"{path}/rejects", batch_id)

    return start_batches(asked, body, checkpoint, available_now)


def recent_documents(stored: DataFrame, k: int = 10) -> DataFrame:
    return history.recent(search_view(stored), k)
