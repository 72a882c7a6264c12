"""Threat analysis: retrieve context, render, call the model, parse, ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.functions.hashing import stable_id
from flowwarden.functions.models import (EmbedderFactory, GeneratorFactory, call, embed, hashing_embedder, spread,
                                         template_generator)
from flowwarden.functions.responses import parse_responses
from flowwarden.functions.text import (FULL_TEXT, PREVIEW, SNIPPET, analysis_prompt, document_metadata, document_text, fill,
                                       search_text, shorten)
from flowwarden.functions.times import to_epoch
from flowwarden.operators import history
from flowwarden.session import materialize
from flowwarden.sources import response_log

CONTEXT_K = 3
MODEL_NAME = "built-in"
METHOD = "batched_generation"

# Field names a flow may arrive under, with the value used when none is present.
ALIASES = {
    "src_ip": (["src_ip", "SrcIP"], ""), "dst_ip": (["dst_ip", "DstIP"], ""),
    "src_port": (["src_port", "SrcPort"], 0), "dst_port": (["dst_port", "DstPort"], 0),
    "protocol": (["protocol", "Proto"], ""), "bytes_count": (["bytes", "TotBytes"], 0),
    "packets_count": (["packets", "TotPkts"], 0), "duration": (["Dur", "duration"], 0.0),
    "tcp_flags": (["State", "tcp_flags"], ""), "confidence": (["confidence"], 0.0),
}


# What a payload shows where an analysis lacks a field; ``{kind}`` is the attack type, ``{src_ip}`` the source.
PAYLOAD_LEVEL, PAYLOAD_RISK, PAYLOAD_CONFIDENCE = "HIGH", 75, 0.8
PAYLOAD_VECTOR = "{kind} attack detected"
PAYLOAD_IMPACT = "Potential {kind} attack detected"
PAYLOAD_ANALYSIS = "Detailed analysis of {kind} attack pattern"
PAYLOAD_ACTIONS = ["Block source IP {src_ip}", "Monitor for similar patterns", "Alert security team"]


def standard_fields(df: DataFrame, keep: list[str] = ("flow_id", "attack_type", "ts")) -> DataFrame:
    """Flow fields under one naming, whatever alias they arrive under."""
    present = set(df.columns)
    out = [F.col(c) for c in keep if c in present]
    for name, (aliases, default) in ALIASES.items():
        out.append(F.coalesce(*[F.col(f"`{a}`") for a in aliases if a in present], F.lit(default)).alias(name))
    return df.select(*out)


def context_of(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, context)`` from ranked hits.  Only the part of a text a prompt shows is carried along."""
    shown = docs.select("doc_index", F.substring("text", 1, SNIPPET).alias("text"))
    return found.join(shown, "doc_index").groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score", "text", "doc_index"))).alias("context"))  # k entries


def retrieve_context(threats: DataFrame, docs: DataFrame, flow_id: str = "flow_id", k: int = CONTEXT_K,
                     embedder: EmbedderFactory = hashing_embedder, strategy: str = "blocks") -> DataFrame:
    """Threats with ``context array<struct<rank, score, text, doc_index>>`` of the k closest past analyses.

    Flows that render the same search text share one embedding call, texts with the same embedding one search and one context.
    """
    asked = threats.withColumn("search_text", search_text()).withColumn("search_key", F.md5("search_text"))
    texts = spread(asked.select("search_key", "search_text").distinct(), "search_key")
    vector_key = F.concat_ws(":", F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding"))
    embedded = materialize(texts.select("search_key", embed(F.col("search_text"), embedder).alias("embedding"))
                           .withColumn("query_id", vector_key), "queries")
    queries = embedded.select("query_id", "embedding").dropDuplicates(["query_id"])
    context = context_of(history.search(docs, queries, k, strategy=strategy, attach=False), docs)
    joined = asked.join(embedded.drop("embedding"), "search_key", "left").join(context, "query_id", "left").drop(
        "search_key", "query_id")
    empty = F.array().cast("array<struct<rank:int,score:double,text:string,doc_index:bigint>>")
    return joined.withColumn("context", F.coalesce("context", empty))


def analyze_threats(threats: DataFrame, docs: DataFrame | None = None, flow_id: str = "flow_id",
                    embedder: EmbedderFactory = hashing_embedder, generator: GeneratorFactory = template_generator,
                    strategy: str = "blocks", model_name: str = MODEL_NAME, attempts: int = 3,
                    log_path: str | None = None) -> DataFrame:
    """Prompt, model answer and validated analysis of each threat.

    ``threats`` carries the flow fields, ``attack_type``, ``confidence`` and optionally ``similar_flows``.
    The answers are written once before parsing: a model call is never repeated for a second reader.  Each result says how
    it came about: ``model_name``, ``inference_method``, ``inference_time`` (seconds), ``attempts``, ``model_error`` and
    ``analysis_timestamp``.  With ``log_path`` every request is appended to the response log.
    """
    work = threats if docs is None else retrieve_context(threats, docs, flow_id, embedder=embedder, strategy=strategy)
    context = F.col("context") if docs is not None else None
    similar = F.col("similar_flows") if "similar_flows" in threats.columns else None
    answered = spread(work, flow_id).withColumn("prompt", analysis_prompt(context, similar))
    called = answered.withColumn("_call", call(F.col("prompt"), generator, attempts=attempts)).withColumns({
        "response": F.col("_call.answer"), "inference_time": F.col("_call.seconds"), "attempts": F.col("_call.attempts"),
        "model_error": F.col("_call.error"), "model_name": F.lit(model_name), "inference_method": F.lit(METHOD),
        "analysis_timestamp": F.current_timestamp()}).drop("_call")
    answered = materialize(called, "answers")
    parsed = parse_responses(answered, error_source="error_fallback")
    if log_path is not None:
        response_log.append(response_log.log_records(
            parsed.withColumn("parsed_result", response_log.logged_analysis()), "analysis", "analysis_timestamp"), log_path)
    return with_response_fields(parsed, F.size(context) > 0 if context is not None else F.lit(False))


def with_response_fields(df: DataFrame, context_used: Column) -> DataFrame:
    text = F.coalesce("response", F.lit(""))
    return df.withColumns({
        "full_response_preview": shorten(text, PREVIEW), "full_text": F.substring(text, 1, FULL_TEXT),
        "full_response_length": F.length(text), "rag_context_used": context_used})


def analysis_payload(results: DataFrame) -> DataFrame:
    """Nested record for consumers, with the defaults of an incomplete analysis."""
    a = F.col("analysis")
    kind = F.col("attack_type")
    shown = {"kind": kind, "src_ip": F.col("src_ip")}
    default_actions = F.array(*[fill(text, shown) for text in PAYLOAD_ACTIONS])
    rag = F.coalesce(a["rag_assisted"], F.lit(False))
    seconds = F.coalesce("inference_time", F.lit(0.0)) if "inference_time" in results.columns else F.lit(0.0)
    details = F.struct(
        F.coalesce("confidence", F.lit(PAYLOAD_CONFIDENCE)).alias("confidence"), F.col("protocol").alias("protocol"),
        seconds.alias("analysis_time"), rag.alias("rag_assisted"), F.coalesce("rag_context_used", F.lit(False)).alias("rag_context_used"))
    return results.select(
        F.struct(F.col("flow_id").alias("id"), "src_ip", "dst_ip", "protocol", "attack_type", "timestamp").alias("flow"),
        F.struct(
            F.col("flow_id"), F.coalesce(a["threat_level"], F.lit(PAYLOAD_LEVEL)).alias("threat_level"),
            F.coalesce(a["risk_score"], F.lit(PAYLOAD_RISK)).alias("risk_score"), kind.alias("attack_type"),
            F.coalesce(a["attack_vector"], fill(PAYLOAD_VECTOR, shown)).alias("attack_vector"),
            F.coalesce(a["potential_impact"], fill(PAYLOAD_IMPACT, shown)).alias("description"),
            F.coalesce(a["immediate_actions"], default_actions).alias("recommendations"),
            details.alias("technical_details"),
            F.coalesce(a["technical_analysis"], fill(PAYLOAD_ANALYSIS, shown)).alias("technical_analysis"),
            F.col("analysis_number"), rag.alias("rag_assisted")).alias("analysis"))


def history_documents(results: DataFrame, at: str = "ts", embedder: EmbedderFactory = hashing_embedder) -> DataFrame:
    """Analyses as history documents without their number: text, metadata, embedding, time."""
    text = document_text(F.col("attack_type"), F.col("analysis"))
    meta = document_metadata(F.col("attack_type"), F.col("analysis"), to_epoch(F.col(at)))
    docs = results.select(F.col("flow_id"), text.alias("text"), meta.alias("metadata"), F.col(at).alias("ts"))
    return spread(docs, "flow_id").withColumn("embedding", embed(F.col("text"), embedder))


def ingest_analyses(results: DataFrame, stored: DataFrame | None = None, at: str = "ts",
                    embedder: EmbedderFactory = hashing_embedder) -> DataFrame:
    """New history documents, numbered after the stored ones in time order."""
    fresh = history_documents(results, at, embedder)
    return history.append_numbered(stored, fresh, ["ts", "flow_id"]).select(
        "doc_index", "text", "metadata", "embedding", "ts")


def analysis_id(attack_type: Column, *parts: Column) -> Column:
    """Id of an analysis: type plus content hash, so that analyses of one second do not collide."""
    return F.concat_ws("_", F.coalesce(attack_type, F.lit("unknown")), F.substring(stable_id("a", *parts), 3, 24))
