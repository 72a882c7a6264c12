"""Text rendering: numbers, snippets, prompts, document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwarden.schemas import ANALYSIS, ANALYSIS_LISTS

SNIPPET = 400
PREVIEW, FULL_TEXT = 200, 1000

# Prompt wording.  ``{name}`` marks a column.
SYSTEM_ANALYST = (
    "<|system|>\nYou are an expert cybersecurity analyst. Analyze the network flow and provide a comprehensive "
    "threat assessment in valid JSON format.\n\n<|user|>\n"
)
FLOW_BLOCK = (
    "NETWORK FLOW ANALYSIS REQUEST:\n\nFlow Information:\n"
    "- Source: {src_ip}:{src_port}\n- Destination: {dst_ip}:{dst_port}\n- Protocol: {protocol}\n"
    "- Data Volume: {bytes_count} bytes, {packets_count} packets\n- Duration: {duration}s\n"
    "- TCP Flags: {tcp_flags}\n- Detected Attack Type: {attack_type}\n- Detection Confidence: {confidence}\n\n"
)
CONTEXT_TITLE = "\U0001F4DA HISTORICAL THREAT ANALYSIS CONTEXT:\n"
CONTEXT_LINE = "[Analysis {rank}] (Relevance: {score}) {snippet}"
SIMILAR_TITLE = "Similar Attack Patterns:\n"
SIMILAR_LINE = "- Pattern {rank}: similarity={similarity}\n"
JSON_CONTRACT = (
    "CRITICAL: Respond with ONLY a valid JSON object using this EXACT structure:\n\n{\n"
    '  "threat_level": "HIGH",\n  "risk_score": 85,\n  "attack_vector": "Brief description of attack method",\n'
    '  "potential_impact": "What damage this could cause",\n'
    '  "immediate_actions": ["Action 1", "Action 2", "Action 3"],\n'
    '  "investigation_steps": ["Step 1", "Step 2", "Step 3"],\n'
    '  "prevention_measures": ["Measure 1", "Measure 2", "Measure 3"],\n'
    '  "technical_analysis": "Detailed technical explanation of the attack pattern and network behavior",\n'
    '  "rag_assisted": %s\n}\n\n'
    "DO NOT include any text before or after the JSON. Respond with ONLY the JSON object.\n\n<|assistant|>\n"
)
QUESTION_HEAD = (
    "<|system|>\nYou are an expert cybersecurity analyst. Answer the user's question about a previous threat "
    "analysis with detailed, technical information.\n\n<|user|>\nORIGINAL THREAT ANALYSIS:\n"
)
QUESTION_TAIL = (
    "\n\nPlease provide a detailed, technical answer to the user's question based on the original analysis. "
    "Focus on cybersecurity expertise and practical insights. Respond in plain text format (not JSON).\n\n"
    "<|assistant|>\n"
)
SEARCH_TEXT = (
    "{attack_type} attack analysis Protocol={protocol} TotalBytes={bytes_count} TotalPackets={packets_count} "
    "Duration={duration} threat assessment"
)
DOCUMENT_TEXT = (
    "Attack Type: {attack_type}\nThreat Level: {threat_level}\nRisk Score: {risk_score}/100\n\n"
    "Attack Vector: {attack_vector}\nPotential Impact: {potential_impact}\n\n"
    "Technical Analysis: {technical_analysis}\n\nImmediate Actions: {immediate_actions}\n"
    "Investigation Steps: {investigation_steps}\nPrevention Measures: {prevention_measures}"
)


def number_text(x: Column) -> Column:
    """Shortest decimal text of a double, in plain notation from 1e-4 up to 1e16."""
    magnitude = F.abs(x)
    plain = x.cast("string")
    trimmed = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), "0+$", "")
    trimmed = F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
    parts = F.split(plain, "E")
    power = parts[1].cast("int")
    scientific = F.concat(
        F.regexp_replace(parts[0], r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    return (
        F.when((magnitude == 0) | ((magnitude >= 1e-3) & (magnitude < 1e7)), plain)
        .when((magnitude >= 1e-4) & (magnitude < 1e16), trimmed)
        .when(F.isnan(x), "nan").when(magnitude == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .otherwise(scientific)
    )


def fixed2(x: Column) -> Column:
    """Two decimals, half to even (the JVM formatter alone rounds half up)."""
    return F.format_string("%.2f", F.rint(x * 100) / 100)


def fill(template: str, values: dict[str, Column]) -> Column:
    """Concatenate ``template`` with its ``{name}`` parts replaced; a null value renders empty."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        name, closing, after = tail.partition("}")
        if not brace or not closing:
            parts.append(F.lit(rest))
            break
        if head:
            parts.append(F.lit(head))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = after
    return F.concat(*parts)


def shorten(text: Column, size: int) -> Column:
    """First ``size`` characters with ``...`` when something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def flow_values(source=F.col) -> dict[str, Column]:
    names = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol", "bytes_count", "packets_count", "tcp_flags",
             "attack_type"]
    return {**{n: source(n) for n in names}, "duration": number_text(source("duration").cast("double")),
            "confidence": fixed2(F.coalesce(source("confidence"), F.lit(0.0)))}


def search_text() -> Column:
    return fill(SEARCH_TEXT, flow_values())


def context_block(context: Column) -> Column:
    """``context array<struct<rank, score, text>>`` ordered by rank; empty text when there is none."""
    lines = F.transform(context, lambda d: fill(CONTEXT_LINE, {
        "rank": d["rank"], "score": fixed2(d["score"]),
        "snippet": F.replace(F.substring(F.coalesce(d["text"], F.lit("")), 1, SNIPPET), F.lit("\n"), F.lit(" "))}))
    block = F.concat(F.lit(CONTEXT_TITLE), F.array_join(lines, "\n"), F.lit("\n\n"))
    return F.when(F.size(context) > 0, block).otherwise("")


def similar_block(similar: Column, shown: int = 2) -> Column:
    lines = F.transform(F.slice(similar, 1, shown), lambda s: fill(SIMILAR_LINE, {
        "rank": s["rank"], "similarity": fixed2(s["similarity"])}))
    block = F.concat(F.lit(SIMILAR_TITLE), F.array_join(lines, ""), F.lit("\n"))
    return F.when(F.size(similar) > 0, block).otherwise("")


def analysis_prompt(context: Column | None = None, similar: Column | None = None) -> Column:
    parts = [F.lit(SYSTEM_ANALYST), fill(FLOW_BLOCK, flow_values())]
    used = F.lit(False)
    if context is not None:
        parts.append(context_block(context))
        used = F.coalesce(F.size(context) > 0, F.lit(False))
    if similar is not None:
        parts.append(similar_block(similar))
    contract = F.when(used, JSON_CONTRACT % "true").otherwise(JSON_CONTRACT % "false")
    return F.concat(*parts, contract)


def json_string(text: Column) -> Column:
    """JSON string literal of ``text``."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def analysis_json(analysis: Column) -> Column:
    """Two-space indented JSON of an analysis struct; null fields are left out."""
    lines = []
    for f in ANALYSIS.fields:
        value = analysis[f.name]
        if f.name in ANALYSIS_LISTS:
            items = F.array_join(F.transform(value, lambda x: F.concat(F.lit("    "), json_string(x))), ",\n")
            shown = F.when(F.size(value) == 0, "[]").when(value.isNotNull(), F.concat(F.lit("[\n"), items, F.lit("\n  ]")))
        elif f.dataType.simpleString() == "string":
            shown = F.when(value.isNotNull(), json_string(value))
        else:
            shown = value.cast("string")
        lines.append(F.concat(F.lit(f'  "{f.name}": '), shown))
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def question_prompt(analysis: Column, question: Column) -> Column:
    return F.concat(F.lit(QUESTION_HEAD), analysis_json(analysis), F.lit("\n\nUSER QUESTION: "), question,
                    F.lit(QUESTION_TAIL))


def document_text(attack_type: Column, analysis: Column) -> Column:
    values = {n: F.coalesce(analysis[n], F.lit("")) for n in ("attack_vector", "potential_impact", "technical_analysis")}
    lists = {n: F.coalesce(F.array_join(analysis[n], ", "), F.lit("")) for n in ANALYSIS_LISTS}
    return fill(DOCUMENT_TEXT, {
        "attack_type": attack_type, "threat_level": F.coalesce(analysis["threat_level"], F.lit("Unknown")),
        "risk_score": F.coalesce(analysis["risk_score"], F.lit(0)), **values, **lists})


def document_metadata(attack_type: Column, analysis: Column, at: Column, source=F.col) -> Column:
    return F.struct(
        attack_type.alias("attack_type"),
        F.coalesce(analysis["threat_level"], F.lit("Unknown")).alias("threat_level"),
        F.coalesce(analysis["risk_score"], F.lit(0)).alias("risk_score"),
        at.cast("double").alias("timestamp"), source("protocol").alias("protocol"),
        source("packets_count").cast("bigint").alias("total_packets"),
        source("bytes_count").cast("bigint").alias("total_bytes"),
        source("duration").cast("double").alias("duration"), source("tcp_flags").alias("tcp_flags"),
        F.lit("gpu_llm_analysis").alias("analysis_source"))
