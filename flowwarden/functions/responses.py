"""Model answers: find, parse, validate or replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.functions.hashing import digest, digest_int
from flowwarden.functions.scoring import clip
from flowwarden.functions.text import fill
from flowwarden.schemas import ANALYSIS_LISTS, ANALYSIS_TEXTS

# Accepted levels, defaults of a partial answer and the replacement analyses.
THREAT_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
DEFAULTS = {
    "threat_level": "HIGH",
    "risk_score": 80,
    "attack_vector": "Malicious network activity detected",
    "potential_impact": "Potential network security compromise",
    "immediate_actions": ["Block source IP", "Monitor traffic patterns"],
    "investigation_steps": ["Analyze logs", "Check for lateral movement"],
    "prevention_measures": ["Update firewall rules", "Enhanced monitoring"],
    "technical_analysis": "Network intrusion attempt detected",
}
FALLBACK_RISK, FALLBACK_CHARS = 75, 500
FALLBACK = {
    "attack_vector": "{attack_type} attack detected",
    "potential_impact": "Network security threat from {src_ip}",
    "immediate_actions": ["Block source IP {src_ip}", "Monitor for similar attack patterns",
                          "Alert security team immediately"],
    "investigation_steps": ["Review full packet capture", "Check for indicators of compromise",
                            "Analyze network logs for persistence"],
    "prevention_measures": ["Update intrusion detection signatures", "Implement network segmentation",
                            "Enhanced monitoring and alerting"],
    "technical_analysis": "Analysis generated from fallback method",
}
ERROR_RISK = 72
ERROR = {
    "attack_vector": "Detected {attack_type} attack pattern",
    "potential_impact": "Potential compromise of {dst_ip}",
    "immediate_actions": ["Immediately block {src_ip}", "Monitor traffic to {dst_ip}", "Escalate to security team"],
    "investigation_steps": ["Full network traffic analysis", "Endpoint security scan", "Check for attack persistence"],
    "prevention_measures": ["Update security policies", "Implement rate limiting", "Deploy additional monitoring"],
    "technical_analysis": "System-generated analysis for {attack_type} attack",
}
SIMULATED_RISK = (70, 95)
SIMULATED = {
    "attack_vector": "{attack_type} attack detected",
    "potential_impact": "Potential {attack_type} network security threat",
    "immediate_actions": ["Block source IP {src_ip}", "Monitor for similar patterns", "Alert security team"],
    "technical_analysis": "Simulated analysis for {attack_type} attack pattern",
}
FALLBACK_MARK, SHORT_ANALYSIS = "System-generated analysis", 50

FIELDS = ["threat_level", "risk_score", "attack_vector", "potential_impact", *ANALYSIS_LISTS, "technical_analysis",
          "rag_assisted", "response_source"]


def json_block(response: Column) -> Column:
    """From the first ``{`` to the last ``}``, null when there is no such span."""
    block = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    return F.when(block != "", block)


def parse_object(block: Column) -> Column:
    """Variant of exactly one JSON object, null for broken text or trailing content."""
    # wrapped in a list, text after the object either breaks the list or becomes a second item
    items = F.try_parse_json(F.concat(F.lit("["), block, F.lit("]")))
    single = F.try_variant_get(items, "$[1]", "variant").isNull()
    return F.when(single, F.try_variant_get(items, "$[0]", "variant"))


CHECKED = ["threat_level", "risk_score", *ANALYSIS_TEXTS, *ANALYSIS_LISTS, "rag_assisted"]


class _Parsed:
    """Fields of a parsed object held as flat columns: type name, text, list of each checked key.

    Each extraction is computed once per row and read by several rules; as nested expressions the same
    work would be repeated in every rule and outgrow one generated method.
    """

    def __init__(self, prefix: str = "_a"):
        self.prefix = prefix

    def columns(self, v: Column) -> dict[str, Column]:
        out = {}
        for n in CHECKED:
            out[f"{self.prefix}_kind_{n}"] = F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant"))
            out[f"{self.prefix}_text_{n}"] = F.try_variant_get(v, f"$.{n}", "string")
        for n in ANALYSIS_LISTS:
            out[f"{self.prefix}_list_{n}"] = F.try_variant_get(v, f"$.{n}", "array<string>")
        return out

    def kind(self, name: str) -> Column:
        return F.col(f"{self.prefix}_kind_{name}")

    def text(self, name: str) -> Column:
        return F.col(f"{self.prefix}_text_{name}")

    def items(self, name: str) -> Column:
        return F.col(f"{self.prefix}_list_{name}")

    def blank(self, name: str) -> Column:
        """Missing, null, empty text or empty list."""
        kind, text = self.kind(name), self.text(name)
        return kind.isNull() | (kind == "VOID") | (kind == "STRING") & (text == "") | \
            kind.startswith("ARRAY") & (text == "[]")


def _risk(p: _Parsed) -> Column:
    kind, text = p.kind("risk_score"), F.trim(p.text("risk_score"))
    number = text.try_cast("double")
    value = (
        F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?\d+$"), number))
        .when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        .when(~kind.startswith("ARRAY") & ~kind.startswith("OBJECT"), number)
    )
    cut = F.when(value < 0, F.ceil(value).cast("double")).otherwise(F.floor(value).cast("double"))
    return F.coalesce(clip(F.when(F.abs(value) < 1e15, cut).otherwise(value), 0.0, 100.0).cast("int"),
                      F.lit(DEFAULTS["risk_score"]))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def _truth(p: _Parsed, name: str) -> Column:
    kind, text = p.kind(name), p.text(name)
    return (
        F.when(p.blank(name), False).when(kind == "BOOLEAN", text == "true")
        .when(kind.startswith("OBJECT"), text != "{}").when(kind.startswith("ARRAY") | (kind == "STRING"), True)
        .otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True)))
    )


def _validated(p: _Parsed) -> dict[str, Column]:
    """Analysis fields of a parsed object with defaults, ranges and enumerations enforced."""
    out: dict[str, Column] = {}
    level = F.when(p.kind("threat_level") == "STRING", p.text("threat_level"))
    out["threat_level"] = F.when(level.isin(THREAT_LEVELS), level).otherwise("HIGH")
    out["risk_score"] = F.when(p.blank("risk_score"), F.lit(DEFAULTS["risk_score"])).otherwise(_risk(p))
    for name in ANALYSIS_TEXTS:
        out[name] = F.when(p.blank(name), DEFAULTS[name]).otherwise(p.text(name))
    for name in ANALYSIS_LISTS:
        out[name] = F.when(p.blank(name), _strings(DEFAULTS[name])).otherwise(
            F.coalesce(p.items(name), F.array(p.text(name))))
    out["rag_assisted"] = _truth(p, "rag_assisted")
    return out


def _flow(source=F.col) -> dict[str, Column]:
    return {n: source(n) for n in ("attack_type", "src_ip", "dst_ip")}


def _template(texts: dict, risk: Column, source: str, flow: dict[str, Column]) -> dict[str, Column]:
    out = {"threat_level": F.lit("HIGH"), "risk_score": risk.cast("int")}
    for name in [*ANALYSIS_TEXTS, *ANALYSIS_LISTS]:
        value = texts.get(name)
        if value is None:
            out[name] = F.lit(None).cast("array<string>")
        elif isinstance(value, list):
            out[name] = F.array(*[fill(x, flow) for x in value])
        else:
            out[name] = fill(value, flow)
    out["rag_assisted"], out["response_source"] = F.lit(False), F.lit(source)
    return out


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[fields[n].alias(n) for n in FIELDS])


def _fallback_fields(response: Column, flow: dict[str, Column] | None) -> dict[str, Column]:
    fields = _template(FALLBACK, F.lit(FALLBACK_RISK), "fallback_parsed", flow or _flow())
    text = F.when(response == "", FALLBACK["technical_analysis"]).otherwise(response)
    fields["technical_analysis"] = F.substring(F.coalesce(text, F.lit(FALLBACK["technical_analysis"])), 1,
                                               FALLBACK_CHARS)
    return fields


def fallback_analysis(response: Column, flow: dict[str, Column] | None = None) -> Column:
    """Used when the answer holds no usable JSON; keeps the first 500 characters of it."""
    return _struct(_fallback_fields(response, flow))


def _error_fields(source: str, flow: dict[str, Column] | None) -> dict[str, Column]:
    return _template(ERROR, F.lit(ERROR_RISK), source, flow or _flow())


def error_analysis(source: str = "fallback_analysis", flow: dict[str, Column] | None = None) -> Column:
    """Used when there is no answer at all."""
    return _struct(_error_fields(source, flow))


def simulated_analysis(flow_id: Column, flow: dict[str, Column] | None = None) -> Column:
    """Analysis without a model; the risk is a fixed draw per flow."""
    low, high = SIMULATED_RISK
    risk = F.lit(low) + F.pmod(digest_int(digest(flow_id)), F.lit(high - low + 1))
    return _struct(_template(SIMULATED, risk, "simulated_analysis", flow or _flow()))


def parse_responses(df: DataFrame, response: str = "response", out: str = "analysis",
                    flow: dict[str, Column] | None = None, error_source: str = "fallback_analysis") -> DataFrame:
    """Add the analysis struct of each response: parsed and validated, or a replacement.

    Three projections - find and parse, extract, decide - so each text is parsed once per row.
    """
    text, p = F.col(response), _Parsed()
    parsed = df.withColumn("_object", parse_object(json_block(text)))
    extracted = parsed.withColumns(p.columns(F.col("_object")))
    good = {**_validated(p), "response_source": F.lit("llm_parsed")}
    error, fallback = _error_fields(error_source, flow), _fallback_fields(text, flow)
    usable = F.col("_object").isNotNull()
    # the choice is made per field, so a reader of one field computes that field only
    fields = {n: F.when(text.isNull(), error[n]).when(usable, good[n]).otherwise(fallback[n]) for n in FIELDS}
    return extracted.withColumn(out, _struct(fields)).drop("_object", *p.columns(F.col("_object")))


def quality(response: Column, technical_analysis: Column) -> dict[str, Column]:
    """Flags of a logged answer."""
    text = F.coalesce(response, F.lit(""))
    technical = F.coalesce(technical_analysis, F.lit(""))
    return {
        "has_text": F.length(text) > 0,
        "has_json": text.contains("{") & text.contains("}"),
        "valid_json": F.coalesce(parse_object(json_block(text)).isNotNull(), F.lit(False)),
        "looks_fallback": technical.contains(FALLBACK_MARK) | (F.length(technical) < SHORT_ANALYSIS),
    }
