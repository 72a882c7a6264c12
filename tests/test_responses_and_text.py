import json

import pytest
from pyspark.sql import functions as F

from flowwarden.functions import responses as resp
from flowwarden.functions import text as txt
from flowwarden.sources import response_log

FLOW = ("synscan", "10.0.0.1", "10.0.0.2")


def parse(spark, *answers):
    df = spark.createDataFrame([(i, a, *FLOW) for i, a in enumerate(answers)],
                               "i int, response string, attack_type string, src_ip string, dst_ip string")
    return [r["a"] for r in resp.parse_responses(df, out="a").orderBy("i").collect()]


GOOD = {"threat_level": "LOW", "risk_score": 20, "attack_vector": "v", "potential_impact": "p",
        "immediate_actions": ["a", "b"], "investigation_steps": ["c"], "prevention_measures": ["d"],
        "technical_analysis": "t", "rag_assisted": True}


def test_reasoning_before_json(spark):
    (a,) = parse(spark, "First I look at the ports, then at the volume.\n\n```json\n" + json.dumps(GOOD, indent=2) + "\n```")
    assert a["response_source"] == "llm_parsed"
    assert {k: a[k] for k in GOOD} == GOOD


@pytest.mark.parametrize("risk, expected", [
    (85, 85), ("85", 85), (" 85 ", 85), (85.7, 85), (-5, 0), (400, 100), ("high", 80), ("85.5", 80), (True, 1),
    (None, 80), ("", 80), ([], 80), ([1], 80), ({"a": 1}, 80), (-0.5, 0), (0, 0), (10 ** 30, 100)])
def test_risk(spark, risk, expected):
    (a,) = parse(spark, json.dumps({**GOOD, "risk_score": risk}))
    assert a["risk_score"] == expected


def test_defaults_and_enumeration(spark):
    empty, severe, number, texts = parse(
        spark, "{}", '{"threat_level": "SEVERE", "attack_vector": "", "immediate_actions": [], "rag_assisted": null}',
        '{"threat_level": 3, "technical_analysis": 12, "rag_assisted": 0}',
        '{"immediate_actions": "one", "investigation_steps": [1, true], "rag_assisted": "no"}')
    for name, value in resp.DEFAULTS.items():
        assert empty[name] == value
    assert severe["threat_level"] == "HIGH" and severe["attack_vector"] == resp.DEFAULTS["attack_vector"]
    assert severe["immediate_actions"] == resp.DEFAULTS["immediate_actions"] and severe["rag_assisted"] is False
    assert number["threat_level"] == "HIGH" and number["technical_analysis"] == "12" and number["rag_assisted"] is False
    assert texts["immediate_actions"] == ["one"] and texts["investigation_steps"] == ["1", "true"]
    assert texts["rag_assisted"] is True


def test_unusable_answers(spark):
    long = "no structure " * 60
    none, cut, two, empty, missing, trailing = parse(
        spark, long, '{"threat_level": "LOW"', '{"a": 1} and {"b": 2}', "", None, '{"a": 1}, {"b": 2}')
    for a in (none, cut, two, empty, trailing):
        assert a["response_source"] == "fallback_parsed" and a["risk_score"] == 75
        assert a["attack_vector"] == "synscan attack detected" and a["immediate_actions"][0] == "Block source IP 10.0.0.1"
    assert none["technical_analysis"] == long[:500]
    assert empty["technical_analysis"] == "Analysis generated from fallback method"
    assert missing["response_source"] == "fallback_analysis" and missing["risk_score"] == 72
    assert missing["technical_analysis"] == "System-generated analysis for synscan attack"
    assert missing["potential_impact"] == "Potential compromise of 10.0.0.2"


def test_repeated_keys_keep_the_last(spark):
    (a,) = parse(spark, '{"risk_score": 1, "risk_score": 2}')
    assert a["risk_score"] == 2


def test_number_text(spark):
    values = [0.1, 0.0, 5.0, 0.0004, 0.00012345, 1e-5, 1.5e-7, 12345678.9, 1e15, 1e16, 1.5e300, -0.0005, 100000000.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(txt.number_text(F.col("x"))).collect()] == [str(v) for v in values]


def test_fixed2(spark):
    values = [0.125, 0.375, 2.5, 0.0, 0.999, 0.8, 12.345678]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(txt.fixed2(F.col("x"))).collect()] == [f"{v:.2f}" for v in values]


def test_analysis_json_is_what_a_json_writer_prints(spark):
    (a,) = parse(spark, json.dumps({**GOOD, "attack_vector": 'say "hi"\n\\', "immediate_actions": ["x"]}))
    from flowwarden.schemas import ANALYSIS

    df = spark.createDataFrame([(a.asDict(),)], "a " + ANALYSIS.simpleString())
    text = df.select(txt.analysis_json(F.col("a"))).first()[0]
    want = {f: a[f] for f in ANALYSIS.names if a[f] is not None}
    assert text == json.dumps(want, indent=2)


def test_prompt_with_and_without_context(spark):
    df = spark.createDataFrame(
        [("10.0.0.1", 1, "10.0.0.2", 22, "tcp", 100, 5, 0.5, "SYN", "synscan", 0.8,
          [(1, 0.9, "line one\nline two" + "x" * 500)], [(1, 0.75), (2, 0.5), (3, 0.1)])],
        "src_ip string, src_port int, dst_ip string, dst_port int, protocol string, bytes_count bigint, "
        "packets_count bigint, duration double, tcp_flags string, attack_type string, confidence double, "
        "context array<struct<rank:int,score:double,text:string>>, similar array<struct<rank:int,similarity:double>>")
    full = df.select(txt.analysis_prompt(F.col("context"), F.col("similar"))).first()[0]
    assert "[Analysis 1] (Relevance: 0.90) line one line twoxxx" in full and '"rag_assisted": true' in full
    assert "- Pattern 2: similarity=0.50" in full and "Pattern 3" not in full
    assert "- Duration: 0.5s" in full and "- Detection Confidence: 0.80" in full
    snippet = full.split("(Relevance: 0.90) ")[1].split("\n")[0]
    assert len(snippet) == 400
    bare = df.select(txt.analysis_prompt()).first()[0]
    assert "HISTORICAL" not in bare and '"rag_assisted": false' in bare


def test_response_log_roundtrip(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(i, f"f{i}", "prompt", json.dumps(GOOD) if i % 2 else "nothing", *FLOW) for i in range(12)],
                               "i int, flow_id string, prompt string, response string, attack_type string, src_ip string, "
                               "dst_ip string")
    rows = resp.parse_responses(df, out="parsed_result").withColumn(
        "ts", F.timestamp_seconds(F.lit(1700000000) + F.col("i")))
    response_log.append(response_log.log_records(rows, "analysis"), path)
    log = response_log.read(spark, path)
    assert log.count() == 12 and log.where("logged_at IS NULL").count() == 0
    report = response_log.report(log).collect()
    assert len(report) == 10 and report[0]["timestamp"] == "20231114_221331"
    assert [r["valid_json"] for r in report] == [True, False] * 5
    assert response_log.retain(log, keep=3, row_id="flow_id").count() == 3
    stats = response_log.model_stats(log).first()
    assert (stats["total_analyses"], stats["total_questions"], stats["average_inference_time"]) == (12, 0, 0.0)


def test_pretty_printed_old_and_new_layouts(spark, tmp_path):
    (tmp_path / "analysis_20250101_010203.json").write_text(json.dumps(
        {"timestamp": "20250101_010203", "request_type": "analysis", "full_response": "x", "response_length": 1,
         "parsed_result": GOOD, "model_params": {"temperature": 0.7, "do_sample": True}}, indent=2))
    (tmp_path / "analysis_synscan_20240101_010203.json").write_text(json.dumps(
        {"timestamp": "20240101_010203", "attack_type": "synscan", "response_source": "llm_parsed",
         "full_response": "y", "parsed_result": {**GOOD, "risk_score": 85.0}, "analysis_number": 4}, indent=2))
    rows = response_log.read(spark, str(tmp_path), multi_line=True).orderBy("timestamp").collect()
    assert [r["request_type"] for r in rows] == ["analysis", "analysis"]
    assert rows[0]["attack_type"] == "synscan" and rows[0]["analysis_number"] == 4
    assert rows[1]["parsed_result"]["risk_score"] == "20" and rows[1]["model_params"]["temperature"] == "0.7"
