import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowwarden.functions.models import embed
from flowwarden.operators import history, questions, recency, threats
from flowwarden.plans import analyze
from flowwarden.schemas import ANALYSIS
from flowwarden.sources import history_store


def docs(spark, n=130):
    rows = [(i, f"{'syn scan on port' if i % 3 else 'udp flood volume'} {i}", "SynScan" if i % 3 else "udpflood", 1000 - i)
            for i in range(n)]
    return spark.createDataFrame(rows, "doc_index bigint, text string, attack_type string, ts bigint").withColumn(
        "embedding", embed(F.col("text")))


def query(spark, text):
    return spark.createDataFrame([(0, text)], "query_id bigint, text string").select(
        "query_id", embed(F.col("text")).alias("embedding"))


def test_search_filters_before_searching(spark):
    d = docs(spark).persist()
    best = history.search(d, query(spark, "udp flood volume 9"), 3).orderBy("rank").collect()
    assert best[0]["doc_index"] == 9 and best[0]["score"] == pytest.approx(1.0)
    typed = history.search(d, query(spark, "udp flood volume 9"), 4, attack_type="SYNSCAN").collect()
    assert len(typed) == 4 and {r["attack_type"] for r in typed} == {"SynScan"}
    assert history.search(d, query(spark, "x"), 4, attack_type="none").count() == 0
    recent = history.search(d, query(spark, "udp flood volume 120"), 100, recent_only=True).collect()
    assert {r["doc_index"] for r in recent} == set(range(100))  # ts falls with the id: 0..99 are the newest
    small = history.search(d.where("doc_index < 50"), query(spark, "x"), 60, recent_only=True)
    assert small.count() == 50  # fewer than 100 documents: no restriction


def test_by_type_uses_the_empty_query(spark):
    empty = spark.range(1).select(embed(F.lit("")).alias("embedding"))
    got = history.by_type(docs(spark), empty, 2)
    assert sorted((r["attack_type"], r["rank"]) for r in got.collect()) == [
        ("synscan", 1), ("synscan", 2), ("udpflood", 1), ("udpflood", 2)]


def test_retain_is_idempotent_and_renumbers(spark):
    d = docs(spark).drop("embedding")
    once = history.retain(d, 40)
    assert [(r["old_index"], r["doc_index"]) for r in once.orderBy("doc_index").collect()] == [(i, i) for i in range(40)]
    twice = history.retain(once.drop("old_index"), 40)
    assert twice.select("doc_index", "ts").exceptAll(once.select("doc_index", "ts")).count() == 0
    report = recency.retention_report(d, "ts", "doc_index", 40).first()
    assert tuple(report) == (130, 40, 90)


def test_numbering_over_many_partitions(spark):
    df = spark.range(5000).withColumn("t", F.col("id") % 7).repartition(9)
    got = recency.numbered(df, ["t", "id"], "n").collect()
    assert [r["n"] for r in sorted(got, key=lambda r: (r["t"], r["id"]))] == list(range(1, 5001))


def test_eviction(spark):
    df = spark.range(101)
    assert recency.evict_oldest(df, "id", "id").agg(F.min("id"), F.count("*")).first() == (50, 51)
    assert recency.evict_oldest(spark.range(100), "id", "id").count() == 100


def test_last_rows_in_arrival_order(spark):
    got = [r["id"] for r in recency.last_in_arrival_order(spark.range(50), "id", "id", 5).collect()]
    assert got == [45, 46, 47, 48, 49]


def test_first_per_type_and_skip(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 3), (4, None, 1)], "id int, attack_type string, ts int")
    first = {r["attack_type"]: r["id"] for r in threats.first_per_type(df, "ts", "id").collect()}
    assert first == {"a": 2, "b": 3, None: 4}
    done = spark.createDataFrame([("a",)], "attack_type string")
    assert sorted(r["id"] for r in threats.not_yet_analysed(df, done).collect()) == [3, 4]


def test_embeddings_are_unit_and_repeatable(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    rows = [r[0] for r in df.select(embed(F.col("t"))).collect()]
    assert all(sum(x * x for x in v) == pytest.approx(1.0) for v in rows)
    assert rows[1] == rows[2] and rows[1][0] == 1.0


def flows(spark, n=6):
    rows = [(f"f{i}", dt.datetime(2024, 1, 1, 0, 0, i), "10.0.0.1", 1, "10.0.0.2", 22, "tcp", 100 + i % 2, 5, 0.5, "SYN",
             "synscan", 0.8) for i in range(n)]
    return spark.createDataFrame(
        rows, "flow_id string, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, "
              "bytes_count bigint, packets_count bigint, duration double, tcp_flags string, attack_type string, "
              "confidence double")


def test_analyze_and_ingest(spark, tmp_path):
    stored = docs(spark)
    out = analyze.analyze_threats(flows(spark), stored).orderBy("flow_id").collect()
    assert len(out) == 6 and all(len(r["context"]) == 3 and r["rag_context_used"] for r in out)
    assert all(r["analysis"]["response_source"] == "llm_parsed" and r["analysis"]["rag_assisted"] for r in out)
    results = analyze.analyze_threats(flows(spark))
    fresh = analyze.ingest_analyses(results, stored)
    assert sorted(r["doc_index"] for r in fresh.collect()) == list(range(130, 136))
    path = str(tmp_path / "history")
    assert history_store.load(spark, path).count() == 0
    history_store.append(fresh, path, 0)
    history_store.append(fresh, path, 0)  # replay replaces
    back = history_store.load(spark, path)
    assert back.count() == 6 and back.first()["metadata"]["protocol"] == "tcp"
    history_store.export(back, str(tmp_path / "export"), "m")
    assert spark.read.json(str(tmp_path / "export" / "documents")).count() == 6
    assert spark.read.json(str(tmp_path / "export" / "metadata")).first()["total_documents"] == 6


def test_failing_model_gives_error_analysis(spark):
    def broken():
        def call(prompts):
            raise RuntimeError("no model")
        return call

    out = analyze.analyze_threats(flows(spark), generator=broken).first()
    assert out["response"] is None and out["analysis"]["response_source"] == "error_fallback"


def analyses(spark):
    values = {"attack_vector": F.lit("v"), "risk_score": F.lit(80)}
    fields = [values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in ANALYSIS.fields]
    return spark.createDataFrame([("a", "2024"), ("b", None)], "flow_id string, timestamp string").withColumn(
        "analysis", F.struct(*fields))


def test_questions(spark):
    asked = spark.createDataFrame(
        [("1", " why? ", "a "), ("2", " \n", "a"), ("3", "how", " "), ("4", "how", "zz"), ("5", None, None)],
        "question_id string, question string, flow_id string").withColumn("timestamp", F.lit("t"))
    good = questions.admitted(asked, analyses(spark))
    assert [(r["question_id"], r["question"]) for r in good.collect()] == [("1", "why?")]
    reasons = {r["question_id"]: r["reason"] for r in questions.rejected(asked, analyses(spark)).collect()}
    assert reasons == {"2": "Question is required", "3": "Flow ID is required",
                       "4": "No analysis found for flow_id: zz", "5": "Question is required"}
    no_model = questions.payload(questions.answer(good)).first()
    assert no_model["inference_time"] == 0.1 and not no_model["error"]
    named = questions.payload(questions.answer(good.withColumn("requester_id", F.lit("r")))).first()
    assert named["requester_id"] == "r" and "requester_id" not in no_model.asDict()

    def echo():
        return lambda prompts: [p.splitlines()[-4][:10] for p in prompts]

    answered = questions.answer(good, echo).first()
    assert answered["response_source"] == "llm_question_answer" and "USER QUESTION: why?" in answered["prompt"]


def test_available(spark):
    rows = questions.available(analyses(spark)).collect()
    assert [(r["flow_id"], r["threat_level"], r["timestamp"]) for r in rows] == [
        ("b", "Unknown", "Unknown"), ("a", "Unknown", "2024")]


def test_newest_analysis_of_a_flow_counts(spark):
    asked = spark.createDataFrame([("f1", "why?")], "flow_id string, question string")
    stored = spark.createDataFrame([("f1", "new", 2), ("f1", "old", 1), ("f2", "x", 1)],
                                   "flow_id string, analysis string, timestamp long")
    assert [r.analysis for r in questions.admitted(asked, stored).collect()] == ["new"]


def test_texts_with_one_embedding_share_a_search(spark, monkeypatch):
    """Six flows of two attack types differ in their numbers only, which this embedder does not see."""
    import numpy as np

    from flowwarden.operators import history
    from flowwarden.plans import analyze

    def embedder():
        return lambda texts: np.array([[1.0, t.count("synscan"), t.count("udpscan")] for t in texts])

    rows = [(f"f{i}", "a", i, "b", 2, "tcp", 10 + i, 2, 0.5, "SYN", ["synscan", "udpscan"][i % 2], 0.8) for i in range(6)]
    threats = spark.createDataFrame(rows, "flow_id string, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, "
                                          "bytes_count long, packets_count long, duration double, tcp_flags string, attack_type string, confidence double")
    docs = spark.createDataFrame([(0, "x", [1.0, 9.0, 0.0]), (1, "y", [1.0, 0.0, 9.0]), (2, "z", [1.0, 0.0, 0.0])],
                                 "doc_index long, text string, embedding array<double>")
    asked, search = [], history.search
    monkeypatch.setattr(history, "search", lambda d, q, *a, **b: (asked.append(q.count()), search(d, q, *a, **b))[1])
    out = analyze.retrieve_context(threats, docs, k=1, embedder=embedder).collect()
    assert asked == [2]
    assert {r.flow_id: [c.doc_index for c in r.context] for r in out} == {f"f{i}": [i % 2] for i in range(6)}
    assert "query_id" not in out[0] and "search_key" not in out[0]
