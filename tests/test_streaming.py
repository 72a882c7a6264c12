import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flowwarden.operators import knn
from flowwarden.operators.threats import counters
from flowwarden.plans.classify import classify_flows
from flowwarden.sources import history_store, response_log
from flowwarden.streaming import detect, intake, respond

SCHEMA = "flow_id bigint, ts timestamp, attack_type string, classification string, x double, y double"


def write_events(spark, path, n=60, files=4):
    rows = [(i, dt.datetime(2024, 1, 1, i % 24), ["synscan", "udpscan", None][i % 3],
             ["malicious", "suspicious", "benign"][i % 3], float(i % 11), float(i % 7)) for i in range(n)]
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.json(path)
    return spark.read.schema(SCHEMA).json(path)


def stream(spark, path, max_files=1):
    from pyspark.sql.types import _parse_datatype_string

    return intake.read_files(spark, path, _parse_datatype_string(SCHEMA), max_files=max_files)


def test_stream_classification_equals_batch_over_several_batches(spark, tmp_path):
    batch = write_events(spark, str(tmp_path / "in"))
    refs = spark.createDataFrame([(g, i, [float(i % 11), float(i % 5)]) for i in range(40) for g in ("benign", "synscan")],
                                 "grp string, row_id bigint, features array<double>")
    index = knn.build_cells(refs)
    vectors = lambda b: knn.query_rows(b.where("flow_id <> 5"), "flow_id", F.array("x", "y"))
    seen = []
    q = detect.classify_stream(stream(spark, str(tmp_path / "in")), index, vectors, str(tmp_path / "out"),
                               str(tmp_path / "cp"), consumers=[lambda df, b: seen.append((b, df.count()))],
                               available_now=True)
    q.awaitTermination()
    out = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))
    got = {r["flow_id"]: (r["classification"], r["confidence"]) for r in out.collect()}
    want = {r["query_id"]: (r["classification"], r["confidence"]) for r in classify_flows(index, vectors(batch)).collect()}
    assert got.pop(5) == ("unknown", 0.0)  # could not be scored, but is not lost
    assert got == want
    assert len(seen) >= 4 and sum(n for _, n in seen) == 60


def test_counters_and_first_of_type(spark, tmp_path):
    batch = write_events(spark, str(tmp_path / "in"))
    latest = {}

    def keep(name):
        def body(df, batch_id):
            latest[name] = [r.asDict() for r in df.collect()] if name == "counters" else \
                latest.get(name, []) + [r.asDict() for r in df.collect()]
        return body

    for name, df, mode in (
            ("counters", detect.running_counters(stream(spark, str(tmp_path / "in"))), "complete"),
            ("first", detect.first_arrivals(stream(spark, str(tmp_path / "in")).where("attack_type IS NOT NULL"), "flow_id"), "append")):
        intake.start_batches(df, keep(name), str(tmp_path / f"cp-{name}"), True, mode=mode).awaitTermination()
    want = {r["classification"]: r["flows"] for r in counters(batch).collect()}
    assert {r["classification"]: r["flows"] for r in latest["counters"]} == want
    assert sorted(r["attack_type"] for r in latest["first"]) == ["synscan", "udpscan"]


def test_resume_from_checkpoint_processes_only_new_files(spark, tmp_path):
    write_events(spark, str(tmp_path / "in"), n=20, files=2)
    seen = []
    body = lambda df, b: seen.append(df.count())

    def run():
        s = intake.read_files(spark, str(tmp_path / "in") + "*", stream(spark, str(tmp_path / "in")).schema)
        intake.start_batches(s, body, str(tmp_path / "cp"), True).awaitTermination()

    run()
    write_events(spark, str(tmp_path / "in2"), n=7, files=1)
    run()
    assert sum(seen) == 27 and seen[-1] == 7


def test_replayed_batch_replaces_itself(spark, tmp_path):
    df = spark.range(5)
    for _ in range(2):
        intake.write_batch(df, str(tmp_path / "out"), 3)
    assert intake.read_batches(spark, str(tmp_path / "out"), df.schema).count() == 5


def test_a_failed_consumer_does_not_repeat_the_others(spark, tmp_path):
    got, fail = [], [True]

    def second(d, b):
        if fail.pop() if fail else False:
            raise OSError("full")
        got.append(("second", b, d.count()))

    consumers = intake.Consumers(str(tmp_path / "done"), {
        "first": lambda d, b: got.append(("first", b, d.count())), "second": second,
        "third": lambda d, b: got.append(("third", b, d.count()))})
    with pytest.raises(RuntimeError, match="failed in: second"):
        consumers(spark.range(3), 7)
    consumers(spark.range(3), 7)
    assert got == [("first", 7, 3), ("third", 7, 3), ("second", 7, 3)]
    consumers(spark.range(3), 7)
    assert len(got) == 3


def test_bounded_parts_lose_nothing_and_keep_the_order(spark):
    seen = []
    run = intake.in_bounded_parts(lambda d, n: seen.append((n, [r[0] for r in d.orderBy("id").collect()])), 10, ["id"])
    run(spark.range(47).repartition(5), 2)
    assert [n for n, _ in seen] == [(2 << 20) + i for i in range(5)]
    assert [x for _, rows in seen for x in rows] == list(range(47)) and max(len(r) for _, r in seen) == 10
    run(spark.range(0), 3)
    assert len(seen) == 5


def test_the_store_does_not_grow_with_batches(spark, tmp_path):
    import glob

    from flowwarden.session import materialize, scoped_tables, shared_dir

    tables = lambda: len(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/flowwarden/*"))
    before = tables()
    for i in range(10):
        with scoped_tables(spark):
            kept = materialize(spark.range(i), "inner").count()
            assert kept == i and tables() == before + 1
    assert tables() == before


def test_results_of_a_failed_batch_are_not_asked_for_again(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()

    def model():
        import json as j
        import uuid

        def generate(prompts):
            (calls / uuid.uuid4().hex).write_text(str(len(prompts)))
            return [j.dumps({"threat_level": "LOW"}) for _ in prompts]

        return generate

    row = {"flow_id": "f", "ts": "2024-01-01T00:00:00", "src_ip": "a", "src_port": 1, "dst_ip": "b", "dst_port": 2, "protocol": "tcp",
           "bytes_count": 10, "packets_count": 2, "duration": 0.5, "tcp_flags": "SYN", "attack_type": "synscan", "confidence": 0.8}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(json.dumps(row))
    arriving = intake.read_files(spark, str(tmp_path / "in"), spark.read.json(str(tmp_path / "in")).schema).withColumn(
        "ts", F.col("ts").cast("timestamp"))
    run = lambda: respond.analysis_stream(
        arriving, str(tmp_path / "history"), str(tmp_path / "results"), str(tmp_path / "cp"), generator=model, available_now=True,
        log_path=str(tmp_path / "log")).awaitTermination()
    with monkeypatch.context() as m:
        m.setattr(history_store, "append", lambda *a: (_ for _ in ()).throw(OSError("no room")))
        with pytest.raises(Exception, match="no room"):
            run()
    run()
    assert [p.read_text() for p in calls.iterdir()] == ["1"]
    assert history_store.load(spark, str(tmp_path / "history")).count() == 1
    logged = response_log.read(spark, str(tmp_path / "log")).first()
    assert logged.request_type == "analysis" and float(logged.parsed_result.inference_time) >= 0


def test_analyses_become_searchable_for_the_next_batch(spark, tmp_path):
    for i in range(2):
        rows = [{"flow_id": f"{i}-{j}", "ts": f"2024-01-01T0{i}:00:0{j}", "src_ip": "a", "src_port": 1, "dst_ip": "b",
                 "dst_port": 2, "protocol": "tcp", "bytes_count": 10, "packets_count": 2, "duration": 0.5,
                 "tcp_flags": "SYN", "attack_type": "synscan", "confidence": 0.8} for j in range(3)]
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
    schema = spark.read.json(str(tmp_path / "in")).schema
    arriving = intake.read_files(spark, str(tmp_path / "in"), schema, max_files=1).withColumn("ts", F.col("ts").cast("timestamp"))
    respond.analysis_stream(arriving, str(tmp_path / "history"), str(tmp_path / "results"), str(tmp_path / "cp"),
                            available_now=True).awaitTermination()
    docs = history_store.load(spark, str(tmp_path / "history"))
    assert sorted(r["doc_index"] for r in docs.collect()) == list(range(6))
    results = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "results")).collect()
    used = {r["flow_id"][0]: r["rag_context_used"] for r in results}
    assert sorted(used.values()) == [False, True]  # the first batch finds an empty history, the second does not
    assert respond.recent_documents(docs, 2).count() == 2


def test_analyses_stored_after_the_start_can_be_asked_about(spark, tmp_path):
    schema = "question_id string, question string, flow_id string, timestamp string"
    from pyspark.sql.types import _parse_datatype_string

    from flowwarden.schemas import ANALYSIS

    (tmp_path / "in").mkdir()
    arriving = intake.read_files(spark, str(tmp_path / "in"), _parse_datatype_string(schema))
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in ANALYSIS.fields])
    known = lambda s: s.read.parquet(str(tmp_path / "known"))
    for flow in ("a", "b"):
        spark.createDataFrame([(flow,)], "flow_id string").withColumn("analysis", empty).write.mode("append").parquet(
            str(tmp_path / "known"))
        (tmp_path / "in" / f"{flow}.json").write_text(json.dumps(
            {"question_id": flow, "question": "why?", "flow_id": flow, "timestamp": "t"}))
        respond.question_stream(arriving, known, str(tmp_path / "out"), str(tmp_path / "cp"),
                                available_now=True).awaitTermination()
    out = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out" / "answers"))
    assert sorted(r["flow_id"] for r in out.collect()) == ["a", "b"]


def test_throughput_windows(spark, tmp_path):
    batch = write_events(spark, str(tmp_path / "in"))
    rows = detect.throughput(batch, "1 hour").collect()
    assert sum(r["flows"] for r in rows) == 60 and len(rows) == 24


@pytest.mark.parametrize("folder", [True, False])
def test_a_table_streams_as_a_folder_and_as_a_single_file(spark, tmp_path, folder):
    import catalog

    catalog.load_all()
    turns = [(i // 3, i % 3, ["user", "assistant", "user"][i % 3], f"turn {i}") for i in range(30)] + [(99, 0, "user", "who?")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    (df.repartition(4) if folder else df.coalesce(1)).write.parquet(str(tmp_path / "written"))
    target = tmp_path / "conversations.parquet"
    if folder:
        (tmp_path / "written").rename(target)
    else:
        next((tmp_path / "written").glob("*.parquet")).rename(target)
    got = catalog.QUERIES["stream_questions"](spark, str(tmp_path)).collect()
    assert {(r.outcome, r.questions) for r in got} == {("answered", 20), ("rejected", 1)}


def test_no_batch_reads_as_no_rows(spark, tmp_path):
    assert intake.read_batches(spark, str(tmp_path / "none"), "a long").count() == 0


def test_a_part_reads_its_own_rows_only(spark):
    df, seen = spark.range(95).select(F.col("id").alias("n"), F.lit("x").alias("text")), []

    def take(part, number):
        seen.append((number, [r.n for r in part.collect()], {f.split("part=")[1].split("/")[0] for f in part.inputFiles()}, part.columns))

    intake.in_bounded_parts(take, 10, ["n"])(df.repartition(7), 3)
    assert [s[0] - (3 << 20) for s in seen] == list(range(10)) and [i for s in seen for i in s[1]] == list(range(95))
    assert [s[2] for s in seen] == [{str(i)} for i in range(10)] and {tuple(s[3]) for s in seen} == {("n", "text")}
    intake.in_bounded_parts(take, 10, ["n"])(df.limit(0), 0)
    assert len(seen) == 10
