import json
import os
import re

import pytest
from pyspark.sql import functions as F

from flow_samples import flow_row, write_csv, write_folder
from flowwarden.operators import knn, quality, splitting
from flowwarden.operators.cleaning import clean_flows
from flowwarden.plans import classify, data_quality, reference_index, similar
from flowwarden.schemas import ATTACK_CLASSES, BENIGN, FLOW_COLUMNS, NUMERIC
from flowwarden.sources import flow_csv


def test_reads_every_class_and_ignores_the_stream_file(spark, tmp_path):
    write_folder(str(tmp_path), per_class=5)
    raw = flow_csv.read_flow_csv(spark, str(tmp_path))
    counts = {r["traffic_class"]: r["n"] for r in raw.groupBy("traffic_class").agg(F.count("*").alias("n")).collect()}
    assert counts == {c: 5 for c in [BENIGN, *ATTACK_CLASSES]}
    flows = clean_flows(raw)
    assert dict(flows.dtypes)["Dur"] == "double" and dict(flows.dtypes)["sTos"] == "string"
    assert flows.select("row_id").distinct().count() == 45
    assert {r["corrupt_record"] for r in raw.select("Seq", "corrupt_record").collect()} == {None}


def test_uneven_headers(spark, tmp_path):
    import random

    rng = random.Random(0)
    rows = [flow_row(rng, BENIGN, i) for i in range(4)]
    rows[1]["Dur"] = "broken"
    write_csv(str(tmp_path / "benign.csv"), rows)
    fewer = [c for c in FLOW_COLUMNS if c not in ("Load", "Rate")]
    write_csv(str(tmp_path / "sub" / "udpscan.csv"), [flow_row(rng, "udpscan", i) for i in range(3)], fewer)
    path = str(tmp_path / "synscan_padded.csv")
    order = ["", " State ", "Dur ", "extra", "Proto", "TotPkts"]
    with open(path, "w") as f:
        f.write(",".join(order) + "\n0,CON,1.5,x,tcp,3\n1,REQ,2.5,y,udp,4\n")
    open(str(tmp_path / "httpflood.csv"), "w").close()
    raw = flow_csv.read_flow_csv(spark, str(tmp_path), layout="by_header")
    flows = clean_flows(raw)
    got = {r["traffic_class"]: r for r in flows.groupBy("traffic_class").agg(
        F.count("*").alias("n"), F.sum("Dur").alias("dur"), F.max("Rate").alias("rate"), F.max("extra").alias("extra")).collect()}
    assert {k: v["n"] for k, v in got.items()} == {BENIGN: 4, "udpscan": 3, "synscan": 2}
    assert got["synscan"]["dur"] == 4.0 and got["synscan"]["rate"] == 0.0 and got["synscan"]["extra"] == "y"
    assert got[BENIGN]["dur"] == pytest.approx(sum(r["Dur"] for r in rows if r["Dur"] != "broken"))


def test_profile_of_files_with_equal_names_and_blanks(spark, tmp_path):
    import random

    rng = random.Random(1)
    for name, n in (("mon/benign.csv", 3), ("tue/benign.csv", 5), ("wed/udpscan a+b.csv", 4)):
        write_csv(str(tmp_path / name), [flow_row(rng, BENIGN, i) for i in range(n)])
    files = quality.file_profile(spark, str(tmp_path)).collect()
    assert sorted((r["file_name"], r["rows"]) for r in files) == [
        ("benign.csv", 3), ("benign.csv", 5), ("udpscan a+b.csv", 4)]


def test_row_ids_of_files_with_equal_names_and_without_index(spark, tmp_path):
    import random

    rng = random.Random(2)
    for name, n in (("mon/benign.csv", 3), ("tue/benign.csv", 5), ("wed/udpscan a+b.csv", 4)):
        write_csv(str(tmp_path / name), [flow_row(rng, BENIGN, i) for i in range(n)])
    ids = [r[0] for r in flow_csv.read_flow_csv(spark, str(tmp_path)).select("row_id").collect()]
    assert len(set(ids)) == len(ids) == 12 and "mon/benign.csv:0" in ids
    plain = tmp_path / "thu" / "synscan.csv"
    plain.parent.mkdir()
    plain.write_text("Proto,Dur\ntcp,1\nudp,2\ntcp,3\n")
    ids = [r[0] for r in flow_csv.read_flow_csv(spark, str(tmp_path), layout="by_header").select("row_id").collect()]
    assert len(set(ids)) == len(ids) == 15
    only = flow_csv.read_flow_csv(spark, str(plain.parent), layout="by_header")
    assert only.select("row_id").distinct().count() == 3 and "file_path" not in only.columns


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("flows")
    write_folder(str(root), per_class=40)
    flows = clean_flows(flow_csv.read_flow_csv(spark, str(root))).drop("file_name", "corrupt_record")
    halves = splitting.split(flows, "traffic_class", "row_id").persist()
    index_half = halves.where("split = 'index'").drop("split")
    ref = reference_index.build_reference_index(index_half, copies=10)
    return str(root), halves, ref


def test_schema_is_frozen_to_47_features_and_25_selected(built):
    _, _, ref = built
    assert len(ref.space.names) == 47 and len(ref.space.selected) == 25
    assert ref.space.numeric == sorted(NUMERIC)


def test_index_metadata_and_calibration(built):
    _, halves, ref = built
    meta = {r["traffic_class"]: r for r in ref.metadata.collect()}
    assert set(meta) == {BENIGN, *ATTACK_CLASSES}
    assert meta[BENIGN]["index_type"] == "IVFFlat" and meta["udpscan"]["index_type"] == "Flat"
    assert all(m["feature_dim"] == 25 and m["calibration"]["p5"] <= m["calibration"]["p95"] for m in meta.values())
    counts = splitting.split_counts(halves, "traffic_class")
    assert reference_index.reconcile_counts(ref.metadata, counts).count() == 0


def test_save_load_classify_and_similar(spark, built, tmp_path):
    _, halves, ref = built
    held_out = halves.where("split = 'test'")
    path = str(tmp_path / "index")
    reference_index.save(ref, path)
    assert any(d.startswith("cell=") for d in os.listdir(f"{path}/vectors/grp={BENIGN}"))
    back = reference_index.load(spark, path)

    def run(r):
        out = classify.classify_flows(r.index, r.queries(held_out, "row_id"))
        return {x["query_id"]: (x["classification"], round(x["confidence"], 9), x["attack_type"]) for x in out.collect()}

    first = run(ref)
    assert first == run(back)
    truth = {r["row_id"]: r["traffic_class"] for r in held_out.collect()}
    assert set(first) == set(truth)
    attacks = [k for k, v in truth.items() if v != BENIGN]
    assert sum(first[k][2] == truth[k] for k in attacks) / len(attacks) > 0.9

    one = spark.createDataFrame([("q", ref.index.vectors.first()["features"], "synscan")],
                                "query_id string, features array<double>, grp string")
    stored = reference_index.load(spark, path).index
    plan = knn.search_cells(stored, one, 1, nprobe=1)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (IN|=)", plan)  # only the probed cell is read

    found = similar.similar_flows(back.index, back.queries(held_out, "row_id", "traffic_class"), 3, back.calibration,
                                  back.rows).collect()
    assert len(found) == 3 * len(attacks)
    assert all(0.0 <= r["similarity"] <= 1.0 and r["flow"]["traffic_class"] == r["grp"] for r in found)


def test_approximate_classification_agrees_with_exact(built):
    _, halves, ref = built
    queries = ref.queries(halves.where("split = 'test'"), "row_id")
    exact = classify.classify_flows(ref.index, queries).select("query_id", "classification", "attack_type")
    probed = classify.classify_flows(ref.index, queries, nprobe=10).select("query_id", "classification", "attack_type")
    assert exact.exceptAll(probed).count() == 0


def test_metadata_json(spark, built, tmp_path):
    _, _, ref = built
    path = str(tmp_path / "info")
    reference_index.export_metadata_json(ref.metadata, ref.space, path)
    rows = {r["traffic_class"]: r for r in reference_index.read_metadata_json(spark, path).collect()}
    assert rows[BENIGN]["num_samples"] == {r["traffic_class"]: r for r in ref.metadata.collect()}[BENIGN]["num_samples"]
    flat = tmp_path / "flat.json"
    flat.write_text(json.dumps({"synscan": {"num_samples": 3, "feature_dim": 25, "index_type": "Flat",
                                            "calibration": {"p5": 0.0, "p95": 1.0}},
                                "feature_selection": {"selected_count": 25}}))
    only = reference_index.read_metadata_json(spark, str(flat)).collect()
    assert [(r["traffic_class"], r["num_samples"], r["calibration"]["p95"]) for r in only] == [("synscan", 3, 1.0)]


def test_single_row_class_has_no_calibration_and_uses_inverse_similarity(spark):
    refs = spark.createDataFrame([("synscan", 1, [1.0])], "grp string, row_id bigint, features array<double>")
    index = knn.build_cells(refs, copies=6)
    from flowwarden.operators.calibration import calibrate

    cal = calibrate(index, refs)
    assert cal.count() == 0
    q = spark.createDataFrame([(9, [4.0], "synscan")], "query_id bigint, features array<double>, grp string")
    assert similar.similar_flows(index, q, 5, cal).first()["similarity"] == pytest.approx(0.1)


def test_quality_report(spark, built):
    root, _, ref = built
    open(os.path.join(root, "index", "attack_type_extra_index.csv"), "w").close()
    write_csv(os.path.join(root, "notes.csv"), [{"a": 1}], ["a", "Proto"])
    report = data_quality.data_quality_report(spark, root, ref)
    files = {r["file_name"]: r for r in report["files"].collect()}
    assert files["benign_index.csv"]["rows"] == 40 and files["benign_index.csv"]["columns"] == 52
    assert files["benign_index.csv"]["status"] == "small" and files["benign_index.csv"]["missing_columns"] == []
    assert files["attack_type_extra_index.csv"]["status"] == "empty"
    assert files["notes.csv"]["missing_columns"] == ["TotPkts", "TotBytes", "Dur"]
    assert files["notes.csv"]["category"] == "unknown"
    assert report["missing"].count() == 0
    assert all(r["found"] for r in report["coverage"].collect())
    assert {r["status"] for r in report["index_health"].collect()} == {"ok"}
    summary = report["summary"].first()
    assert summary["has_benign"] and not summary["few_files"]
    assert report["vector_health"].first()["largest"] > 0


def test_naming(spark):
    names = ["Benign_index.csv", "attack_type_new_index.csv", "x_UDPScan_1.csv", "test_stream.csv", "udp_flood.csv",
             "slowloris_1.csv"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = df.select(flow_csv.class_from_file_name(F.col("f")), flow_csv.class_from_file_name_legacy(F.col("f")),
                    flow_csv.file_category(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [
        ("benign", "benign", "benign"), ("new", None, "unknown"), ("udpscan", "udpscan", "attack"),
        (None, None, "unknown"), (None, "udpflood", "attack"), (None, "slowrateDos", "unknown")]


def test_status(spark):
    df = spark.createDataFrame([(0,), (99,), (100,)], "n bigint")
    assert [r[0] for r in df.select(quality.status(F.col("n"))).collect()] == ["empty", "small", "ok"]
