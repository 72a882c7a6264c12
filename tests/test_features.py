import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.functions.flow_features import flow_features
from flowwarden.operators import cleaning, encoding, scaling, splitting
from flowwarden.plans import preprocessing
from flowwarden.schemas import FLOW_EVENT


def test_numbers(spark):
    texts = ["3.5", " 3.5 ", "x", "", None, "nan", "1e3", "-2", "5d", "7F", "0x10"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(cleaning.to_number(F.col("t"))).collect()]
    assert got == [3.5, 3.5, 0.0, 0.0, 0.0, 0.0, 1000.0, -2.0, 0.0, 0.0, 0.0]


def test_clean_flows(spark):
    df = spark.createDataFrame([("abc", None, None, None, "l"), ("2", "tcp", "0.0", "x", None)],
                               "Dur string, Proto string, sTos string, note string, Label string")
    a, b = cleaning.clean_flows(df).collect()
    assert (a["Dur"], a["Proto"], a["sTos"], a["note"], a["Label"]) == (0.0, "nan", "0.0", "nan", "l")
    assert (b["Dur"], b["Proto"], b["note"], b["Label"]) == (2.0, "tcp", "x", None)
    assert cleaning.clean_flows_legacy(df).first()["sTos"] == 0.0


def test_align(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "b double, extra double")
    out = cleaning.align(df, ["a", "b"])
    assert out.columns == ["a", "b"] and tuple(out.first()) == (0.0, 1.0)


def test_codes_follow_byte_order_and_unseen_takes_unknown(spark):
    df = spark.createDataFrame([("b",), ("B",), ("é",), ("zz",), (None,)], "c string")
    codes = encoding.category_codes(df, ["c"])
    assert {r["value"]: r["code"] for r in codes.collect()} == {"B": 0, "b": 1, "unknown": 2, "zz": 3, "é": 4}
    seen = spark.createDataFrame([("zz",), ("new",), (None,)], "c string")
    assert [r["c_le"] for r in encoding.encode(seen, codes, ["c"]).collect()] == [3.0, 2.0, 2.0]


def test_scaler_and_anova_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(1e6, 3, (300, 3)), 3)
    y = np.array(["a", "b", "c"])[np.arange(300) % 3]
    x[y == "b", 1] += 5
    df = spark.createDataFrame([(*map(float, r), 4.0, str(c)) for r, c in zip(x, y)],
                               "f0 double, f1 double, f2 double, f3 double, y string")
    names = ["f0", "f1", "f2", "f3"]
    direct = {r["feature"]: r for r in scaling.scaler_fit(df, names).collect()}
    moments = scaling.class_moments(df, names, "y")
    pooled = {r["feature"]: r for r in scaling.scaler_from_moments(moments).collect()}
    for i in range(3):
        for got in (direct, pooled):
            assert got[f"f{i}"]["mean"] == pytest.approx(x[:, i].mean(), rel=1e-12)
            assert got[f"f{i}"]["std"] == pytest.approx(x[:, i].std(), rel=1e-9)
    assert direct["f3"]["scale"] == pooled["f3"]["scale"] == 1.0
    scores = {r["feature"]: r["f_score"] for r in scaling.anova_f(df, names, "y").collect()}
    for i in range(3):
        groups = [x[y == c, i] for c in "abc"]
        between = sum(len(g) * (g.mean() - x[:, i].mean()) ** 2 for g in groups) / 2
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 297
        assert scores[f"f{i}"] == pytest.approx(between / within, rel=1e-6)
    assert math.isnan(scores["f3"])
    best = [r["feature"] for r in scaling.select_k_best(scaling.anova_f(df, names, "y"), 2).collect()]
    assert best == [f for f in names if f in sorted(names[:3], key=lambda f: -scores[f])[:2]]


def test_selection_ties_keep_the_later_feature(spark):
    scores = spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0), (2, "c", float("nan")), (3, "d", float("inf"))],
                                   "pos int, feature string, f_score double")
    assert [r["feature"] for r in scaling.select_k_best(scores, 2).collect()] == ["b", "d"]


def test_split_is_disjoint_complete_and_repeatable(spark):
    df = spark.range(4000).withColumn("c", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    halves = splitting.split(df, "c", "id").persist()
    counts = {r["traffic_class"]: r for r in splitting.split_counts(halves, "c").collect()}
    assert counts[None]["total_rows"] == 4000
    assert all(0.45 < r["test_rows"] / r["total_rows"] < 0.55 for r in counts.values())
    again = splitting.split(df.repartition(5), "c", "id")
    assert halves.exceptAll(again.select(halves.columns)).count() == 0


def test_sampling_threshold_does_not_change_the_sample(spark):
    df = spark.range(3000).withColumn("c", F.when(F.col("id") < 2000, "big").when(F.col("id") < 2990, "mid").otherwise("s"))
    got = {(r["c"], r["id"]) for r in splitting.sample_per_group(df, "c", "id", 50).collect()}
    import hashlib

    want = set()
    for c, ids in (("big", range(2000)), ("mid", range(2000, 2990)), ("s", range(2990, 3000))):
        ranked = sorted(ids, key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
        want |= {(c, i) for i in ranked[:50]}
    assert got == want


def test_sample_per_class_takes_three_thousand_rows_of_a_class(spark, tmp_path):
    """The size of the reference's calibration sample, in the query and in its SQL alike; smaller classes stay whole."""
    import catalog
    import duckdb
    import hashlib

    catalog.load_all()
    sizes = {"view": 3500, "click": 3000, "error": 150}
    kinds = [c for c, n in sizes.items() for _ in range(n)]
    spark.createDataFrame(enumerate(kinds), "event_id bigint, event_type string").selectExpr(
        "event_id", "timestamp'2024-01-01 00:00:00' AS ts", "event_id AS user_id", "event_type", "1.0D AS value",
        "'{\"k\": 1}' AS props").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    want = set()
    for c in sizes:
        ids = [i for i, kind in enumerate(kinds) if kind == c]
        ranked = sorted(ids, key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
        want |= {("benign" if c == "view" else c, i) for i in ranked[:3000]}
    assert len(want) == 3000 + 3000 + 150
    got = [(r["traffic_class"], r["flow_id"]) for r in catalog.QUERIES["sample_per_class"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert set(connection.sql(catalog.ORACLES["sample_per_class"]).fetchall()) == want


def test_sample_per_class_keeps_rows_without_class_apart_and_rows_without_id_last(spark, tmp_path):
    from collections import Counter

    import catalog
    import duckdb

    catalog.load_all()
    kinds = [None] * 3200 + ["unknown"] * 3100 + [""] * 3050 + ["signup"] * 4000
    rows = [(None if kind == "signup" and i % 8 < 3 else i, kind) for i, kind in enumerate(kinds)]
    spark.createDataFrame(rows, "event_id bigint, event_type string").selectExpr(
        "event_id", "timestamp'2024-01-01 00:00:00' AS ts", "event_id AS user_id", "event_type", "1.0D AS value",
        "'{\"k\": 1}' AS props").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    got = Counter((r["traffic_class"], r["flow_id"]) for r in catalog.QUERIES["sample_per_class"](spark, str(tmp_path)).collect())
    assert Counter(c for c, _ in got.elements()) == {None: 3000, "unknown": 3000, "": 3000, "signup": 3000}
    assert got["signup", None] == 500  # 2,500 rows have an id
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert Counter(connection.sql(catalog.ORACLES["sample_per_class"]).fetchall()) == got


def test_split_summary_roundtrip(spark, tmp_path):
    df = spark.range(100).withColumn("c", F.when(F.col("id") % 4 == 0, "x").otherwise("y"))
    counts = splitting.split_counts(splitting.split(df, "c", "id"), "c")
    path = str(tmp_path / "summary")
    splitting.split_summary(counts).coalesce(1).write.json(path)
    back = {tuple(r) for r in splitting.read_split_summary(spark, path).collect()}
    assert back == {tuple(r) for r in counts.collect()}


def test_flow_features(spark):
    rows = [("t", "a", "b", 1, 2, "UDP", 1001, 7, 0.0, "SYN"), ("t", "a", "b", 1, 2, "weird", 1, 1, 2.0, "?"),
            ("t", "a", "b", 1, 2, "icmp", 0, 0, 2.0, "ICMP")]
    a, b, c = flow_features(spark.createDataFrame(rows, FLOW_EVENT), ["src_ip"]).collect()
    assert (a["Proto"], a["State"], a["SrcPkts"], a["DstPkts"], a["SrcBytes"], a["DstBytes"]) == ("udp", "REQ", 3, 4, 500, 501)
    assert a["Rate"] == pytest.approx(1001 / 0.001) and a["TcpRtt"] == 0.0 and a["AckDat"] == 0.0
    assert (b["Proto"], b["State"], b["TcpRtt"], b["AckDat"], b["SrcPkts"]) == ("tcp", "CON", 2000.0, 1.0, 1)
    assert (c["Proto"], c["State"], c["sMeanPktSz"], c["SrcBytes"]) == ("icmp", "ECO", 0.0, 1)
    assert 50 <= a["sTtl"] <= 255 and 1 <= a["sHops"] <= 20 and 1000 <= a["Offset"] <= 200000
    assert len(a) == 49


def test_feature_space_roundtrip_and_unseen(spark, tmp_path):
    rows = [(float(i % 7), float(i), "tcp" if i % 2 else "udp", "benign" if i % 3 else "synscan") for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, Proto string, traffic_class string")
    space = preprocessing.fit(df, k=2)
    assert space.names == ["x", "y", "Proto_le"] and len(space.selected) == 2
    space.save(str(tmp_path))
    back = preprocessing.FeatureSpace.load(spark, str(tmp_path))
    fresh = spark.createDataFrame([(1, 2.0, "gre"), (2, None, None)], "id int, x double, Proto string")
    a = space.featurize(fresh, ["id"]).orderBy("id").collect()
    assert a == back.featurize(fresh, ["id"]).orderBy("id").collect()
    assert all(len(r["features"]) == 2 for r in a)
    assert back.thresholds == space.thresholds and back.temperature == space.temperature


def test_legacy_space(spark):
    df = spark.createDataFrame([(1, 1.0, "udp", "benign"), (2, 2.0, "tcp", "synscan"), (3, 9.0, "tcp", "synscan"),
                                (4, 1.5, "icmp", "benign")], "Seq int, x double, Proto string, traffic_class string")
    space = preprocessing.fit_legacy(df)
    assert space.names == ["Seq", "x", "Proto_le"]
    codes = {r["value"]: r["code"] for r in space.codes.collect()}
    assert codes == {"icmp": 0, "udp": 1}
    assert space.encoded(df).where("Seq = 2").first()["Proto_le"] == 0.0
