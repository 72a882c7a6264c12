import math

import pytest
from pyspark.sql import functions as F

from flowwarden.functions import scoring
from flowwarden.plans import classify


def similarity(d):
    if d > 1000:
        return 0.0
    if d > 100:
        return 0.1
    if d > 10:
        return 0.3 + 0.4 * math.exp(-d / 50)
    return 0.7 + 0.3 * math.exp(-d / 5)


def test_bands(spark):
    edges = [0.0, 1e-9, 5.0, 10.0, 10.000001, 69.0, 50 * math.log(4), 70.0, 100.0, 100.1, 1000.0, 1000.5, 1e12]
    df = spark.createDataFrame([(d,) for d in edges], "d double")
    for r in df.select("d", scoring.distance_similarity(F.col("d")).alias("s")).collect():
        assert r["s"] == pytest.approx(similarity(r["d"]), abs=1e-12)


@pytest.mark.parametrize("benign, attack, label, confidence, kind", [
    (0.0, 0.41, "malicious", 0.70, "x"), (1.0, 0.95, "malicious", 0.95, "x"), (1.0, 0.6, "malicious", 0.8, "x"),
    (1.0, 0.4, "suspicious", 0.55, "x"), (0.0, 0.26, "suspicious", 0.55, "x"),
    (0.31, 0.25, "benign", 0.60, None), (0.95, 0.1, "benign", 0.90, None), (0.7, 0.0, "benign", 0.8, None),
    (0.3, 0.1, "benign", 0.5, None)])
def test_decision(spark, benign, attack, label, confidence, kind):
    d = scoring.decision(F.lit(benign), F.lit(attack), F.lit("x"))
    r = spark.range(1).select(d.alias("d")).select("d.*").first()
    assert (r["classification"], r["attack_type"]) == (label, kind)
    assert r["confidence"] == pytest.approx(confidence)


def test_zero_distance_modes(spark):
    df = spark.createDataFrame([(True, None), (False, 4.0), (False, None)], "z boolean, d double")
    ref = [r[0] for r in df.select(scoring.neighbour_score(F.col("z"), F.col("d"))).collect()]
    match = [r[0] for r in df.select(scoring.neighbour_score(F.col("z"), F.col("d"), "match")).collect()]
    assert ref[0] == 0.0 and match[0] == 1.0
    assert ref[1] == match[1] == pytest.approx(similarity(4.0))
    assert ref[2] == 0.0


def test_calibrated_and_softmax(spark):
    df = spark.createDataFrame([(5.0, 1.0, 9.0), (0.0, 1.0, 9.0), (99.0, 1.0, 9.0), (3.0, 2.0, 2.0), (3.0, None, None)],
                               "d double, p5 double, p95 double")
    s = scoring.similarity_with_calibration(F.col("d"), F.col("p5"), F.col("p95"))
    assert [r[0] for r in df.select(s).collect()] == [0.5, 1.0, 0.0, 0.5, 0.25]
    p = spark.range(1).select(scoring.softmax_pair(F.lit(0.9), F.lit(0.2), 0.35).alias("p")).first()["p"]
    assert p["p1"] + p["p2"] == pytest.approx(1.0) and p["p1"] == pytest.approx(1 / (1 + math.exp(-2)))


def neighbours(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, grp string, row_id bigint, dist double, rank int")


def test_classification_from_neighbours(spark):
    rows = [(1, "benign", i, 1.0, i + 1) for i in range(10)]
    rows += [(1, "udpscan", i, 500.0, i + 1) for i in range(10)]
    rows += [(2, "synscan", i, 3.0, i + 1) for i in range(3)] + [(2, "httpflood", i, 3.0, i + 1) for i in range(3)]
    rows += [(3, "synscan", i, 0.0, i + 1) for i in range(10)]
    rows += [(4, "synscan", 0, 0.0, 1), (4, "synscan", 1, 2.0, 2)]
    got = {r["query_id"]: r for r in classify.classify_neighbours(neighbours(spark, rows)).collect()}
    assert got[1]["classification"] == "benign" and got[1]["attack_type"] is None
    assert got[2]["attack_type"] == "httpflood"  # equal scores: first class by name
    assert (got[3]["classification"], got[3]["confidence"]) == ("benign", 0.5)  # only copies: no evidence
    assert got[4]["attack_score"] == pytest.approx(similarity(2.0))


def test_legacy_classification(spark):
    rows = [(1, "benign", i, 0.01, i + 1) for i in range(5)] + [(1, "udpscan", i, 0.0, i + 1) for i in range(5)]
    rows += [(2, "benign", 0, 9.0, 1), (2, "udpscan", 0, 0.1, 1), (2, "udpscan", 1, 0.1, 2), (2, "udpscan", 2, 0.1, 3),
             (2, "udpscan", 3, 900.0, 4)]
    rows += [(3, "udpscan", 0, 1.0, 1)]
    got = {r["query_id"]: r for r in classify.classify_neighbours_legacy(neighbours(spark, rows)).collect()}
    assert got[1]["classification"] == "benign" and got[1]["confidence"] == pytest.approx(1 / 1.01)
    assert got[2]["classification"] == "malicious" and got[2]["confidence"] == pytest.approx(1 / 1.1)
    assert got[3]["classification"] == "suspicious" and got[3]["confidence"] == 0.5


def test_unscored_flows_are_unknown(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    results = classify.classify_neighbours(neighbours(spark, [(1, "benign", 1, 1.0, 1)]))
    got = {r["query_id"]: r["classification"] for r in classify.with_unclassified(results, queries).collect()}
    assert got == {1: "benign", 2: "unknown"}
