import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowwarden.operators import knn


def brute(queries, refs, k, metric="l2"):
    """{(query, group): [(row, dist)]} by full scan."""
    out = {}
    for qid, qv, *qg in queries:
        for g in sorted({r[0] for r in refs}):
            if qg and qg[0] != g:
                continue
            found = []
            for rg, rid, rv in refs:
                if rg == g:
                    d = 0.0
                    for a, b in zip(qv, rv):
                        d += (a - b) * (a - b) if metric == "l2" else -a * b
                    found.append((d, rid))
            out[qid, g] = [(rid, d) for d, rid in sorted(found)[:k]]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["grp"], r["rank"])):
        out.setdefault((r["query_id"], r["grp"]), []).append((r["row_id"], r["dist"]))
    return out


def frames(spark, queries, refs):
    q_schema = "query_id bigint, features array<double>" + (", grp string" if len(queries[0]) > 2 else "")
    return (spark.createDataFrame(queries, q_schema).repartition(3),
            spark.createDataFrame(refs, "grp string, row_id bigint, features array<double>").repartition(4))


def skewed(seed=1, n=600, dim=4):
    """A third exact copies, a third in one tight spot, the rest spread; two uneven groups and a tiny one."""
    rng = np.random.default_rng(seed)
    refs = []
    for i in range(n):
        v = [1.0] * dim if i % 3 == 0 else (5 + rng.random(dim) * 1e-3).tolist() if i % 3 == 1 else \
            (rng.random(dim) * 100).round(2).tolist()
        refs.append(("a" if i % 10 else "b", i, v))
    refs.append(("tiny", n, [2.0] * dim))
    queries = [(i, ([1.0] * dim if i % 4 == 0 else (rng.random(dim) * 100).round(2).tolist())) for i in range(80)]
    queries += [(100 + i, [5.0005] * dim) for i in range(40)]
    return queries, refs


@pytest.mark.parametrize("train, rounds", [("sample", 1), ("kmeans", 1), ("sample", 2)])
def test_cells_equal_brute_force_on_skewed_data(spark, train, rounds):
    queries, refs = skewed()
    q, r = frames(spark, queries, refs)
    index = knn.build_cells(r, copies=10, train=train, block_rows=16)
    # tiny blocks force both salts
    assert max(c["salts"].max() for c in index.cells.values()) > 1
    got = collected(knn.search_cells(index, q, 10, query_block=8, rounds=rounds))
    assert got == brute(queries, refs, 10)


def test_copies_beyond_k_are_dropped_without_changing_results(spark):
    queries, refs = skewed()
    _, r = frames(spark, queries, refs)
    kept = knn.drop_surplus_copies(r, 3)
    per_vector = kept.groupBy("grp", "features").count().agg(F.max("count")).first()[0]
    assert per_vector == 3
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


@pytest.mark.parametrize("rounds", [1, 2])
def test_summary_agrees_with_neighbours(spark, rounds):
    queries, refs = skewed()
    q, r = frames(spark, queries, refs)
    index = knn.build_cells(r, copies=10, block_rows=16)
    got = {(x["query_id"], x["grp"]): (x["all_zero"], x["nearest_positive"])
           for x in knn.nearest_summary(index, q, 10, query_block=8, rounds=rounds).collect()}
    for key, hits in brute(queries, refs, 10).items():
        zero = all(d == 0 for _, d in hits)
        assert got[key][0] == zero
        if not zero:
            assert got[key][1] == min(d for _, d in hits if d > 0)


def test_scan_equals_cells_and_respects_groups(spark):
    queries, refs = skewed()
    queries = [(i, v, "a" if i % 2 else "tiny") for i, v in queries]
    q, r = frames(spark, queries, refs)
    want = brute(queries, refs, 4)
    assert collected(knn.search_scan(r, q, 4)) == want
    assert collected(knn.search_cells(knn.build_cells(r, 4), q, 4, rounds=2)) == want
    assert collected(knn.knn_join(q, r, 4, strategy="cells")) == want
    assert collected(knn.knn_join(q, r, 4)) == want


def test_scan_refuses_more_queries_than_it_may_broadcast(spark):
    queries, refs = skewed()
    q, r = frames(spark, queries, refs)
    with pytest.raises(ValueError):
        knn.search_scan(r, q, 3, max_queries=10)


def test_cosine(spark):
    rng = np.random.default_rng(5)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    refs = [("all", i, unit(rng.normal(size=16))) for i in range(150)]
    queries = [(i, unit(rng.normal(size=16))) for i in range(30)]
    q, r = frames(spark, queries, refs)
    want = brute(queries, refs, 5, "cosine")
    got = collected(knn.knn_join(q, r, 5, "cosine", "cells"))
    two = collected(knn.search_cells(knn.build_cells(r, 5, metric="cosine"), q, 5, rounds=2))
    assert {k: [x for x, _ in v] for k, v in two.items()} == {k: [x for x, _ in v] for k, v in want.items()}
    assert {k: [x for x, _ in v] for k, v in got.items()} == {k: [x for x, _ in v] for k, v in want.items()}


def test_probing_all_cells_is_exact_and_few_cells_recall_well(spark):
    queries, refs = skewed(2)
    q, r = frames(spark, queries, refs)
    want = brute(queries, refs, 10)
    index = knn.build_cells(r, copies=10, cells_for=lambda g, n: 12, train="kmeans")
    assert collected(knn.search_cells(index, q, 10, nprobe=12)) == want
    few = collected(knn.search_cells(index, q, 10, nprobe=4))
    hits = sum(len({x for x, _ in few[k]} & {x for x, _ in v}) for k, v in want.items())
    assert hits / sum(len(v) for v in want.values()) > 0.8


def test_missing_components_and_unknown_groups(spark):
    refs = [("a", 1, [0.0, float("nan")]), ("a", 2, [0.0, 3.0]), ("a", 3, None)]
    q = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [0.0, 0.0], "zzz")],
                              "id bigint, v array<double>, g string")
    r = spark.createDataFrame(refs, "g string, row_id bigint, v array<double>")
    found = knn.knn_join(knn.query_rows(q, "id", "v", "g"), knn.reference_rows(r, "row_id", "v", "g"), 5,
                         strategy="cells")
    assert collected(found) == {(1, "a"): [(1, 0.0), (2, 9.0)]}


def test_empty_sides(spark):
    queries, refs = skewed()
    q, r = frames(spark, queries, refs)
    assert knn.knn_join(q, r.where("false"), 3, strategy="cells").count() == 0
    assert knn.knn_join(q.where("false"), r, 3, strategy="cells").count() == 0
    assert knn.knn_join(q.where("false"), r, 3).count() == 0
    assert knn.search_cells(knn.build_cells(r), q.where("false"), 3, rounds=2).count() == 0


def test_index_must_keep_enough_copies(spark):
    queries, refs = skewed()
    q, r = frames(spark, queries, refs)
    with pytest.raises(ValueError):
        knn.search_cells(knn.build_cells(r, copies=3), q, 4)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=60),
       st.integers(1, 6))
def test_grid_points_with_many_ties(spark, points, k):
    refs = [(g, i, [float(x), float(y)]) for i, (g, x, y) in enumerate(points)]
    queries = [(i, [float(i % 5), float(i % 3)]) for i in range(10)]
    q, r = frames(spark, queries, refs)
    assert collected(knn.knn_join(q, r, k, strategy="cells")) == brute(queries, refs, k)


def test_local_plan_has_no_cross_join(spark):
    queries, refs = skewed()
    q, r = frames(spark, queries, refs)
    plan = knn.search_cells(knn.build_cells(r), q, 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
