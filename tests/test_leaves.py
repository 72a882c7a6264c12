"""Leaves, work units of several cells and what travels to them, against plain loops."""

import numpy as np
import pyarrow as pa
import pytest

from flowwarden.operators import knn, leaves


def points(kind, rows, dim, seed):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 5, (rows, dim)).astype(float) if kind == "grid" else rng.normal(size=(rows, dim))


@pytest.mark.parametrize("kind", ["grid", "normal"])
@pytest.mark.parametrize(("rows", "dim", "k"), [(2500, 3, 10), (40, 2, 5), (6, 3, 10), (900, 12, 4), (1, 1, 3)])
def test_leaves_equal_brute_force(kind, rows, dim, k):
    r, q = points(kind, rows, dim, 1), points(kind, 150, dim, 2)
    d2 = knn._exact_all(q, r, "l2")
    part, bounds = np.random.default_rng(3).integers(0, 4, rows), np.full(len(q), np.inf)
    allowed = np.random.default_rng(4).random((len(q), 4)) < 0.5
    for tree in (leaves.Leaves(r), leaves.Leaves(r, part)):
        want = np.argsort(d2, axis=1, kind="stable")[:, :k]
        kth = np.take_along_axis(d2, want, 1)[:, -1]
        for known in (bounds, kth):
            qi, ri, dist = leaves.top(q, tree, known, k)
            assert np.array_equal(ri, want.ravel()) and np.array_equal(dist, np.take_along_axis(d2, want, 1).ravel())
            assert np.array_equal(qi, np.repeat(np.arange(len(q)), want.shape[1]))
        zeros, nearest = leaves.summary(q, tree, bounds)
        assert np.array_equal(zeros, (d2 == 0).sum(1)) and np.array_equal(nearest, np.where(d2 > 0, d2, np.inf).min(1))
    qi, ri, _ = leaves.top(q, tree, bounds, k, allowed)
    among = np.where(allowed[:, part], d2, np.inf)
    want = [i for row in among for i in np.argsort(row, kind="stable")[:min(k, np.isfinite(row).sum())]]
    assert ri.tolist() == want


def test_leaves_leave_most_rows_out(monkeypatch):
    r, q = points("normal", 20000, 3, 5), points("normal", 10000, 3, 6)
    tree, pairs, to_rows = leaves.Leaves(r), [], leaves.Leaves.to_rows
    monkeypatch.setattr(leaves.Leaves, "to_rows", lambda *a: (pairs.append((d := to_rows(*a)).size), d)[1])
    leaves.top(q, tree, np.full(len(q), np.inf), 10)
    assert sum(pairs) < 0.25 * len(r) * len(q)


def test_few_probed_cells_equal_a_plain_loop(spark):
    """The nearest rows among those of the three nearest centres, ties by id."""
    r, q = points("normal", 600, 3, 7), points("normal", 40, 3, 8)
    refs = spark.createDataFrame([("ab"[i % 2], i, v.tolist()) for i, v in enumerate(r)], "grp string, row_id long, features array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, features array<double>")
    index = knn.build_cells(refs, cells_for=lambda g, n: 12, train="kmeans", train_rounds=2)
    got = {}
    for x in knn.search_cells(index, asked, 5, nprobe=3).orderBy("rank").collect():
        got.setdefault((x.query_id, x.grp), []).append(x.row_id)
    for g, c in index.centres.items():
        mine = np.flatnonzero(np.arange(600) % 2 == "ab".index(g))
        cell = ((r[mine][:, None] - c[None]) ** 2).sum(2).argmin(1)
        for i, v in enumerate(q):
            near = np.argsort(((v - c) ** 2).sum(1), kind="stable")[:3]
            some = mine[np.isin(cell, near)]
            assert got[i, g] == some[np.argsort(((v - r[some]) ** 2).sum(1), kind="stable")[:5]].tolist()


@pytest.mark.parametrize("nprobe", [None, 30])
def test_a_query_travels_to_a_unit_once(spark, nprobe):
    """30 cells of one class are one unit: not 30 copies of each query, and batches of bounded bytes."""
    r, q = points("normal", 900, 40, 9), points("normal", 700, 40, 10)
    refs = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(r)], "grp string, row_id long, features array<double>")
    plan = knn._Probe(knn.build_cells(refs, cells_for=lambda g, n: 30, metric="cosine"), 5, nprobe)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(700)), pa.array(q.tolist()), pa.array(range(700))], names=["query_id", "features", "h"])
    counted = pa.Table.from_batches(knn._count_kernel(plan)([batch])).to_pylist()
    assert [(x["unit"], x["n"]) for x in counted if x["unit"] is not None] == [(0, 700)]
    assert sorted(x["cell"] for x in counted if x["cell"] is not None) == list(range(30))
    packed = pa.Table.from_batches(knn._pack_kernel(plan, {0: 3})([batch])).to_pylist()
    assert sorted(i for x in packed for i in x["ids"]) == list(range(700)) and {x["qsalt"] for x in packed} == {0, 1, 2}


def test_packed_batches_are_bounded(spark, monkeypatch):
    r, q = points("normal", 4000, 40, 11), points("normal", 500, 40, 12)
    refs = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(r)], "grp string, row_id long, features array<double>")
    monkeypatch.setattr(knn, "UNIT_ROWS", 1024)
    monkeypatch.setattr(knn, "PACK_BYTES", 100 * 8 * 40)
    plan = knn._Probe(knn.build_cells(refs, cells_for=lambda g, n: 40, metric="cosine"), 5)
    assert len(plan.salts) >= 4
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(500)), pa.array(q.tolist()), pa.array(range(500))], names=["query_id", "features", "h"])
    sizes = [sum(map(len, b.column("ids").to_pylist())) for b in knn._pack_kernel(plan, dict.fromkeys(range(len(plan.salts)), 1))([batch])]
    assert max(sizes) <= 100 and sum(sizes) >= 4 * 450


@pytest.mark.parametrize("units", [1, 6])
def test_two_rounds_visit_other_units_only_where_there_are_any(spark, monkeypatch, units):
    r, q = points("normal", 7000, 3, 13), points("normal", 300, 3, 14)
    refs = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(r)], "grp string, row_id long, features array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, features array<double>")
    monkeypatch.setattr(knn, "UNIT_ROWS", 7000 if units == 1 else 1200)
    modes, run = [], knn._run_units
    monkeypatch.setattr(knn, "_run_units", lambda i, q, plan, *a: (modes.append(plan.mode), run(i, q, plan, *a))[1])
    index = knn.build_cells(refs)
    want = np.argsort(knn._exact_all(q, r, "l2"), axis=1, kind="stable")[:, :10]
    found = knn.search_cells(index, asked, 10, rounds=2).orderBy("query_id", "rank").collect()
    assert [x.row_id for x in found] == want.ravel().tolist()
    least = {x.query_id: x.nearest_positive for x in knn.nearest_summary(index, asked, 10, rounds=2).collect()}
    assert least == {i: pytest.approx(((r[w[0]] - v) ** 2).sum()) for i, (w, v) in enumerate(zip(want, q))}
    assert modes == (["home"] if units == 1 else ["home", "rest"]) * 2
