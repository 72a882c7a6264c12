"""The blocked product join and k-means over all groups, against brute force."""

import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.operators import blocks, history, knn, lloyd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def frames(spark, rng, n, m, dim, groups=3):
    refs = [(i, [float(x) for x in rng.normal(size=dim).round(1)], f"g{int(rng.integers(groups))}") for i in range(n)]
    refs += [(n + i, refs[0][1], refs[0][2]) for i in range(9)]  # copies: ties by id
    queries = [(i, [float(x) for x in rng.normal(size=dim).round(1)], f"g{int(rng.integers(groups + 1))}") for i in range(m)]
    schema = "id long, v array<double>, g string"
    return refs, queries, spark.createDataFrame(refs, schema), spark.createDataFrame(queries, schema)


def brute(refs, queries, k, metric, own_group):
    out = []
    for i, q, qg in queries:
        by_group = {}
        for j, r, rg in refs:
            a, b = np.array(q), np.array(r)
            if metric == "cosine":
                a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
            d = -sum(x * y for x, y in zip(a, b)) if metric == "cosine" else sum((x - y) ** 2 for x, y in zip(a, b))
            if not own_group or rg == qg:
                by_group.setdefault(rg, []).append((d, j))
        for g, found in by_group.items():
            out += [(i, g, j, rank + 1, round(d, 9)) for rank, (d, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def collected(df):
    return sorted((r.query_id, r.grp, r.row_id, r["rank"], round(r.dist, 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block_bytes", [1 << 24, 12 * 8 * 20])
def test_blocks_equal_brute_force(spark, metric, block_bytes):
    refs, queries, r, q = frames(spark, np.random.default_rng(4), 90, 40, 12)
    rows, asked = knn.reference_rows(r, "id", "v", "g"), knn.query_rows(q, "id", "v")
    assert collected(blocks.search_blocks(rows, asked, 4, metric, block_bytes)) == brute(refs, queries, 4, metric, False)
    within = blocks.search_blocks(rows, knn.query_rows(q, "id", "v", "g"), 4, metric, block_bytes)
    assert collected(within) == brute(refs, queries, 4, metric, True)


def test_blocks_of_empty_tables(spark):
    _, _, r, q = frames(spark, np.random.default_rng(4), 20, 5, 4)
    rows, asked = knn.reference_rows(r, "id", "v"), knn.query_rows(q, "id", "v")
    assert blocks.search_blocks(rows.where("false"), asked, 3).count() == 0
    assert blocks.search_blocks(rows, asked.where("false"), 3).count() == 0


def test_each_query_is_shipped_once_to_every_block(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows, asked = knn.reference_rows(e, "vec_id", "embedding"), knn.query_rows(e, "vec_id", "embedding")
    n, block_rows = e.count(), 60
    plan = blocks.plan_blocks(rows, asked, block_rows * 8 * 64)
    shipped = blocks.query_blocks(asked, plan).groupBy("query_id").count().agg(F.max("count"), F.count("*")).first()
    assert tuple(shipped) == (math.ceil(n / block_rows), n)
    assert blocks.query_blocks(asked, blocks.plan_blocks(rows, asked)).count() == n


def test_a_worker_stays_below_half_a_gigabyte(tmp_path):
    """20,000 references and 5,000 queries of 384 dimensions, in workers of their own."""
    script = tmp_path / "run.py"
    script.write_text(f"""
import resource, sys
sys.path.insert(0, {ROOT!r})
import pyarrow as pa
from pyspark.sql import functions as F
from flowwarden.operators import blocks, knn
from flowwarden.session import build_session
spark = build_session("memory", "local[4]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}})
vector = F.transform(F.sequence(F.lit(1), F.lit(384)), lambda j: (F.xxhash64("id", j) % 1000) / 1000.0)
refs = spark.range(20000).withColumn("v", vector)
found = blocks.search_blocks(knn.reference_rows(refs, "id", "v"), knn.query_rows(refs.where("id % 4 = 0"), "id", "v"), 5)
assert found.where("rank = 1 and query_id = row_id").count() == 5000
def peak(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss] * batch.num_rows)], ["kb"])
print("peak", spark.range(1000).repartition(16).mapInArrow(peak, "kb long").agg(F.max("kb")).first()[0] // 1024)
""")
    out = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=600, check=True).stdout
    assert int(out.split("peak")[1]) < 512


def test_history_search_uses_blocks(spark):
    rng = random.Random(2)
    docs = [(i, f"t{i % 3}", i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(5)], f"text {i}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_index long, attack_type string, ts long, embedding array<double>, text string")
    asked = df.where("doc_index < 30").select(F.col("doc_index").alias("query_id"), "attack_type", "embedding")
    for strategy in ("blocks", "cells"):
        same = history.search(df, asked, 3, strategy=strategy, attach=False).select("query_id", "doc_index", "rank")
        got = sorted(tuple(r) for r in same.collect())
        assert len(got) == 90 and (strategy == "blocks" or got == first)
        first = got


def test_lloyd_equals_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=3).round(2) + 5 * (i % 4)], "ab"[i % 2]) for i in range(400)]
    df = knn.reference_rows(spark.createDataFrame(rows, "id long, v array<double>, g string"), "id", "v", "g")
    start = lloyd.first_centres(df, {"a": 5, "b": 3}, 42)
    assert {g: len(c) for g, c in start.items()} == {"a": 5, "b": 3}
    got = lloyd.fit_centres(df, start, rounds=6)
    again = lloyd.fit_centres(df.repartition(7), start, rounds=6)
    for g in "ab":
        x, c = np.array([v for _, v, own in rows if own == g]), start[g]
        for _ in range(6):
            at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
        assert np.allclose(got[g], c, atol=1e-9) and np.array_equal(got[g], again[g])


def test_nearest_breaks_ties_by_difference():
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (500, 4)).astype(float) * 1e3
    c = rng.integers(-3, 4, (40, 4)).astype(float) * 1e3
    want = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert np.array_equal(knn.nearest(x, c), want)


def test_more_cells_than_the_budget_is_an_error(spark, monkeypatch):
    _, _, r, _ = frames(spark, np.random.default_rng(4), 60, 1, 4, groups=2)
    monkeypatch.setattr(knn, "CELL_BUDGET", 20)
    with pytest.raises(ValueError, match="cells asked for"):
        knn.build_cells(knn.reference_rows(r, "id", "v", "g"), cells_for=lambda g, n: n)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_equal_rows_are_compared_once(monkeypatch, metric):
    rng = np.random.default_rng(6)
    q, r = rng.integers(1, 4, (600, 5)).astype(float)[rng.integers(0, 4, 5000)], rng.integers(1, 4, (3, 5)).astype(float)[rng.integers(0, 3, 9000)]
    pairs = []
    exact = knn._exact
    monkeypatch.setattr(knn, "_exact", lambda q, r, qi, ri, m: (pairs.append(len(qi)), exact(q, r, qi, ri, m))[1])
    monkeypatch.setattr(knn, "_exact_all", lambda *a: pytest.fail("the whole block was compared"))
    qi, ri, dist = knn._block_topk(q, r, np.full(len(q), np.inf), 4, metric)
    monkeypatch.undo()
    all_pairs = knn._exact_all(q[:50], r, metric)
    want = np.argsort(all_pairs, axis=1, kind="stable")[:, :4]
    assert np.array_equal(qi, np.repeat(np.arange(5000), 4)) and sum(pairs) <= 4 * 3 * 4
    assert np.array_equal(ri[:200].reshape(50, 4), want)
    assert np.array_equal(dist[:200].reshape(50, 4), np.take_along_axis(all_pairs, want, 1))


def test_many_ties_beside_vectors_of_length_zero():
    """Distances of equal size by the thousand in several chunks, and vectors without a direction."""
    rng = np.random.default_rng(8)
    for metric, k in (("l2", 10), ("cosine", 3)):
        r, q = rng.integers(0, 2, (2, 9500, 14)).astype(float)
        q = q[:300]
        if metric == "cosine":
            r[::7], q[3] = 0, 0
            r, q = knn._unit(r), knn._unit(q)
        qi, ri, dist = knn._block_topk(q, r, np.full(len(q), np.inf), k, metric)
        all_pairs = knn._exact_all(q, r, metric)
        want = np.argsort(all_pairs, axis=1, kind="stable")[:, :k]
        assert np.array_equal(ri.reshape(-1, k), want) and np.array_equal(dist, np.take_along_axis(all_pairs, want, 1).ravel())


def test_a_narrow_table_is_searched_by_more_than_one_task(spark):
    """20,000 rows of 4 dimensions are far less than a block, yet 400 million pairs."""
    df = spark.range(20000).select("id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: (F.xxhash64("id", j) % 1000) / 1000.0).alias("v"))
    rows, asked = knn.reference_rows(df, "id", "v"), knn.query_rows(df, "id", "v")
    plan = blocks.plan_blocks(rows, asked).first()
    assert plan.blocks == 1 and plan.qblocks >= spark.sparkContext.defaultParallelism
    found = blocks.search_blocks(rows, asked, 2, "l2")
    assert found.where("rank = 1 and query_id = row_id and dist = 0").count() == 20000
