"""Cases that once gave wrong results, and plain forms of two operators."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.llm import nbsvm, pii, sharding, substring, topk, warc


def test_scores_of_large_components(spark):
    df = spark.createDataFrame([(1, [20000.0, 1.0]), (2, [20000.0, 0.0]), (3, [40000.0, 0.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id = 1"), df, 2).collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 20000 * 256 * 40000 * 256), (2, 20000 * 256 * 20000 * 256)]
    wide = spark.createDataFrame([(1, [1e7]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(wide.where("vec_id = 1"), wide, 1).first().score == 2_560_000_000 * 512
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(*[spark.createDataFrame([(1, [1e9]), (2, [1e8])], "vec_id long, embedding array<double>")] * 2)


def test_texts_without_id_whose_short_hashes_clash(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(f"{rng.randrange(10 ** 9)}" for _ in range(22))) for i in range(120_000)]
    df = spark.createDataFrame(texts, "n long, text string").withColumn("h", F.xxhash64("text").bitwiseAND(0x7FFFFFFF))
    clash = df.groupBy("h").agg(F.collect_list("text").alias("t")).where(F.size("t") > 1).first()
    a, b = clash.t[:2]
    rows = spark.createDataFrame([(1, a), (None, a), (None, b)], "doc_id long, text string")
    got = sorted((r.doc_id or 9, r.n_removed) for r in substring.remove_copies(rows).collect())
    assert got == [(1, 0), (9, 0), (9, 22)]


def test_equal_rows_are_dealt_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_REPEATS", 500)
    df = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")).union(
        spark.range(6000).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string"))))
    got = sharding.uniform_shards(df, 24).groupBy("shard").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("doc_id") == 7, 1)).alias("equal"), F.countDistinct("slot").alias("slots")).collect()
    assert len(got) == 24 and {(r.n, r.slots) for r in got} == {(500, 500)}
    # hypergeometric: mean 250, deviation about 11
    assert all(190 < r.equal < 310 for r in got)


def test_shards_like_the_plain_permutations(spark):
    """The same draws, permutations and pieces in plain Python, from the keys alone."""
    rows = [(i, "x" * (i % 9)) for i in range(300)] + [(5, "xxxxx")] * 3 + [(None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seed, shards = 7, 5
    base = sharding._told_apart(df.select(
        F.col("doc_id").alias("id"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")))
    keys = base.withColumn("k", F.xxhash64(F.lit(seed), "id", "text_crc32", "size", "number"))
    keys = keys.withColumn("k1", F.xxhash64(F.lit(seed + 1), "k"))
    for s in range(shards):
        keys = keys.withColumn(f"k2_{s}", F.xxhash64(F.lit(seed + 2), "k", F.lit(s).cast("int")))
    keys = [r.asDict() for r in keys.collect()]
    n = len(keys)
    parts = 16 + int(n ** 0.5)
    bucket = lambda k, m: int(((k % 2 ** 64) >> 32) * m / 2 ** 32)
    by_part = collections.defaultdict(list)
    for r in keys:
        by_part[bucket(r["k"], parts)].append(r)
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = sharding.communication_matrix([len(by_part[p]) for p in range(parts)], sizes, seed)
    dealt = collections.defaultdict(list)
    for p in range(parts):
        order, at = sorted(by_part[p], key=lambda r: r["k1"]), 0
        for s, count in enumerate(matrix[p]):
            dealt[s] += order[at:at + count]
            at += count
    pieces = -(-parts // shards)
    named = lambda x: -1 if x is None else x
    want = sorted((named(r["id"]), r["size"], s, slot) for s in range(shards) for slot, r in enumerate(
        sorted(dealt[s], key=lambda r: (bucket(r[f"k2_{s}"], pieces), r[f"k2_{s}"]))))
    got = sharding.uniform_shards(df, shards).collect()
    assert sorted((named(r.doc_id), r.size, r.shard, r.slot) for r in got) == want


def test_dual_optimum_of_the_hinge_loss():
    """The box-constrained dual against projected gradient steps on the same problem."""
    rng = np.random.default_rng(4)
    n, size = 60, 15
    rows = [np.sort(rng.choice(size, 6, replace=False)) for _ in range(n)]
    values = [(lambda v: v / np.linalg.norm(v))(rng.normal(size=6)) for _ in range(n)]
    x = np.zeros((n, size + 1))
    x[:, size] = 1.0
    for i in range(n):
        x[i, rows[i]] = values[i]
    labels = np.where(x[:, 0] + 0.7 * rng.normal(size=n) > 0, 1, -1)
    bounds = np.where(labels == 1, 0.7, 1.3)
    weight, bias, alpha = nbsvm.descend(rows, values, labels, bounds, size, 2000, 1)
    q = (x * labels[:, None]) @ (x * labels[:, None]).T
    other = np.zeros(n)
    for _ in range(20000):
        other = np.clip(other - (q @ other - 1) / np.linalg.norm(q, 2), 0, bounds)
    dual = lambda a: a.sum() - a @ q @ a / 2
    assert dual(alpha) == pytest.approx(dual(other), rel=1e-5) and ((alpha >= 0) & (alpha <= bounds)).all()
    assert (alpha == bounds).any() and np.allclose(np.r_[weight, bias], x.T @ (alpha * labels))


def test_a_labelled_id_stored_often_counts_once(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, ("good words here " if i % 2 else "bad stuff there ") * 3 + str(i)) for i in range(40)]
    once = nbsvm.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, held_out_rest=None)
    often = nbsvm.fit(spark.createDataFrame(rows + rows[:1] * 500, "doc_id long, text string"), labels, held_out_rest=None)
    assert np.array_equal(once.weights, often.weights) and np.array_equal(once.curve, often.curve)


def test_header_blocks_hold_the_mandatory_fields(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>"), (2, "http://b/", "<p>"), (None, None, None)], "page_id long, url string, html string")
    for r in warc.read_records(warc.write_archive(pages)).collect():
        names = [line.split(": ")[0] for line in bytes(r.header).decode().split("\r\n")[1:] if line]
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(names)
        assert ("WARC-Profile" in names) == (r.record_type == "revisit") != ("Content-Type" in names)


def test_the_network_adds_spans_written_otherwise(spark, sf_dir):
    """Trained on half of the texts, read on the other half: precision and recall of spans that the patterns do not know."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet").select("text").distinct()
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    net = pii.fit(docs.where(half == 0))
    hit = missed = false = plain = 0
    for r in docs.where((half == 1) & F.col("text").rlike("[0-9@]")).collect():
        base = pii.base_spans(r.text)
        (_, every), = pii.all_spans([r.text], net)
        plain += len(every) - len(base)
        text, known = pii.varied(r.text, base)
        (own, every), = pii.all_spans([text], net)
        want, got = set(pii._beside(known, own)), set(every) - set(own)
        hit, missed, false = hit + len(want & got), missed + len(want - got), false + len(got - want)
    assert hit > 50 and hit / (hit + missed) > 0.8 and hit / (hit + false) > 0.95 and plain <= 2


def test_spans_across_windows_and_reconciliation():
    tags, chance = np.zeros(160, np.int64), np.full((160, pii.N_TAGS), 0.01)
    tags[20:130] = 2
    tags[20] = 1
    chance[np.arange(160), tags] = 0.8
    parts = [(s, tags[s:s + 64].copy(), chance[s:s + 64]) for s in (0, 32, 64, 96)]
    parts[1][1][0] = 0  # an edge of a window that its neighbour reads better
    assert list(pii._across(parts, 160)) == [(0.8, ("email", 20, 130))]
    rng = random.Random(3)
    for _ in range(200):
        found = {("ip", a, a + rng.randint(1, 9)): rng.random() for a in (rng.randrange(30) for _ in range(8))}
        kept = pii.reconcile(found)
        assert all(a[2] <= b[1] for a, b in zip(kept, kept[1:]))
        best = max((sum(found[s] * (s[2] - s[1]) for s in c) for n in range(9) for c in itertools.combinations(sorted(found), n)
                    if all(a[2] <= b[1] for a, b in zip(sorted(c, key=lambda s: s[1]), sorted(c, key=lambda s: s[1])[1:]))))
        assert sum(found[s] * (s[2] - s[1]) for s in kept) == pytest.approx(best)
        base = sorted((("ip", a, a + rng.randint(1, 9)) for a in (rng.randrange(30) for _ in range(4))), key=lambda s: s[1])
        want = [s for s in kept if not any(s[1] < b[2] and b[1] < s[2] for b in base)]
        assert pii._beside(kept, base) == want
