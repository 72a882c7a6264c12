"""Order MinHash and the pipeline's stages against plain Python, and operators on repeated rows and rows without an id."""

import collections
import math
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from flowwarden.llm import mixing, nbsvm, order_minhash, pii, queries, segmentation, sharding, topk

ALL = (1 << 64) - 1


def hashed(parts):
    """Spark's xxhash64 of a row of byte strings."""
    h = 42
    for part in parts:
        h = xxhash.xxh64(part, seed=h).intdigest()
    return h


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    w = words(text)
    if not w:
        return ""
    codes = [hashed([x.encode() for x in w[i:i + 3]]) for i in range(max(1, len(w) - 2))]
    bits = math.ceil(math.log2(len(codes) + 1.0)) + 1
    seen, elements = collections.Counter(), []
    for at, code in enumerate(codes):
        name = code & (ALL >> bits)
        h = hashed([struct.pack("<Q", code), struct.pack("<i", seen[name])])
        seen[name] += 1
        elements.append((h >> (bits + 1) << bits) | at)
    bins = collections.defaultdict(list)
    for v in sorted(elements):
        if len(bins[v >> 58]) < 2:
            bins[v >> 58].append(v & ((1 << bits) - 1))
    return "".join(f"{b:02X}{hashed([struct.pack('<Q', codes[at]) for at in sorted(kept)]) & 0xFFFFFFFF:08X}"
                   for b, kept in sorted(bins.items()))


def alike(a, b):
    a, b = ({f[i:i + 10] for i in range(0, len(f), 10)} for f in (a, b))
    either = len({x[:2] for x in a | b})
    return 1.0 if not either else len(a & b) / either


def test_order_minhash_in_plain_python(spark):
    rng = random.Random(2)
    texts = ["", None, "one", "one two", "a b c", "a b c " * 30, "é 漢 字 x", "w " * 400]
    texts += [" ".join(rng.choice("abcdef") + rng.choice(["", "x", "é"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here at all"), (3, "one two three four")]
    got = order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by_text = collections.defaultdict(set)
    for i, t in rows:
        by_text[i].add(fingerprint(t))
    for r in got:
        assert r.fingerprint in by_text[r.doc_id] and r.edited_fingerprint == fingerprint(r.edited)
        assert r.near_edited == pytest.approx(alike(r.fingerprint, r.edited_fingerprint))
    assert fingerprint("a b c " * 30) != fingerprint("a b c") != ""


def test_hot_ids_are_cut_into_ranges(spark):
    """A third of the rows without an id, a third with one id: the same neighbours as in one sorted list, no large bucket."""
    rows = [(None, f"none {i} {i * 7} x") for i in range(150)] + [(5, f"five {i} {i * 3} y") for i in range(150)] + [
        (i, f"own {i} z") for i in range(-70, 80) if i != 5]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    tied = {(r.doc_id, r.text): r.tie for r in df.withColumn("tie", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -tied[r]))
    want = set()
    for at, (i, text) in enumerate(order):
        after, cut = order[(at + 1) % len(order)][1], len(text) // 3
        want.add((i, text[:len(text) - cut] + after[:cut]))
    got = order_minhash.fingerprints(df).select("doc_id", "edited").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    parts = 2 + math.isqrt(len(rows))
    cuts = df.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    bucket = order_minhash._bucket(sorted(cuts), parts, F.col("doc_id"), F.xxhash64("text"))
    assert df.groupBy(bucket).count().agg(F.max("count")).first()[0] < 70


def test_repeated_rows_and_rows_without_id(spark):
    """Rows that repeat entirely and rows without an id stay, each with the result of its text."""
    text = "the quick brown fox calls +1 555 010 7788 or a.b@example.com about 10.0.0.1 today"
    rows = [(1, text)] * 3 + [(None, text)] * 2 + [(None, None)] * 2 + [(2, "something else entirely"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    found = pii.find(df, pii.Network.fresh())
    scored = nbsvm.score(df, nbsvm.fit(df, labels, held_out_rest=None))
    prints = order_minhash.fingerprints(df)
    for out, column in ((found, "base"), (scored, "score"), (prints, "fingerprint")):
        got = collections.defaultdict(list)
        for r in out.select("doc_id", column).collect():
            got[r[0]].append(r[1])
        assert {k: len(v) for k, v in got.items()} == {1: 3, None: 4, 2: 2} and len(set(got[1])) == 1
        assert got[None].count(got[1][0]) == 2
    assert sorted(sharding.uniform_shards(df, 2).groupBy("shard").count().select("count").toPandas()["count"]) == [4, 5]
    assert mixing.mix(df).count() == len(rows)
    drawn = segmentation.encode(df, segmentation.Vocabulary.read(queries.MODEL), verify=True)
    assert drawn.where("rank = 1").count() == len(rows) and drawn.where("not lossless").isEmpty()
    same = {tuple(r.ids) for r in drawn.where("doc_id = 1 and rank = 1").collect()}
    assert len(same) == 1
    vectors = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [5.0]), (2, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    best = topk.top_k(vectors.where("vec_id = 1"), vectors, 3).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in best] == [(1, 2, 256 * 512)] * 2


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    """The documents before and after every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10 ** 6, None, "en", None, 0), (10 ** 6 + 1, "", "en", "src1", 0)], docs.schema)
    out, docs = {}, docs.union(odd)
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "staged")
        out[name], docs = (docs, after), after
    return out


def test_quality_stage(spark, sf_dir, staged):
    before, after = staged["quality"]
    model = nbsvm.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out_rest=None)
    rows = before.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = {r.doc_id for r in rows if model.score(nbsvm.slots(__import__("numpy").frombuffer(r.text.encode(), "uint8")),
                                                  len(r.text.encode())) >= corpus_pipeline.REJECTED_BELOW}
    assert {r.doc_id for r in after.select("doc_id").collect()} == want and len(want) < len(rows)


def test_near_duplicate_stage(staged):
    before, after = staged["near_duplicates"]
    sets = {}
    for r in before.select("doc_id", "text").collect():
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(r.text)]
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert {r.doc_id for r in after.select("doc_id").collect()} == {i for i in ids if root(i) == i}


def test_personal_data_stage(staged):
    before, after = staged["personal_data"]
    net = pii.fit(before)
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        text = texts[r.doc_id]
        want = None if text is None else pii.masked(text, pii.all_spans([text], net)[0][1])
        assert r.text == want and r.n_chars == (None if want is None else len(want))
    assert any("<" in (r.text or "") and "<" not in (texts[r.doc_id] or "") for r in after.collect())


def test_mix_and_token_stages(staged):
    before, after = staged["mix"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    got = collections.Counter(r.doc_id for r in after.select("doc_id").collect())
    assert got == {i: n for i, n in copies.items() if n}
    before, after = staged["tokens"]
    texts, ranks = collections.Counter(r.doc_id for r in before.select("doc_id").collect()), collections.Counter()
    for r in after.collect():
        assert r.lossless
        ranks[r.doc_id] += r["rank"] == 1
    assert ranks == texts
