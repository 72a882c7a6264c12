"""Periodic runs, repeated lines and source divergence against brute force, with odd rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.llm import divergence, lines, queries, runs

SCHEMA = "doc_id long, text string, lang string, source string, kept string, id string, n int, hash long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    """Null and empty values, repeated rows, null ids, long lines and columns whose names clash with inner ones."""
    rng = random.Random(3)
    line = [f"{'Shared' if i % 2 else ' shared'} line {i % 7} {'é' * (8 + i % 7)}\t" for i in range(14)]
    rows = []
    for i in range(120):
        body = [rng.choice(line) if rng.random() < 0.5 else f"own {i} {j} {'x' * rng.randint(0, 20)}" for j in range(rng.randint(0, 12))]
        tail = " ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 80)))
        rows.append((i, "\n".join([*body, tail])))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "  \t "), (204, line[3] * 400), (205, line[3] * 400), (206, line[3] * 400)]
    rows += [(None, f"{line[1]}\nnull id {i % 2}") for i in range(4)] + [(300, f"{line[5]}\ntwice")] * 2
    rows += [(301, "A b A b A b A b A b\n" * 30), (302, "w " * 5), (303, "w " * 6), (304, "漢 字 " * 9 + "end")]
    return spark.createDataFrame(
        [(i, t, [None, "en", "de"][(i or 0) % 3], None if (i or 0) % 11 == 0 else f"s{(i or 0) % 5}", "clash", "clash", 1, 2)
         for i, t in rows], SCHEMA).repartition(5)


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            first = i
            while i < n and w[i] == w[i - q]:
                i += 1
            start, length = first - q, i - first + q
            if length >= max(6, 4 * q) and not any(
                    all(w[start + k] == w[start + k - p] for k in range(p, length)) for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone), len(gone)


def test_automaton_and_regions_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 3 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            for _ in range(rng.choice([0, 0, 2])):
                w[rng.randrange(n)] = rng.randrange(k)
        both = w + [9] + w[::-1]
        hashes = runs.mix(np.array(w + both, np.uint64) + np.uint64(77))
        row, starts = np.repeat([0, 1], [len(w), len(both)]), np.array([0, len(w), len(w) + len(both)])
        got = runs.runs_of(hashes, row, starts)
        assert got.get(0, []) == brute_runs(w) and got.get(1, []) == brute_runs(both)


def test_access_yields_last_ends():
    """Colours of the paths are the last ends of their sequences, also after clones."""
    rng = random.Random(5)
    for _ in range(200):
        w = [rng.randrange(2) for _ in range(30)]
        automaton = runs.Automaton()
        for end, word in enumerate(w):
            state = automaton.append(word, end)
            for before, length in automaton.access(state, end):
                piece = w[end - length + 1:end + 1]
                last = max(e for e in range(length - 1, end) if w[e - length + 1:e + 1] == piece)
                assert before == last


def test_periodic_runs_of_texts(docs, empty):
    got = collections.defaultdict(set)
    for r in runs.periodic_runs(docs, keep=("kept", "text", "lang")).collect():
        w = words(r.text)
        found = brute_runs(w)
        collapsed, dropped = brute_collapse(w, found)
        assert [tuple(x) for x in r.runs] == found and r.n_words == len(w)
        assert (r.collapsed, r.n_dropped, r.kept) == (collapsed, dropped, "clash")
        got[r.doc_id].add(len(found))
    assert got[302] == {0} and got[303] == {1} and got[304] == {1} and got[200] == {0} and len(got[None]) == 1
    assert runs.periodic_runs(empty).count() == 0


def test_a_long_text_is_read_whole(spark):
    rng = random.Random(8)
    head = [f"u{rng.randrange(10 ** 6)}" for _ in range(200_000)]
    text = " ".join(head + [f"p{i}" for i in range(5000)] * 5 + head[:7])
    got = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(200_000, 25_000, 5000)] and got.n_dropped == 20_000


def test_op11_plants_and_reports(spark, docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs.where("doc_id is not null").write.parquet(path)
    texts = collections.Counter((r.doc_id, r.text) for r in docs.where("doc_id is not null").collect())
    want = collections.Counter()
    for (i, text), times in texts.items():
        w, h = words(text), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = brute_runs(w)
        best = (None,) * 4
        if found:
            s, length, q = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))
            best = (s, length, q, 1000 * length // q)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, brute_collapse(w, found)[0])]
        want[(i, len(found), *best, *digest)] += times
    got = queries.op11(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts) > 5


def strip(line):
    return re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows):
    """Rows equal in id and text stand or fall together; others of one key are ordered by id, nulls first."""
    holders = collections.defaultdict(list)
    for i, text in rows:
        for key in {strip(x) for x in (text or "").split("\n")}:
            if len(key) >= 20:
                holders[key].append((i, text or ""))
    out = []
    for i, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            held = holders.get(strip(line), [])
            largest = max((h[0] for h in held if h[0] is not None), default=None)
            kept.append(None if len(held) >= 3 and i != largest else line)
        out.append((i, len(kept), kept.count(None), "\n".join(x for x in kept if x is not None)))
    return out


@pytest.mark.parametrize("most_broadcast", [lines.MOST_BROADCAST, 0])
def test_repeated_lines(docs, empty, most_broadcast):
    """Both ways to find suspects: the broadcast filter and the join of segments."""
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()]
    got = lines.drop_repeated_lines(docs.where("doc_id is not null"), keep=("source", "kept"), most_broadcast=most_broadcast)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == sorted(brute_lines(rows))
    assert sum(r[2] for r in brute_lines(rows)) > 100
    assert lines.drop_repeated_lines(empty, most_broadcast=most_broadcast).count() == 0


def test_repeated_lines_without_ids(docs, spark):
    got = lines.drop_repeated_lines(docs)
    assert got.count() == docs.count()
    of_null = {(r.n_dropped, r.kept.split("\n")[-1]) for r in got.where("doc_id is null").collect()}
    assert of_null == {(1, "null id 0"), (1, "null id 1")}  # documents with ids hold the line too
    alone = spark.createDataFrame([(None, "the same line of twenty\na")] * 2 + [(None, "the same line of twenty\nb")] * 2,
                                  "doc_id long, text string")
    kept = collections.Counter(r.kept for r in lines.drop_repeated_lines(alone).collect())
    assert sorted(kept.values()) == [2, 2] and sum("same" in k for k in kept) == 1  # the rows of one text keep it


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2 ** 63, 300_000).astype(np.uint64)
    again = hashes[:50_000]
    filters = lines.Filters()
    for part in np.array_split(np.concatenate([hashes, again]), 7):
        filters.add(part)
    packed, zero = np.packbits(filters.twice)[None, :], np.zeros(len(hashes), np.int64)
    held = lines._holds(packed, zero, hashes)
    assert held[:50_000].all() and held[50_000:].mean() < 0.01


def test_hot_line_in_many_rows(spark):
    """A line in every row, some rows over the share that is met by broadcast."""
    rows = [(i, f"a line that every document holds\nonly here number {i} of all\nshared by only ten {i // 10:05d}") for i in range(3000)]
    got = {r.doc_id: r.n_dropped for r in lines.drop_repeated_lines(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == {i: (i != 2999) + (i % 10 != 9) for i, _ in rows}


def brute_audit(rows, most=200):
    n, docs_of = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        n[lang, source].update(found)
        docs_of[lang].update(set(found))
    kept = {lang: sorted((t for t, k in docs_of[lang].items() if k >= 3), key=str.encode) for lang, _ in groups}

    def share(count, lang, parts):
        total = sum(n[lang, s][t] for s in parts for t in kept[lang])
        return 1 + 10 ** 9 * (count + 1) // (total + len(kept[lang]))

    out = []
    for lang, source in groups:
        own = [s for g, s in groups if g == lang]
        p = {t: share(n[lang, source][t], lang, [source]) for t in kept[lang]}
        pairs = []
        for other in own:
            if other != source:
                q = {t: share(n[lang, other][t], lang, [other]) for t in kept[lang]}
                pairs.append((other, sum((p[t] - q[t]) ** 2 // q[t] for t in kept[lang])))
        q = {t: share(sum(n[lang, s][t] for s in own), lang, own) for t in kept[lang]}
        gaps = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept[lang] if n[lang, source][t] and p[t] > q[t]]
        for part, items, limit in (("pair", pairs, None), ("term", gaps, most)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, r + 1) for r, (item, value) in enumerate(items[:limit])]
    return sorted(out)


@pytest.mark.parametrize("tile, block", [(8, 1 << 18), (2, 5), (1, 20)])
def test_divergence(docs, empty, monkeypatch, tile, block):
    """One tile and one block, and many of both."""
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", block)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    kept, groups = divergence.count_terms(docs)
    pairs = divergence.pair_divergences(kept, groups, tile)
    assert sorted((r.lang, r.source, r.item, r.value) for r in pairs.collect()) == sorted(
        (lang, s, item, value) for lang, s, part, item, value, _ in brute_audit(rows) if part == "pair")
    if tile == 8:
        assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == brute_audit(rows)
        assert len({r[:2] for r in brute_audit(rows)}) > 12
        assert divergence.audit(empty).count() == 0


def test_divergence_without_kept_terms_and_of_long_texts(spark):
    rows = [("one two", "xx", "a"), ("three", "xx", "b"), (None, "xx", None), ("zu " * 700_000 + "Zu" * 600_000, "yy", "a"),
            ("ZU é", "yy", "b"), ("zu É", "yy", "b"), ("é!É", "yy", "c")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == brute_audit(rows)


def test_shares_are_exact_beyond_doubles(spark):
    counts = [0, 1, 7, 10 ** 6, 10 ** 12 - 1, 3 * 10 ** 12]
    total, v = 4 * 10 ** 12 + 7, 12345
    got = divergence._prices(np.array(counts, np.int64), total, v).tolist()
    want = [1 + 10 ** 9 * (c + 1) // (total + v) for c in counts]
    df = spark.createDataFrame([(c, total + v) for c in counts], "c long, m long")
    assert got == want == [r[0] for r in df.select(divergence._share(F.col("c") + 1, F.col("m"))).collect()]
