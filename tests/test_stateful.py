"""First of a type and the work queue over several batches and restarts."""

import json
import os

import pytest
from pyspark.sql.types import _parse_datatype_string

from flowwarden.streaming import intake, stateful

THREATS = "id bigint, ts bigint, attack_type string, note string"
WORK = "kind string, id string, ts bigint, payload string"


class Feed:
    """A folder to which files are added, read file by file on one checkpoint."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema, self.n = spark, root, _parse_datatype_string(schema), 0
        (root / "in").mkdir()

    def add(self, rows):
        path = self.root / "in" / f"{self.n:03d}.json"
        path.write_text("\n".join(json.dumps(dict(zip(self.schema.names, r))) for r in rows))
        os.utime(path, (1_700_000_000 + self.n,) * 2)  # files are read in the order of their times
        self.n += 1

    def run(self, shape):
        """Drain what is there; returns rows by batch."""
        out = []
        stream = shape(intake.read_files(self.spark, str(self.root / "in"), self.schema, max_files=1))
        intake.start_batches(stream, lambda df, i: out.append([tuple(r) for r in df.collect()]), str(self.root / "cp"),
                             True).awaitTermination()
        return out


def test_first_of_type_over_batches_and_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path, THREATS)
    done = spark.createDataFrame([("old",), ("old",)], "attack_type string")
    shape = lambda s: stateful.first_of_type(s, "ts", done)
    feed.add([(2, 20, "syn", "b"), (1, 10, "syn", "a"), (3, 5, "old", "skipped"), (4, 6, None, "no type")])
    assert sorted(feed.run(shape)[0], key=str) == [(1, 10, "syn", "a"), (4, 6, None, "no type")]
    feed.add([(5, 1, "syn", "late"), (6, 30, "udp", "c"), (7, 31, None, "again")])
    feed.add([(8, 2, "udp", "later"), (9, 3, "old", "skipped"), (10, 40, "icmp", "d")])
    rows = [r for batch in feed.run(shape) for r in batch]
    assert sorted(rows) == [(6, 30, "udp", "c"), (10, 40, "icmp", "d")]


def test_a_type_passes_again_after_its_expiry(spark, tmp_path):
    feed = Feed(spark, tmp_path, THREATS)
    shape = lambda s: stateful.first_of_type(s, "ts", expiry=10)
    feed.add([(1, 1, "syn", "a"), (2, 10, "syn", "skipped"), (3, 11, "syn", "b")])
    feed.add([(4, 20, "syn", "skipped"), (5, 21, "syn", "c")])
    assert sorted(r for batch in feed.run(shape) for r in batch) == [(1, 1, "syn", "a"), (3, 11, "syn", "b"), (5, 21, "syn", "c")]


def test_queue_serves_questions_first_and_holds_analyses_while_paused(spark, tmp_path):
    feed = Feed(spark, tmp_path, WORK)
    shape = lambda s: stateful.serve(s, lanes=1)
    batches = [
        [("analysis", "a1", 1, "x"), ("question", "q2", 5, ""), ("question", "q1", 5, ""), ("analysis", "a0", 0, None)],
        [("pause", "p", 6, None), ("analysis", "a2", 7, None), ("question", "q3", 8, None)],
        [("analysis", "a3", 2, None), ("question", "q4", 1, None)],
        [("resume", "r", 9, None), ("question", "q5", 9, None), ("analysis", "a4", 5, None)],
        [("analysis", "a5", 1, None), ("question", "q6", 0, None)],
    ]
    want = [["q1", "q2", "a0", "a1"], ["q3"], ["q4"], ["q5", "a3", "a4", "a2"], ["q6", "a5"]]
    got = []
    for rows in batches[:2]:
        feed.add(rows)
    got += feed.run(shape)
    for rows in batches[2:]:  # after a restart: what waits is still there
        feed.add(rows)
    got += feed.run(shape)
    served = [sorted(batch, key=lambda r: r[5]) for batch in got if batch]
    assert [[r[2] for r in batch] for batch in served] == want
    assert [r[5] for batch in served for r in batch] == list(range(1, 13))


@pytest.mark.parametrize("lanes", [1, 3])
def test_bounded_turns_lose_nothing(spark, tmp_path, lanes):
    feed = Feed(spark, tmp_path, WORK)
    shape = lambda s: stateful.serve(s, lanes, bound=4)
    work = [("question" if i % 3 else "analysis", f"w{i:02d}", i, None) for i in range(18)]
    feed.add(work)
    got = [r for batch in feed.run(shape) for r in batch]
    for i in range(5):  # rows that start further turns
        feed.add([("resume", "r", 100 + i, None)])
    got += [r for batch in feed.run(shape) for r in batch]
    assert sorted(r[2] for r in got) == [w[1] for w in work]
    by_turn = {}
    for r in got:
        by_turn.setdefault((r[0], r[6]), []).append(r)
    assert max(map(len, by_turn.values())) == 4
    for lane in range(lanes):
        order = [r for r in sorted(got, key=lambda r: r[5]) if r[0] == lane]
        assert [r[1] for r in order] == sorted([r[1] for r in order], reverse=True)  # all questions came first


def test_flags_alone_and_unknown_kinds(spark, tmp_path):
    feed = Feed(spark, tmp_path, WORK)
    feed.add([("pause", "p", 1, None), ("resume", "r", 2, None), ("other", "o", 3, None)])
    feed.add([("analysis", "a", 1, None)])
    assert [r[2] for batch in feed.run(lambda s: stateful.serve(s, 2)) for r in batch] == ["a"]
