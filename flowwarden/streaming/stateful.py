"""Operators that keep state over micro-batches and restarts: first of a type, and the work queue."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of these operators is kept in this store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def use_state_store(df: DataFrame) -> None:
    """Name the state store the processors need, where the session does not."""
    for key, value in STATE_STORE.items():
        if df.sparkSession.conf.get(key) != value:
            df.sparkSession.conf.set(key, value)


# -- first of a type


class _FirstOfType(StatefulProcessor):
    """Lets the first row of a key pass and remembers its place, up to ``expiry`` later if that is given."""

    def __init__(self, expiry: float | None):
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: r["_order"]):
            at = float(row["_order"])
            if not self.seen.exists() or self.expiry is not None and at >= self.seen.get()[0] + self.expiry:
                self.seen.update((at,))
                yield row

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.update((float(initialState["done"]),))

    def close(self) -> None:
        pass


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of everything a task reads in a batch, the earliest row of each type: a hot type reaches its state as one row a task."""
    best: dict[object, tuple[object, pa.RecordBatch]] = {}
    for batch in batches:
        kinds, order = batch.column("attack_type").to_pylist(), batch.column("_order").to_pylist()
        for i, (kind, at) in enumerate(zip(kinds, order)):
            if kind not in best or at < best[kind][0]:
                best[kind] = at, batch.slice(i, 1)
    for _, row in best.values():
        yield row


def first_of_type(threats: DataFrame, order: str, analysed: DataFrame | None = None, expiry: float | None = None) -> DataFrame:
    """The first threat of each ``attack_type``; later ones are skipped, over batches and restarts of the stream.

    Within a batch the row of the smallest ``order`` (a number, not null) counts.  ``analysed``: types (``attack_type``) done
    before the stream first started, skipped from the beginning.  With ``expiry`` (in units of ``order``) a type is forgotten that
    much later than its last passed threat; types done before count from ``order`` 0.  A null type is a type.
    """
    use_state_store(threats)
    key = F.coalesce(F.concat(F.lit("="), "attack_type"), F.lit(""))
    keyed = threats.withColumns({"_order": F.col(order), "_key": key})
    # without expiry only the earliest row of a type can pass
    thinned = keyed.mapInArrow(_earliest, keyed.schema) if expiry is None else keyed
    done = analysed.select(key.alias("_key"), F.lit(0.0).alias("done")).distinct().groupBy("_key") if analysed is not None else None
    passed = thinned.groupBy("_key").transformWithState(_FirstOfType(expiry), keyed.schema, "Append", "None", done)
    return passed.drop("_order", "_key")


# -- work queue

#: Kinds of rows a queue takes; the last two are flags, not work.
QUESTION, ANALYSIS, PAUSE, RESUME = "question", "analysis", "pause", "resume"
WORK = T.StructType([T.StructField("lane", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("id", T.StringType()),
                     T.StructField("ts", T.LongType()), T.StructField("payload", T.StringType())])
SERVED = T.StructType([*WORK.fields, T.StructField("served", T.LongType()), T.StructField("turn", T.LongType())])
_WAITING = "ts bigint, id string, payload string"


class _Queue(StatefulProcessor):
    """Waiting questions and analyses of one lane, whether analyses are paused, and how much has been served."""

    def __init__(self, bound: int | None, wait_ms: int | None):
        self.bound, self.wait_ms = bound, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = {kind: handle.getListState(kind, _WAITING) for kind in (QUESTION, ANALYSIS)}
        self.flags = handle.getValueState("flags", "paused boolean, served bigint, turn bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[str, list[tuple]] = {QUESTION: [], ANALYSIS: []}
        flags = []
        for r in rows:
            if r["kind"] in new:
                new[r["kind"]].append((r["ts"], r["id"], r["payload"]))
            else:
                flags.append((r["ts"], r["kind"] == PAUSE))
        yield from self._serve(key, new, max(flags)[1] if flags else None, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._serve(key, {QUESTION: [], ANALYSIS: []}, None, timerValues)

    def _serve(self, key, new: dict[str, list[tuple]], pause: bool | None, timers) -> Iterator[Row]:
        paused, served, turn = self.flags.get() if self.flags.exists() else (False, 0, -1)
        paused, turn = (paused if pause is None else pause), turn + 1
        left = self.bound if self.bound is not None else float("inf")
        more = False
        for kind in (QUESTION, ANALYSIS):
            state = self.waiting[kind]
            rows = sorted([*(tuple(r) for r in state.get())] + new[kind]) if state.exists() else sorted(new[kind])
            n = 0 if kind == ANALYSIS and paused else int(min(left, len(rows)))
            for ts, id_, payload in rows[:n]:
                served += 1
                yield Row(lane=key[0], kind=kind, id=id_, ts=ts, payload=payload, served=served, turn=turn)
            left -= n
            more |= n < len(rows) and not (kind == ANALYSIS and paused)
            if rows[n:]:
                state.put(rows[n:])
            elif state.exists():
                state.clear()
        self.flags.update((paused, served, turn))
        if more and self.wait_ms is not None:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.wait_ms)

    def close(self) -> None:
        pass


def serve(work: DataFrame, lanes: int = 16, bound: int | None = None, wait_ms: int | None = None) -> DataFrame:
    """Work in the order it is served: in every turn of a lane, questions before analyses, each by ``ts``, then ``id``.

    ``work``: ``kind, id, ts (bigint), payload (string)``.  A ``pause`` row holds the analyses of all lanes, those of
    its own batch included, until a ``resume`` row comes (of several flags in a batch the latest ``ts`` counts);
    questions are served meanwhile and nothing is lost.  ``bound`` rows of a lane are served in a turn, the rest in the
    next one, which the lane's next row starts, or with ``wait_ms`` a timer (such a stream runs on until it is stopped, as a timer
    may be set at any time).  Lanes are dealt by the hash of the id.  Adds ``lane``, ``served`` (running number in the lane)
    and ``turn``.
    """
    use_state_store(work)
    flag = F.col("kind").isin(PAUSE, RESUME)
    own = F.array(F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(lanes - 1))
    rows = work.where(flag | F.col("kind").isin(QUESTION, ANALYSIS)).select(
        F.explode(F.when(flag, every).otherwise(own)).alias("lane"), "kind", "id", F.col("ts").cast("long").alias("ts"), "payload")
    return rows.groupBy("lane").transformWithState(
        _Queue(bound, wait_ms), SERVED, "Append", "None" if wait_ms is None else "ProcessingTime")
