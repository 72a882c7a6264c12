"""Line deduplication behind two Bloom filters.

Every line of enough code points is hashed, once for each document that holds it.  One filter marks hashes seen once,
the other those seen twice; only lines found in the second are suspects, and only suspects are shuffled, to be counted
by a strong digest and to choose the document that keeps them.

The filters are cut by hash into segments of fixed size whose number grows with the lines.  A map task sends each segment
its distinct hashes, each at most twice, so that a line found everywhere is no hot key.  The second filter goes to
every task while it is below ``MOST_BROADCAST`` bytes; beyond, the suspects of each segment are joined to the hashes of the
lines.  Both ways give the same suspects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.words import _BYTE_CODE, _LOWER, _SEPARATOR, BYTE_BASE, mix, slices, spans, text_bytes
from flowwarden.session import materialize

#: Bits of a segment, bits of the filter for each line, and positions of a hash.
SEGMENT_BITS, BITS_PER_LINE, POSITIONS = 1 << 22, 8, 3
#: The second filter is broadcast up to this size (bytes), joined beyond.
MOST_BROADCAST = 32 << 20
#: Hashes a map task gathers before it sends them on.
_GATHERED = 1 << 18
#: Keys held by more than this share of all suspects are met by broadcast: there are fewer than one over it.
HOT_SHARE = 1e-3


def _line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and past-the-end byte of every line; each row has one more line than line feeds."""
    feeds = np.flatnonzero(data == 10)
    per_row = 1 + np.diff(np.searchsorted(feeds, offsets))
    first = np.cumsum(per_row) - per_row
    inner = np.ones(per_row.sum(), bool)
    inner[first] = False
    start = np.empty(len(inner), np.int64)
    start[~inner], start[inner] = offsets[:-1], feeds + 1
    inner = np.ones(len(inner), bool)
    inner[first + per_row - 1] = False
    end = np.empty(len(inner), np.int64)
    end[~inner], end[inner] = offsets[1:], feeds
    return np.repeat(np.arange(len(per_row)), per_row), start, end


def _keys(data: np.ndarray, offsets: np.ndarray, least: int):
    """Lines whose key has ``least`` code points: row, number in the row, first and past-the-end byte and hash of the key."""
    row, start, end = _line_bounds(data, offsets)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    wide = np.flatnonzero(end - start >= least)
    row, number, start, end = row[wide], number[wide], start[wide], end[wide]
    out: list[tuple[np.ndarray, ...]] = []
    low = 0
    while low < len(row):  # a few lines at a time: about a million bytes
        high = max(low + 1, int(np.searchsorted(start, start[low] + (1 << 20))))
        at = start[low]
        piece = data[at:end[high - 1]]
        solid = np.flatnonzero(~_SEPARATOR[piece])
        points = np.r_[0, np.cumsum((piece & 0xC0) != 0x80, dtype=np.int32)]
        a, b = np.searchsorted(solid, start[low:high] - at), np.searchsorted(solid, end[low:high] - at)
        some = np.flatnonzero(b > a)
        first, last = solid[a[some]], solid[b[some] - 1] + 1
        enough = points[last] - points[first] >= least
        some, first, last = some[enough], first[enough], last[enough]
        hashes = spans(_BYTE_CODE[_LOWER[piece]], first, last, BYTE_BASE) if len(some) else np.empty(0, np.uint64)
        hashes = mix(hashes + (last - first).astype(np.uint64) * np.uint64(BYTE_BASE))
        out.append((row[low + some], number[low + some], first + at, last + at, hashes))
        low = high
    if not out:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def _positions(hashes: np.ndarray) -> np.ndarray:
    """Bits of each hash within its segment, one row for each of ``POSITIONS``."""
    salt = np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    return (mix(hashes[None, :] ^ salt[:, None]) % np.uint64(SEGMENT_BITS)).astype(np.int64)


class Filters:
    """The pair of filters of one segment."""

    def __init__(self) -> None:
        self.once, self.twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)

    def add(self, hashes: np.ndarray) -> None:
        """Every hash stands for one document; a bit set by two of them is set in the second filter."""
        for low in range(0, len(hashes), 1 << 19):
            set_by = np.bincount(_positions(hashes[low:low + (1 << 19)]).ravel(), minlength=SEGMENT_BITS)
            self.twice |= (set_by > 1) | (self.once & (set_by > 0))
            self.once |= set_by > 0


def _holds(packed: np.ndarray, segment: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have all their bits in the packed filters (one row of bytes for each segment)."""
    found = np.ones(len(hashes), bool)
    for bits in _positions(hashes):
        found &= (packed[segment, bits >> 3] >> (7 - (bits & 7)).astype(np.uint8) & 1).astype(bool)
    return found


def _sent(segments: int, least: int):
    """Rows (segment, hashes) of a task: each hash once for every document that holds it, at most twice."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(parts), return_counts=True)
        values = np.repeat(values, np.minimum(times, 2))
        segment = (values % np.uint64(segments)).astype(np.int32)
        order = np.argsort(segment, kind="stable")
        values, segment = values[order], segment[order]
        own, first = np.unique(segment, return_index=True)
        cuts = np.r_[first, len(segment)]
        return pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
            ["segment", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in slices(batches):
            row, _, _, _, hashes = _keys(*text_bytes(batch.column("text")), least)
            order = np.lexsort((row, hashes))
            row, hashes = row[order], hashes[order]
            again = np.zeros(len(row), bool)
            again[1:] = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
            parts.append(hashes[~again])
            n += len(parts[-1])
            if n > _GATHERED:
                yield flush(parts)
                parts, n = [], 0
        if n:
            yield flush(parts)

    return run


def _segment_filters(table: pa.Table) -> pa.Table:
    """Second filter of a segment and the hashes it holds."""
    filters = Filters()
    given = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
    for hashes in given:
        filters.add(hashes)
    packed = np.packbits(filters.twice)
    held = np.concatenate([h[_holds(packed[None, :], np.zeros(len(h), np.int64), h)] for h in given])
    return pa.table({"segment": table.column("segment").slice(0, 1).cast(pa.int32()),
                     "twice": pa.array([packed.tobytes()], pa.binary()),
                     "suspects": pa.array([np.unique(held).view(np.int64)], pa.list_(pa.int64()))})


def _suspects(segments: int, least: int, packed) -> object:
    """Rows (id, t1, t2, hash, digest, numbers) of each document's distinct suspect keys; all keys where ``packed`` is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None if packed is None else np.frombuffer(packed.value, np.uint8).reshape(segments, SEGMENT_BITS >> 3)
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            row, number, start, end, hashes = _keys(data, offsets, least)
            if filters is not None and len(row):
                kept = _holds(filters, (hashes % np.uint64(segments)).astype(np.int64), hashes)
                row, number, start, end, hashes = (x[kept] for x in (row, number, start, end, hashes))
            found: dict[tuple[int, bytes], list[int]] = {}
            code: list[int] = []
            for r, k, a, b, h in zip(row.tolist(), number.tolist(), start.tolist(), end.tolist(), hashes.view(np.int64).tolist()):
                key = r, hashlib.blake2b(_LOWER[data[a:b]].tobytes(), digest_size=16).digest()
                if key not in found:
                    found[key] = []
                    code.append(h)
                found[key].append(k)
            at = pa.array([r for r, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in ("id", "t1", "t2")], pa.array(code, pa.int64()),
                 pa.array([d for _, d in found], pa.binary()), pa.array(list(found.values()), pa.list_(pa.int32()))],
                ["id", "t1", "t2", "hash", "digest", "numbers"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the lines whose numbers a row carries."""
    for batch in slices(batches):
        n_lines, n_dropped, kept = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            if gone is None:
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
                kept.append(text)
                continue
            lines, gone = text.split("\n"), set(gone)
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
            kept.append("\n".join(line for i, line in enumerate(lines) if i not in gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string()),
             batch.column("kept")], ["id", "n_lines", "n_dropped", "kept_text", "kept"])


def drop_repeated_lines(docs: DataFrame, least: int = 20, holders: int = 3, keep: tuple[str, ...] = (),
                        id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Id, ``n_lines``, ``n_dropped``, ``kept`` text and the columns ``keep`` of every row.

    A line's key is the line stripped of blanks at both ends, A-Z lower-cased.  A key of at least ``least`` code points
    found in ``holders`` rows or more stays in the row of the largest id only, with all its lines there.  Every row is a
    document: a null id is below all others, rows of equal id are told apart by their text, and rows equal in both keep or
    lose a line together.  A null or empty text is one empty line; a line of any length is compared whole; an empty table
    gives an empty result; other columns are left out.
    """
    if holders < 2:
        raise ValueError("a repeated line has at least two holders")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("text"),
                        F.struct(*[F.col(c) for c in keep] or [F.lit(1).alias("one")]).alias("kept"))
    keyed = given.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))
    lines = given.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    segments = max(1, -(-lines * BITS_PER_LINE // SEGMENT_BITS))
    filters = materialize(
        given.select("text").mapInArrow(_sent(segments, least), "segment int, hashes binary").groupBy("segment")
        .applyInArrow(_segment_filters, "segment int, twice binary, suspects array<bigint>"), "line-filters")
    read = keyed.select("id", "t1", "t2", "text")
    schema = "id long, t1 long, t2 long, hash long, digest binary, numbers array<int>"
    if segments * (SEGMENT_BITS >> 3) <= most_broadcast:
        packed = np.zeros((segments, SEGMENT_BITS >> 3), np.uint8)
        for segment, twice in filters.select("segment", "twice").toLocalIterator():
            packed[segment] = np.frombuffer(twice, np.uint8)
        sent = docs.sparkSession.sparkContext.broadcast(packed.tobytes())
        suspects = read.mapInArrow(_suspects(segments, least, sent), schema)
    else:
        held = filters.select(F.explode("suspects").alias("hash"))
        suspects = read.mapInArrow(_suspects(segments, least, None), schema).join(held, "hash", "left_semi").select(
            "id", "t1", "t2", "hash", "digest", "numbers")
    suspects = materialize(suspects.drop("hash"), "suspect-lines")

    counted = suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "t1", "t2")).alias("last"))
    repeated = materialize(counted.where(F.col("n") >= holders), "repeated-lines")
    bound = max(1, int((repeated.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    # fewer than 1 / HOT_SHARE keys can exceed that share of all suspects, at any size
    hot = F.broadcast(repeated.where(F.col("n") > bound).select("digest", F.col("last").alias("hot_last")))
    marked = suspects.join(hot, "digest", "left")
    own = F.struct("id", "t1", "t2")
    rest = marked.where("hot_last is null").join(repeated.where(F.col("n") <= bound).select("digest", "last"), "digest")
    gone = (marked.where("hot_last is not null").select("id", "t1", "t2", "numbers", F.col("hot_last").alias("last"))
            .unionByName(rest.select("id", "t1", "t2", "numbers", "last")).where(~own.eqNullSafe(F.col("last")))
            .groupBy("id", "t1", "t2").agg(F.flatten(F.collect_list("numbers")).alias("gone")))
    g = gone.select(F.col("id").alias("g_id"), F.col("t1").alias("g1"), F.col("t2").alias("g2"), "gone")
    joined = keyed.join(g, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")),
                        "left").select("id", "text", "gone", "kept")
    kept_type = given.schema["kept"].dataType.simpleString()
    out = joined.mapInArrow(_without, f"id long, n_lines long, n_dropped long, kept_text string, kept {kept_type}")
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("kept_text").alias("kept"),
                      *[F.col("kept")[c].alias(c) for c in keep if c not in (id_col, "n_lines", "n_dropped", "kept")])
