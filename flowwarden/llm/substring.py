"""Remove passages that already occur earlier: winnowed fragments and window hashes against indexed reference blocks.

They replace a relative Lempel-Ziv parse: no longest match is sought, as only the windows that occur earlier are asked for.

The reference is the corpus itself in the order (id, position).  It is cut by content: the smallest k-word hash of a
window is its anchor, equal windows have equal anchors, and all windows with one anchor go to one block.  So a text
need not meet every block, only those that can hold a factor of it.

1. Each text is cut into fragments, the longest runs of windows with one anchor.  A fragment that equals an earlier
   one of its block is copied as a whole.  Adjacent fragments together are the long copied passages.
2. At the ends of copied passages a fragment may share only some windows with another: where a block has different fragments for
   one anchor, their windows are looked up one by one, in blocks keyed by the 128-bit hash of the window.
3. Words covered by a copied window go.

Fragments are compared by 64-bit anchor and 64-bit content hash, windows by 128 bits.  Only the first occurrence of a
content leaves a slice of a map task, and anchors with many contents there go straight to step 2, so that a passage
in every text puts no large group into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.words import OTHER_BASE, WORD_BASE, mix, slices, spans, text_bytes, texts
from flowwarden.session import materialize

#: Words of an anchor.
ANCHOR = 8
#: Contents of one anchor that a slice sends to the anchor's block; with more, the anchor is known to need step 2.
CONTENTS = 4
#: Text bytes for each block of the index.
BLOCK_BYTES = 8 << 20

#: A fragment or window on its way to a block, and a finding: ``kind`` 1 is copied, 2 goes to step 2.
_RECORD = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("n", "<i4")])
_MARKS = pa.schema([("doc", pa.int64()), ("text", pa.int64()), ("kind", pa.int32()), ("start", pa.int32()),
                    ("n", pa.int32())])
_MARKS_DDL = "doc long, text long, kind int, start int, n int"
_SENT = pa.schema([("block", pa.int32()), ("records", pa.binary()), ("marks", pa.binary())])


def _earliest(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by content and place, and which of them have the same content at an earlier place."""
    found = found[np.lexsort((found["text"], found["start"], found["doc"], found["b"], found["a"]))]
    new = np.ones(len(found), bool)
    new[1:] = (found["a"][1:] != found["a"][:-1]) | (found["b"][1:] != found["b"][:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(found) else np.empty(0, np.int64)
    later = (found["doc"] != found["doc"][first]) | (found["start"] != found["start"][first])
    return found, later


def _contents(found: np.ndarray) -> np.ndarray:
    """For records sorted by content: how many contents the anchor of each has."""
    if not len(found):
        return np.empty(0, np.int64)
    anchor = np.ones(len(found), bool)
    anchor[1:] = found["a"][1:] != found["a"][:-1]
    new = anchor.copy()
    new[1:] |= found["b"][1:] != found["b"][:-1]
    group = np.cumsum(anchor) - 1
    return np.bincount(group, weights=new).astype(np.int64)[group]


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return (batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64),
            batch.column("hash").to_numpy(zero_copy_only=False).astype(np.int64))


def fragments(batch: pa.RecordBatch, window: int, anchor: int = ANCHOR) -> np.ndarray:
    """The fragments of all rows: anchor hash, content hash, place, number of windows."""
    words = texts(batch)
    starts = words.windows(window)
    if not len(starts):
        return np.empty(0, _RECORD)
    grams = np.arange(len(words.hashes) - anchor + 1)
    gram = spans(words.hashes, grams, grams + anchor, WORD_BASE)
    per_window = window - anchor + 1
    least, width = gram, 1
    while width < per_window:  # running minimum, doubling the width
        step = min(width, per_window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    least = least[starts]
    at = np.zeros(len(starts), np.int64)
    for offset in range(per_window - 1, -1, -1):  # the leftmost of equal minima
        at[gram[starts + offset] == least] = offset
    place = starts + at
    new = np.ones(len(starts), bool)
    new[1:] = place[1:] != place[:-1]
    begin = np.flatnonzero(new)
    n = np.diff(np.r_[begin, len(starts)])
    first = starts[begin]
    shape = (n.astype(np.uint64) << np.uint64(32)) | (place[begin] - first).astype(np.uint64)
    content = mix(spans(words.hashes, first, first + n + window - 1, OTHER_BASE) ^ (shape * np.uint64(WORD_BASE)))
    doc, text = _places(batch)
    row = words.row[first]
    out = np.empty(len(begin), _RECORD)
    out["a"], out["b"], out["n"] = gram[place[begin]], content, n
    out["doc"], out["text"], out["start"] = doc[row], text[row], first - words.row_start[row]
    return out


def _marks(found: np.ndarray, kind: int) -> np.ndarray:
    out = np.empty((len(found), 5), np.int64)
    for i, values in enumerate((found["doc"], found["text"], np.full(len(found), kind), found["start"], found["n"])):
        out[:, i] = values
    return out


def _send(records: np.ndarray, marks: np.ndarray, blocks: int) -> pa.RecordBatch:
    """One row for each block: its records and, as passengers, findings that are already final."""
    block = (records["a"] >> np.uint64(33)).astype(np.int64) % blocks
    records = records[np.argsort(block, kind="stable")]
    ends = np.cumsum(np.bincount(block, minlength=blocks))
    parts = np.array_split(marks, blocks)
    rows = [(b, records[low:high].tobytes(), part.tobytes())
            for b, (low, high, part) in enumerate(zip(np.r_[0, ends[:-1]], ends, parts)) if high > low or len(part)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        zip(*rows) if rows else ([], [], []), (pa.int32(), pa.binary(), pa.binary()))], schema=_SENT)


def _parse(window: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            found, later = _earliest(fragments(batch, window))
            many = _contents(found) > CONTENTS
            send = ~later & ~many
            # of an anchor with many contents two go to the block, so that it knows of more than one
            crowded = np.flatnonzero(~later & many)
            if len(crowded):
                anchors = found["a"][crowded]
                begin = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
                nth = np.arange(len(anchors)) - np.repeat(begin, np.diff(np.r_[begin, len(anchors)]))
                other = np.r_[True, found["b"][crowded][1:] != found["b"][crowded][:-1]]
                send[crowded[other & (nth < 2)]] = True
            marks = np.concatenate([_marks(found[later], 1), _marks(found[~later & many & ~send], 2)])
            yield _send(found[send], marks, blocks)

    return run


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    records = np.frombuffer(b"".join(table.column("records").to_pylist()), _RECORD)
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.int64).reshape(-1, 5)
    return records, marks


def _table(*marks: np.ndarray) -> pa.Table:
    joined = np.concatenate(marks)
    return pa.Table.from_arrays([pa.array(joined[:, i]).cast(field.type) for i, field in enumerate(_MARKS)], schema=_MARKS)


def _fragment_block(table: pa.Table) -> pa.Table:
    records, passed = _received(table)
    found, later = _earliest(records)
    unlike = _contents(found) > 1
    return _table(passed, _marks(found[later], 1), _marks(found[~later & unlike], 2))


def _window_block(table: pa.Table) -> pa.Table:
    records, passed = _received(table)
    found, later = _earliest(records)
    return _table(passed, _marks(found[later], 1))


def _windows(window: int, blocks: int):
    """Look-ups of step 2: the windows of the listed fragments, first occurrences of the slice only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            words = texts(batch)
            doc, text = _places(batch)
            listed = batch.column("marks")
            code = listed.values.to_numpy(zero_copy_only=False)
            offsets = listed.offsets.to_numpy()
            code = np.asarray(code[offsets[0]:offsets[-1]], np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            start, n = code >> 32, code & 0xFFFFFFFF
            row, start = np.repeat(row, n), np.repeat(start, n)
            start = start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
            first = words.row_start[row] + start
            out = np.empty(len(first), _RECORD)
            out["a"] = spans(words.hashes, first, first + window, WORD_BASE)
            out["b"] = spans(words.hashes, first, first + window, OTHER_BASE)
            out["doc"], out["text"], out["start"], out["n"] = doc[row], text[row], start, 1
            found, later = _earliest(out)
            yield _send(found[~later], _marks(found[later], 1), blocks)

    return run


def copied_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of windows that occur earlier: doc, text (hash), kind 1, start, n; see :func:`remove_copies`."""
    keyed = _keyed(docs, id_col, text_col)
    blocks = 16 + (keyed.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // BLOCK_BYTES
    sent = keyed.mapInArrow(_parse(window, blocks), "block int, records binary, marks binary")
    marks = materialize(sent.groupBy("block").applyInArrow(_fragment_block, _MARKS_DDL), "copied-fragments")
    listed = _per_text(marks.where("kind = 2"))
    joined = keyed.join(listed, ["doc", "hash"])
    looked_up = (joined.mapInArrow(_windows(window, blocks), "block int, records binary, marks binary")
                 .groupBy("block").applyInArrow(_window_block, _MARKS_DDL))
    return marks.where("kind = 1").union(looked_up)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id (null sorts last), a 64-bit hash that tells texts of one id, or without one, apart, text (null is empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
                       F.xxhash64(text).alias("hash"), text.alias("text"))


def _per_text(marks: DataFrame) -> DataFrame:
    code = F.shiftleft(F.col("start").cast("long"), 32) + F.col("n")
    return (marks.groupBy("doc", F.col("text").alias("hash")).agg(F.collect_list(code).alias("marks")))


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            data, counts, removed, kept = data.tobytes(), [], [], []
            for low, high, marks in zip(offsets[:-1], offsets[1:], batch.column("marks")):
                words = data[low:high].split()  # bytes split at just the six separators
                counts.append(len(words))
                if marks.is_valid:
                    code = np.array(marks.as_py(), np.int64)
                    start, n = code >> 32, code & 0xFFFFFFFF
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + window - 1, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stays)]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def remove_copies(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text without the words of windows that occur earlier: id, n_words, n_removed, kept.

    A window is ``window`` consecutive words of one text; it goes if its word sequence also starts at a smaller
    (id, start).  All windows are judged on the input.  ``kept`` has the remaining words joined by one space.  A null
    text has no words, a null id sorts after all others.  Rows with one id and equal text get the same result, as
    neither starts earlier; with one id and different texts they are compared by their starts.  Texts shorter than a
    window lose nothing.  An empty table gives an empty result.  Other columns are left out.
    """
    marks = _per_text(copied_windows(docs, window, id_col, text_col))
    keyed = _keyed(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col)
    rows = keyed.join(marks, ["doc", "hash"], "left").select(
        F.when(F.col("doc") != (1 << 63) - 1, F.col("doc")).alias("id"), "text", "marks")
    return (rows.mapInArrow(_kept(window), "id long, n_words long, n_removed long, kept string")
            .withColumnRenamed("id", id_col))


def digests(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row the counts and the SHA-256 of the kept text."""
    return kept.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
