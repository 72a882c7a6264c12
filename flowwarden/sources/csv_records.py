"""Records of many CSV files in one scan of their lines, split anywhere.

A line break inside quotes does not end a record, and whether a split of a file starts inside quotes depends on all quotes before it.
Every split is therefore read under both assumptions; the parity of quotes, summed over the splits of a file, says which
one holds.  Records that cross splits are put together from their few fragments.  Only one row per split is ever
ordered, lines are not shuffled.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_EMITTED = 4000  # records per Arrow batch


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, block, value)``: lines of all ``*.csv`` below ``path``, in order within each split of a file."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), "value")


def fields(record: str) -> list[str | None]:
    """Fields of one record, empty ones as null; text that is no record is one field."""
    try:
        row = next(csv.reader([record]), [])
    except csv.Error:
        row = [record]
    return [x if x != "" else None for x in row]


class _Reading:
    """Records of one split under one assumption about its start."""

    def __init__(self, inside: bool):
        self.inside = self.head = inside  # head: still in the record that an earlier split began
        self.lines: list[str] = []
        self.number = 0

    def add(self, line: str, odd: bool) -> tuple[int, str] | None:
        """The record that ends with this line, and its number; the end of an earlier split's record has number -1."""
        blank = not self.inside and not odd and not line.strip()
        if blank:
            return None
        self.lines.append(line)
        self.inside ^= odd
        if self.inside:
            return None
        record, self.lines = "\n".join(self.lines), []
        number, self.head = (-1, False) if self.head else (self.number, False)
        self.number += 1
        return number, record


def _splits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Consecutive lines of one split, with the split's key; a split may come in several pieces."""
    for batch in batches:
        files, blocks = batch.column("file_path"), batch.column("block").to_pylist()
        coded = files.dictionary_encode()
        codes, names = coded.indices.to_pylist(), coded.dictionary.to_pylist()
        values = batch.column("value").to_pylist()
        low = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or codes[i] != codes[low] or blocks[i] != blocks[low]:
                yield (names[codes[low]], blocks[low]), values[low:i]
                low = i


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: parity of its quotes, records ended in it under both assumptions, its first record if it starts a file."""
    key, rows = None, []

    def row() -> tuple:
        return (*key, int(readings[0].inside), readings[0].number, readings[1].number, header)

    for own, lines in _splits_of(batches):
        if own != key:
            if key is not None:
                rows.append(row())
            key, readings, header = own, (_Reading(False), _Reading(True)), None
        for line in lines:
            odd = bool(line.count('"') & 1)
            ended = readings[0].add(line, odd)
            readings[1].add(line, odd)
            if header is None and ended and own[1] == 0:
                header = ended[1]
    if key is not None:
        rows.append(row())
    if rows:
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
             pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.string())],
            ["file_path", "block", "parity", "n0", "n1", "header"])


def read_splits(lines: DataFrame) -> DataFrame:
    """One row per split: ``file_path, block, start`` (1: inside quotes), ``records`` ended in it, ``first`` (records before it),
    ``open`` (1: it ends inside quotes), ``last`` (the file's last split) and the file's ``header``."""
    found = lines.mapInArrow(_summarise, "file_path string, block long, parity int, n0 long, n1 long, header string")
    order = Window.partitionBy("file_path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).cast("int")
    states = found.withColumn("start", start).withColumn(
        "records", F.when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1")))
    return states.select(
        "file_path", "block", "start", "records", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("first"),
        ((F.col("start") + F.col("parity")) % 2).cast("int").alias("open"),
        F.lead("block").over(order).isNull().alias("last"),
        F.first("header", ignorenulls=True).over(order).alias("header"))


def count_records(splits: DataFrame) -> DataFrame:
    """``(file_path, records, header)`` of every file with a line, the header being its first record.

    A quote left open at the end of a file makes what follows it one record.
    """
    unfinished = F.max(F.when(F.col("last"), F.col("open")).otherwise(0))
    return splits.groupBy("file_path").agg((F.sum("records") + unfinished).alias("records"), F.first("header", True).alias("header"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and fragments of every split under the assumptions it may have; a file starts outside quotes."""
    csv.field_size_limit(1 << 30)
    out: list[tuple] = []
    key, readings = None, ()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
             pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.list_(pa.string())), pa.array(columns[5], pa.string())],
            ["file_path", "block", "start", "number", "values", "fragment"])

    def rest() -> None:
        """A record left open: its number is -3 where the split both ends and began inside it, else -2."""
        for start, reading in enumerate(readings):
            if reading.lines:
                out.append((*key, start, -3 if reading.head else -2, None, "\n".join(reading.lines)))

    for own, lines in _splits_of(batches):
        if own != key:
            rest()
            key, readings = own, (_Reading(False), _Reading(True))[:1 if own[1] == 0 else 2]
        for line in lines:
            odd = bool(line.count('"') & 1)
            for start, reading in enumerate(readings):
                ended = reading.add(line, odd)
                if ended is not None:
                    number, record = ended
                    out.append((*key, start, number, *((fields(record), None) if number >= 0 else (None, record))))
        if len(out) >= _EMITTED:
            yield flush()
    rest()
    if out:
        yield flush()


def _join_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(1 << 30)
    for batch in batches:
        values = [fields(x) for x in batch.column("record").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file_path"), batch.column("number"), pa.array(values, pa.list_(pa.string()))],
                                         ["file_path", "number", "values"])


def read_records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``(file_path, number, values array<string>)`` of every record; the header of a file has number 0.

    ``splits`` is :func:`read_splits` of the same lines, written once: one row per split.
    """
    read = lines.mapInArrow(_parse, "file_path string, block long, start int, number long, values array<string>, fragment string")
    true = read.join(splits.select("file_path", "block", "start", "first", "records"), ["file_path", "block", "start"])
    whole = true.where("number >= 0").select("file_path", (F.col("first") + F.col("number")).alias("number"), "values")
    # fragments, at most two per split: -2 begins a record, -3 goes on, -1 ends it
    parts = true.where("number < 0").withColumn("place", F.when(F.col("number") == -2, 1).otherwise(0))
    order = Window.partitionBy("file_path").orderBy("block", "place")
    grouped = parts.withColumn("record", F.sum(F.when(F.col("number") == -2, 1).otherwise(0)).over(order))
    pieces = F.sort_array(F.collect_list(F.struct("block", "place", "fragment")))
    joined = grouped.groupBy("file_path", "record").agg(
        pieces.alias("pieces"), F.max(F.when(F.col("number") == -1, F.col("first"))).alias("ended"),
        F.max(F.col("first") + F.col("records")).alias("behind"))
    texts = joined.select("file_path", F.coalesce("ended", "behind").alias("number"), F.array_join("pieces.fragment", "\n").alias("record"))
    return whole.unionByName(texts.mapInArrow(_join_fragments, "file_path string, number long, values array<string>"))
