"""Uniform shuffle into shards of exact sizes, through a hypergeometric communication matrix.

Rows are first dealt to source partitions by a hash of their id.  The number of rows that each partition sends to
each shard is drawn exactly as a uniform random permutation of all rows would make it: a random contingency table
with the partition sizes and the shard sizes as margins.  Rows are permuted inside their partition, cut at the drawn
counts, exchanged, and permuted again inside their shard.  Only the partition sizes and the table reach the driver.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowwarden.session import materialize

#: Source partitions for each root of the number of rows: their number and their size both grow with the root, so that
#: neither the matrix on the driver nor a window grows with the rows.
PARTS_PER_ROOT = 1.0
#: Equal rows that are told apart in one task.
_REPEATS = 10_000
_BITS = 32


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items, taken without putting back, are good.

    Rejection sampling for log-concave laws with a known mode; four tries on average at any size.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low

    def log_p(k: int) -> float:
        return -sum(math.lgamma(x + 1) for x in (k, good - k, draws - k, bad - draws + k))

    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    total = math.lgamma(good + 1) + math.lgamma(bad + 1) + math.lgamma(draws + 1) + math.lgamma(good + bad - draws + 1) \
        - math.lgamma(good + bad + 1)
    top = log_p(mode)
    peak = math.exp(min(0.0, top + total))
    width = 1 + peak / 2
    while True:
        if rng.random() <= width / (1 + width):
            reach = rng.random() * width / peak
        else:
            reach = (width - math.log(1 - rng.random())) / peak
        step = round(reach)
        k = mode + (step if rng.random() < 0.5 else -step)
        if low <= k <= high and rng.random() * min(1.0, math.exp(width - peak * reach)) <= math.exp(log_p(k) - top):
            return k


def communication_matrix(counts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows sent by each partition to each shard; row sums are ``counts``, column sums ``shards``."""
    if sum(counts) != sum(shards):
        raise ValueError("partition sizes and shard sizes differ in total")
    rng, left, matrix = random.Random(seed), list(shards), []
    for count in counts:
        rest, row = sum(left), []
        for room in left:
            sent = hypergeometric(rng, room, rest - room, count - sum(row))
            row.append(sent)
            rest -= room
        left = [room - sent for room, sent in zip(left, row)]
        matrix.append(row)
    return matrix


def _bucket(key: Column, n: int) -> Column:
    """The range of equal width, of ``n``, into which the upper bits of a 64-bit hash fall."""
    return F.floor(F.shiftrightunsigned(key, 64 - _BITS) * F.lit(n) / F.lit(1 << _BITS)).cast("int")


def _told_apart(key: DataFrame) -> DataFrame:
    """The rows with a number for each of those that are equal; a row that many others equal is numbered in several tasks.

    Equal rows are counted before they are shuffled and then made again, as nothing but their number is needed.
    """
    counted = key.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _REPEATS).cast("long")))
    chunks = counted.withColumn("chunk", chunk).repartition("id", "size", "text_crc32", "chunk")
    first = F.col("chunk") * _REPEATS
    number = F.explode(F.sequence(first, F.least(first + _REPEATS, F.col("n")) - 1))
    return chunks.select("id", "size", "text_crc32", number.alias("number"))


def uniform_shards(rows: DataFrame, n_shards: int, seed: int = 7, id_col: str = "doc_id",
                   text_col: str = "text", parts_per_root: float = PARTS_PER_ROOT) -> DataFrame:
    """Deal all rows into ``n_shards`` shards whose sizes differ by one at most, in random order.

    Returns id, size (UTF-8 bytes of the text plus 8), text_crc32, shard and slot (0, 1, ... in each shard).  The
    result depends on the rows, the seed and ``parts_per_root`` alone, not on files or partitions.  A null id is
    a value like any other, a null text counts as no bytes; rows that repeat entirely are numbered, dealt one by one and
    get slots of their own.  An empty table gives an empty result.  Other columns are left out.
    """
    spark = rows.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = _told_apart(rows.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                                  F.crc32(text.cast("binary")).cast("long").alias("text_crc32")))
    key = materialize(key.withColumn("k", F.xxhash64(F.lit(seed), "id", "text_crc32", "size", "number")), "shard-keys")
    n_rows = key.count()
    parts = 16 + int(math.isqrt(n_rows) * parts_per_root)
    key = key.withColumn("part", _bucket("k", parts))
    counted = {r["part"]: r["count"] for r in key.groupBy("part").count().collect()}
    counts = [counted.get(p, 0) for p in range(parts)]
    targets = [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]
    matrix = communication_matrix(counts, targets, seed)
    bounds, pieces = [], max(1, math.ceil(parts / n_shards))
    for p, row in enumerate(matrix):
        ends, at = [], 0
        for sent in row:
            at += sent
            ends.append(at)
        bounds.append((p, ends))
    table = spark.createDataFrame(bounds, "part int, ends array<long>")
    permuted = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "k"), "k", "id", "size", "number")
    sent = (key.withColumn("at", F.row_number().over(permuted)).join(table, "part")
            .withColumn("shard", F.size(F.filter("ends", lambda end: end < F.col("at"))).cast("int"))
            .withColumn("k2", F.xxhash64(F.lit(seed + 2), "k", "shard"))
            .withColumn("piece", _bucket("k2", pieces)))
    # where each piece of a shard begins: the second permutation orders pieces by the upper bits of its key
    begins = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sent.groupBy("shard", "piece").count()
               .select("shard", "piece", F.coalesce(F.sum("count").over(begins), F.lit(0)).alias("begin")))
    again = Window.partitionBy("shard", "piece").orderBy("k2", "k", "id", "size", "number")
    return (sent.withColumn("within", F.row_number().over(again)).join(offsets, ["shard", "piece"])
            .select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("begin") + F.col("within") - 1).cast("long").alias("slot")))
