"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Candidates are cut into blocks, queries into chunks, and every chunk meets every block once.  In a block the vectors
are turned into postings, one list of (candidate, weight) per term.  Each term of the queries scatters its weighted
postings into a dense array of scores; the k best of a block come from a partition selection, and the lists of all
blocks are merged.  Nothing is pruned: every candidate gets its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Candidates of a block and queries of a chunk.  A block is sent once for each chunk, a chunk once for each block, so
#: larger chunks move fewer bytes; a task holds one block, one chunk and a slab of scores.
BLOCK_ROWS, CHUNK_ROWS = 4096, 2048
_SLAB = 128


def scaled(rows: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v``: floor(scale * x) of each component; rows with a null or non-finite component are left out.

    A scaled component beyond 64 bits ends the job with an error.
    """
    most = F.lit(float(1 << 62))
    floor = lambda x: F.floor(F.when(F.abs(x) < most, x).otherwise(
        F.raise_error(F.lit("a scaled component exceeds 64 bits")).cast("double")))
    vector = F.transform(F.col(vector_col), lambda x: floor(x.cast("double") * scale).cast("long"))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"), vector.alias("v")))


def _extent(rows: DataFrame) -> tuple[int, int, int]:
    """Rows, largest absolute component and largest number of components."""
    r = rows.agg(F.count(F.lit(1)), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))), F.max(F.size("v"))).first()
    return r[0], r[1] or 0, r[2] or 0


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, and the non-zero weights as (slot, term, weight), slots following the ids."""
    ids = table.column("id").to_numpy()
    vectors = table.column("v").combine_chunks()
    order = np.argsort(ids, kind="stable")
    slot_of = np.empty(len(ids), np.int64)
    slot_of[order] = np.arange(len(ids))
    ends = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].astype(np.int64)
    lengths = np.diff(ends)
    row = np.repeat(np.arange(len(ids)), lengths)
    term = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)
    used = flat != 0
    return ids[order], slot_of[row[used]], term[used], flat[used]


def _postings(slots: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int):
    """Per term its slots and weights; a term that every candidate has is kept as one dense run."""
    order = np.lexsort((slots, terms))
    slots, terms, weights = slots[order], terms[order], weights[order]
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.empty(0, np.int64)
    for start, end in zip(starts, np.r_[starts[1:], len(terms)]):
        where = slice(0, n) if end - start == n else slots[start:end]
        yield terms[start], where, weights[start:end]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Slots of the k highest scores, best first, ties to the smaller slot."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        found = np.r_[above, np.flatnonzero(scores == least)[:k - len(above)]]
    else:
        found = np.arange(len(scores))
    return found[np.lexsort((found, -scores[found]))]


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            query_ids, q_slots, q_terms, q_weights = _columns(left)
            ids, slots, terms, weights = _columns(right)
            lists = list(_postings(slots, terms, weights, len(ids)))
            for low in range(0, len(query_ids), _SLAB):
                high = min(low + _SLAB, len(query_ids))
                mine = (q_slots >= low) & (q_slots < high)
                sparse: dict[int, tuple[np.ndarray, np.ndarray]] = {
                    t: (rows - low, w) for t, rows, w in _postings(q_slots[mine], q_terms[mine], q_weights[mine], -1)}
                scores = np.zeros((high - low, len(ids)), np.int64)
                for term, where, posting in lists:
                    if term in sparse:
                        for row, weight in zip(*sparse[term]):
                            if isinstance(where, slice):
                                scores[row] += weight * posting
                            else:
                                scores[row, where] += weight * posting  # slots of a list are distinct
                for row in range(high - low):
                    own = slice(np.searchsorted(ids, query_ids[low + row], "left"),
                                np.searchsorted(ids, query_ids[low + row], "right"))
                    line, at = scores[row], ids
                    if own.stop > own.start:
                        line, at = np.delete(line, own), np.delete(ids, own)
                    best = _best(line, k)
                    out.append((np.full(len(best), query_ids[low + row]), at[best], line[best]))
        columns = [np.concatenate(c) if out else np.empty(0, np.int64) for c in zip(*out)] or [np.empty(0, np.int64)] * 3
        return pa.table({"query_id": columns[0], "id": columns[1], "score": columns[2]})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The k candidates of the highest inner product for each query: query_id, rank (from 1), id_col, score.

    Components become floor(scale * x), so scores are exact integers; where a score might exceed 64 bits, by the largest
    components of both sides, a ValueError says so.  Ties go to the smaller id; a query's own id is no candidate.  Vectors that are null or hold a null or
    non-finite component take no part, nor do null ids.  Missing trailing components count as zero.  Of query rows
    with the same id the smallest vector asks; candidate rows that repeat an id each count.  A query that finds fewer
    than k candidates gets those; empty tables give an empty result.  Other columns are left out.
    """
    asked = scaled(queries, scale, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    held = scaled(candidates, scale, id_col, vector_col)
    (n_asked, most_asked, width_asked), (n_held, most_held, width_held) = _extent(asked), _extent(held)
    if most_asked * most_held * min(width_asked, width_held) >= 1 << 63:
        raise ValueError(f"scores may exceed 64 bits: components up to {most_asked} and {most_held}")
    # components of ordinary vectors travel as 32-bit numbers
    asked, held = (side.withColumn("v", F.col("v").cast("array<int>")) if most < 1 << 31 else side
                   for side, most in ((asked, most_asked), (held, most_held)))
    chunks = 1 + n_asked // chunk_rows
    blocks = 1 + n_held // block_rows
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    left = asked.select("id", "v", dealt(chunks, 1).alias("chunk"), spread(blocks).alias("block"))
    right = held.select("id", "v", dealt(blocks, 2).alias("block"), spread(chunks).alias("chunk"))
    found = (left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block"))
             .applyInArrow(_cell(k), "query_id long, id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
