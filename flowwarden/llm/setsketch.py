"""Near-duplicate documents by SetSketch registers: band, estimate by likelihood, verify on whole sets.

A sketch holds, for each of m hash functions, the smallest hash value of the set as an exponential variable, truncated
to a power of ``BASE``: register = floor(1 - log(value)).  Sketches of parts merge by the register-wise maximum, and
the share of equal registers grows with the Jaccard similarity, so that runs of registers serve as bands.

1. Documents with equal shingle sets form one class, represented by its smallest id.
2. Representatives that share a band value meet.  From three counts (registers larger, smaller, equal) and both set
   sizes, the likelihood says whether the similarity can reach the threshold; what is left links candidates.
3. Inside each connected group of candidates the whole sets are compared exactly.
4. Components of the confirmed links give every document its class.

Steps 2 and 3 take two rounds.  The first compares every member of a group with its hub, the smallest member (step 3
also within blocks of the group); the second takes only groups that the first left in several parts.  There the largest
part and the rest are cut into blocks; a block of the rest and any other block are one cell, so no task holds a large
group, and a cell returns links between different parts only, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowwarden.llm.components import components
from flowwarden.llm.words import BYTE_BASE, WORD_BASE, mix, slices, spans, texts
from flowwarden.session import materialize

#: Bands and registers of a band.  At similarity 0.8 a pair shares no band in 7 of a million cases.
BANDS, ROWS = 48, 7
REGISTERS = BANDS * ROWS
#: Base and rate of the registers, which fit into a byte for sets of up to 10**9 members.
BASE, RATE, LARGEST = 1.1, 20.0, 255
#: Members of a block; a cell compares two blocks.
BLOCK = 256
EDGE = "a long, b long"

_FACTOR = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(BYTE_BASE)) | np.uint64(1)
_SHIFT = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(WORD_BASE))


def shingle_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each row; a shorter text is one shingle, an empty one has none."""
    words = texts(batch, lower=True)
    starts = words.windows(width)
    hashes = spans(words.hashes, starts, starts + width, WORD_BASE)
    bounds = np.searchsorted(starts, words.row_start)
    out = []
    for row in range(batch.num_rows):
        low, high = words.row_start[row], words.row_start[row + 1]
        if high - low >= width:
            out.append(np.unique(hashes[bounds[row]:bounds[row + 1]]))
        elif high > low:
            out.append(spans(words.hashes, np.array([low]), np.array([high]), WORD_BASE))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def registers(members: np.ndarray) -> np.ndarray:
    """SetSketch of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for low in range(0, len(members), 128):
        np.minimum(least, (members[low:low + 128, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LARGEST).astype(np.uint8)


def may_reach(threshold: float, sketch: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the most likely similarity to each other set is at least ``threshold``.

    The log-likelihood of the counts of larger, smaller and equal registers is concave in the similarity, so its
    slope at the threshold tells on which side the maximum lies.
    """
    larger, smaller = (sketch > others).sum(axis=1), (sketch < others).sum(axis=1)
    share = size / (size + sizes)
    step = (BASE - 1) / BASE
    x, y = share - (1 - share) * threshold, (1 - share) - share * threshold
    possible = (x >= 0) & (y >= 0)
    x, y = np.maximum(x, 1e-12), np.maximum(y, 1e-12)
    chance = lambda z: -np.log1p(-z * step) / np.log(BASE)
    rate = lambda z: step / (1 - z * step) / np.log(BASE)
    dx, dy = -(1 - share) * rate(x), -share * rate(y)
    slope = larger * dx / chance(x) + smaller * dy / chance(y) \
        - (REGISTERS - larger - smaller) * (dx + dy) / (1 - chance(x) - chance(y))
    return possible & (slope >= 0)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch, width)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([registers(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
            ], ["id", "n", "class", "registers"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(WORD_BASE)) | np.uint64(1)
    seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        sketch = _stack(batch.column("registers")).reshape(-1, BANDS, ROWS).astype(np.uint64)
        value = mix((sketch * weights).sum(axis=2, dtype=np.uint64) ^ seeds)
        node = np.repeat(batch.column("node").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(value.reshape(-1).view(np.int64)), pa.array(node)], ["band", "node"])


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), REGISTERS)


def _stars(links: np.ndarray, node: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect what a symmetric boolean matrix connects: from the smallest node of each part to the others.

    Cells that overlap then mostly return the same edges.
    """
    open_ = np.ones(len(links), bool)
    for root in np.argsort(node, kind="stable"):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            found = np.flatnonzero(links[queue.pop()] & open_)
            open_[found] = False
            for other in found:
                yield int(node[root]), int(node[other])
            queue.extend(found)


def _block(size: str) -> tuple[Column, Column]:
    """Number of blocks of a group of that size, and the block of a row."""
    blocks = F.greatest(F.ceil(F.col(size) / BLOCK).cast("int"), F.lit(1))
    return blocks, F.pmod(F.xxhash64("node"), blocks).cast("int")


def _own_blocks(df: DataFrame, key: str, size: str) -> DataFrame:
    """One cell for each block of a group, which also gets the hub, the row whose node is the key."""
    blocks, mine = _block(size)
    mine = F.when(F.col("node") == F.col(key), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(mine))
    dealt = df.withColumn("block", F.explode(mine)).withColumn("cell", F.xxhash64(key, "block")).drop("block", key, size)
    return dealt.repartition("cell").sortWithinPartitions("cell")


def _across_parts(df: DataFrame, key: str) -> DataFrame:
    """Cells in which every row meets all rows of its group but, where its part is the main one, the rows of that part.

    Blocks of the rest pair with blocks of the main part and with each other.  The main part thus costs no more
    rows than it has times the blocks of the rest.
    """
    main_blocks, in_main = _block("main_n")
    rest_blocks, in_rest = _block("rest_n")
    rest = F.sequence(F.lit(0), rest_blocks - 1)
    cell = lambda kind, a, b: F.xxhash64(F.col(key), F.lit(kind), a, b)
    cells = F.when(F.col("part") == F.col("main"), F.transform(rest, lambda r: cell("main", in_main, r))).otherwise(F.concat(
        F.transform(F.sequence(F.lit(0), main_blocks - 1), lambda m: cell("main", m, in_rest)),
        F.transform(rest, lambda r: cell("rest", F.least(r, in_rest), F.greatest(r, in_rest)))))
    dealt = df.withColumn("cell", F.explode(cells)).drop(key, "main", "main_n", "rest_n")
    return dealt.repartition("cell").sortWithinPartitions("cell")


def _in_parts(members: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """Members of those groups whose nodes lie in several parts (``node``, ``label``).

    Each comes with its ``part``, the ``main`` (largest) part of its group, and how many members are in it and not.
    """
    named = members.join(parts.select("node", F.col("label").alias("part")), "node", "left").withColumn(
        "part", F.coalesce("part", "node"))
    counts = named.groupBy(key, "part").agg(F.count("*").alias("n"))
    several = counts.groupBy(key).agg(
        F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("main_n"),
        (F.sum("n") - F.max("n")).alias("rest_n")).where("rest_n > 0")
    return named.join(several, key)


def _by_cell(links_of: Callable[[pa.Table], np.ndarray]):
    """Rows sorted by cell, one cell at a time, to edges between the parts that its links connect."""

    def edges(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        table = pa.Table.from_batches(parts).combine_chunks()
        if table.num_rows < 2:
            return []
        part, code = np.unique(table.column("part").to_numpy(), return_inverse=True)
        if len(part) < 2:
            return []
        joined = np.zeros((len(part), len(part)), bool)
        a, b = np.nonzero(links_of(table))
        joined[code[a], code[b]] = True
        return list(_stars(joined, part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            if not len(cell):
                continue
            bounds = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
            found: list[tuple[int, int]] = []
            for low, high in zip(bounds[:-1], bounds[1:]):
                if held and cell[low] != last:
                    found += edges(held)
                    held = []
                held.append(batch.slice(low, high - low))
                last = cell[low]
            yield _edge_batch(found)
        if held:
            yield _edge_batch(edges(held))

    return run


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _likely(threshold: float):
    def links(table: pa.Table) -> np.ndarray:
        sketch = _stack(table.column("registers").combine_chunks())
        size = table.column("n").to_numpy()
        return np.stack([may_reach(threshold, sketch[i], size[i], sketch, size) for i in range(len(size))])

    return links


def _likely_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mine, hubs = _stack(batch.column("registers")), _stack(batch.column("hub_registers"))
                keep = may_reach(threshold, mine, batch.column("n").to_numpy(), hubs, batch.column("hub_n").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("node")], ["a", "b"]).filter(pa.array(keep))

    return run


def _exact(percent: int):
    def links(table: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(s, np.uint64) for s in table.column("members").to_pylist()]
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        member = np.concatenate(sets)
        order = np.argsort(member, kind="stable")
        member, row = member[order], row[order]
        new = np.r_[True, member[1:] != member[:-1]]
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        common = np.zeros((len(sets), len(sets)), np.int64)
        step = max(1, (4 << 20) // len(sets))  # columns of the membership matrix held at once
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            a, b = np.searchsorted(column, [low, low + step])
            part = np.zeros((len(sets), step), np.float32)
            part[row[a:b], column[a:b] - low] = 1
            common += (part @ part.T).astype(np.int64)
        return 100 * common >= percent * (size[:, None] + size[None, :] - common)

    return links


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = pa.array([s.tobytes() for s in shingle_sets(batch, width)], pa.binary())
            kept = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(kept | {"members": sets})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Every row with its class: id, n_shingles, component_id (smallest id reachable by links), kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of ``width``-word shingles
    (ASCII letters lower-cased, words unchanged otherwise).  A text with fewer words is one shingle; a null or empty
    text has none and is linked with nothing.  Rows that share an id are classed by their own texts; an id that stands for
    several texts joins their classes.  A row with a null id takes no part: its component is null and it is kept.  An empty table gives an empty result.  Other
    columns are left out.  ``kept`` marks the row whose id is its component's.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = materialize(keyed.mapInArrow(_sketches(width), "id long, n long, class binary, registers binary"), "sketches")
    filled = rows.where("n > 0 and id is not null")
    classes = filled.groupBy("class").agg(F.min("id").alias("node"))
    nodes = (filled.join(classes.withColumnRenamed("class", "c"), F.expr("class = c and id = node"))
             .select("node", "n", "registers", "class").dropDuplicates(["node", "class"]))
    nodes = materialize(nodes, "representatives")

    # candidates: a band value held by two representatives or more
    bands = nodes.mapInArrow(_bands, "band long, node long").distinct()
    # bands met by the same representatives are one group: their members' hashes add up alike
    same_band = Window.partitionBy("band")
    met = (bands.withColumn("size", F.count("*").over(same_band)).withColumn("hub", F.min("node").over(same_band))
           .withColumn("group", F.bit_xor(F.xxhash64("node")).over(same_band)).where("size > 1")
           .select("group", "size", "hub", "node").distinct())
    met = materialize(met, "met")
    reach = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
    sketch = nodes.select("node", "n", "registers")
    hubs = sketch.select(*[F.col(c).alias(as_) for c, as_ in (("node", "hub"), ("n", "hub_n"), ("registers", "hub_registers"))])
    pairs = met.where("hub <> node").select("hub", "node").distinct().join(sketch, "node").join(hubs, "hub")
    likely = components(pairs.mapInArrow(_likely_pairs(reach), EDGE))
    # a group of two is its hub's only pair
    apart = _in_parts(met.where("size > 2").select("group", "node"), "group", likely)
    cells = _across_parts(apart.join(sketch, "node"), "group")
    likely = components(likely.toDF("b", "a").unionByName(cells.mapInArrow(_by_cell(_likely(reach)), EDGE)))

    # exact comparison inside each group of candidates
    sizes = likely.groupBy("label").agg(F.count("*").alias("size"))
    groups = likely.join(sizes, "label")
    # the groups grow with the documents, so they are not broadcast, whatever their size
    held = keyed.join(groups.hint("merge"), keyed["id"] == groups["node"]).select("node", "label", "size", "text")
    held = materialize(held, "candidates")

    sets = _members(width)
    members = held.withColumn("part", F.col("node")).mapInArrow(
        sets, "node long, label long, size long, part long, members binary")
    confirmed = components(_own_blocks(members, "label", "size").mapInArrow(_by_cell(_exact(percent)), EDGE))
    large = held.where(F.col("size") > BLOCK)
    apart = materialize(_in_parts(large.select("node", "label").distinct(), "label", confirmed).drop("label"), "apart")
    if not apart.isEmpty():
        schema = "node long, label long, part long, main long, main_n long, rest_n long, members binary"
        members = large.drop("size").join(apart, "node").mapInArrow(sets, schema)
        found = _across_parts(members, "label").mapInArrow(_by_cell(_exact(percent)), EDGE)
        confirmed = components(confirmed.toDF("b", "a").unionByName(found))

    same = rows.select("id", "n", "class").join(classes, "class", "left")
    component = F.when(F.col("n") > 0, F.coalesce("label", "node")).otherwise(F.col("id"))
    return (same.join(confirmed, "node", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), component).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))
