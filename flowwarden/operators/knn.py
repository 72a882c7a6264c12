"""k-nearest-neighbour joins.

Three plans, one result contract ``(query_id, grp, row_id, dist, rank)``:

* ``cells`` - both sides large.  The reference side is cut into Voronoi cells around sampled (or k-means)
  centres.  Each query gets an upper bound on its k-th distance from the centre table alone and visits only
  cells whose lower bound (triangle inequality and bisecting hyperplane) does not exceed it.  Neighbouring cells
  make a work unit, to which a query travels once however many of its cells it visits, so the join is an equi-join on
  ``(unit, salt, qsalt)`` and still exact.  Heavy cells are split by ``salt`` on the reference side, units by
  ``qsalt`` on the query side; sizes are measured first, so every unit is bounded on both sides however skewed the
  data is, and emits only its own top k, found by :mod:`flowwarden.operators.leaves` or, where dimensions are many, by
  products.  With ``nprobe`` only the nprobe nearest cells count (approximate); bounds then hold for their rows.
* ``blocks`` - both sides large, many dimensions: see :mod:`flowwarden.operators.blocks`.
* ``scan`` - few queries (counted first).  The queries travel to every reference partition, which answers
  with its local top k; the reference side is never shuffled.

Exact copies beyond the k smallest ids per vector can never reach a top k, so they are dropped before
anything is shuffled; this is what keeps massively duplicated attack traffic cheap.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.functions.vectors import as_double
from flowwarden.operators import leaves
from flowwarden.session import materialize

ALL = "all"
METRICS = ("l2", "cosine")
CELL_BUDGET = 65536  # centres over all groups; with CENTRE_BYTES bounds what is broadcast
CENTRE_BYTES = 64 << 20
BLOCK_BYTES = 16 << 20  # reference vectors per work unit
UNIT_ROWS = 1 << 18  # most reference rows of the cells put together to a work unit
QUERY_BYTES, QUERY_ROWS = 8 << 20, 1 << 17  # queries per work unit
LEAST_QUERIES = 1024  # queries of a work unit that are not split further to keep all cores busy
TWO_ROUND_UNITS = 4  # units of a group beyond which the home unit is searched first
PACK_BYTES = 8 << 20  # vectors packed at a time
LEAF_DIMENSIONS = 32  # beyond these, boxes leave nothing out
PRUNED_CELLS = 1000  # most cells named in a partition filter on the stored index
NOT_FINITE = 1e6
SCAN_QUERIES = 1000  # most queries the scan plan broadcasts
DENSE = 0.1  # share of candidate pairs from which a block is computed as a whole
MATRIX_CELLS = 2_000_000  # largest distance block held by one kernel step
TILE, CHUNK = 256, 4096  # queries and references of one product of a top k


# --------------------------------------------------------------------------------------------- input


def reference_rows(df: DataFrame, row_id: str, features: str | Column,
                   group: str | Column | None = None) -> DataFrame:
    """Project a table to the reference contract ``(grp, row_id, features)``."""
    grp = F.lit(ALL) if group is None else (F.col(group) if isinstance(group, str) else group)
    return df.select(
        F.coalesce(grp.cast("string"), F.lit("unknown")).alias("grp"),
        F.col(row_id).alias("row_id"),
        _vector(features).alias("features"),
    ).where(F.col("features").isNotNull())


def query_rows(df: DataFrame, query_id: str, features: str | Column,
               group: str | Column | None = None) -> DataFrame:
    """Project a table to the query contract ``(query_id, features[, grp])``; ``grp`` restricts the search."""
    cols = [F.col(query_id).alias("query_id"), _vector(features).alias("features")]
    if group is not None:
        grp = F.col(group) if isinstance(group, str) else group
        cols.append(F.coalesce(grp.cast("string"), F.lit("unknown")).alias("grp"))
    return df.select(*cols).where(F.col("features").isNotNull())


def _vector(features: str | Column) -> Column:
    return as_double(F.col(features) if isinstance(features, str) else features)


def drop_surplus_copies(refs: DataFrame, copies: int) -> DataFrame:
    """Keep the ``copies`` smallest ids of each distinct vector per group (lossless for k <= copies).

    Adds ``copy`` (1-based).  The rank limit is applied before the shuffle as well, so a vector that makes
    up a third of the table leaves at most ``copies`` rows per input partition.
    """
    w = Window.partitionBy("grp", "features").orderBy("row_id")
    return refs.withColumn("copy", F.row_number().over(w)).where(F.col("copy") <= copies)


# --------------------------------------------------------------------------------------------- index


@dataclass
class CellIndex:
    """Reference vectors cut into cells, plus the bounded centre table.

    ``vectors``: ``(grp, row_id, features, cell, salt)``; ``centres[g]``: matrix; ``cells[g]``: dict of
    arrays ``cell, radius, near, salts, rows`` aligned with it.
    """

    vectors: DataFrame
    copies: int
    metric: str = "l2"
    centres: dict[str, np.ndarray] = field(default_factory=dict)
    cells: dict[str, dict[str, np.ndarray]] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)  # kept rows per group

    @property
    def spark(self) -> SparkSession:
        return self.vectors.sparkSession

    def cell_table(self) -> DataFrame:
        """One row per cell (at most ``CELL_BUDGET``)."""
        rows = []
        for g, c in self.cells.items():
            for i in range(len(c["cell"])):
                near = [float(x) for x in c["near"][i] if math.isfinite(x)]
                rows.append((g, int(c["cell"][i]), [float(x) for x in self.centres[g][i]],
                             float(c["radius"][i]), near, int(c["salts"][i]), self.sizes[g], self.copies,
                             self.metric, int(c["rows"][i])))
        schema = ("grp string, cell int, centre array<double>, radius double, near array<double>, "
                  "salts int, group_rows bigint, copies int, metric string, rows bigint")
        return self.spark.createDataFrame(rows, schema)

    @staticmethod
    def from_tables(vectors: DataFrame, cell_table: DataFrame) -> "CellIndex":
        index = CellIndex(vectors, 1)
        by_group: dict[str, list] = {}
        stored = cell_table.orderBy("cell").limit(CELL_BUDGET + 1).collect()
        if len(stored) > CELL_BUDGET:
            raise ValueError(f"the stored index has more than {CELL_BUDGET} cells")
        for row in stored:
            by_group.setdefault(row["grp"], []).append(row)
            index.copies, index.metric = row["copies"], row["metric"]
        for g, rows in by_group.items():
            near = np.full((len(rows), index.copies), np.inf)
            for i, r in enumerate(rows):
                near[i, : len(r["near"])] = r["near"]
            index.sizes[g] = rows[0]["group_rows"]
            index.centres[g] = np.array([r["centre"] for r in rows], dtype=float)
            index.cells[g] = {
                "cell": np.array([r["cell"] for r in rows], dtype=np.int32),
                "radius": np.array([r["radius"] for r in rows], dtype=float),
                "near": near,
                "salts": np.array([r["salts"] for r in rows], dtype=np.int32),
                # an index stored without sizes: as if cells were even
                "rows": np.array([r["rows"] if "rows" in r else -(-r["group_rows"] // len(rows)) for r in rows], dtype=np.int64),
            }
        return index


def default_cells(n: int, cap: int) -> int:
    return max(1, min(cap, round(math.sqrt(n))))


def build_cells(refs: DataFrame, copies: int = 10, cells_for=None, train: str = "sample", seed: int = 42,
                block_rows: int | None = None, metric: str = "l2", train_rounds: int = 10,
                rows_per_centre: int | None = None) -> CellIndex:
    """Build a :class:`CellIndex` from ``(grp, row_id, features)``.

    ``cells_for(group, rows)`` sets the number of cells; more than the budget is an error, as a smaller number would
    change what ``nprobe`` finds.  ``train`` is ``"sample"`` (centres are hash-sampled vectors) or ``"kmeans"``
    (``train_rounds`` rounds of Lloyd's method over all rows, or about ``rows_per_centre`` of them per centre).
    Results of exact searches do not depend on either.  With ``metric="cosine"`` vectors are scaled to length 1 wherever
    they are read, and neighbours rank by inner product.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    spark = refs.sparkSession
    kept = materialize(drop_surplus_copies(refs, copies), "vectors")
    groups = kept.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("dim")) \
        .limit(CELL_BUDGET + 1).collect()
    sizes = {r["grp"]: r["n"] for r in groups}
    if len(sizes) > CELL_BUDGET:
        raise ValueError(f"more than {CELL_BUDGET} groups; search groups with an equi-join instead")
    if not sizes:
        return CellIndex(kept.select("grp", "row_id", "features", F.lit(0).alias("cell"), F.lit(0).alias("salt")),
                         copies, metric)
    dim = max(r["dim"] for r in groups)
    block_rows = block_rows or max(1024, BLOCK_BYTES // (8 * dim))
    budget = min(CELL_BUDGET, CENTRE_BYTES // (8 * dim))
    cap = max(1, budget // len(sizes))
    wanted = {g: max(1, min(n, cells_for(g, n) if cells_for else default_cells(n, cap))) for g, n in sizes.items()}
    if sum(wanted.values()) > max(budget, len(sizes)):
        raise ValueError(f"{sum(wanted.values())} cells asked for, at most {budget} of {dim} dimensions")
    if train == "kmeans":
        from flowwarden.operators import lloyd

        start = lloyd.first_centres(kept.where("copy = 1"), wanted, seed)
        centres = lloyd.fit_centres(_thinned(kept, sizes, wanted, rows_per_centre, seed), start, train_rounds, metric)
    else:
        centres = _sample_centres(spark, kept, sizes, wanted, seed)
    if metric == "cosine":
        centres = {g: _unit(c) for g, c in centres.items()}

    index = CellIndex(kept, copies, metric, centres, sizes=sizes)
    offset = 0
    for g in sorted(centres):
        index.cells[g] = {"cell": np.arange(offset, offset + len(centres[g]), dtype=np.int32)}
        offset += len(centres[g])
    out_schema = T.StructType(kept.select("grp", "row_id", "features", "copy").schema.fields
                              + [T.StructField("cell", T.IntegerType()), T.StructField("pd", T.DoubleType())])
    assigned = materialize(
        kept.select("grp", "row_id", "features", "copy")
        .mapInArrow(_assign_kernel(centres, {g: c["cell"] for g, c in index.cells.items()}, metric), out_schema),
        "assigned",
    )
    # per cell: size, radius and the smallest centre distances of distinct vectors, one bounded row per cell
    rank = Window.partitionBy("cell").orderBy("pd")
    near_rows = (
        assigned.where("copy = 1").select("cell", "pd", F.row_number().over(rank).alias("r"))
        .where(F.col("r") <= copies)
        .groupBy("cell").agg(F.sort_array(F.collect_list("pd")).alias("near"))
    )
    sized = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("pd").alias("radius"))
    near, stats = {}, {}
    for r in sized.unionByName(near_rows, allowMissingColumns=True).collect():
        if r["near"] is None:
            stats[r["cell"]] = r
        else:
            near[r["cell"]] = r["near"]
    for g, c in index.cells.items():
        k = len(c["cell"])
        c["radius"], c["near"] = np.full(k, -1.0), np.full((k, copies), np.inf)
        c["salts"], c["rows"] = np.zeros(k, dtype=np.int32), np.zeros(k, dtype=np.int64)
        for i, cell in enumerate(c["cell"].tolist()):
            if cell in stats:
                c["radius"][i] = stats[cell]["radius"]
                c["near"][i, : len(near.get(cell, ()))] = near.get(cell, ())
                c["salts"][i], c["rows"][i] = -(-stats[cell]["n"] // block_rows), stats[cell]["n"]
    salts = _per_cell(spark, {int(cell): int(s) for c in index.cells.values()
                              for cell, s in zip(c["cell"], c["salts"]) if s}, "salts")
    index.vectors = (
        assigned.join(F.broadcast(salts), "cell")
        .select("grp", "row_id", "features", "cell",
                F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int").alias("salt"))
    )
    return index


def _per_cell(spark: SparkSession, values: dict[int, int], name: str) -> DataFrame:
    return _local_table(spark, {"cell": pa.array(list(values), pa.int32()),
                                name: pa.array(list(values.values()), pa.int32())})


def _local_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A small driver-side table as a local relation (no job to read it)."""
    return spark.createDataFrame(pa.table(columns))


def _thinned(kept: DataFrame, sizes: dict[str, int], wanted: dict[str, int], per_centre: int | None, seed: int) -> DataFrame:
    """Rows with a small hash of their id, about ``per_centre`` for every centre of their group; all without a number."""
    if per_centre is None:
        return kept
    scale = 1 << 30
    thresholds = _local_table(kept.sparkSession, {
        "grp": pa.array(list(sizes)),
        "threshold": pa.array([int(min(1.0, per_centre * wanted[g] / n + 64 / n) * scale)
                               for g, n in sizes.items()], pa.int64())})
    return (kept.join(F.broadcast(thresholds), "grp").withColumn("h", F.xxhash64(F.col("row_id"), F.lit(seed)))
            .where(F.pmod(F.col("h"), F.lit(scale)) < F.col("threshold")))


def _sample_centres(spark, kept, sizes, wanted, seed) -> dict[str, np.ndarray]:
    pool = _thinned(kept.where("copy = 1"), sizes, wanted, 8, seed)
    rank = Window.partitionBy("grp").orderBy("h", "row_id")
    rows = (pool.select("grp", "features", F.row_number().over(rank).alias("r"))
            .where(F.col("r") <= max(wanted.values())).collect())
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["r"]):
        if r["r"] <= wanted[r["grp"]]:
            out.setdefault(r["grp"], []).append(r["features"])
    # a group the hash sample missed gets its mean as the only centre
    missed = [g for g in sizes if g not in out]
    if missed:
        dim = kept.select(F.size("features")).first()[0]
        means = [F.avg(F.nanvl(F.col("features")[i], F.lit(0.0))).alias(f"m{i}") for i in range(dim)]
        for r in kept.where(F.col("grp").isin(missed)).groupBy("grp").agg(*means).collect():
            out[r["grp"]] = [[r[f"m{i}"] for i in range(dim)]]
    return {g: _finite(np.array(v, dtype=float)) for g, v in out.items()}


# -------------------------------------------------------------------------------------------- search


def search_cells(index: CellIndex, queries: DataFrame, k: int = 10,
                 nprobe: int | dict[str, int] | None = None, query_block: int | None = None,
                 rounds: int | None = None) -> DataFrame:
    """Top-k of each query in each group of ``index`` (or in its own ``grp`` if the queries carry one)."""
    if k > index.copies:
        raise ValueError(f"index keeps {index.copies} copies per vector; k={k} needs a larger index")
    result = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("grp", T.StringType()),
        T.StructField("row_id", index.vectors.schema["row_id"].dataType), T.StructField("dist", T.DoubleType()),
        T.StructField("unit", T.IntegerType()),
    ])
    plan = _Probe(index, k, nprobe)
    kernel = _unit_kernel(k, plan, result)
    if nprobe is None and _rounds(plan, rounds) == 2:
        squared = F.col("dist") if index.metric == "l2" else 2 + 2 * F.col("dist")
        kth = F.when(F.count(F.lit(1)) >= k, F.max(squared))  # k entries per salt of the home unit
        local = _two_rounds(index, queries, plan, query_block, kernel, result, kth)
    else:
        local = _run_units(index, queries, plan, query_block, kernel, result)
    return _ranked(local.drop("unit"), k)


def nearest_summary(index: CellIndex, queries: DataFrame, k: int = 10, query_block: int | None = None,
                    rounds: int | None = None) -> DataFrame:
    """``(query_id, grp, all_zero, nearest_positive)``: what scoring needs of the k nearest neighbours.

    The k neighbours are all exact copies iff at least min(k, group size) copies exist, and otherwise
    their smallest positive distance is the nearest vector that is not a copy.  So a bound on the second
    distinct vector is enough, each unit emits one row per query, and the merge is a plain aggregate with
    map-side combine instead of a ranked top k.
    """
    if k > index.copies:
        raise ValueError(f"index keeps {index.copies} copies per vector; k={k} needs a larger index")
    if index.copies < 2 or index.metric != "l2":
        raise ValueError("nearest_summary needs an l2 index with copies >= 2")
    result = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("grp", T.StringType()),
        T.StructField("zeros", T.LongType()), T.StructField("nearest", T.DoubleType()),
        T.StructField("unit", T.IntegerType()),
    ])
    plan, kernel = _Probe(index, 2), _summary_kernel(result)
    if _rounds(plan, rounds) == 2:
        local = _two_rounds(index, queries, plan, query_block, kernel, result, F.min("nearest"))
    else:
        local = _run_units(index, queries, plan, query_block, kernel, result)
    sizes = _local_table(index.spark, {"grp": pa.array(list(index.sizes), pa.string()),
                                       "group_rows": pa.array(list(index.sizes.values()), pa.int64())})
    merged = local.groupBy("query_id", "grp").agg(
        F.sum("zeros").alias("zeros"), F.min("nearest").alias("nearest_positive"))
    return merged.join(F.broadcast(sizes), "grp").select(
        "query_id", "grp", (F.col("zeros") >= F.least(F.lit(k), F.col("group_rows"))).alias("all_zero"),
        "nearest_positive")


def _rounds(plan: "_Probe", rounds: int | None) -> int:
    """Two rounds pay off where a query would otherwise travel to several units of a group."""
    return rounds or (2 if max(map(len, plan.members.values()), default=0) > TWO_ROUND_UNITS else 1)


def _two_rounds(index: CellIndex, queries: DataFrame, plan: "_Probe", query_block: int | None, kernel, result: T.StructType,
                bound: Column) -> DataFrame:
    """Search the home unit of each query first, then only the units that can beat what was found there.

    The distance found at home is close to the true one (the centre table alone bounds it several times too
    high), so the second round visits a fraction of the units.  ``bound`` aggregates the squared bound per
    query and group from first-round rows.  The home unit travels with it and is not visited again.
    """
    first = _run_units(index, queries, plan.with_mode("home"), query_block, kernel, result)
    if max(map(len, plan.members.values()), default=0) <= 1:
        return first  # home is all there is
    first = materialize(first, "home")
    known = (
        first.groupBy("query_id", "grp").agg(bound.alias("bound"), F.max("unit").alias("unit"))
        .groupBy("query_id").agg(F.collect_list(F.struct("grp", "bound", "unit")).alias("known"))  # one per group
    )
    asked = materialize(queries.join(known, "query_id", "left"), "asked")
    rest = _run_units(index, asked, plan.with_mode("rest"), query_block, kernel, result)
    return first.unionByName(rest)


def _run_units(index: CellIndex, queries: DataFrame, plan: "_Probe", query_block: int | None, kernel,
               result: T.StructType) -> DataFrame:
    spark = index.spark
    query_type = queries.schema["query_id"].dataType
    cols = [c for c in ("query_id", "features", "grp", "known") if c in queries.columns]
    queries = queries.select(*cols, F.xxhash64("query_id").alias("h"))

    # pass 1 measures the probes per unit; pass 2 ships the vectors, split by the measured sizes
    counted = queries.mapInArrow(_count_kernel(plan), "unit int, cell int, n bigint")
    counts = counted.groupBy("unit", "cell").agg(F.sum("n").alias("n")).collect()  # a row for each unit and cell at most
    probes = {r["unit"]: r["n"] for r in counts if r["unit"] is not None}
    unit_of = {int(cell): int(u) for g, c in index.cells.items() for cell, u in zip(c["cell"], plan.units[g])}
    visited = sorted(r["cell"] for r in counts if r["cell"] is not None and unit_of[r["cell"]] in probes)
    if not probes:
        return spark.createDataFrame([], result)
    cores = spark.sparkContext.defaultParallelism
    if query_block is None:
        query_block = min(QUERY_ROWS, max(1, QUERY_BYTES // (8 * plan.dim)))
        query_block = min(query_block, max(LEAST_QUERIES, -(-sum(probes.values()) // (6 * cores))))
    splits = {u: int(-(-n // query_block)) for u, n in probes.items()}

    packed_schema = T.StructType([
        T.StructField("unit", T.IntegerType()), T.StructField("qsalt", T.IntegerType()),
        T.StructField("salts", T.IntegerType()),
        T.StructField("ids", T.ArrayType(query_type)),
        T.StructField("vectors", T.ArrayType(T.DoubleType())),
        T.StructField("bounds", T.ArrayType(T.DoubleType())),
    ])
    left = (
        queries.mapInArrow(_pack_kernel(plan, splits), packed_schema)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    )
    vectors = index.vectors
    if len(visited) <= PRUNED_CELLS and len(visited) < sum(len(c["cell"]) for c in index.cells.values()):
        # few cells visited: name them, so that an index stored by cell is read only where needed
        vectors = vectors.where(F.col("cell").isin(visited))
    of_cell = _local_table(spark, {"cell": pa.array(visited, pa.int32()),
                                   "unit": pa.array([unit_of[c] for c in visited], pa.int32()),
                                   "splits": pa.array([splits[unit_of[c]] for c in visited], pa.int32())})
    right = (
        vectors.join(F.broadcast(of_cell), "cell")
        .withColumn("qsalt", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
    )
    key = ["unit", "salt", "qsalt"]
    # a number of partitions, as the adaptive planner merges by bytes, and a unit costs far more than its input
    parts = min(max(3 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))),
                2 * sum(n * plan.salts[u] for u, n in splits.items()))
    left, right = (side.repartition(parts, *key).groupBy(*key) for side in (left, right))
    return left.cogroup(right).applyInArrow(kernel, result)


def search_scan(refs: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2",
                max_queries: int = SCAN_QUERIES) -> DataFrame:
    """Same contract for a query set whose size is checked: one pass over the references, no shuffle of them."""
    by_group = "grp" in queries.columns
    rows = queries.limit(max_queries + 1).toArrow()
    if rows.num_rows > max_queries:
        raise ValueError(f"more than {max_queries} queries; use search_cells")
    result = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("grp", T.StringType()),
        T.StructField("row_id", refs.schema["row_id"].dataType), T.StructField("dist", T.DoubleType()),
    ])
    if rows.num_rows == 0:
        return _ranked(refs.sparkSession.createDataFrame([], result), k)
    return _ranked(refs.select("grp", "row_id", "features")
                   .mapInArrow(_scan_kernel(rows, by_group, k, metric, result), result), k)


def knn_join(queries: DataFrame, refs: DataFrame, k: int = 10, metric: str = "l2", strategy: str = "cells",
             nprobe: int | None = None, **build) -> DataFrame:
    """Exact k-NN join by the named plan: ``cells``, ``blocks`` (many dimensions) or ``scan`` (few queries)."""
    if strategy == "scan":
        return search_scan(refs, queries, k, metric)
    if strategy == "blocks":
        from flowwarden.operators.blocks import search_blocks

        return search_blocks(refs, queries, k, metric, **build)
    if strategy != "cells":
        raise ValueError(strategy)
    return search_cells(build_cells(refs, copies=k, metric=metric, **build), queries, k, nprobe)


def _ranked(local: DataFrame, k: int) -> DataFrame:
    """Merge local top-k lists.  Spark applies the rank limit in the map tasks too, so they ship k rows per query."""
    w = Window.partitionBy("query_id", "grp").orderBy("dist", "row_id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_score(neighbours: DataFrame) -> DataFrame:
    """Cosine result: ``score`` (inner product of unit vectors) instead of ``dist``."""
    return neighbours.withColumn("score", -F.col("dist")).drop("dist")


# ------------------------------------------------------------------------------------------- kernels


def _matrix(column, metric: str = "l2") -> np.ndarray:
    """list<double> column to a 2-d array, rows of length 1 for cosine; a missing or NaN component is 0, an infinite one is large.

    Every kernel reads vectors here, so all of them see the same numbers.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
    return _shaped(flat, n, metric)


def _shaped(flat: np.ndarray, rows: int, metric: str) -> np.ndarray:
    x = _finite(flat).reshape(rows, -1)
    return _unit(x) if metric == "cosine" else x


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1.0)


def _finite(x: np.ndarray) -> np.ndarray:
    return x if np.isfinite(x).all() else np.nan_to_num(x, nan=0.0, posinf=NOT_FINITE, neginf=-NOT_FINITE)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by difference, dimension by dimension, so that ties are true ties."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        step = np.subtract.outer(a[:, j], b[:, j])
        out += step * step
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Position of the nearest centre of each row, the first of equally near ones.

    A matrix product finds it; where its rounding leaves a choice, distances are taken by difference.
    """
    out = np.empty(len(x), np.int64)
    norms = (centres * centres).sum(1)
    for a, b in _steps(len(x), len(centres)):
        d2 = norms - 2.0 * (x[a:b] @ centres.T)
        out[a:b] = d2.argmin(1)
        slack = 1e-11 * ((x[a:b] * x[a:b]).sum(1) + norms.max()) + 1e-300
        close = np.flatnonzero((d2 <= (d2.min(1) + slack)[:, None]).sum(1) > 1)
        for low, high in _steps(len(close), len(centres)):
            rows = close[low:high]
            out[a + rows] = _direct(x[a + rows], centres).argmin(1)
    return out


def group_codes(column) -> tuple[list[str], np.ndarray]:
    """Distinct values of a string column and the position of each row's value among them."""
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _steps(rows: int, width: int):
    size = max(1, MATRIX_CELLS // max(1, width))
    for start in range(0, rows, size):
        yield start, min(rows, start + size)


def _assign_kernel(centres, cell_ids, metric):
    def kernel(batches):
        for batch in batches:
            names, codes = group_codes(batch.column("grp"))
            x = _matrix(batch.column("features"), metric)
            cell, pd_ = np.zeros(len(x), np.int32), np.zeros(len(x))
            for code, g in enumerate(names):
                rows = np.flatnonzero(codes == code)
                at = nearest(x[rows], centres[g])
                cell[rows] = cell_ids[g][at]
                # recomputed by difference: the radius must not carry cancellation error
                pd_[rows] = np.sqrt(((x[rows] - centres[g][at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp"), batch.column("row_id"), batch.column("features"), batch.column("copy"),
                 pa.array(cell), pa.array(pd_)], names=["grp", "row_id", "features", "copy", "cell", "pd"])

    return kernel


def _put_together(centres: np.ndarray, rows: np.ndarray, alone: np.ndarray, most: int) -> list[np.ndarray]:
    """Positions of neighbouring cells with at most ``most`` rows together; ``alone``: cells that are a unit each."""
    out = [np.array([i]) for i in np.flatnonzero(alone)]
    todo = [np.flatnonzero(~alone)]
    while todo:
        cells = todo.pop()
        if len(cells) > 1 and rows[cells].sum() > most:
            part = centres[cells]
            cells = cells[np.argsort(part[:, np.ptp(part, axis=0).argmax()], kind="stable")]
            half = np.searchsorted(rows[cells].cumsum(), rows[cells].sum() / 2)
            half = min(max(1, half), len(cells) - 1)
            todo += [cells[:half], cells[half:]]
        elif len(cells):
            out.append(cells)
    return out


class _Probe:
    """Which units a batch of queries must visit, and an upper bound on each k-th distance."""

    def __init__(self, index: CellIndex, k: int, nprobe=None):
        self.mode = "all"  # all: every useful unit; home: that of the nearest cell; rest: useful ones but the known home
        self.centres, self.cells, self.k = index.centres, index.cells, k
        self.metric = index.metric
        self.dim = max((c.shape[1] for c in index.centres.values()), default=1)
        self.leaves = index.metric == "l2" and self.dim <= LEAF_DIMENSIONS
        most = max(1024, min(UNIT_ROWS, BLOCK_BYTES // (8 * self.dim)))
        # units[g]: of each cell; members[g]: the units in order; met[g]: cells by units; salts: of each unit
        self.limits, self.units, self.members, self.met, self.salts = {}, {}, {}, {}, []
        for g in sorted(self.cells):
            info = self.cells[g]
            limit = nprobe.get(g) if isinstance(nprobe, dict) else nprobe
            if limit is not None and limit < (info["salts"] > 0).sum():  # all of them: an exact search
                self.limits[g] = limit
            alone = (info["salts"] > 1) | (g in self.limits and not self.leaves)  # products know no cells
            parts = _put_together(self.centres[g], info["rows"], alone, most)
            self.units[g], self.met[g] = np.zeros(len(alone), np.int32), np.zeros((len(alone), len(parts)), np.float32)
            self.members[g] = np.arange(len(self.salts), len(self.salts) + len(parts), dtype=np.int32)
            for i, cells in enumerate(parts):
                self.units[g][cells], self.met[g][cells, i] = self.members[g][i], 1
                self.salts.append(int(max(1, info["salts"][cells].max())))

    def with_mode(self, mode: str) -> "_Probe":
        import copy

        other = copy.copy(self)
        other.mode = mode
        return other

    def probed(self, q: np.ndarray, g: str) -> np.ndarray:
        """Whether each cell is among the nearest ones that count for a query."""
        filled = self.cells[g]["salts"] > 0
        order = np.argsort(np.where(filled, _direct(q, self.centres[g]), np.inf), axis=1, kind="stable")[:, :self.limits[g]]
        hit = np.zeros((len(q), len(filled)), bool)
        np.put_along_axis(hit, order, True, axis=1)
        return hit & filled

    def visits(self, x: np.ndarray, g: str, known: np.ndarray | None = None, home_unit: np.ndarray | None = None):
        """Yield ``(query rows, units, squared bounds, cells)`` for group ``g``: a row for each unit visited, cells that matter."""
        c, info = self.centres[g], self.cells[g]
        filled, members = info["salts"] > 0, self.members[g]
        if len(members) == 1 and g not in self.limits:
            # there is no choice, and nothing beside home
            rows = np.arange(len(x) if filled.any() and self.mode != "rest" else 0)
            yield rows, np.full(len(rows), members[0], np.int32), np.full(len(rows), np.inf), filled
            return
        for a, b in _steps(len(x), len(c)):
            q = x[a:b]
            d = _distances(q, c)
            slack = 1e-6 * (1.0 + np.sqrt((q * q).sum(1)) + np.abs(c).max())
            if self.mode == "home":
                hit = np.zeros(d.shape, bool)
                hit[np.arange(len(q)), np.where(filled, d, np.inf).argmin(1)] = filled.any()
                bound, useful = np.full(len(q), np.inf), filled  # rows of other cells at home are searched as well
            else:
                among = self.probed(q, g) if g in self.limits else filled[None]
                bound = self._bound(np.where(among, d, np.inf), info["near"]) + slack
                if known is not None:
                    bound = np.minimum(bound, np.sqrt(np.maximum(known[a:b], 0.0)) + slack)
                home = d.argmin(1)
                ids, pos = np.unique(home, return_inverse=True)
                between = _distances(c[ids], c)[pos]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d * d - (d.min(1) ** 2)[:, None]) / (2.0 * between)
                plane = np.where(between > 0, plane, 0.0)
                lower = np.maximum(d - info["radius"], plane)
                hit = (lower <= (bound + slack)[:, None]) & among
                useful = hit.any(0)
            met = hit.astype(np.float32) @ self.met[g] > 0
            if home_unit is not None:
                seen = np.flatnonzero(home_unit[a:b] >= 0)
                met[seen, np.searchsorted(members, home_unit[a:b][seen])] = False
            rows, units = np.nonzero(met)
            yield rows + a, members[units], (bound * bound)[rows], useful

    def _bound(self, d: np.ndarray, near: np.ndarray) -> np.ndarray:
        k, width = self.k, d.shape[1]
        out = np.full(len(d), np.inf)
        for t in (min(8, width), width):
            todo = np.flatnonzero(np.isinf(out))
            if not len(todo):
                break
            part = d[todo]
            nearest = np.argpartition(part, t - 1, axis=1)[:, :t] if t < width else \
                np.broadcast_to(np.arange(width), part.shape)
            for a, b in _steps(len(todo), t * near.shape[1]):
                reach = np.take_along_axis(part[a:b], nearest[a:b], 1)[:, :, None] + near[nearest[a:b]]
                reach = reach.reshape(b - a, -1)
                if reach.shape[1] >= k:
                    out[todo[a:b]] = np.partition(reach, k - 1, axis=1)[:, k - 1]
        return out

    def batches(self, batch, features):
        """Yield ``(group, query rows, units, squared bounds, cells that matter)`` for an Arrow batch."""
        if "grp" in batch.schema.names:
            names, codes = group_codes(batch.column("grp"))
            chosen = [(g, np.flatnonzero(codes == code)) for code, g in enumerate(names) if g in self.centres]
        else:
            chosen = [(g, np.arange(len(features))) for g in sorted(self.centres)]
        found = self._found(batch) if self.mode == "rest" else {}
        for g, rows in chosen:
            known, home = found.get(g, (None, None))
            extra = (known[rows], home[rows]) if known is not None else ()
            for part, units, bounds, cells in self.visits(features[rows], g, *extra):
                yield g, rows[part], units, bounds, cells

    @staticmethod
    def _found(batch) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Per group: squared bound (inf if none) and home unit (-1 if none) of each row of the batch."""
        import pyarrow.compute as pc

        column = batch.column("known")
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(column)), lengths)
        flat = column.flatten()
        groups = np.asarray(flat.field("grp").to_pylist(), dtype=object)
        bounds = pc.fill_null(flat.field("bound"), np.inf).to_numpy(zero_copy_only=False)
        units = flat.field("unit").to_numpy(zero_copy_only=False)
        out = {}
        for g in set(groups.tolist()):
            mine = groups == g
            known, home = np.full(len(column), np.inf), np.full(len(column), -1, np.int64)
            known[rows[mine]], home[rows[mine]] = bounds[mine], units[mine]
            out[g] = known, home
        return out


def _count_kernel(plan: _Probe):
    def kernel(batches):
        total, matter = np.zeros(len(plan.salts), np.int64), set()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for g, _, units, _, cells in plan.batches(batch, _matrix(batch.column("features"), plan.metric)):
                total += np.bincount(units, minlength=len(total))
                matter.update(plan.cells[g]["cell"][cells].tolist() if len(units) else ())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*used.tolist(), *[None] * len(matter)], pa.int32()),
             pa.array([*[None] * len(used), *sorted(matter)], pa.int32()),
             pa.array([*total[used].tolist(), *[0] * len(matter)], pa.int64())], names=["unit", "cell", "n"])

    return kernel


def _lists(values, starts) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)


def _pack_kernel(plan: _Probe, splits: dict[int, int]):
    names = ["unit", "qsalt", "salts", "ids", "vectors", "bounds"]
    wide, salts = np.ones(len(plan.salts), np.int64), np.array(plan.salts, np.int32)
    for unit, n in splits.items():
        wide[unit] = n

    def kernel(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch.column("features"), plan.metric)
            h = batch.column("h").to_numpy(zero_copy_only=False)
            ids = batch.column("query_id")
            dim = x.shape[1]
            for _, rows, units, bounds, _ in plan.batches(batch, x):
                # the salt depends on the row alone, so a retried task packs the same rows the same way
                qsalt = np.mod(h[rows], wide[units])
                order = np.lexsort((rows, qsalt, units))
                for low in range(0, len(order), max(1, PACK_BYTES // (8 * dim))):
                    part = order[low:low + max(1, PACK_BYTES // (8 * dim))]
                    unit, salt, row = units[part], qsalt[part], rows[part]
                    new = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (salt[1:] != salt[:-1])])
                    starts = np.r_[new, len(row)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(unit[new], pa.int32()), pa.array(salt[new], pa.int32()), pa.array(salts[unit[new]], pa.int32()),
                         _lists(ids.take(pa.array(row)), starts),
                         _lists(pa.array(x[row].ravel()), starts * dim),
                         _lists(pa.array(bounds[part]), starts)], names=names)

    return kernel


def _exact(q: np.ndarray, r: np.ndarray, qi: np.ndarray, ri: np.ndarray, metric: str) -> np.ndarray:
    """Distances of chosen pairs, summed dimension by dimension: exact copies are at 0 and ties are true ties."""
    out = np.zeros(len(qi))
    for a, b in _steps(len(qi), q.shape[1]):
        x, y = q[qi[a:b]], r[ri[a:b]]
        if metric == "l2":
            x -= y
            x *= x
        else:
            x *= -y
        for j in range(x.shape[1]):
            out[a:b] += x[:, j]
    return out


def _exact_all(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """The same sums for all pairs of a block."""
    out, step = np.zeros((len(q), len(r))), np.empty((len(q), len(r)))
    for j in range(q.shape[1]):
        if metric == "l2":
            np.subtract.outer(q[:, j], r[:, j], out=step)
            step *= step
            out += step
        else:
            np.multiply.outer(q[:, j], r[:, j], out=step)
            out -= step
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows side by side, earlier rows first, and the number of each row's run in that order."""
    weights = np.random.default_rng(5).uniform(1, 2, x.shape[1])
    order = np.argsort((x * weights).sum(1), kind="stable")
    apart = (x[order[1:]] != x[order[:-1]]).any(1)  # rows that differ with the same sum only make more runs
    return order, np.r_[0, np.cumsum(apart)] if len(x) else np.zeros(0, int)


def _block_topk(q: np.ndarray, r: np.ndarray, bounds: np.ndarray, k: int, metric: str):
    """Top-k of each row of ``q`` among ``r``, which is sorted by id: positions in q, positions in r, distances.

    Equal rows of ``q`` are searched once, and of equal rows of ``r`` the k first can be in a result.
    """
    order, run = _runs(r)
    kept = np.sort(order[_position(run) < k])
    order, run = _runs(q)
    first = np.flatnonzero(_position(run) == 0)
    at, ri, dist = _distinct_topk(q[order[first]], r[kept], np.maximum.reduceat(bounds[order], first), k, metric)
    # every row of q gets the rows found for its run
    of = np.empty(len(q), int)
    of[order] = run
    start = np.searchsorted(at, np.arange(len(first) + 1))
    n = (start[1:] - start[:-1])[of]
    qi = np.repeat(np.arange(len(q)), n)
    pick = np.arange(len(qi)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[of], n)
    return qi, kept[ri[pick]], dist[pick]


def _distinct_topk(q: np.ndarray, r: np.ndarray, bounds: np.ndarray, k: int, metric: str):
    """Matrix products pick candidates with a slack for rounding; only those are computed exactly.

    A product is taken of a tile of queries and a chunk of references; the first chunk bounds the k-th distance, so that
    of all others only a comparison is left.
    """
    kk = min(k, len(r))
    qn, rn = (q * q).sum(1), (r * r).sum(1)
    if metric == "cosine":
        # of unit vectors, half the squared distance less one; a vector of length 0 is no unit vector
        bounds = bounds / 2 - 1 if qn.all() and rn.all() else np.full(len(q), np.inf)
        left, right = q, np.ascontiguousarray(-r.T)
    else:
        centre = r.mean(0)
        q_, r_ = q - centre, r - centre
        qn, rn = (q_ * q_).sum(1), (r_ * r_).sum(1)
        bounds = bounds - qn
        left, right = np.c_[q_, np.ones(len(q))], np.ascontiguousarray(np.c_[-2.0 * r_, rn].T)
    slack = 1e-11 * (qn + rn.max()) + 1e-300
    out, buffer = [], np.empty(TILE * CHUNK)
    for a in range(0, len(q), TILE):
        b = min(a + TILE, len(q))
        limit, found, held = bounds[a:b] + slack[a:b], [], 0
        for low in range(0, len(r), CHUNK):
            wide = min(CHUNK, len(r) - low)
            near = np.matmul(left[a:b], right[:, low:low + wide], out=buffer[:(b - a) * wide].reshape(b - a, wide))
            if not low:
                limit = np.minimum(limit, _kth_at_most(near, kk) + slack[a:b])
            at = np.flatnonzero(near <= limit[:, None])
            found.append((at // wide, at % wide + low, near.ravel()[at]))
            held += len(at)
            if held > MATRIX_CELLS // 4:  # ties: what is held stays bounded
                found = [_best_of(q[a:b], r, *map(np.concatenate, zip(*found)), slack[a:b], kk, metric)[:3]]
                held = len(found[0][0])
                full = np.flatnonzero(np.bincount(found[0][0], minlength=b - a) == kk)
                last = np.searchsorted(found[0][0], full, "right") - 1
                limit[full] = np.minimum(limit[full], found[0][2][last] + 2 * slack[a:b][full])
        qi, ri, _, dist = _best_of(q[a:b], r, *map(np.concatenate, zip(*found)), slack[a:b], kk, metric)
        out.append((qi + a, ri, dist))
    return tuple(np.concatenate(v) for v in zip(*out))


def _kth_at_most(near: np.ndarray, k: int) -> np.ndarray:
    """An upper bound on the k-th smallest value of each row: that of the minima over parts of the columns."""
    width = near.shape[1] // 8
    if width >= 2 * k:
        near = near[:, :8 * width].reshape(len(near), 8, width).min(1)
    return np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] >= k else np.full(len(near), np.inf)


def _best_of(q, r, qi, ri, near, slack, k: int, metric: str):
    """The k first of each query's candidates by exact distance and id: query, reference, ``near``, distance."""
    order = np.lexsort((near, qi))
    qi, ri, near = qi[order], ri[order], near[order]
    position = _position(qi)
    cut = np.full(len(q), np.inf)
    last = position == k - 1
    cut[qi[last]] = near[last]
    keep = near <= (cut + 2 * slack)[qi]
    qi, ri, near = qi[keep], ri[keep], near[keep]
    dist = _exact(q, r, qi, ri, metric)
    order = np.lexsort((ri, dist, qi))
    keep = order[_position(qi[order]) < k]
    return qi[keep], ri[keep], near[keep], dist[keep]


def _position(keys: np.ndarray) -> np.ndarray:
    """0-based position of each element within its run of equal keys."""
    if not len(keys):
        return np.zeros(0, int)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))


def _result_arrow(result: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(result)


def _flat(column) -> pa.Array:
    """Concatenated values of a chunked list column."""
    parts = [c.flatten() for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    return pa.concat_arrays(parts)


def _repeat(table, name: str, n: int) -> pa.Array:
    """The table's (single) value of a key column, n times."""
    return pa.array(np.full(n, table.column(name)[0].as_py(), np.int32))


def _sorted_by(table, name):
    import pyarrow.compute as pc

    return table.take(pc.sort_indices(table.column(name)))


def _unit_kernel(k: int, plan: _Probe, result: T.StructType):
    schema, metric = _result_arrow(result), plan.metric
    # only what the search of a unit needs travels with it
    probe = plan if plan.limits and plan.leaves else None
    by_leaves = plan.leaves

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        right = _sorted_by(right.select(["grp", "row_id", "features", "cell"]), "row_id")
        r = _matrix(right.column("features"), metric)
        ids = _flat(left.column("ids"))
        bounds = _flat(left.column("bounds")).to_numpy(zero_copy_only=False)
        q = _flat(left.column("vectors")).to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        grp = right.column("grp")[0].as_py()
        if probe is not None and grp in probe.limits:
            at = np.searchsorted(probe.cells[grp]["cell"], right.column("cell").to_numpy())
            found = [leaves.top(q[a:b], tree, bounds[a:b], k, probe.probed(q[a:b], grp))
                     for tree in [leaves.Leaves(r, at)] for a, b in _steps(len(q), len(probe.centres[grp]))]
            starts = [a for a, _ in _steps(len(q), len(probe.centres[grp]))]
            qi, ri, dist = (np.concatenate(v) for v in zip(*[(i + a, j, d) for a, (i, j, d) in zip(starts, found)]))
        else:
            tree = leaves.Leaves(r) if by_leaves else None
            if tree is not None and leaves.worthwhile(q, tree, bounds, leaves.kth(k)):
                qi, ri, dist = leaves.top(q, tree, bounds, k)
            else:
                qi, ri, dist = _block_topk(q, r, bounds, k, metric)
        pos = pa.array(ri)
        return pa.Table.from_arrays(
            [ids.take(pa.array(qi)), right.column("grp").take(pos).cast(schema.field("grp").type),
             right.column("row_id").take(pos), pa.array(dist), _repeat(left, "unit", len(qi))], schema=schema)

    return kernel


def _block_summary(q: np.ndarray, r: np.ndarray, bounds: np.ndarray):
    """Per row of ``q``: exact copies in ``r`` and smallest positive distance (inf if none)."""
    centre = r.mean(0)
    qc, rc = q - centre, r - centre
    qn, rn = (qc * qc).sum(1), (rc * rc).sum(1)
    zeros, nearest = np.zeros(len(q), np.int64), np.full(len(q), np.inf)
    flipped = -2.0 * rc.T
    for a, b in _steps(len(q), len(r)):
        d2 = qc[a:b] @ flipped
        d2 += rn
        d2 += qn[a:b, None]
        slack = (1e-11 * (qn[a:b] + rn.max()) + 1e-300)[:, None]
        maybe_copy = d2 <= slack
        best = (np.where(maybe_copy, np.inf, d2) if maybe_copy.any() else d2).min(1)
        near = d2 <= np.minimum(best, bounds[a:b])[:, None] + slack
        near |= maybe_copy
        if np.count_nonzero(near) > DENSE * near.size + 64:
            dist = _exact_all(q[a:b], r, "l2")
            zeros[a:b] = (dist == 0).sum(1)
            nearest[a:b] = np.where(dist > 0, dist, np.inf).min(1)
            continue
        qi, ri = np.nonzero(near)
        qi = qi + a
        dist = _exact(q, r, qi, ri, "l2")
        np.add.at(zeros, qi[dist == 0], 1)
        np.minimum.at(nearest, qi[dist > 0], dist[dist > 0])
    return zeros, nearest


def _summary_kernel(result: T.StructType):
    schema = _result_arrow(result)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        r = _matrix(right.column("features"))
        ids = _flat(left.column("ids"))
        bounds = _flat(left.column("bounds")).to_numpy(zero_copy_only=False)
        q = _flat(left.column("vectors")).to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        tree = leaves.Leaves(r) if r.shape[1] <= LEAF_DIMENSIONS else None
        if tree is not None and leaves.worthwhile(q, tree, bounds, leaves.least_positive):
            zeros, nearest = leaves.summary(q, tree, bounds)
        else:
            zeros, nearest = _block_summary(q, r, bounds)
        keep = np.flatnonzero((zeros > 0) | np.isfinite(nearest))
        grp = pa.array([right.column("grp")[0].as_py()] * len(keep), schema.field("grp").type)
        near = nearest[keep]
        return pa.Table.from_arrays(
            [ids.take(pa.array(keep)), grp, pa.array(zeros[keep]), pa.array(near, mask=~np.isfinite(near)),
             _repeat(left, "unit", len(keep))], schema=schema)

    return kernel


def _scan_kernel(queries: pa.Table, by_group: bool, k: int, metric: str, result: T.StructType):
    schema = _result_arrow(result)
    queries = queries.combine_chunks()

    def kernel(batches):
        q_all = _matrix(queries.column("features"), metric)
        q_groups = np.asarray(queries.column("grp").to_pylist(), dtype=object) if by_group else None
        best: dict[str, pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups = np.asarray(table.column("grp").to_pylist(), dtype=object)
            for g in sorted(set(groups.tolist())):
                pick = np.flatnonzero(q_groups == g) if by_group else np.arange(len(q_all))
                if not len(pick):
                    continue
                rows = table.take(pa.array(np.flatnonzero(groups == g)))
                # earlier winners compete again, so state stays at k rows per query and group
                part = _sorted_by(rows, "row_id")
                qi, ri, dist = _block_topk(q_all[pick], _matrix(part.column("features"), metric),
                                           np.full(len(pick), np.inf), k, metric)
                found = pa.Table.from_arrays(
                    [pa.array(pick[qi], pa.int64()), part.column("row_id").take(pa.array(ri)), pa.array(dist)],
                    names=["q", "row_id", "dist"])
                if g in best:
                    found = pa.concat_tables([best[g], found.cast(best[g].schema)])
                found = found.sort_by([("q", "ascending"), ("dist", "ascending"), ("row_id", "ascending")])
                position = _position(found.column("q").to_numpy())
                best[g] = found.take(pa.array(np.flatnonzero(position < k))).combine_chunks()
        for g, found in best.items():
            ids = queries.column("query_id").take(found.column("q"))
            grp = pa.array([g] * found.num_rows, schema.field("grp").type)
            table = pa.Table.from_arrays(
                [ids, pa.chunked_array([grp]), found.column("row_id"), found.column("dist")], schema=schema)
            yield from table.to_batches()

    return kernel
