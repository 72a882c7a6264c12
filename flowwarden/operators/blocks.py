"""Exhaustive k-nearest-neighbour join in blocks, for vectors of many dimensions.

Cell bounds prune nothing there, so nothing is probed: references are cut by the hash of their id into blocks of bounded bytes,
queries likewise, and a task takes the product of one block of each.  A query travels once to every reference block of its
group, a reference once to every query block, and a task returns its own top k.  Hash blocks are even however
skewed or duplicated the vectors are.  Results equal those of :func:`flowwarden.operators.knn.search_cells`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.operators import knn

#: Vector bytes of a block, on either side of a product.
BLOCK_BYTES = 16 << 20
#: Pairs from which a task of its own pays off: smaller tables than cores have blocks are cut further on the side of the queries.
TASK_PAIRS = 1 << 24


def plan_blocks(refs: DataFrame, queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(grp, first, blocks, qblocks)``: blocks of each group, numbered on from ``first``, and of the queries that meet it.

    One row per group, at most ``knn.CELL_BUDGET``.
    """
    sizes = refs.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("dim"))
    if "grp" in queries.columns:
        asked = queries.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
        sizes = sizes.join(asked, "grp")
    else:
        sizes = sizes.withColumn("m", F.lit(queries.count()))
    groups = sorted(sizes.limit(knn.CELL_BUDGET + 1).collect(), key=lambda r: r["grp"])
    if len(groups) > knn.CELL_BUDGET:
        raise ValueError(f"more than {knn.CELL_BUDGET} groups; search groups with an equi-join instead")
    rows = [max(1, block_bytes // (8 * max(1, r["dim"]))) for r in groups]
    blocks = [-(-r["n"] // size) for r, size in zip(groups, rows)]
    pairs = sum(r["n"] * r["m"] for r in groups)
    tasks = min(3 * refs.sparkSession.sparkContext.defaultParallelism, pairs // TASK_PAIRS)
    qblocks = [max(1, -(-r["m"] // size), min(r["m"], tasks * r["n"] * r["m"] // max(1, pairs) // b))
               for r, size, b in zip(groups, rows, blocks)]
    return knn._local_table(refs.sparkSession, {
        "grp": pa.array([r["grp"] for r in groups], pa.string()),
        "first": pa.array(np.r_[0, np.cumsum(blocks)][:-1].astype(np.int32) if groups else [], pa.int32()),
        "blocks": pa.array(blocks, pa.int32()), "qblocks": pa.array(qblocks, pa.int32())})


def query_blocks(queries: DataFrame, plan: DataFrame) -> DataFrame:
    """``(block, qblock, query_id, features)``: each query once for every reference block it must meet."""
    if "grp" in queries.columns:
        met = queries.join(F.broadcast(plan), "grp")
    else:
        # a query without a group is asked of every group; the plan has one bounded row for each
        groups = [F.struct(*[F.lit(r[c]).alias(c) for c in ("first", "blocks", "qblocks")]) for r in plan.collect()]
        none = F.array().cast("array<struct<first:int,blocks:int,qblocks:int>>")
        met = queries.withColumn("g", F.explode(F.array(*groups) if groups else none)).select("query_id", "features", "g.*")
    qblock = F.pmod(F.xxhash64(F.lit(7), "query_id"), F.col("qblocks")).cast("int")
    block = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1))
    return met.select(qblock.alias("qblock"), block.alias("block"), "query_id", "features")


def reference_blocks(refs: DataFrame, plan: DataFrame) -> DataFrame:
    """``(block, qblock, grp, row_id, features)``: each reference once for every query block."""
    block = F.col("first") + F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int")
    return refs.join(F.broadcast(plan), "grp").select(
        block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qblock"), "grp", "row_id", "features")


def search_blocks(refs: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Top-k of each query in each group (or in its own ``grp`` if queries carry one): ``query_id, grp, row_id, dist, rank``."""
    if metric not in knn.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    result = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("grp", T.StringType()),
        T.StructField("row_id", refs.schema["row_id"].dataType), T.StructField("dist", T.DoubleType()),
    ])
    plan = plan_blocks(refs, queries, block_bytes)
    left, right = query_blocks(queries, plan), reference_blocks(refs, plan)
    key = ["block", "qblock"]
    parts = _partitions(plan)
    left, right = (side.repartition(parts, *key).groupBy(*key) for side in (left, right))
    return knn._ranked(left.cogroup(right).applyInArrow(_product_kernel(k, metric, result), result), k)


def _partitions(plan: DataFrame) -> int:
    """Partitions of the products.  A number, as the adaptive planner merges by bytes, and a product costs far more than its input."""
    spark = plan.sparkSession
    most = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(most, 2 * sum(r["blocks"] * r["qblocks"] for r in plan.collect())))


def _product_kernel(k: int, metric: str, result: T.StructType):
    schema = knn._result_arrow(result)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        right = knn._sorted_by(right.select(["grp", "row_id", "features"]), "row_id")
        r, q = knn._matrix(right.column("features"), metric), knn._matrix(left.column("features"), metric)
        qi, ri, dist = knn._block_topk(q, r, np.full(len(q), np.inf), k, metric)
        pos = pa.array(ri)
        return pa.Table.from_arrays(
            [left.column("query_id").take(pa.array(qi)), right.column("grp").take(pos).cast(schema.field("grp").type),
             right.column("row_id").take(pos), pa.array(dist)], schema=schema)

    return kernel
