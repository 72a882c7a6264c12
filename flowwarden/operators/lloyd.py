"""k-means centres of many groups at once: every round of Lloyd's method is one Spark job over all groups.

Tasks assign their rows to the nearest centre of the row's group and add them up per centre in whole numbers, so that a round
ships one row per task and centre and its result does not depend on how rows are dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.operators import knn

ROUNDS = 10


def first_centres(rows: DataFrame, wanted: dict[str, int], seed: int) -> dict[str, np.ndarray]:
    """Per group the ``wanted`` vectors whose id has the smallest digest, in that order.  ``rows``: distinct vectors."""
    sizes = knn._local_table(rows.sparkSession, {"grp": pa.array(list(wanted), pa.string()),
                                                 "wanted": pa.array(list(wanted.values()), pa.int32())})
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_id").cast("string")).cast("binary"))
    rank = Window.partitionBy("grp").orderBy("digest", "row_id")
    ranked = rows.withColumn("digest", digest).withColumn("r", F.row_number().over(rank)).where(
        F.col("r") <= max(wanted.values()))
    out: dict[str, list] = {}
    for row in sorted(ranked.join(F.broadcast(sizes), "grp").where("r <= wanted").select("grp", "r", "features").collect(),
                      key=lambda r: r["r"]):
        out.setdefault(row["grp"], []).append(row["features"])
    return {g: knn._finite(np.array([[np.nan if x is None else x for x in f] for f in v], dtype=float)) for g, v in out.items()}


def fit_centres(rows: DataFrame, centres: dict[str, np.ndarray], rounds: int = ROUNDS, metric: str = "l2") -> dict[str, np.ndarray]:
    """Improve ``centres`` over all ``rows`` ``(grp, features)``; stops early once no centre moves.

    A centre that no row is nearest to stays where it is; of equally near centres the first takes a row.  Sums
    are exact in units of a power of two chosen from the largest component, hence the same in every run.
    """
    rows = rows.select("grp", "features")
    n, largest = rows.select(F.explode(F.transform("features", lambda x: F.abs(F.nanvl(x, F.lit(0.0))))).alias("x")).agg(
        F.count(F.lit(1)), F.max(F.when(F.col("x") == float("inf"), knn.NOT_FINITE).otherwise(F.col("x")))).first()
    largest = 1.0 if metric == "cosine" else largest
    if not n:
        return centres
    unit = 2.0 ** (61 - int(np.ceil(np.log2(n * max(largest or 0.0, 1e-300) + 1))))
    dim = next(iter(centres.values())).shape[1]
    for _ in range(rounds):
        first, total = {}, 0
        for g in sorted(centres):
            first[g], total = total, total + len(centres[g])
        sums = rows.mapInArrow(_sum_kernel(centres, first, total, unit, metric), "cell int, n bigint, sums array<bigint>")
        merged = sums.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(dim)])
        found = {r[0]: np.array(r[2:], dtype=float) / unit / r[1] for r in merged.collect()}
        better = {g: np.array([found.get(first[g] + i, c) for i, c in enumerate(old)]) for g, old in centres.items()}
        if metric == "cosine":
            better = {g: knn._unit(c) for g, c in better.items()}
        still = all(np.array_equal(better[g], centres[g]) for g in centres)
        centres = better
        if still:
            break
    return centres


def _sum_kernel(centres: dict[str, np.ndarray], first: dict[str, int], total: int, unit: float, metric: str):
    def kernel(batches):
        n, sums = np.zeros(total, np.int64), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = knn._matrix(batch.column("features"), metric)
            sums = np.zeros((total, x.shape[1]), np.int64) if sums is None else sums
            names, codes = knn.group_codes(batch.column("grp"))
            for code, g in enumerate(names):
                mine = x[codes == code]
                at = knn.nearest(mine, centres[g]) + first[g]
                n += np.bincount(at, minlength=total)
                np.add.at(sums, at, np.rint(mine * unit).astype(np.int64))
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
                ["cell", "n", "sums"])

    return kernel
