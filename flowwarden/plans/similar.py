"""Similar reference flows of a given attack type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.functions.scoring import inverse_similarity, similarity_with_calibration
from flowwarden.operators.knn import CellIndex, search_cells
from flowwarden.schemas import BENIGN

K = 5


def similar_flows(index: CellIndex, queries: DataFrame, k: int = K, calibration: DataFrame | None = None,
                  rows: DataFrame | None = None, benign: str = BENIGN) -> DataFrame:
    """k nearest reference flows of each query's own attack type (``queries.grp``).

    ``similarity`` is calibrated where the class has a calibration and ``1/(1+d)`` elsewhere.  ``rows``
    (``grp, row_id, flow``) attaches the original records, after the top k.
    """
    asked = queries.where(F.col("grp") != benign)
    out = search_cells(index, asked, k)
    if calibration is None:
        out = out.withColumn("similarity", inverse_similarity(F.col("dist")))
    else:
        # one row per class
        out = out.join(F.broadcast(calibration.select("grp", "p5", "p95")), "grp", "left").withColumn(
            "similarity", similarity_with_calibration(F.col("dist"), F.col("p5"), F.col("p95"))).drop("p5", "p95")
    if rows is not None:
        out = out.join(rows.select("grp", "row_id", "flow"), ["grp", "row_id"])
    return out


def similar_flows_legacy(index: CellIndex, queries: DataFrame, k: int = K, rows: DataFrame | None = None) -> DataFrame:
    """Earlier variant: ``1/(1+d)`` for every class."""
    return similar_flows(index, queries, k, None, rows)


def attach_similar(flows: DataFrame, similar: DataFrame, flow_id: str = "flow_id", shown: int = 2) -> DataFrame:
    """Flows with ``similar_flows array<struct<rank, similarity>>`` of the first ``shown`` neighbours."""
    top = (
        similar.where(F.col("rank") <= shown).groupBy(F.col("query_id").alias(flow_id))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "similarity"))).alias("similar_flows"))
    )
    return flows.join(top, flow_id, "left")
