"""Routing, first-of-type selection, flow records and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.functions.hashing import stable_id


def route(flows: DataFrame, first_of_type: bool = False) -> DataFrame:
    """Flows that go to analysis: malicious ones; in first-of-type mode also suspicious ones with a type."""
    malicious = F.col("classification") == "malicious"
    if first_of_type:
        malicious = malicious | ((F.col("classification") == "suspicious") & F.col("attack_type").isNotNull())
    return flows.where(malicious)


def first_per_type(threats: DataFrame, order: str, row_id: str) -> DataFrame:
    """Earliest threat of each attack type; one row per type and input partition is shuffled."""
    rest = F.struct(*[F.col(c) for c in threats.columns])
    first = F.min_by(rest, F.struct(F.col(order), F.col(row_id)))
    return threats.groupBy("attack_type").agg(first.alias("r")).select("r.*")


def not_yet_analysed(threats: DataFrame, analysed: DataFrame) -> DataFrame:
    """Threats whose attack type has no analysis yet (an unknown type always passes)."""
    return threats.join(analysed.select("attack_type").distinct(), "attack_type", "left_anti")


def flow_record(flows: DataFrame) -> DataFrame:
    """The 12-field record shown to consumers."""
    return flows.select(
        stable_id("flow", *[F.col(c) for c in ("timestamp", "src_ip", "dst_ip", "src_port", "dst_port")]).alias("id"),
        "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        F.col("bytes_count").alias("bytes"), F.col("packets_count").alias("packets"),
        "classification", "confidence", "attack_type")


def counters(flows: DataFrame) -> DataFrame:
    """Flows per classification; unclassifiable flows are counted as ``unknown``."""
    label = F.coalesce("classification", F.lit("unknown"))
    return flows.groupBy(label.alias("classification")).agg(F.count(F.lit(1)).alias("flows"))
