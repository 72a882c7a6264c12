"""Distances to similarities, similarities to decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands of the distance-to-similarity map and the decision thresholds.
FAR, MEDIUM, NEAR = 1000.0, 100.0, 10.0
MALICIOUS_ABOVE, SUSPICIOUS_ABOVE, BENIGN_ABOVE = 0.4, 0.25, 0.3
LEGACY_BENIGN_ABOVE, LEGACY_MALICIOUS_ABOVE, LEGACY_SUSPICIOUS_ABOVE = 0.85, 0.75, 0.4
DEFAULT_THRESHOLDS = {"malicious_threshold": 0.70, "suspicious_floor": 0.55, "margin_required": 0.10}
DEFAULT_TEMPERATURE = 0.35


def clip(x: Column, low: float, high: float) -> Column:
    # least and greatest skip nulls, which would turn a missing value into a bound
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def distance_similarity(d: Column) -> Column:
    """Banded similarity of a squared distance."""
    banded = (
        F.when(d > FAR, F.lit(0.0))
        .when(d > MEDIUM, F.lit(0.1))
        .when(d > NEAR, 0.3 + 0.4 * F.exp(-d / 50.0))
        .otherwise(0.7 + 0.3 * F.exp(-d / 5.0))
    )
    return F.when(d.isNotNull(), F.least(F.greatest(banded, F.lit(0.0)), F.lit(1.0)))


def neighbour_score(all_zero: Column, nearest_positive: Column, zero_distance: str = "reference") -> Column:
    """Score of one class from its k neighbours.

    A flow whose k neighbours are all exact copies scores 0 under ``"reference"`` and 1 under ``"match"``;
    a class without neighbours scores 0.
    """
    if zero_distance not in ("reference", "match"):
        raise ValueError(zero_distance)
    copies = F.lit(0.0 if zero_distance == "reference" else 1.0)
    return F.when(all_zero, copies).otherwise(F.coalesce(distance_similarity(nearest_positive), F.lit(0.0)))


def decision(benign_score: Column, attack_score: Column, attack_type: Column) -> Column:
    """struct<classification, confidence, attack_type>; any clear attack score beats any benign score."""
    malicious = attack_score > MALICIOUS_ABOVE
    suspicious = attack_score > SUSPICIOUS_ABOVE
    benign = benign_score > BENIGN_ABOVE
    label = F.when(malicious, "malicious").when(suspicious, "suspicious").otherwise("benign")
    confidence = (
        F.when(malicious, clip(attack_score + 0.2, 0.70, 0.95))
        .when(suspicious, clip(attack_score + 0.15, 0.55, 0.85))
        .when(benign, clip(benign_score + 0.1, 0.60, 0.90))
        .otherwise(0.5)
    )
    return F.struct(
        label.alias("classification"),
        confidence.alias("confidence"),
        F.when(suspicious, attack_type).alias("attack_type"),
    )


def legacy_decision(benign_similarity: Column, attack_similarity: Column, attack_type: Column) -> Column:
    """Earlier rule set: a strong benign match is tested first."""
    attack = F.coalesce(attack_similarity, F.lit(0.0))
    benign = F.coalesce(benign_similarity > LEGACY_BENIGN_ABOVE, F.lit(False))
    malicious = attack > LEGACY_MALICIOUS_ABOVE
    suspicious = attack > LEGACY_SUSPICIOUS_ABOVE
    return F.struct(
        F.when(benign, "benign").when(malicious, "malicious").when(suspicious, "suspicious").otherwise("benign")
        .alias("classification"),
        F.when(benign, benign_similarity).when(suspicious, attack).otherwise(1.0 - attack).alias("confidence"),
        F.when(~benign & suspicious, attack_type).alias("attack_type"),
    )


def inverse_similarity(d: Column) -> Column:
    return 1.0 / (1.0 + d)


def calibrated_similarity(d: Column, p5: Column, p95: Column) -> Column:
    """Place a distance between the class's own p5 and p95; 0.5 when they coincide."""
    return F.when(p95 <= p5, F.lit(0.5)).otherwise(clip((p95 - d) / (p95 - p5), 0.0, 1.0))


def similarity_with_calibration(d: Column, p5: Column, p95: Column) -> Column:
    known = p5.isNotNull() & p95.isNotNull()
    return F.when(known, calibrated_similarity(d, p5, p95)).otherwise(inverse_similarity(d))


def decay_similarity(mean_distance: Column) -> Column:
    return F.exp(-mean_distance / 10.0)


def softmax_pair(s1: Column, s2: Column, temperature: float = DEFAULT_TEMPERATURE) -> Column:
    """struct<p1, p2>: two-way softmax, shifted by the maximum."""
    t = max(1e-6, temperature)
    top = F.greatest(s1, s2)
    e1, e2 = F.exp((s1 - top) / t), F.exp((s2 - top) / t)
    return F.struct((e1 / (e1 + e2)).alias("p1"), (e2 / (e1 + e2)).alias("p2"))
