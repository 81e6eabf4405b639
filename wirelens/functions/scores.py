"""Score calibration, thresholds and the fusion arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelens import constants as K


def clip(value: Column, low, high) -> Column:
    """Null and NaN stay unknown; `greatest` and `least` alone would turn them into a bound."""
    value = value.cast("double")
    return F.when(
        value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(low), F.least(F.lit(high), value))
    )


def tier(value: Column, tiers) -> Column:
    expr = F.when(value.isNull(), F.lit(None).cast("string"))
    for upper, name in tiers:
        expr = expr.when(value < upper, name)
    return expr.otherwise(K.TOP_TIER)


def severity_unit(score: Column) -> Column:
    return tier(score, K.UNIT_TIERS)


def severity_risk(risk: Column) -> Column:
    return tier(risk, K.RISK_TIERS)


def calibrate_decision(decision: Column, lowest, highest) -> Column:
    """Isolation decision -> [0, 1]; 0.5 is the decision boundary, 1 the most isolated row."""
    inlier_span = F.greatest(F.lit(highest), F.lit(1e-4))
    outlier_span = F.greatest(F.abs(F.lit(lowest)), F.lit(1e-4))
    inlier = F.lit(0.5) * (F.lit(1.0) - clip(decision / inlier_span, 0.0, 1.0))
    outlier = F.lit(0.5) + F.lit(0.5) * clip(-decision / outlier_span, 0.0, 1.0)
    return clip(F.when(decision >= 0, inlier).otherwise(outlier), 0.0, 1.0)


def at_least(score: Column, threshold: float = K.DETECTOR_THRESHOLD) -> Column:
    return (score >= threshold).cast("int")


def squared_errors(x: Column, reconstruction: Column) -> Column:
    return F.zip_with(x, reconstruction, lambda a, b: (a - b) * (a - b))


def reconstruction_error(x: Column, reconstruction: Column) -> Column:
    total = F.aggregate(squared_errors(x, reconstruction), F.lit(0.0), lambda acc, e: acc + e)
    return total / F.size(x)


def exceeds(error: Column, threshold) -> Column:
    return ~F.isnan(error) & (error > F.lit(threshold))


def normalize_error(error: Column, threshold) -> Column:
    ratio = error / F.greatest(F.lit(threshold), F.lit(1e-6))
    return clip(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.5) * (ratio - F.lit(0.85)))), 0.0, 1.0)


def top_class(probabilities: Column) -> Column:
    """Index of the largest probability, the first one on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def class_name(index: Column, names: list[str], missing: str = "UNKNOWN") -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), index), F.lit(missing))


def probability_map(probabilities: Column, names: list[str]) -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.transform(probabilities, lambda p: F.round(p, 4))
    )


def benign_probability(by_class: Column) -> Column:
    return F.coalesce(
        F.try_element_at(by_class, F.lit("BENIGN")),
        F.try_element_at(by_class, F.lit("Normal")),
        F.lit(0.5),
    )


def composite(if_score: Column, ae_score: Column) -> Column:
    return F.lit(0.5) * if_score + F.lit(0.5) * ae_score


def is_anomalous(if_score, ae_flag, composite_score, attack_probability) -> Column:
    return (
        ((if_score >= K.ANOMALY_THRESHOLD) & ae_flag)
        | (composite_score >= 0.55)
        | (attack_probability >= 0.65)
    )


def is_known_attack(name: Column, confidence: Column, threshold=K.NOVEL_CONFIDENCE) -> Column:
    return (F.upper(name) != "BENIGN") & (confidence >= threshold)


def fused_risk(anomalous, known, composite_score, attack_probability, confidence) -> Column:
    normal = clip(
        (F.lit(0.6) * composite_score + F.lit(0.4) * attack_probability) * 50.0, 2.0, 35.0
    )
    matched = clip(
        F.lit(45.0)
        + (
            F.lit(0.35) * composite_score
            + F.lit(0.35) * attack_probability
            + F.lit(0.30) * confidence
        )
        * 55.0,
        60.0,
        98.0,
    )
    novel = clip(
        F.lit(55.0)
        + (F.lit(0.5) * composite_score + F.lit(0.5) * (F.lit(1.0) - confidence)) * 40.0,
        70.0,
        95.0,
    )
    return F.when(~anomalous, normal).when(anomalous & known, matched).when(anomalous, novel)
