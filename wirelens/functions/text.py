"""Formatting and wording. Numbers are rounded before formatting so that no tie is left to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelens import constants as K


def fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.round(value, places))


def grouped(value: Column, places: int) -> Column:
    return F.format_string(f"%,.{places}f", F.round(value, places))


def signed(value: Column, places: int) -> Column:
    return F.format_string(f"%+.{places}f", F.round(value, places))


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(part) for item in pairs.items() for part in item])


def friendly_name(feature: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(K.FRIENDLY_NAMES), feature), feature)


def deviation_sentence(name: Column, observed: Column, mean: Column) -> Column:
    delta = observed - mean
    percent = delta / F.abs(mean) * 100.0
    near_zero_above = F.concat(
        name, F.lit(" significantly above normal (observed: "), fixed(observed, 1),
        F.lit(" vs normal: "), fixed(mean, 2), F.lit(", +"), fixed(delta, 1), F.lit(")"),
    )
    near_zero_below = F.concat(
        name, F.lit(" significantly suppressed (observed: "), fixed(observed, 1),
        F.lit(" vs normal: "), fixed(mean, 2), F.lit(")"),
    )
    span = F.concat(
        F.lit("% "), F.when(percent > 0, "above").otherwise("below"),
        F.lit(" benign baseline (observed: "), grouped(observed, 1),
        F.lit(" vs normal: "), grouped(mean, 1), F.lit(")"),
    )
    raised = F.concat(name, F.lit(" elevated by "), signed(percent, 1), span)
    lowered = F.concat(name, F.lit(" decreased by "), fixed(F.abs(percent), 1), span)
    return F.when(
        F.abs(mean) < 1.0, F.when(observed > mean, near_zero_above).otherwise(near_zero_below)
    ).otherwise(F.when(percent > 0, raised).otherwise(lowered))


def impact(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size >= 4.0, "CRITICAL").when(size >= 2.5, "HIGH").otherwise("MODERATE")


def signal_bullets(if_score: Column, ae_error: Column, ae_threshold: Column) -> Column:
    autoencoder = F.when(
        ae_error > ae_threshold,
        F.concat(
            F.lit("Deep Autoencoder reconstruction error ("), fixed(ae_error, 4),
            F.lit(") exceeds the calibrated 95th percentile threshold ("), fixed(ae_threshold, 4),
            F.lit("), signaling unlearned structural behavior."),
        ),
    ).when(
        ae_error.isNotNull() & ae_threshold.isNotNull(),
        F.concat(
            F.lit("Deep Autoencoder reconstruction error ("), fixed(ae_error, 4),
            F.lit(") conforms with learned benign flow profiles."),
        ),
    )
    forest = F.when(
        if_score >= K.ANOMALY_THRESHOLD,
        F.concat(
            F.lit("Isolation Forest flags flow as an unsupervised topological outlier "
                  "(anomaly score: "),
            fixed(if_score, 2), F.lit(")."),
        ),
    )
    return F.array_compact(F.array(autoencoder, forest))


def headline(risk: Column) -> Column:
    return F.when(risk < 30, K.HEADLINE_QUIET).otherwise(
        F.concat(
            F.lit("Threat detection flagged with Risk Score "), fixed(risk, 0),
            F.lit("/100 based on the following corroborating factors:"),
        )
    )


def notification_title(severity, category, is_novel, product: str = "Flow monitor") -> Column:
    icon = F.coalesce(
        F.try_element_at(literal_map(K.SEVERITY_ICONS), F.upper(severity)), F.lit(K.DEFAULT_ICON)
    )
    title = F.when(is_novel, "Potential Novel Anomaly Detected!").otherwise(
        F.concat(F.coalesce(category, F.lit("Anomalous Traffic")), F.lit(" Detected!"))
    )
    return F.concat(icon, F.lit(f" {product}: "), title)


def notification_message(is_novel, risk, source_ip, destination_port) -> Column:
    source = F.coalesce(source_ip, F.lit("Remote Host"))
    port = F.coalesce(destination_port.cast("string"), F.lit("Service"))
    score = F.concat(F.lit("(Risk: "), fixed(risk, 0), F.lit("/100)."))
    return F.when(
        is_novel,
        F.concat(
            F.lit("Zero-Day network telemetry pattern from "), source, F.lit(" "), score,
            F.lit(" Click to inspect."),
        ),
    ).otherwise(
        F.concat(
            F.lit("Suspicious activity targeted at port "), port, F.lit(" from "), source,
            F.lit(" "), score,
        )
    )


def consumer_level(risk: Column) -> Column:
    return (
        F.when(risk >= 80, "High Threat")
        .when(risk >= 60, "Suspicious")
        .when(risk >= 30, "Low Risk")
        .otherwise("Safe")
    )


def consumer_badge(risk: Column) -> Column:
    return (
        F.when(risk < 30, "SAFE").when(risk < 60, "LOW").when(risk < 80, "MEDIUM")
        .otherwise("CRITICAL")
    )


def consumer_status(status: Column) -> Column:
    return (
        F.when(status.contains("NOVEL"), "Unusual Activity")
        .when(status.contains("ATTACK"), "Threat Detected")
        .otherwise("All Safe")
    )


def consumer_attack(name: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(K.CONSUMER_ATTACKS), F.upper(name)),
        F.lit("Normal Internet Traffic"),
    )


def consumer_model_status(status: Column) -> Column:
    upper = F.upper(status)
    return (
        F.when(upper.contains("ANOMAL") | upper.contains("ATTACK"), "Unusual")
        .when((upper != "NORMAL") & (upper != "BENIGN"), status)
        .otherwise("Safe")
    )


def consumer_model(name: Column) -> Column:
    """Struct of the consumer name and role of a model."""
    lowered = F.lower(name)
    friendly, role = name, F.lit(K.CONSUMER_MODEL_ROLE)
    for parts, label, task in reversed(K.CONSUMER_MODELS):
        match = reduce(lambda a, b: a | b, [lowered.contains(p) for p in parts])
        friendly = F.when(match, label).otherwise(friendly)
        role = F.when(match, task).otherwise(role)
    return F.struct(friendly.alias("name"), role.alias("role"))


def consumer_reason(sentence: Column) -> Column:
    return reduce(
        lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])),
        K.CONSUMER_PHRASES,
        sentence,
    )


def consumer_reasons(sentences: Column, risk: Column) -> Column:
    """Reworded sentences; a stock pair or line where there is none."""
    quiet = F.array(F.lit("Normal data speed"), F.lit("Normal connection count"))
    loud = F.array(F.lit("Unusual traffic spike detected"))
    return F.when(
        F.size(sentences) > 0, F.transform(sentences, consumer_reason)
    ).otherwise(F.when(risk < 30, quiet).otherwise(loud))


def consumer_summary(risk: Column) -> Column:
    return F.when(risk < 30, "Your network is safe. No unusual activity detected.").otherwise(
        "Unusual internet traffic detected. Review details below."
    )
