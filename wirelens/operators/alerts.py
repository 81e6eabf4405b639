"""Alert tables, summaries, notifications and the alert cooldown."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens import constants as K
from wirelens.functions import text as X
from wirelens.workspace import materialize

ALERT_TABLE_DEFAULTS = {
    "timestamp": None, "source_ip": "192.168.1.10", "destination_ip": "10.0.0.1",
    "destination_port": 80,
}


def alert_table(alerts: DataFrame, key: str) -> DataFrame:
    """Nested alerts -> 14 flat columns, defaults where metadata is missing. The default flow id is made
    of `key`: a row's number with four digits or more, or any text as it is."""
    fields = set()
    if "metadata" in alerts.columns:
        fields = set(alerts.schema["metadata"].dataType.names)

    def meta(name: str, default: Column) -> Column:
        if name not in fields:
            return default.alias(name)
        return F.coalesce(F.col(f"metadata.{name}"), default).alias(name)

    now = F.date_format(F.current_timestamp(), "dd/MM/yyyy HH:mm:ss")
    number = F.col(key)
    if isinstance(alerts.schema[key].dataType, (T.IntegerType, T.LongType)):
        number = F.format_string("%04d", number)
    return alerts.select(
        meta("flow_id", F.concat(F.lit("FLOW-"), number.cast("string"))),
        meta("timestamp", now),
        meta("source_ip", F.lit(ALERT_TABLE_DEFAULTS["source_ip"])),
        meta("destination_ip", F.lit(ALERT_TABLE_DEFAULTS["destination_ip"])),
        meta("destination_port", F.lit(ALERT_TABLE_DEFAULTS["destination_port"])),
        "status", "risk_score", "severity", "attack_category", "is_novel_anomaly",
        F.col("models.isolation_forest.anomaly_score").alias("if_score"),
        F.col("models.deep_autoencoder.reconstruction_error").alias("ae_mse"),
        F.col("models.random_forest.predicted_class").alias("rf_class"),
        F.col("models.quantum_kernel_svm.prediction").alias("kernel_status"),
    )


def batch_summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("total_evaluated"),
        F.count_if(F.col("status") != K.STATUS_NORMAL).alias("threats_detected"),
        F.count_if("is_novel_anomaly").alias("novel_anomalies"),
    )


def monitor_counts() -> list[Column]:
    """Counters of tiered scoring; they add up over parts of the rows."""
    cleared = F.count_if(F.col("tier_used") == "TIER_1_FAST_SCREENING")
    total = F.count(F.lit(1))
    return [
        total.alias("flows_analyzed"),
        cleared.alias("tier1_fast_cleared"),
        (total - cleared).alias("tier2_deep_evaluated"),
        F.count_if(F.col("status") != K.STATUS_NORMAL).alias("threats_detected"),
        F.count_if("is_novel_anomaly").alias("novel_anomalies"),
    ]


COUNTERS = ["flows_analyzed", "tier1_fast_cleared", "tier2_deep_evaluated", "threats_detected", "novel_anomalies"]


def merged_counters(parts: DataFrame) -> DataFrame:
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def with_cleared_percent(counters: DataFrame) -> DataFrame:
    share = F.coalesce(F.try_divide("tier1_fast_cleared", "flows_analyzed"), F.lit(0.0))
    return counters.withColumn("cleared_percent", F.round(share * 100.0, 1))


def monitor_statistics(tiered: DataFrame) -> DataFrame:
    return with_cleared_percent(tiered.agg(*monitor_counts()))


def top_alert(alerts: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """The alert of the highest risk, the first key on ties."""
    best = F.min_by(
        F.struct(*keep), F.struct((-F.col("risk_score")).alias("r"), *key)
    ).alias("best")
    return alerts.agg(best).select("best.*")


def scan_verdict(top: DataFrame) -> DataFrame:
    """Verdict of a whole scan from its highest alert; where that carries `explainability`, its first three
    sentences are the findings, and a stock line stands in for none."""
    stock = F.array(F.lit(K.NO_FINDINGS))
    findings = []
    if "explainability" in top.columns:
        bullets = F.slice("explainability.feature_bullets", 1, 3)
        findings = [F.when(F.size(bullets) > 0, bullets).otherwise(stock).alias("findings")]
    safe = F.col("risk_score") < 40
    category = F.col("attack_category")
    flood = ~safe & category.contains("DDoS")
    probe = ~safe & category.contains("Port")
    novel = ~safe & F.col("is_novel_anomaly")
    return top.select(
        F.when(safe, "SAFE").otherwise("ATTACK").alias("status"),
        F.when(safe, "Normal Internet Traffic").otherwise(category).alias("attack_name"),
        F.col("risk_score").cast("int").alias("threat_level"),
        F.when(safe, "You have basic protection")
        .otherwise(F.concat(F.lit("Threat detected: "), category)).alias("heading"),
        F.when(safe, "All network connections and device telemetry are safe.")
        .otherwise(F.concat(
            F.lit("Detected potentially harmful network traffic matching "), category, F.lit(".")
        )).alias("summary"),
        F.lit("Protected").alias("device_status"),
        F.when(flood, "Traffic Alert!").otherwise("Protected").alias("traffic_status"),
        F.when(probe, "Probe Detected!").when(safe, "0 Attacks (Active)").otherwise("Safe")
        .alias("probe_status"),
        F.when(novel, "Novel Threat!").when(safe, "Protected (QML)").otherwise("Active")
        .alias("novel_status"),
        flood.alias("traffic_alert"), probe.alias("probe_alert"), novel.alias("novel_alert"),
        *findings,
    )


def notifiable(alerts: DataFrame) -> DataFrame:
    return alerts.where(
        F.col("severity").isin("MEDIUM", "HIGH", "CRITICAL") | F.col("is_novel_anomaly")
    )


def notifications(alerts: DataFrame, keep: list[str], product: str = "Flow monitor") -> DataFrame:
    return notifiable(alerts).select(
        *keep,
        X.notification_title(
            F.col("severity"), F.col("attack_category"), F.col("is_novel_anomaly"), product
        ).alias("title"),
        X.notification_message(
            F.col("is_novel_anomaly"), F.col("risk_score"), F.col("source_ip"),
            F.col("destination_port"),
        ).alias("message"),
    )


def latest(alerts: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of a descending order (a bounded top-n, no full sort)."""
    return alerts.orderBy(*order).limit(n)


def alert_history(alerts: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    return latest(alerts.where(F.col("risk_score") >= 60), order, n)


def oldest(flows: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    """The first completed flows, in arrival order."""
    return flows.orderBy(*order).limit(n)


def pop_oldest(
    flows: DataFrame, order: list[str], n: int = 50
) -> tuple[DataFrame, DataFrame]:
    """(the first n rows of an order that tells all rows apart, the rest): taking from a queue."""
    popped = materialize(oldest(flows, [F.col(c) for c in order], n), "popped")
    taken = F.broadcast(popped.select(*order))
    return popped, flows.join(taken, order, "left_anti")


def consumer_models(alerts: DataFrame, keep: list[str]) -> DataFrame:
    """Model cards, one row per model of an alert: name, role, status and score in consumer words."""
    models = F.array(*[
        F.struct(F.lit(name).alias("model"), status.alias("status"), score.cast("double").alias("score"))
        for name, status, score in (
            ("isolation_forest", F.when(F.col("models.isolation_forest.is_anomaly"), "ANOMALY").otherwise("NORMAL"),
             F.col("models.isolation_forest.anomaly_score")),
            ("deep_autoencoder", F.when(F.col("models.deep_autoencoder.is_anomaly"), "ANOMALY").otherwise("NORMAL"),
             F.col("models.deep_autoencoder.normalized_score")),
            ("random_forest", F.col("models.random_forest.predicted_class"), F.col("models.random_forest.confidence")),
            ("quantum_kernel_svm", F.col("models.quantum_kernel_svm.prediction"),
             F.col("models.quantum_kernel_svm.confidence")),
        )
    ])
    cards = alerts.select(*keep, F.explode(models).alias("m"))
    named = X.consumer_model(F.col("m.model"))
    return cards.select(
        *keep, F.col("m.model").alias("model"), named["name"].alias("name"), named["role"].alias("role"),
        X.consumer_model_status(F.coalesce("m.status", F.lit("NORMAL"))).alias("status"),
        F.coalesce("m.score", F.lit(0.0)).alias("score"),
    )


def consumer_wording(alerts: DataFrame, keep: list[str]) -> DataFrame:
    risk = F.col("risk_score")
    return alerts.select(
        *keep,
        X.consumer_level(risk).alias("risk_level"),
        X.consumer_badge(risk).alias("badge"),
        X.consumer_status(F.col("status")).alias("primary_status"),
        X.consumer_attack(F.col("rf_class")).alias("attack_type"),
        X.consumer_model_status(F.col("status")).alias("model_status"),
        X.consumer_summary(risk).alias("summary"),
    )


# --- cooldown ----------------------------------------------------------------------------------


def cooled_down(
    alerts: DataFrame, time_us: str, gap_us: int, order: list[str], slice_us: int | None = None
) -> DataFrame:
    """The alert rows that are notified: eligible ones, at most one per severity and category within
    `gap_us`. Of several alerts of a key at one time the first by `order` stands for all."""
    keyed = notifiable(alerts).withColumn(
        "cooldown_key", F.concat_ws("_", "severity", "attack_category")
    ).where(F.col(time_us).isNotNull())
    # combined before the shuffle, so a hot key arrives as one row per task and time
    first = keyed.groupBy("cooldown_key", time_us).agg(
        F.min_by(F.struct(*[c for c in keyed.columns if c not in ("cooldown_key", time_us)]),
                 F.struct(*order)).alias("row")
    )
    kept = cooldown(first, "cooldown_key", time_us, gap_us, slice_us)
    return first.join(kept, ["cooldown_key", time_us]).select("cooldown_key", time_us, "row.*")


def walk(times: np.ndarray, last: int | None, gap: int) -> np.ndarray:
    """Indices emitted from sorted times: each at least `gap` after the one emitted before it."""
    picked = []
    at = 0 if last is None else int(np.searchsorted(times, last + gap, "left"))
    while at < len(times):
        picked.append(at)
        at = int(np.searchsorted(times, times[at] + gap, "left"))
    return np.asarray(picked, dtype=np.int64)


def cooldown(
    alerts: DataFrame, key: str, time_us: str, gap_us: int, slice_us: int | None = None
) -> DataFrame:
    """Alert times kept per key when each must follow the kept one before it by `gap_us` or more.

    What a time slice emits depends on its past only through the last emission, which lies at
    most `gap_us` before it or does not matter. So each slice is first summed up as a table
    "entry time -> last emission" (few rows: chains merge), these tables are chained per key, and
    then every slice emits on its own. Returns the distinct kept (key, time).
    """
    slice_us = slice_us or max(gap_us * 64, 1)
    times = alerts.select(
        F.col(key).cast("string").alias("key"), F.col(time_us).cast("long").alias("at")
    ).distinct().withColumn("slice", F.floor(F.col("at") / F.lit(slice_us)))

    def summarise(frame: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(frame["at"].to_numpy(np.int64))
        following = np.searchsorted(at, at + gap_us, "left")
        # follow each chain to its end by doubling the jumps
        jump = np.where(following < len(at), following, np.arange(len(at)))
        while not np.array_equal(further := jump[jump], jump):
            jump = further
        end = at[jump]
        # entries can only be among the times less than one gap after the slice begins, or the
        # first one
        start = int(frame["slice"].iloc[0]) * slice_us
        reachable = max(1, int(np.searchsorted(at, start + gap_us, "right")) + 1)
        entry, end = at[:reachable], end[:reachable]
        # runs of entries with the same end are one row: the entry is the latest of them
        last_of_run = np.append(end[1:] != end[:-1], True)
        return pd.DataFrame({
            "key": frame["key"].iloc[0], "slice": frame["slice"].iloc[0],
            "first": at[0], "entry": entry[last_of_run], "end": end[last_of_run],
            "final": at[-1],
        })

    tables = times.groupBy("key", "slice").applyInPandas(
        summarise, "key string, slice long, first long, entry long, end long, final long"
    )

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        last, rows = None, []
        frame = frame.sort_values(["slice", "entry"])
        for number, part in frame.groupby("slice", sort=True):
            rows.append((part["key"].iloc[0], int(number), last))
            ready = int(part["first"].iloc[0]) if last is None else last + gap_us
            if ready > int(part["final"].iloc[0]):
                continue
            entries = part["entry"].to_numpy(np.int64)
            at = int(np.searchsorted(entries, ready, "left"))
            last = int(part["end"].iloc[at])
        return pd.DataFrame(rows, columns=["key", "slice", "last"]).astype({"last": "Int64"})

    carried = tables.groupBy("key").applyInPandas(chain, "key string, slice long, last long")

    def emit(key, frame: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(frame["at"].to_numpy(np.int64))
        last = past["last"].iloc[0] if len(past) else None
        kept = at[walk(at, None if pd.isna(last) else int(last), gap_us)]
        return pd.DataFrame({"key": key[0], "at": kept})

    return times.groupBy("key", "slice").cogroup(carried.groupBy("key", "slice")).applyInPandas(
        emit, "key string, at long"
    ).select(F.col("key").alias(key), F.col("at").alias(time_us))
