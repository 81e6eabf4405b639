"""Queries that fit models, and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelens import constants as K
from wirelens.functions import scores as S
from wirelens.operators import alerts as A
from wirelens.operators import fusion, schema
from wirelens.operators.autoencoder import fit_autoencoder
from wirelens.operators.classify import fit_classifier
from wirelens.operators.forest import fit_isolation_forest
from wirelens.operators.kernel import fit_kernel_classifier
from wirelens.operators.reduction import fit_reducer
from wirelens.plans import catalog_flows as CF
from wirelens.plans import catalog_scores as CS
from wirelens.plans import held_out, training
from wirelens.plans import sql as Q
from wirelens.plans.registry import query
from wirelens.sources import replay, tables
from wirelens.sources import views as V
from wirelens.streaming import alerts as SA
from wirelens.streaming import flows as SF
from wirelens.streaming import runs
from wirelens.streaming.snapshots import Snapshots
from wirelens.workspace import materialize, scratch_path

_KEY = ["event_id"]
_CLASSES = sorted(K.ATTACK_CLASSES)


def _synthetic(spark, d):
    """Generated flows, written once: several passes read them, and making a row costs more than reading it."""
    return materialize(V.synthetic(spark, d), "synthetic")


def _reduced(spark, d):
    """Generated flows with labels and reduced vectors."""
    flows = _synthetic(spark, d)
    idx = F.array_position(F.array(*[F.lit(c) for c in _CLASSES]), F.col("label")) - 1
    rows = flows.withColumn("y_multi", idx.cast("int")).withColumn(
        "y_binary", (F.col("label") != "BENIGN").cast("int")
    )
    reducer = fit_reducer(rows, K.FEATURE_COLUMNS, "y_binary")
    return reducer, reducer.apply(rows).select(
        "event_id", "label", "y_multi", "y_binary", "x_classical", "x_angles"
    )


@query(None)
def pca_project(spark, d):
    _, rows = _reduced(spark, d)
    return rows.select(
        "event_id", *[F.round(F.get("x_angles", F.lit(i)), 6).alias(f"angle_{i}")
                      for i in range(K.N_ANGLES)],
    )


@query(None)
def reduction_summary(spark, d):
    reducer, _ = _reduced(spark, d)
    return reducer.summary(spark).select(
        "n_classical_features", "n_angle_features", "total_variance_explained",
        F.posexplode(F.arrays_zip("selected_features", "feature_scores")).alias("rank", "cell"),
    ).select("*", "cell.*").drop("cell")


@query(None)
def iforest_scores(spark, d):
    _, rows = _reduced(spark, d)
    forest = fit_isolation_forest(rows, _KEY)
    scored = forest.apply(rows)
    return scored.select(
        "event_id", "label", F.round("if_decision", 6).alias("if_decision"),
        F.round("if_score", 6).alias("if_score"),
        S.severity_unit(F.col("if_score")).alias("severity"),
    )


@query(None)
def rf_probabilities(spark, d):
    _, rows = _reduced(spark, d)
    model = fit_classifier(rows, _CLASSES)
    return model.apply(rows).select(
        "event_id", "label", S.class_name(F.col("rf_index"), _CLASSES).alias("rf_class"),
        F.round("rf_confidence", 4).alias("rf_confidence"),
    )


@query(None)
def ae_scores(spark, d):
    _, rows = _reduced(spark, d)
    model = fit_autoencoder(schema.benign_or_all(rows))
    return model.apply(rows).select(
        "event_id", "label", F.round("ae_error", 6).alias("ae_error"), "ae_is_anomaly",
        F.round("ae_score", 6).alias("ae_score"),
    )


@query(None)
def kernel_svm(spark, d):
    _, rows = _reduced(spark, d)
    model = fit_kernel_classifier(rows, _KEY)
    report = model.report(rows, keep=["event_id", "label"])
    return report.select(
        "event_id", "label", "prediction", "confidence",
        F.element_at("class_probabilities", "ANOMALY").alias("anomaly_probability"),
    )


@query(None)
def leave_one_class_out(spark, d):
    return held_out.leave_one_out(_synthetic(spark, d), _KEY)


@query(None)
def train_all(spark, d):
    return training.train(
        _synthetic(spark, d), _KEY, report_path=scratch_path(spark, "reports")
    )[1]


# --- streams -----------------------------------------------------------------------------------


@query(CF.FLOW_FEATURES_SQL)
def stream_sessions(spark, d):
    """Flows of a packet stream: those it emitted and, from its state, those still open at its end."""
    packets = V.packets_from(V.stream(spark, d, "events"))
    emitted, state = runs.drain_with_state(
        SF.stream_flows(packets, V.SESSION_GAP_US, bucket_us=V.SESSION_BUCKET_US), "sessions", conf=SF.STATE_STORE
    )
    rest = SF.open_flows(spark, state, V.SESSION_GAP_US, V.SESSION_BUCKET_US)
    return CF.rounded_flows(emitted.unionByName(rest))


def _kept_of_stream(spark, alerts, name, key, gap_us, order):
    """All rows that a stream of alerts keeps: those it emitted and those that were pending at its end."""
    kept, state = runs.drain_with_state(SA.stream_kept(alerts, key, "ts", gap_us, order), name, conf=SF.STATE_STORE)
    return kept.unionByName(SA.pending_kept(spark, state, alerts.schema, gap_us))


@query(CS.COOLDOWN_SQL)
def stream_cooldown(spark, d):
    ts = F.col("ts").cast("timestamp")
    alerts = V.stream(spark, d, "events").select("event_type", ts.alias("ts"), F.unix_micros(ts).alias("at_us"))
    kept = _kept_of_stream(spark, alerts, "cooldown", "event_type", CS.COOLDOWN_US, "at_us")
    return kept.select("event_type", "at_us")


@query(CS.NOTIFY_SQL)
def stream_notify(spark, d):
    """Whole alerts that pass the cooldown of a stream, with title and message."""
    rows = _tiered_stream(spark, d).withColumn("ts", CS.flow_day().cast("timestamp"))
    alerts = SA.cooldown_keyed(rows)
    kept = _kept_of_stream(spark, alerts, "notify", "cooldown_key", CS.NOTIFY_GAP_US, "flow_key")
    return A.notifications(kept, ["cooldown_key", "flow_key"])


def _tiered_stream(spark, d):
    scores = V.scores_from(V.stream(spark, d, "lineitem"))
    return fusion.tiered(scores, metadata=CS.METADATA, keep=["flow_key"])


@query(f"{Q.ALL_TIERED} SELECT * FROM tiered")
def stream_tiered(spark, d):
    return runs.drain(_tiered_stream(spark, d), "tiered")


@query(CS.STATISTICS_SQL)
def stream_stats(spark, d):
    path = scratch_path(spark, "statistics")
    runs.drain_each(_tiered_stream(spark, d), "statistics", SA.counters_writer(spark, path))
    return A.with_cleared_percent(Snapshots(spark, path, SA.COUNTERS).read())


@query(CS.HISTORY_SQL)
def stream_history(spark, d):
    path, schema = scratch_path(spark, "history"), "flow_key string, risk_score double, status string, day date"
    rows = _tiered_stream(spark, d).select("flow_key", F.col("risk_score").cast("double").alias("risk_score"), "status",
                                           CS.flow_day().alias("day"))
    runs.drain_each(rows, "history", SA.history_writer(spark, path, schema, CS.newest()))
    return Snapshots(spark, path, schema).read().drop("day")


@query(CF.REPLAY_SQL)
def stream_replay(spark, d):
    """A stream of ticks picks rows of the numbered table in turn."""
    flows = V.flows(spark, d).select("flow_key", "label")
    numbered = materialize(replay.numbered(flows, ["flow_key"], CF.SEED), "numbered")
    ticks = V.stream(spark, d, "events").select(F.col("event_id").alias("tick"))
    out = replay.replay(numbered, ticks, numbered.count()).select("tick", "flow_key", "label")
    return runs.drain(out, "replay")


@query(f"""{Q.ALL_FUSED}
SELECT status, severity, rf_class AS predicted_class, count(*) AS n FROM fused GROUP BY ALL""")
def alert_sink(spark, d):
    """Alert documents written by a stream (a batch replayed overwrites itself) and read back."""
    path = scratch_path(spark, "alerts")
    scored = V.scores_from(V.stream(spark, d, "lineitem"))
    alerts = fusion.alerts(scored, ["source_ip"], ["flow_key"])
    runs.drain_each(alerts, "alerts", tables.alert_sink(path))
    back = spark.read.schema(alerts.schema).json(path)
    return back.groupBy(
        "status", "severity",
        F.col("models.random_forest.predicted_class").alias("predicted_class"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{Q.ALL_FUSED}
SELECT flow_key, status, risk_score, rf_class FROM fused""")
def alert_documents(spark, d):
    """Alerts as JSON text, parsed back."""
    alerts = fusion.alerts(V.scores(spark, d), ["source_ip"], ["flow_key"])
    parsed = tables.alert_documents(alerts).select(
        F.from_json("document", alerts.schema).alias("a")
    )
    return parsed.select(
        "a.flow_key", "a.status", "a.risk_score",
        F.col("a.models.random_forest.predicted_class").alias("rf_class"),
    )
