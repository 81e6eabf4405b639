"""Four model scores -> one risk, verdict and alert record. Row-local: one plan, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens import constants as K
from wirelens.functions import scores as S
from wirelens.functions import text as X
from wirelens.operators import explain as E

# columns `with_verdict` reads
SCORE_COLUMNS = [
    "if_score", "ae_error", "ae_threshold", "rf_class", "rf_confidence", "class_probabilities",
]


def with_verdict(
    df: DataFrame,
    novel_confidence: float = K.NOVEL_CONFIDENCE,
    source_ip: str = "source_ip",
    destination_port: str = "destination_port",
) -> DataFrame:
    """Adds the fused columns: composite, risk, severity, status, category, notes and so on.

    Missing scores stay unknown: a rule that holds makes a row anomalous whatever else is missing; where no rule
    holds and one cannot be decided, the verdict and its texts are null. An anomalous row without a
    class is novel.
    """
    c = F.col
    out = df.withColumns({
        "if_flag": c("if_score") >= K.ANOMALY_THRESHOLD,
        "ae_flag": S.exceeds(c("ae_error"), c("ae_threshold")),
        "ae_score": S.normalize_error(c("ae_error"), c("ae_threshold")),
        "p_benign": S.benign_probability(c("class_probabilities")),
    }).withColumns({
        "composite": S.composite(c("if_score"), c("ae_score")),
        "attack_probability": F.lit(1.0) - c("p_benign"),
    }).withColumns({
        "anomalous": S.is_anomalous(
            c("if_score"), c("ae_flag"), c("composite"), c("attack_probability")
        ),
        "known": S.is_known_attack(c("rf_class"), c("rf_confidence"), novel_confidence),
    }).withColumn(
        "final_risk",
        S.fused_risk(
            c("anomalous"), c("known"), c("composite"), c("attack_probability"),
            c("rf_confidence"),
        ),
    )

    def present(name: str, default: str) -> Column:
        if name not in df.columns:
            return F.lit(default)
        return F.coalesce(c(name).cast("string"), F.lit(default))

    def pick(normal: Column, known: Column, novel: Column) -> Column:
        return F.when(~c("anomalous"), normal).when(
            c("anomalous") & c("known"), known
        ).when(c("anomalous"), novel)

    return out.withColumns({
        "status": pick(F.lit(K.STATUS_NORMAL), F.lit(K.STATUS_KNOWN), F.lit(K.STATUS_NOVEL)),
        "risk_score": F.round("final_risk", 1),
        "severity": S.severity_risk(c("final_risk")),
        "attack_category": pick(
            F.lit("BENIGN"), F.concat(F.lit("Possible "), c("rf_class")), F.lit(K.CATEGORY_NOVEL)
        ),
        "is_novel_anomaly": c("anomalous") & ~F.coalesce(c("known"), F.lit(False)),
        "analyst_notes": pick(
            F.lit(K.NOTES_NORMAL),
            F.concat(
                F.lit("Network flow signature closely matches known "), c("rf_class"),
                F.lit(" attack telemetry."),
            ),
            F.lit(K.NOTES_NOVEL),
        ),
        "recommendation": pick(
            F.lit(K.RECOMMEND_NORMAL),
            F.concat(
                F.lit("Verify source "), present(source_ip, "host"),
                F.lit(" and inspect destination service on port "),
                present(destination_port, "N/A"), F.lit("."),
            ),
            F.lit(K.RECOMMEND_NOVEL),
        ),
    })


def _model_structs(df: DataFrame) -> Column:
    c = F.col
    has_kernel = "q_label" in df.columns
    q_label = c("q_label") if has_kernel else F.lit("N/A")
    q_confidence = c("q_confidence") if has_kernel else F.lit(0.0)
    return F.struct(
        F.struct(
            F.round("if_score", 3).alias("anomaly_score"), c("if_flag").alias("is_anomaly")
        ).alias("isolation_forest"),
        F.struct(
            F.round("ae_error", 5).alias("reconstruction_error"),
            F.round("ae_threshold", 5).alias("calibrated_threshold"),
            c("ae_flag").alias("is_anomaly"),
            F.round("ae_score", 3).alias("normalized_score"),
        ).alias("deep_autoencoder"),
        F.struct(
            c("rf_class").alias("predicted_class"),
            F.round("rf_confidence", 3).alias("confidence"),
            c("class_probabilities").alias("class_probabilities"),
        ).alias("random_forest"),
        F.struct(
            q_label.alias("prediction"), F.round(q_confidence, 3).alias("confidence"),
            (F.upper(q_label) == "ANOMALY").alias("is_anomaly"),
        ).alias("quantum_kernel_svm"),
    )


def alerts(
    df: DataFrame,
    metadata: list[str] = (),
    keep: list[str] = (),
    features: list[str] | None = None,
    baseline: DataFrame | None = None,
) -> DataFrame:
    """Scored rows -> alert records (nested). With a baseline, each carries its deviations."""
    fused = with_verdict(df)
    if baseline is not None:
        fused = E.with_deviations(fused, features, baseline)
        deviations = F.col("deviations")
        bullets, top = E.bullets(deviations), E.attributions(deviations)
    else:
        bullets = F.array().cast("array<string>")
        top = F.array().cast(
            "array<struct<feature:string,technical_name:string,actual_value:double,"
            "baseline_mean:double,deviation:double,z_score:double,impact:string>>"
        )
    c = F.col
    columns = [
        "status", "risk_score", "severity", "attack_category", "is_novel_anomaly",
    ]
    return fused.select(
        *keep, *columns, F.round("rf_confidence", 3).alias("confidence"), "analyst_notes",
        "recommendation", _model_structs(df).alias("models"),
        F.struct(
            X.headline(c("final_risk")).alias("headline"),
            bullets.alias("feature_bullets"),
            X.signal_bullets(c("if_score"), c("ae_error"), c("ae_threshold")).alias(
                "model_signal_bullets"
            ),
            top.alias("top_contributing_features"),
        ).alias("explainability"),
        F.struct(*[c(m) for m in metadata]).alias("metadata") if metadata
        else F.lit(None).cast("struct<source_ip:string>").alias("metadata"),
    )


def screened(df: DataFrame, metadata: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Alert columns of rows that the first tier cleared; the costly models never see them."""
    c = F.col
    return df.select(
        *keep,
        F.lit(K.STATUS_NORMAL).alias("status"),
        F.round(c("if_score") * 45.0, 1).alias("risk_score"),
        F.lit("SAFE").alias("severity"),
        F.lit("BENIGN").alias("attack_category"),
        F.lit(False).alias("is_novel_anomaly"),
        F.lit(0.98).alias("confidence"),
        F.lit(K.NOTES_SCREENED).alias("analyst_notes"),
        F.lit("TIER_1_FAST_SCREENING").alias("tier_used"),
        F.round("if_score", 3).alias("if_anomaly_score"),
        F.lit("BENIGN").alias("rf_class"),
        F.lit(K.BYPASSED).alias("ae_result"),
        F.lit(K.BYPASSED).alias("kernel_result"),
        F.lit(K.HEADLINE_SCREENED).alias("headline"),
        *metadata,
    )


def tiered(
    df: DataFrame,
    score_rest=None,
    metadata: list[str] = (),
    keep: list[str] = (),
    threshold: float = K.SCREENING_THRESHOLD,
) -> DataFrame:
    """Two filtered branches: rows below the threshold are cleared, `score_rest` adds the costly
    model columns to the others only. Works on batch and streaming tables."""
    cleared = screened(df.where(F.col("if_score") < threshold), metadata, keep)
    rest = df.where(~(F.col("if_score") < threshold) | F.col("if_score").isNull())
    if score_rest is not None:
        rest = score_rest(rest)
    c = F.col
    q_label = c("q_label") if "q_label" in rest.columns else F.lit("N/A")
    full = with_verdict(rest).select(
        *keep, "status", "risk_score", "severity", "attack_category", "is_novel_anomaly",
        F.round("rf_confidence", 3).alias("confidence"), "analyst_notes",
        F.lit("TIER_2_FULL_EVALUATION").alias("tier_used"),
        F.round("if_score", 3).alias("if_anomaly_score"),
        "rf_class",
        X.fixed(c("ae_error"), 5).alias("ae_result"),
        q_label.alias("kernel_result"),
        X.headline(c("final_risk")).alias("headline"),
        *metadata,
    )
    return cleared.unionByName(full)
