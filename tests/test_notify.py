"""Cooldown with whole rows, missing cells in raw records, verdicts with gaps."""

import pytest
from pyspark.sql import functions as F

from wirelens.operators import alerts as A
from wirelens.operators import fusion
from wirelens.functions import scores as S


def test_cooled_down_rows_survive_whole(spark):
    hot = [("HIGH", "DDoS", False, t, f"h{t}", 80.0) for t in range(0, 200, 3)]
    rows = hot + [("HIGH", "DDoS", False, 0, "a0", 81.0), ("LOW", "DDoS", True, 5, "n", 30.0),
                  ("LOW", "DDoS", False, 6, "x", 30.0), ("HIGH", None, False, 7, "c", 70.0)]
    df = spark.createDataFrame(rows, "severity string, attack_category string, is_novel_anomaly boolean, at long, k string, risk_score double")
    got = {(r.cooldown_key, r.at): r.k for r in A.cooled_down(df, "at", 50, ["k"]).collect()}
    assert got == {("HIGH_DDoS", 0): "a0", ("HIGH_DDoS", 51): "h51", ("HIGH_DDoS", 102): "h102", ("HIGH_DDoS", 153): "h153",
                   ("LOW_DDoS", 5): "n", ("HIGH", 7): "c"}
    assert not A.cooled_down(df.limit(0), "at", 50, ["k"]).head(1)


def test_queue(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(20)], "t int, id int")
    popped, rest = A.pop_oldest(df, ["t", "id"], 5)
    assert [tuple(r) for r in popped.orderBy("t", "id").collect()] == sorted((i % 7, i) for i in range(20))[:5]
    assert rest.count() == 15


@pytest.mark.parametrize("value", [None, float("nan")])
def test_unknown_stays_unknown(spark, value):
    row = spark.createDataFrame([(value,)], "x double").select(
        S.clip(F.col("x"), 0.0, 1.0), S.calibrate_decision(F.col("x"), -0.3, 0.2), S.normalize_error(F.col("x"), 0.1),
    ).first()
    assert tuple(row) == (None, None, None)
    scored = spark.createDataFrame(
        [(value, 0.01, 0.02, "BENIGN", 0.9, {"BENIGN": 0.9}), (value, 0.9, 0.02, "DDoS", 0.9, {"BENIGN": 0.1})],
        "if_score double, ae_error double, ae_threshold double, rf_class string, rf_confidence double, "
        "class_probabilities map<string, double>")
    scored = scored.withColumn("if_score", F.when(~F.isnan("if_score"), F.col("if_score")))
    quiet, attack = fusion.with_verdict(scored).select("status", "risk_score", "severity").collect()
    assert tuple(quiet) == (None, None, None)
    assert attack.status == "KNOWN ATTACK" and attack.risk_score is None and attack.severity is None
