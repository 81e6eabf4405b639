import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirelens import constants as K
from wirelens.functions import scores as S
from wirelens.functions import text as X
from wirelens.operators import alerts, classify, explain, fusion

RISK_EDGES = {0.0: "SAFE", 15.0: "SAFE", 20.0: "LOW", 35.0: "LOW", 40.0: "MEDIUM", 55.0: "MEDIUM",
              60.0: "HIGH", 75.0: "HIGH", 80.0: "CRITICAL", 92.0: "CRITICAL"}
UNIT_EDGES = {0.29: "NORMAL", 0.30: "LOW", 0.60: "MEDIUM", 0.80: "HIGH", 0.90: "CRITICAL"}


@pytest.mark.parametrize("fn, edges", [(S.severity_risk, RISK_EDGES),
                                       (S.severity_unit, UNIT_EDGES)])
def test_tiers(spark, fn, edges):
    df = spark.createDataFrame([(k,) for k in edges], "v double").withColumn("t", fn(F.col("v")))
    assert {r["v"]: r["t"] for r in df.collect()} == edges


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=2, max_size=60),
       st.floats(-0.9, 0.0), st.floats(0.0, 0.9))
def test_calibration_is_monotone_and_bounded(spark, decisions, low, high):
    df = spark.createDataFrame([(d,) for d in decisions], "d double")
    rows = df.select("d", S.calibrate_decision(F.col("d"), low, high).alias("s")).collect()
    rows.sort(key=lambda r: r["d"])
    scores = [r["s"] for r in rows]
    assert all(0.0 <= s <= 1.0 for s in scores)
    assert all(a >= b - 1e-12 for a, b in zip(scores, scores[1:], strict=False))
    assert all((r["s"] <= 0.5) == (r["d"] >= 0) for r in rows if abs(r["d"]) > 1e-9)


def python_verdict(if_score, ae_error, threshold, name, conf, p_benign):
    ae = 1 / (1 + np.exp(-2.5 * (ae_error / max(threshold, 1e-6) - 0.85)))
    both = 0.5 * if_score + 0.5 * ae
    attack = 1 - round(p_benign, 4)
    flagged = (if_score >= 0.5 and ae_error > threshold) or both >= 0.55 or attack >= 0.65
    if not flagged:
        return "NORMAL", float(np.clip((0.6 * both + 0.4 * attack) * 50, 2, 35))
    if name != "BENIGN" and conf >= 0.6:
        mix = 0.35 * both + 0.35 * attack + 0.3 * conf
        return "KNOWN ATTACK", float(np.clip(45 + mix * 55, 60, 98))
    mix = 0.5 * both + 0.5 * (1 - conf)
    return "POTENTIAL NOVEL ANOMALY", float(np.clip(55 + mix * 40, 70, 95))


def test_verdict_equals_a_plain_evaluation(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        p = rng.dirichlet([0.6, 0.6, 0.6])
        names = ["BENIGN", "DDoS", "PortScan"]
        rows.append((i, float(rng.random()), float(rng.random() * 0.05), 0.02,
                     names[int(p.argmax())], float(p.max()), [float(v) for v in p]))
    df = spark.createDataFrame(
        rows, "i int, if_score double, ae_error double, ae_threshold double, rf_class string, "
        "rf_confidence double, p array<double>"
    ).withColumn("class_probabilities", S.probability_map(F.col("p"), ["BENIGN", "DDoS", "Port"]))
    got = {r["i"]: (r["status"], r["final_risk"]) for r in fusion.with_verdict(df).collect()}
    for i, if_score, error, threshold, name, conf, p in rows:
        status, risk = python_verdict(if_score, error, threshold, name, conf, p[0])
        assert got[i][0] == status
        assert got[i][1] == pytest.approx(risk, abs=1e-9)
    assert {s for s, _ in got.values()} == {K.STATUS_NORMAL, K.STATUS_KNOWN, K.STATUS_NOVEL}


def test_alert_without_metadata_uses_defaults(spark):
    df = spark.createDataFrame(
        [(0.9, 0.5, 0.1, "DDoS", 0.9, {"BENIGN": 0.05, "DDoS": 0.9})],
        "if_score double, ae_error double, ae_threshold double, rf_class string, "
        "rf_confidence double, class_probabilities map<string,double>",
    )
    alert = fusion.alerts(df).first()
    assert alert["recommendation"] == (
        "Verify source host and inspect destination service on port N/A."
    )
    assert alert["models"]["quantum_kernel_svm"]["prediction"] == "N/A"
    assert len(alert["explainability"]["model_signal_bullets"]) == 2
    assert alert["attack_category"] == "Possible DDoS"


def test_two_model_rule(spark):
    df = spark.createDataFrame(
        [(0.4, "DDoS", 0.9), (0.5, "DDoS", 0.6), (0.95, "DDoS", 0.59), (0.7, "BENIGN", 0.99)],
        "s double, n string, c double",
    )
    verdict = classify.two_model_verdict(
        F.col("s"), F.col("n"), F.col("c"), F.create_map(F.lit("x"), F.lit(1.0))
    )
    rows = [r["v"] for r in df.select(verdict.alias("v")).collect()]
    assert [r["attack_category"] for r in rows] == [
        "BENIGN", "Possible DDoS", K.CATEGORY_NOVEL, K.CATEGORY_NOVEL
    ]
    assert rows[2]["severity"] == "CRITICAL"


def test_deviations_are_ranked(spark):
    benign = spark.createDataFrame(
        [(float(i), 5.0, 0.1 * i, 7.0) for i in range(10)],
        "flow_duration double, total_fwd_packets double, down_up_ratio double, idle_mean double",
    )
    names = benign.columns
    state = explain.baseline(benign, names)
    odd = spark.createDataFrame([(100.0, 9.0, -3.0, 7.0)], benign.schema)
    out = explain.with_deviations(odd, names, state)
    row = out.select(
        explain.attributions(F.col("deviations")).alias("a"),
        explain.bullets(F.col("deviations")).alias("b"),
    ).first()
    assert [a["technical_name"] for a in row["a"]] == [
        "Flow Duration", "Down/Up Ratio", "Total Fwd Packets"
    ]
    assert row["a"][0]["z_score"] == 15.0 and row["a"][0]["impact"] == "CRITICAL"
    assert row["b"][0] == (
        "Connection Duration elevated by +2122.2% above benign baseline "
        "(observed: 100.0 vs normal: 4.5)"
    )
    assert row["b"][1] == (
        "Bidirectional Flow Ratio significantly suppressed (observed: -3.0 vs normal: 0.45)"
    )


def test_wording(spark):
    one = spark.range(1)
    texts = one.select(
        X.consumer_reason(F.lit("Forward Packet Count above benign baseline")).alias("reason"),
        X.consumer_attack(F.lit("PortScan")).alias("attack"),
        X.consumer_model(F.lit("Isolation Forest")).alias("model"),
        X.consumer_model(F.lit("Other")).alias("other"),
        X.notification_message(F.lit(False), F.lit(71.4), F.lit(None).cast("string"),
                               F.lit(None).cast("int")).alias("message"),
        X.headline(F.lit(29.9)).alias("quiet"),
    ).first()
    assert texts["reason"] == "Sent packet count above normal level"
    assert texts["attack"] == "Port Scanning"
    assert texts["model"]["name"] == "Behavior Checker"
    assert texts["other"]["role"] == "AI Safety Check"
    assert texts["message"] == (
        "Suspicious activity targeted at port Service from Remote Host (Risk: 71/100)."
    )
    assert texts["quiet"] == K.HEADLINE_QUIET


@pytest.mark.parametrize("slice_us", [7, 150, 10**6])
def test_cooldown_equals_a_plain_loop(spark, slice_us):
    rng = np.random.default_rng(slice_us)
    gap, rows, want = 10, [], set()
    for key, n, step in (("hot", 3000, 3), ("sparse", 60, 40), ("one", 1, 1)):
        times = np.cumsum(rng.integers(0, step, n)) - 500
        rows += [(key, int(t)) for t in times]
        last = None
        for t in times.tolist():
            if last is None or t - last >= gap:
                want.add((key, t))
                last = t
    df = spark.createDataFrame(rows, "key string, at long")
    got = alerts.cooldown(df, "key", "at", gap, slice_us).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_top_alert_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([("b", 9.0), ("a", 9.0), ("c", 1.0)], "k string, risk_score double")
    assert alerts.top_alert(df, ["k"], ["k"]).first()["k"] == "a"
