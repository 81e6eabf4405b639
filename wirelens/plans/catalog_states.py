"""Queries that apply small fixed model states, and that check what fitting must give.

The states are literals, so their SQL twins can be written out by hand; the fits run on the flows of the given
tables with a label that follows a rule over the features, and return properties that any right fit has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from wirelens.operators.autoencoder import Autoencoder, Network, fit_autoencoder
from wirelens.operators.classify import fit_classifier
from wirelens.operators.forest import IsolationForest, fit_isolation_forest
from wirelens.operators.kernel import KernelClassifier, fit_kernel_classifier
from wirelens.operators.reduction import Reducer, fit_reducer
from wirelens.plans import catalog_scores as CS
from wirelens.plans import sql as Q
from wirelens.plans.registry import query
from wirelens.sources import views as V

# --- fixed states ------------------------------------------------------------------------------

_REDUCER = Reducer(
    features=["flow_duration", "flow_bytes_s", "fwd_packet_length_mean"], mean=[25000.0, 38000.0, 40.0],
    scale=[14000.0, 23000.0, 26.0], scores=[3.0, 2.0, 1.0], selected=[1, 0, 2],
    loadings=[[0.6, 0.48, 0.64], [-0.8, 0.36, 0.48]], variance_ratio=[0.5, 0.25],
    low=[-2.0, -1.5], high=[3.0, 2.5],
)


@query(f"""{Q.ALL_FLOWS}, x AS (
  SELECT flow_key, (flow_bytes_s - 38000.0::DOUBLE) / 23000.0::DOUBLE AS a, (flow_duration - 25000.0::DOUBLE)
    / 14000.0::DOUBLE AS b, (fwd_packet_length_mean - 40.0::DOUBLE) / 26.0::DOUBLE AS c FROM flows)
SELECT flow_key, {Q.rd('a', 6)} AS first, {Q.rd('b', 6)} AS second,
  {Q.rd('(0.6::DOUBLE * a + 0.48::DOUBLE * b + 0.64::DOUBLE * c + 2.0::DOUBLE) * pi() / 5.0::DOUBLE', 6)} AS angle_0,
  {Q.rd('(-0.8::DOUBLE * a + 0.36::DOUBLE * b + 0.48::DOUBLE * c + 1.5::DOUBLE) * pi() / 4.0::DOUBLE', 6)} AS angle_1
FROM x""")
def reducer_state(spark, d):
    """Selected, standardised features and angles of a fixed reduction."""
    rows = _REDUCER.apply(V.flows(spark, d))
    return rows.select(
        "flow_key", F.round(F.get("x_classical", F.lit(0)), 6).alias("first"),
        F.round(F.get("x_classical", F.lit(1)), 6).alias("second"),
        *[F.round(F.get("x_angles", F.lit(i)), 6).alias(f"angle_{i}") for i in range(2)],
    )


# (tree, node, feature, split, left, right, depth, rows); a leaf has feature -1
_TREES = [
    (0, 0, 0, 10.0, 1, 2, 0, 64), (0, 1, -1, 0.0, 0, 0, 1, 2), (0, 2, 1, 50.0, 3, 4, 1, 62),
    (0, 3, -1, 0.0, 0, 0, 2, 40), (0, 4, -1, 0.0, 0, 0, 2, 22),
    (1, 0, 1, 5.0, 1, 2, 0, 64), (1, 1, -1, 0.0, 0, 0, 1, 1), (1, 2, -1, 0.0, 0, 0, 1, 63),
]


def _path(n: int) -> str:
    return f"(2.0::DOUBLE * (ln({n - 1}.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * {n - 1}.0 / {n}.0)"


@query(f"""{Q.ALL_FLOWS}, walked AS (
  SELECT flow_key, CASE WHEN flow_duration / 1000.0::DOUBLE <= 10 THEN 2.0::DOUBLE
      WHEN flow_bytes_s / 1000.0::DOUBLE <= 50 THEN 2.0::DOUBLE + {_path(40)} ELSE 2.0::DOUBLE + {_path(22)} END
    + CASE WHEN flow_bytes_s / 1000.0::DOUBLE <= 5 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + {_path(63)} END AS steps FROM flows),
decided AS (SELECT flow_key, 0.5::DOUBLE - pow(2.0::DOUBLE, -(steps / 2.0::DOUBLE) / {_path(64)}) AS decision FROM walked)
SELECT flow_key, {Q.rd('decision', 6)} AS decision, {Q.rd(
    "CASE WHEN decision >= 0 THEN 0.5::DOUBLE * (1.0::DOUBLE - " + Q.clip('decision / 0.2::DOUBLE', 0.0, 1.0)
    + ") ELSE 0.5::DOUBLE + 0.5::DOUBLE * " + Q.clip('-decision / 0.3::DOUBLE', 0.0, 1.0) + " END", 6)} AS score FROM decided""")
def forest_state(spark, d):
    """Decisions and calibrated scores of two fixed isolation trees."""
    nodes = pd.DataFrame(_TREES, columns=["tree", "node", "feature", "split", "left", "right", "depth", "n"])
    forest = IsolationForest(nodes, subsample=64, offset=-0.5, lowest=-0.3, highest=0.2)
    rows = V.flows(spark, d).withColumn(
        "x_classical", F.array(F.col("flow_duration") / 1000.0, F.col("flow_bytes_s") / 1000.0))
    return forest.apply(rows).select(
        "flow_key", F.round("if_decision", 6).alias("decision"), F.round("if_score", 6).alias("score"))


def _chain() -> Autoencoder:
    """A network in which the first two units of every layer pass two inputs on, scaled and shifted."""
    net = Network(2, 2)
    theta = np.zeros(net.n_parameters)
    for (a, b, norm, _), place in zip(net.layers, net.places, strict=True):
        w = np.zeros((a, b))
        w[0, 0], w[1, 1], w[0, 1] = 0.9, 1.1, 0.25
        theta[place["w"][0]] = w.ravel()
        shift = np.zeros(b)
        shift[:2] = 0.1, -0.2
        theta[place["b"][0]] = shift
        if norm:
            theta[place["gamma"][0]] = 1.0
    return Autoencoder(2, 2, theta.tolist(), [0.0] * net.n_running, [1.0 - 1e-5] * net.n_running, threshold=0.4)


def _chain_sql() -> str:
    """Six layers; all but the last have a leaky unit behind them."""
    steps, source = [], "x"
    for i in range(6):
        p = "(0.9::DOUBLE * p + 0.1::DOUBLE)"
        q = "(1.1::DOUBLE * q + 0.25::DOUBLE * p - 0.2::DOUBLE)"
        if i < 5:
            p, q = (f"CASE WHEN {v} > 0 THEN {v} ELSE 0.1::DOUBLE * {v} END" for v in (p, q))
        steps.append(f"h{i} AS (SELECT flow_key, x0, x1, {p} AS p, {q} AS q FROM {source})")
        source = f"h{i}"
    return ",\n".join(steps)


@query(f"""{Q.ALL_FLOWS}, x AS (
  SELECT flow_key, (flow_duration - 25000.0::DOUBLE) / 14000.0::DOUBLE AS x0,
    (flow_bytes_s - 38000.0::DOUBLE) / 23000.0::DOUBLE AS x1, x0 AS p, x1 AS q FROM flows), {_chain_sql()},
e AS (SELECT flow_key, ((x0 - p) * (x0 - p) + (x1 - q) * (x1 - q)) / 2.0::DOUBLE AS error FROM h5)
SELECT flow_key, {Q.rd('error', 5)} AS error, error > 0.4::DOUBLE AS is_anomaly,
  {Q.rd(Q.clip('1.0::DOUBLE / (1.0::DOUBLE + exp(-2.5::DOUBLE * (error / 0.4::DOUBLE - 0.85::DOUBLE)))', 0.0, 1.0), 5)} AS score
FROM e""")
def autoencoder_state(spark, d):
    """Reconstruction errors of a fixed network."""
    rows = V.flows(spark, d).withColumn("x_classical", F.array(
        (F.col("flow_duration") - 25000.0) / 14000.0, (F.col("flow_bytes_s") - 38000.0) / 23000.0))
    return _chain().apply(rows).select(
        "flow_key", F.round("ae_error", 5).alias("error"), F.col("ae_is_anomaly").alias("is_anomaly"),
        F.round("ae_score", 5).alias("score"))


# weights by pair of basis states: on the real part (b < c) and on the imaginary part
_REAL, _IMAGINARY = {(0, 1): 3.0, (2, 7): -2.0, (5, 12): 1.5}, {(0, 1): -1.0, (3, 9): 2.5}


def _kernel_model() -> KernelClassifier:
    pairs = [(b, c) for b in range(16) for c in range(b + 1, 16)]
    weights = [0.0] * 16 + [_REAL.get(p, 0.0) for p in pairs] + [_IMAGINARY.get(p, 0.0) for p in pairs]
    return KernelClassifier(4, "zz", "linear", weights, 0.05, 4.0, -0.3, ["BENIGN", "ANOMALY"])


_DECISION = " + ".join(
    [f"{w}::DOUBLE * sqrt(2.0::DOUBLE) / 16.0::DOUBLE * {f}(p[{b + 1}] - p[{c + 1}])"
     for f, table in (("cos", _REAL), ("sin", _IMAGINARY)) for (b, c), w in table.items()] + ["0.05::DOUBLE"])


@query(f"""{Q.with_(CS._ANGLES, CS._PHASES)},
wide AS (SELECT vec_id, list(phi ORDER BY state) AS p FROM phases GROUP BY vec_id),
decided AS (SELECT vec_id, {_DECISION} AS decision FROM wide),
likely AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(4.0::DOUBLE * decision - 0.3::DOUBLE))) AS attack FROM decided)
SELECT vec_id, {Q.rd('decision', 5)} AS decision, CASE WHEN attack > 1.0::DOUBLE - attack THEN 'ANOMALY' ELSE 'BENIGN' END AS prediction,
  {Q.rd('greatest(attack, 1.0::DOUBLE - attack)', 4)} AS confidence, {Q.rd('attack', 4)} AS anomaly_probability,
  {Q.rd('a', 4)} AS angle_0 FROM likely JOIN angles USING (vec_id)""")
def kernel_state(spark, d):
    """Decisions, probabilities and the angle report of a fixed kernel model."""
    model = _kernel_model()
    rows = model.apply(V.angles(spark, d)).select("vec_id", "x_angles", F.round("q_decision", 5).alias("decision"))
    report = model.report(rows, keep=["vec_id", "decision"])
    return report.select(
        "vec_id", "decision", "prediction", "confidence",
        F.element_at("class_probabilities", "ANOMALY").alias("anomaly_probability"),
        F.get("angles_rad", F.lit(0)).alias("angle_0"))


# --- what a fit must give ----------------------------------------------------------------------

_FIT = ["flow_duration", "flow_bytes_s", "down_up_ratio", "fwd_packet_length_mean", "average_packet_size"]


def _ruled(spark, d):
    """Flows with a label that follows a rule over two features, and their scaled vector."""
    rows = V.flows(spark, d)
    attack = (F.col("flow_bytes_s") > 50000.0) & (F.col("flow_duration") > 20000.0)
    return rows.withColumns({
        "y": attack.cast("int"),
        "x_classical": F.array(*[F.col(f).cast("double") / scale for f, scale in zip(
            _FIT, (14000.0, 23000.0, 0.03, 25.0, 350.0), strict=True)]),
    }).select("flow_key", "y", "x_classical", *_FIT)


@query("SELECT 0.15::DOUBLE AS outlier_share, true AS in_range, true AS outliers_score_high")
def forest_fit(spark, d):
    """The share of negative decisions is the contamination asked for, and scores follow decisions."""
    rows = _ruled(spark, d)
    scored = fit_isolation_forest(rows, ["flow_key"], trees=40).apply(rows)
    return scored.agg(
        F.round(F.avg((F.col("if_decision") < 0).cast("double")), 2).alias("outlier_share"),
        F.every(F.col("if_score").between(0.0, 1.0)).alias("in_range"),
        F.every((F.col("if_decision") < 0) == (F.col("if_score") > 0.5)).alias("outliers_score_high"))


@query("SELECT true AS accurate, true AS probabilities_sum_to_one")
def classifier_fit(spark, d):
    """A forest learns the rule of the labels; its probabilities sum to one."""
    rows = _ruled(spark, d)
    model = fit_classifier(rows, ["BENIGN", "ATTACK"], label="y", trees=10, depth=6)
    total = F.aggregate("rf_probabilities", F.lit(0.0), lambda a, p: a + p)
    return model.apply(rows).agg(
        (F.avg((F.col("rf_index") == F.col("y")).cast("double")) > 0.98).alias("accurate"),
        F.every(F.abs(total - 1.0) < 1e-9).alias("probabilities_sum_to_one"))


@query(f"""{Q.ALL_FLOWS}, y AS (SELECT *, flow_bytes_s > 50000 AND flow_duration > 20000 AS y FROM flows),
f AS (""" + " UNION ALL ".join(
    f"""SELECT {i} AS idx, '{c}' AS feature, (SELECT sum(n * (m - g) ** 2) / sum(n * v) * (sum(n) - 2) FROM (
      SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM y) AS g FROM y GROUP BY y)) AS score"""
    for i, c in enumerate(_FIT)) + """)
SELECT feature, true AS components_hold, row_number() OVER (ORDER BY score DESC) - 1 AS rank FROM f""")
def reducer_fit(spark, d):
    """Features in the order of their F-scores; the components are eigenvectors of the correlations."""
    rows = _ruled(spark, d)
    reducer = fit_reducer(rows, _FIT, "y", k=5, n_angles=3)
    x = rows.select(array_to_vector(reducer.classical()).alias("x"))
    matrix = Correlation.corr(x, "x").head()[0].toArray()
    values = np.array(reducer.variance_ratio) * len(_FIT)
    holds = all(
        np.abs(matrix @ v - value * v).max() < 1e-6
        for v, value in zip(np.array(reducer.loadings), values, strict=True))
    summary = reducer.summary(spark).select(F.posexplode("selected_features").alias("rank", "feature"))
    return summary.select("feature", F.lit(holds).alias("components_hold"), F.col("rank").cast("long").alias("rank"))


@query("SELECT true AS learns, true AS outliers_stand_out, 0.05::DOUBLE AS above_threshold")
def autoencoder_fit(spark, d):
    """The loss falls, far rows have larger errors, and the threshold is the 95th percentile."""
    rows = _ruled(spark, d)
    model = fit_autoencoder(rows, width=len(_FIT), latent=3, epochs=10)
    far = rows.withColumn("x_classical", F.transform("x_classical", lambda v: v + 20.0))
    near_error = model.apply(rows).agg(
        F.avg("ae_error").alias("near"), F.avg(F.col("ae_is_anomaly").cast("double")).alias("share"))
    far_error = model.apply(far).agg(F.avg("ae_error").alias("far")).head().far
    return near_error.select(
        F.lit(model.loss_history[-1] < model.loss_history[0]).alias("learns"),
        (F.lit(far_error) > 5 * F.col("near")).alias("outliers_stand_out"),
        F.round("share", 2).alias("above_threshold"))


@query("SELECT true AS accurate, true AS probabilities_sum_to_one")
def kernel_fit(spark, d):
    """A kernel model separates vectors by a coordinate of their own map."""
    rows = V.angles(spark, d)
    half = rows.agg(F.percentile_approx(F.get("x_angles", F.lit(0)), 0.5, 1000)).head()[0]
    # the angles lie close together: spread them over their range first
    spread = F.transform("x_angles", lambda a: F.greatest(F.lit(0.0), F.least(F.lit(np.pi), (a - half) * 3.0 + np.pi / 2)))
    rows = rows.select("vec_id", spread.alias("x_angles"), (F.get("x_angles", F.lit(0)) > half).cast("int").alias("y_binary"))
    model = fit_kernel_classifier(rows, ["vec_id"], limit=None, max_iter=100, kind="z")
    return model.apply(rows).agg(
        (F.avg((F.col("q_index") == F.col("y_binary")).cast("double")) > 0.9).alias("accurate"),
        F.every(F.abs(F.get("q_probabilities", F.lit(0)) + F.get("q_probabilities", F.lit(1)) - 1.0) < 1e-9)
        .alias("probabilities_sum_to_one"))
