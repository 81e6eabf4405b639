import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelens.operators import metrics, reduction


def numpy_areas(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    last = np.append(s[1:] != s[:-1], True)
    tp, fp = np.cumsum(y)[last], np.cumsum(1 - y)[last]
    tp0, fp0 = np.append(0, tp[:-1]), np.append(0, fp[:-1])
    roc = ((fp - fp0) * (tp + tp0) / 2).sum() / (tp[-1] * fp[-1])
    precision = tp / (tp + fp)
    before = np.append(1.0, precision[:-1])
    pr = ((tp - tp0) * (precision + before) / 2).sum() / tp[-1]
    return roc, pr


@pytest.mark.parametrize("levels", [3, 50, None])
def test_areas_equal_numpy(spark, levels):
    rng = np.random.default_rng(5)
    y = (rng.random(1500) < 0.3).astype(int)
    s = rng.normal(0, 1, 1500) + y
    if levels:
        s = np.round(s * levels / 6) / levels
    df = spark.createDataFrame(
        [(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double"
    )
    got = metrics.ranking_areas(df, F.col("y") == 1, F.col("s"), slices=16).first()
    roc, pr = numpy_areas(y, s)
    assert got["roc_auc"] == pytest.approx(roc, abs=1e-9)
    assert got["pr_auc"] == pytest.approx(pr, abs=1e-9)


def test_single_class_has_no_area(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, s double")
    got = metrics.ranking_areas(df, F.col("y") == 1, F.col("s")).first()
    assert tuple(got) == (0.0, 0.0)


def test_six_rows(spark):
    truth, score = [0, 0, 1, 1, 0, 1], [0.1, 0.2, 0.9, 0.4, 0.15, 0.85]
    df = spark.createDataFrame(list(zip(truth, score, strict=True)), "y int, s double")
    row = metrics.evaluate_detector(df, "y", "s", 0.5).first()
    assert row["accuracy"] == round(5 / 6, 4)
    assert row["false_positive_rate"] == 0.0 and row["roc_auc"] == 1.0
    assert [tuple(c) for c in row["confusion_matrix"]] == [
        (0, 0, 3), (0, 1, 0), (1, 0, 1), (1, 1, 2)
    ]


def test_macro_and_weighted(spark):
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (2, 0), (2, 3)]
    df = spark.createDataFrame(pairs, "y int, p int")
    row = metrics.averaged_report(df, "y", "p").first()
    precision = {0: 2 / 3, 1: 1 / 2, 2: 0.0, 3: 0.0}
    recall = {0: 2 / 3, 1: 1.0, 2: 0.0, 3: 0.0}
    support = {0: 3, 1: 1, 2: 2, 3: 0}
    assert row["precision_macro"] == pytest.approx(sum(precision.values()) / 4)
    assert row["recall_weighted"] == pytest.approx(sum(recall[c] * support[c] for c in recall) / 6)


def test_compare_has_twelve_rows(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.9), (1, 0, 0.4)], "y int, p int, s double")
    first = metrics.evaluate(df, "y", "p", F.col("s"), 0, 0.1, 1.0)
    second = metrics.evaluate(df, "y", "y", F.col("s"), 0, 0.3, 2.0)
    table = metrics.compare(first, second, ("a", "b"))
    assert table.count() == 12
    sentences = [r["finding"] for r in
                 metrics.findings(table, ("a", "b")).orderBy("position").collect()]
    assert len(sentences) == 3 and "3.0x training runtime" in sentences[1]


def test_most_common_takes_the_smallest(spark):
    df = spark.createDataFrame([("x",), ("a",), ("x",), ("a",), ("m",)], "v string")
    assert metrics.most_common(df, "v").first()["top_guess"] == "a"


def test_reducer_equals_table_operators(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    x = rng.normal(0, 1, (400, 5)) + y[:, None] * np.array([2.0, 0.5, 0, 1, 0])
    x[:, 4] = 3.3
    rows = [(int(a), *map(float, r)) for a, r in zip(y, x, strict=True)]
    names = list("abcde")
    df = spark.createDataFrame(rows, "y int, " + ", ".join(f"{n} double" for n in names))
    reducer = reduction.fit_reducer(df, names, "y", 4, 2)
    scores = {r["feature"]: r["f_score"] for r in reduction.anova(df, names, "y").collect()}
    assert reducer.scores == pytest.approx([scores[n] for n in names])
    ranked = reduction.top_features(reduction.anova(df, names, "y"), 4).orderBy("rank").collect()
    assert [names[i] for i in reducer.selected] == [r["feature"] for r in ranked]
    state = {r["feature"]: r for r in reduction.moments(df, names).collect()}
    assert reducer.mean == pytest.approx([state[n]["mean"] for n in names])
    assert state["e"]["is_constant"] and reducer.scale[4] == 1.0
    angles = np.array([r["x_angles"] for r in reducer.apply(df).collect()])
    assert angles.shape == (400, 2)
    assert angles.min() >= -1e-9 and angles.max() <= np.pi + 1e-9
    scaled = (x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))
    picked = scaled[:, reducer.selected]
    values = np.linalg.eigvalsh(np.cov(picked.T))[::-1]
    assert reducer.variance_ratio == pytest.approx((values / values.sum())[:2].tolist())
