import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelens.operators import ranking, splitting, state


@pytest.mark.parametrize("n, accuracy, window_rows", [
    (7, 10_000, 10**6), (613, 10_000, 10), (5000, 50, 10**6), (5000, 50, 10), (4000, 400, 10**6),
])
def test_percentiles_equal_numpy(spark, n, accuracy, window_rows):
    rng = np.random.default_rng(n)
    values = {
        "smooth": rng.exponential(10.0, n),
        "tied": rng.integers(0, 4, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 3.25, rng.normal(0, 50, n)),
    }
    rows = list(zip(*[map(float, v) for v in values.values()], strict=True))
    df = spark.createDataFrame(rows, "smooth double, tied double, hot double")
    shares = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]
    found = {
        (r["feature"], r["share"]): r["value"]
        for r in ranking.exact_percentiles(
            df, list(values), shares, accuracy, window_rows
        ).collect()
    }
    for name, v in values.items():
        for share in shares:
            assert found[name, share] == pytest.approx(np.percentile(v, share * 100), abs=1e-9)


def test_percentiles_ignore_missing(spark):
    df = spark.createDataFrame(
        [(1.0, None), (float("nan"), None), (3.0, None), (None, None)], "a double, b double"
    )
    found = {r["feature"]: r["value"]
             for r in ranking.exact_percentiles(df, ["a", "b"], [0.5]).collect()}
    assert found == {"a": 2.0, "b": None}


def test_running_sums(spark):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.normal(0, 1, 900))
    weights = rng.integers(0, 9, len(keys))
    df = spark.createDataFrame(
        [(float(k), int(w)) for k, w in zip(keys, weights, strict=True)], "k double, w long"
    )
    for descending in (False, True):
        out = ranking.running_sums(df, "k", ["w"], descending=descending, slices=16)
        rows = sorted(out.collect(), key=lambda r: r["k"], reverse=descending)
        assert [r["cum_w"] for r in rows] == np.cumsum([r["w"] for r in rows]).tolist()


def test_positions_are_a_permutation(spark):
    df = spark.range(2500).select(F.col("id"))
    placed = splitting.shuffled(df, ["id"], 7).collect()
    assert sorted(r["position"] for r in placed) == list(range(2500))
    again = splitting.shuffled(df.repartition(3), ["id"], 7).collect()
    assert {r["id"]: r["position"] for r in placed} == {r["id"]: r["position"] for r in again}


def _sides(df):
    return {
        (r["label"], r["split"]): r["count"]
        for r in df.groupBy("label", "split").count().collect()
    }


def test_split_shares_are_exact_per_class(spark):
    df = spark.range(1000).select(
        "id", F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c")
        .alias("label"),
    )
    out = splitting.split(df, "label", ["id"])
    assert out.count() == out.select("id").distinct().count() == 1000
    assert _sides(out) == {
        ("a", "train"): 490, ("a", "validation"): 105, ("a", "test"): 105,
        ("b", "train"): 140, ("b", "validation"): 30, ("b", "test"): 30,
        ("c", "train"): 70, ("c", "validation"): 15, ("c", "test"): 15,
    }


def test_split_without_strata(spark):
    """A class with one row switches stratification off; no row is lost."""
    df = spark.range(101).select(
        "id", F.when(F.col("id") == 100, "rare").otherwise("common").alias("label")
    )
    out = splitting.split(df, "label", ["id"])
    by_split = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert by_split == {"train": 70, "validation": 15, "test": 16}
    assert out.select("id").distinct().count() == 101


def test_copies_share_a_side(spark):
    """A third of all rows are copies of one row."""
    df = spark.range(900).select(
        F.when(F.col("id") < 300, F.lit(-1)).otherwise(F.col("id")).alias("id"),
        F.lit("a").alias("label"),
    )
    out = splitting.split(df, "label", ["id"])
    assert out.count() == 900
    assert out.where("id = -1").select("split").distinct().count() == 1


def test_large_tables_are_not_broadcast(spark):
    df = spark.range(20)
    assert state.small(df, 19) is df
    assert state.small(df, 20).count() == 20


def test_balanced_sample(spark):
    df = spark.range(500).select("id", (F.col("id") < 30).cast("int").alias("y"))
    sample = splitting.balanced_sample(df, "y", ["id"], 100)
    counts = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    assert counts == {0: 50, 1: 30}


@pytest.mark.parametrize("digits,room", [(3, 100_000), (1, 3), (2, 1)])
def test_cuts_are_refined_until_small(spark, digits, room):
    rows = [(g, i % 700) for g, n in (("a", 900), ("b", 40), (None, 7)) for i in range(n)]  # keys that repeat
    df = spark.createDataFrame(rows, "g string, k int").withColumn("h", ranking.row_hash("k", seed=1))
    size = F.col("size")
    got = {r.g: r for r in ranking.hash_cuts(df, ["g"], "h", [size / 3, size - 2, F.lit(0)], digits, room).collect()}
    found = {}
    for r in df.collect():
        found.setdefault(r.g, []).append(r.h)
    for g, hashes in found.items():
        hashes.sort()
        ranks = [int(len(hashes) / 3), len(hashes) - 2]
        assert [got[g].cut_0, got[g].cut_1, got[g].cut_2] == [*(hashes[k - 1] for k in ranks), None]


def test_running_sums_do_not_grow_the_plan(spark):
    df = spark.range(5000).selectExpr("id * 7 % 5003 AS score", "id % 3 AS n")
    sizes = []
    for slices in (2, 40):
        out = ranking.running_sums(df, "score", ["n"], descending=True, slices=slices)
        rows = sorted(((r.score, r.n, r.cum_n) for r in out.collect()), reverse=True)
        total = 0
        for _, n, cum in rows:
            total += n
            assert cum == total
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 400
