"""Deviations of a row without interpreted lambdas."""

from pyspark.sql import functions as F

from wirelens.operators import explain


def _state(spark):
    return spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 1.0), ("c", 0.0, 2.0)], "feature string, mean double, std_pop double")


def test_order_ties_missing_cells_and_the_limit(spark):
    rows = spark.createDataFrame(
        [(1, 2.0, 2.0, 9.0), (2, None, 1.0, -20.0), (3, float("nan"), 0.0, 0.0), (4, 99.0, -99.0, 99.0)],
        "id int, a double, b double, c double")

    def found(**options):
        judged = explain.with_deviations(rows, ["a", "b", "c"], _state(spark), display=str, **options)
        assert judged.columns == ["id", "a", "b", "c", "deviations"]
        return {r.id: [(d.technical, d.z) for d in r.deviations] for r in judged.collect()}

    everything = {1: [("c", 4.5), ("b", 2.0), ("a", 2.0)], 2: [("c", -10.0)], 3: [], 4: [("c", 15.0), ("b", -15.0), ("a", 15.0)]}
    assert found(top_k=None) == everything
    assert found(top_k=2) == {k: v[:2] for k, v in everything.items()}


def test_plan_has_no_lambda(spark):
    rows = spark.range(3).selectExpr("id", "1.0D * id AS a", "2.0D AS b", "3.0D AS c")
    judged = explain.with_deviations(rows, ["a", "b", "c"], _state(spark))
    listed = judged.select("id", F.posexplode_outer("deviations").alias("rank", "item"))
    plan = listed.select("id", explain.attribution(F.col("item")).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
