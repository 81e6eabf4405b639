"""Benign baseline, z-scores and ranked deviations. Ranking is row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens import constants as K
from wirelens.functions import text as X
from wirelens.functions.scores import clip
from wirelens.operators.state import literals

MIN_Z, TOP_K = 1.75, 4


def baseline(df: DataFrame, features: list[str]) -> DataFrame:
    """State table (idx, feature, mean, std_pop) of benign rows, in one pass."""
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("idx"), F.lit(f).alias("feature"),
            F.avg(f).alias("mean"), F.stddev_pop(f).alias("std_pop"),
        )
        for i, f in enumerate(features)
    ])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def z_score(value: Column, mean: Column, std: Column) -> Column:
    spread = F.when(std > 1e-4, std).otherwise(
        F.greatest(F.abs(mean) * F.lit(0.1), F.lit(1.0))
    )
    return clip((value - mean) / spread, -15.0, 15.0)


def z_scores(
    df: DataFrame, features: list[str], state: DataFrame, keep: list[str] = ()
) -> DataFrame:
    of = literals(state, "feature", ["mean", "std_pop"])
    return df.select(
        *keep,
        *[z_score(F.col(f).cast("double"), of(f, "mean"), of(f, "std_pop")).alias(f)
          for f in features],
    )


def with_deviations(
    df: DataFrame,
    features: list[str],
    state: DataFrame,
    top_k: int = TOP_K,
    min_z: float = MIN_Z,
    column: str = "deviations",
    display=lambda name: K.DISPLAY_BY_COLUMN.get(name, name),
) -> DataFrame:
    """Adds an array of the features with |z| >= min_z, largest first (later column on ties):
    structs of size, idx, technical, observed, mean, z. top_k=None keeps all of them."""
    of = literals(state, "feature", ["mean", "std_pop"])
    # the scores are columns of their own, and no lambda is used: what a lambda reads is interpreted, once per use
    scores = {
        f"_z_{i}": z_score(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), of(f, "mean"), of(f, "std_pop"))
        for i, f in enumerate(features)
    }
    cells, found = [], F.lit(0)
    for i, (f, z) in enumerate(zip(features, scores, strict=True)):
        far = F.abs(z) >= min_z
        found = found + F.when(far, 1).otherwise(0)
        cells.append(F.when(far, F.struct(
            F.abs(z).alias("size"), F.lit(i).alias("idx"), F.lit(display(f)).alias("technical"),
            F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("observed"), of(f, "mean").alias("mean"),
            F.col(z).alias("z"),
        )))
    if top_k is not None:
        found = F.least(found, F.lit(top_k))
    # descending order puts the missing cells last
    ranked = F.slice(F.sort_array(F.array(*cells), asc=False), F.lit(1), found)
    return df.withColumns(scores).withColumn(column, ranked).drop(*scores)


def attribution(d: Column) -> Column:
    """Deviation struct -> report struct, rounded to 2."""
    return F.struct(
        X.friendly_name(d["technical"]).alias("feature"),
        d["technical"].alias("technical_name"),
        F.round(d["observed"], 2).alias("actual_value"),
        F.round(d["mean"], 2).alias("baseline_mean"),
        F.round(d["observed"] - d["mean"], 2).alias("deviation"),
        F.round(d["z"], 2).alias("z_score"),
        X.impact(d["z"]).alias("impact"),
    )


def attributions(deviations: Column) -> Column:
    """Deviation structs -> report structs."""
    return F.transform(deviations, attribution)


def bullets(deviations: Column) -> Column:
    return F.transform(deviations, lambda d: X.deviation_sentence(
        X.friendly_name(d["technical"]), d["observed"], d["mean"]
    ))
