"""Order statistics, ranks and running sums that never sort one group in one task.

Each works in two steps: a coarse one that counts rows per slice of the order (partial aggregation,
one small row per slice), and a fine one inside slices. No window spans more than one slice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.operators.state import small
from wirelens.workspace import materialize

HEX_DIGITS = 3
ROWS_PER_SLICE = 500_000


def slices_for(rows: int) -> int:
    """How many slices of an order keep each at about ROWS_PER_SLICE rows."""
    return max(1, math.ceil(rows / ROWS_PER_SLICE))


def digits_for(rows: int) -> int:
    """How many hex digits of a hash keep the rows of a prefix at about ROWS_PER_SLICE."""
    digits = 1
    while 16**digits < slices_for(rows):
        digits += 1
    return digits


def row_hash(*parts, seed: int = 0) -> Column:
    """Text hash of a row key; equal in every engine, so a split can be repeated elsewhere."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.col(p) for p in parts])
    return F.md5(F.concat(text, F.lit(f"|{seed}")))


# --- percentiles -------------------------------------------------------------------------------


def exact_percentiles(
    df: DataFrame, columns: list[str], shares: list[float], accuracy: int = 10_000,
    window_rows: int = 2_000_000,
) -> DataFrame:
    """Exact linear-interpolated percentiles: one row (feature, share, value) for each pair.

    A sketch brackets every wanted order statistic. A second pass counts values inside the brackets, about
    rows/accuracy per column, one by one and all others per gap between brackets. More than `window_rows` of them are ranked in slices.
    Null and NaN are left out; a column without values gives null.
    """
    wanted = sorted(set(shares))
    # sketch error plus two ranks; tables below `accuracy` rows are counted as a whole
    margin = 4.0 / accuracy
    marks = sorted({min(1.0, max(0.0, s + d)) for s in wanted for d in (-margin, margin)})
    clean = df.select(
        *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]
    )
    sketch = clean.agg(*[
        expr
        for i, c in enumerate(columns)
        for expr in (
            F.count(c).alias(f"n{i}"),
            F.percentile_approx(c, [float(m) for m in marks], accuracy).alias(f"marks{i}"),
        )
    ]).first()
    place = {m: i for i, m in enumerate(marks)}
    brackets = [
        (place[max(0.0, s - margin)], place[min(1.0, s + margin)]) for s in wanted
    ]
    infinity = float("inf")

    def edges_of(i: int) -> list[float]:
        if sketch[f"n{i}"] < accuracy:
            return [-infinity] * (len(marks) - 1) + [infinity]
        return sketch[f"marks{i}"]

    # every cell becomes a row with literals of its column's edges, so the generated code is short whatever the number of
    # columns; outside every bracket a cell counts for the next number after the largest edge below it
    edges = [edges_of(i) for i in range(len(columns))]
    value, inside, gap = F.col("value"), F.lit(False), F.lit(-infinity)
    edge = [F.get(F.lit([float(e[k]) for e in edges]), F.col("position")) for k in range(len(marks))]
    after = [F.get(F.lit([math.nextafter(e[k], infinity) for e in edges]), F.col("position")) for k in range(len(marks))]
    for low, high in brackets:
        inside = inside | value.between(edge[low], edge[high])
    for k in range(len(marks)):
        gap = F.when(value > edge[k], after[k]).otherwise(gap)
    cells = clean.select(F.posexplode(F.array(*columns)).alias("position", "value")).where("value IS NOT NULL")
    binned = cells.select("position", F.when(inside, value).otherwise(gap).alias("value")).groupBy("position", "value").agg(
        F.count(F.lit(1)).alias("rows"))
    binned = materialize(binned, "bins")
    if binned.count() <= window_rows:
        order = Window.partitionBy("position").orderBy("value")
        running = binned.withColumn(
            "cum_rows", F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, 0))
        )
    else:
        running = running_sums(binned, "value", ["rows"], ["position"])
    sizes = binned.groupBy("position").agg(F.sum("rows").alias("size"))
    running = running.join(small(sizes), "position")
    picks = []
    for i, share in enumerate(wanted):
        rank = (F.col("size") - 1) * F.lit(float(share))
        low_rank, high_rank = F.floor(rank), F.ceil(rank)
        low = F.min(F.when(F.col("cum_rows") > low_rank, F.col("value")))
        high = F.min(F.when(F.col("cum_rows") > high_rank, F.col("value")))
        weight = F.max(rank - low_rank)
        picks.append(
            F.struct(
                F.lit(float(share)).alias("share"), (low + (high - low) * weight).alias("value")
            )
        )
    found = running.groupBy("position").agg(F.array(*picks).alias("picks"))
    # one row per wanted pair, also for columns without values
    pairs = df.sparkSession.createDataFrame(
        [(i, c, float(s)) for i, c in enumerate(columns) for s in wanted],
        "position int, feature string, share double",
    )
    found = found.select("position", F.inline("picks"))
    return pairs.join(found, ["position", "share"], "left").select("feature", "share", "value")


# --- ranks by hash -----------------------------------------------------------------------------


def _hash_bucket(hashed: str, digits: int) -> Column:
    return F.substring(hashed, 1, digits)


def hash_cuts(
    df: DataFrame, group: list[str], hashed: str, cuts: list[Column], digits: int = HEX_DIGITS, room: int = 100_000
) -> DataFrame:
    """Per group, the hash of the row that has rank `cut` for every wanted cut (null if cut < 1).

    `cuts` are expressions over a column `size`, the group's row count. A radix selection: rows are counted by
    the first digits of their hash, then only those whose digits hold a cut by more digits, until such a part
    has `room` rows or fewer; these are ranked. Every step but the first reads a 16 ** digits-th of the rows.
    """
    rows = df.select(*group, F.col(hashed))
    length = digits
    counts = rows.groupBy(*group, _hash_bucket(hashed, length).alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*group)
    upto = F.sum("_rows").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_upto", upto).withColumn("size", F.sum("_rows").over(whole))
    wanted = F.array(*[F.struct(F.lit(i).alias("cut"), c.cast("long").alias("rank")) for i, c in enumerate(cuts)])

    def hit(among: Column) -> Column:
        return F.filter(
            among, lambda w: (w["rank"] <= F.col("_upto")) & (w["rank"] > F.col("_upto") - F.col("_rows")))

    def holding(counted: DataFrame, among: Column) -> DataFrame:
        held = counted.withColumn("_wanted", hit(among)).where(F.size("_wanted") > 0)
        return small(held.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_bucket").alias("_of__bucket"),
                                 "_wanted", "_rows", (F.col("_upto") - F.col("_rows")).alias("_before")))

    def inside(held: DataFrame) -> DataFrame:
        """The rows of the parts that hold a cut."""
        same = _hash_bucket(hashed, length) == F.col("_of__bucket")
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
        return rows.join(held.drop("_rows"), same)

    held = holding(counts, wanted)
    longest = 32  # digits of a row hash
    while length < longest and (held.agg(F.max("_rows")).head()[0] or 0) > room:
        near = inside(held)
        length = min(longest, length + digits)
        finer = near.groupBy(*group, "_of__bucket", _hash_bucket(hashed, length).alias("_bucket")).agg(
            F.count(F.lit(1)).alias("_rows"), F.first("_wanted").alias("_wanted"), F.first("_before").alias("_before"))
        inner = Window.partitionBy(*group, "_of__bucket").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        finer = finer.withColumn("_upto", F.col("_before") + F.sum("_rows").over(inner)).drop("_of__bucket", "_before")
        held = holding(finer, F.col("_wanted"))
    near = (
        inside(held).groupBy(*group, "_of__bucket", hashed)
        .agg(F.count(F.lit(1)).alias("_rows"), F.first("_wanted").alias("_wanted"),
             F.first("_before").alias("_before"))
    )
    by_hash = Window.partitionBy(*group, "_of__bucket").orderBy(hashed)
    near = near.withColumn(
        "_upto",
        F.col("_before") + F.sum("_rows").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)),
    )
    hits = near.select(*group, hashed, F.explode(hit(F.col("_wanted"))).alias("_hit"))
    return hits.groupBy(*group).agg(
        *[
            F.max(F.when(F.col("_hit.cut") == i, F.col(hashed))).alias(f"cut_{i}")
            for i in range(len(cuts))
        ]
    )


def hash_positions(
    df: DataFrame, hashed: str, position: str = "position", digits: int | None = None
) -> DataFrame:
    """Number all rows 0..n-1 in hash order; each task ranks hash prefixes, whose length follows from
    the row count."""
    digits = digits or digits_for(df.count())
    bucketed = df.withColumn("_bucket", _hash_bucket(hashed, digits))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # at most 16**digits rows: one per prefix
    upto = F.sum("_rows").over(
        Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    )
    offsets = counts.select("_bucket", (upto - F.col("_rows")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(hashed))
    return (
        bucketed.withColumn("_rank", rank)
        .join(small(offsets), "_bucket")
        .withColumn(position, F.col("_before") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_before")
    )


def lowest_per_group(
    df: DataFrame, group: list[str], order: list[Column], n
) -> DataFrame:
    """The first n rows of each group. The rank filter is pushed below the shuffle by Spark, so
    at most n rows of a group leave a partition."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


# --- running sums over a sorted score ----------------------------------------------------------


def running_sums(
    df: DataFrame,
    key: str,
    sums: list[str],
    by: list[str] | None = None,
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Cumulative sums of `sums` in the order of `key` within `by`, for rows with distinct keys.

    Rows are dealt to ranges of the key and written with the number of their range, so no range (nor any part of
    it that one `by` group holds) has many rows and the plan does not grow with their number; the totals of
    the ranges are added up first and handed to them.
    """
    by = by or []
    slices = slices or slices_for(df.count())
    ordered = F.col(key).desc() if descending else F.col(key).asc()
    cut = materialize(df.repartitionByRange(slices, ordered).withColumn("_slice", F.spark_partition_id()), "ranges")
    totals = cut.groupBy(*by, "_slice").agg(*[F.sum(s).alias(f"_total_{s}") for s in sums])
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by, "_slice",
        *[F.coalesce(F.sum(f"_total_{s}").over(earlier), F.lit(0)).alias(f"_before_{s}")
          for s in sums],
    )
    order = F.col(key).desc() if descending else F.col(key).asc()
    inside = (
        Window.partitionBy(*by, "_slice").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = cut.withColumns({f"_inside_{s}": F.sum(s).over(inside) for s in sums})
    out = out.join(small(totals), by + ["_slice"])
    return out.select(
        *df.columns, *[(F.col(f"_before_{s}") + F.col(f"_inside_{s}")).alias(f"cum_{s}")
                       for s in sums],
    )
