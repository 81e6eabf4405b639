"""Packets -> flows: gap sessions per five-tuple and the 51 flow features.

A five-tuple may hold a large part of all packets. Packets are therefore shuffled by five-tuple and time
slice and summed up there as runs: packets that follow each other within the idle time. A run is a
mergeable summary (first, last, sums, extremes, gaps); runs that touch the border of their slice are
stitched with their neighbours, and sums merge to whole sessions. Hot slices are cut finer by their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens import constants as K
from wirelens.workspace import materialize

FIVE_TUPLE = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
PACKET_SCHEMA = (
    "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, ts timestamp, "
    "length int, is_forward boolean, flags map<string,int>"
)
MICROS = 1_000_000


def flow_id() -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in FIVE_TUPLE])


def protocol_code(is_stream_socket: Column) -> Column:
    return F.when(is_stream_socket, K.TCP).otherwise(K.UDP)


def port_protocol(port: Column) -> Column:
    return F.when(port != 53, K.TCP).otherwise(K.UDP)


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy HH:mm:ss")


#: What a run of packets keeps: numbers that merge with those of the next run of the same key.
#: `_g_*` are sums over the gaps between packets, split at 2 ** 20 so that squares stay exact in 64 bits.
FLAG_SUMS = [f"_{name.lower()}" for name in K.FLAG_NAMES]
SIDES = ("f", "b", "a")
SUMS = ["_n", "_nf", "_nb", "_lf", "_lb", "_l2", "_g_n", "_g_sum", "_g_hh", "_g_hl", "_g_ll", *FLAG_SUMS]
MAXIMA = [*[f"_max_{s}" for s in SIDES], "_g_max"]
MINIMA = [*[f"_min_{s}" for s in SIDES], "_g_min"]
RUN = ["_start", "_end", *SUMS, *MAXIMA, *MINIMA]
GAP_BITS = 20
#: A (five-tuple, slice) with more packets is cut finer.
SLICE_ROWS = 2_000_000


def hot_slices(packets: DataFrame, slice_us: int, keys: list[str] = FIVE_TUPLE, slice_rows: int = SLICE_ROWS,
               finer: int = 64, most: int = 10_000) -> list[DataFrame]:
    """Tables (_hash, _slice), level by level: the slices that hold more than `slice_rows` packets, then those of their
    64 parts that still do, down to single microseconds. Only what is hot is counted again. A table has fewer than
    `most` rows, as each of its slices holds more than 1 / most of all packets."""
    levels: list[DataFrame] = []
    rows = packets.select(F.xxhash64(*keys).alias("_hash"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    width, limit = slice_us, slice_rows
    while True:
        counted = rows.groupBy("_hash", F.floor(F.col("_at") / F.lit(width)).alias("_slice")).count()
        if not levels:
            counted = materialize(counted, "slice_counts")
            total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).head()[0]
            limit = max(slice_rows, total // most)
        hot = materialize(counted.where(F.col("count") > limit).select("_hash", "_slice"), "hot_slices")
        if not hot.head(1):
            return levels
        levels.append(hot)
        if width == 1:
            return levels
        inside = F.broadcast(hot.withColumnRenamed("_slice", "_inside"))
        rows = rows.withColumn("_inside", F.floor(F.col("_at") / F.lit(width))).join(
            inside, ["_hash", "_inside"], "left_semi").select("_hash", "_at")
        width = max(1, width // finer)


def sliced(packets: DataFrame, slice_us: int, keys: list[str] = FIVE_TUPLE, hot: list[DataFrame] | None = None,
           finer: int = 64) -> DataFrame:
    """Packets with their time `_at` in microseconds and their slice: (_level, _slice)."""
    at = F.col("_at")
    out = packets.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumns(
        {"_level": F.lit(0), "_slice": F.floor(at / F.lit(slice_us))})
    if not hot:
        return out
    out, width = out.withColumn("_hash", F.xxhash64(*keys)), slice_us
    for level, table in enumerate(hot):
        width = max(1, width // finer)
        cut = F.broadcast(table.withColumn("_level", F.lit(level)).withColumn("_cut", F.lit(True)))
        out = out.join(cut, ["_hash", "_level", "_slice"], "left").withColumns({
            "_slice": F.when(F.col("_cut"), F.floor(at / F.lit(width))).otherwise(F.col("_slice")),
            "_level": F.when(F.col("_cut"), F.lit(level + 1)).otherwise(F.col("_level")),
        }).drop("_cut")
    return out.drop("_hash")


def _in_runs(packets: DataFrame, gap_us: int, keys: list[str]) -> DataFrame:
    """Sliced packets with the time since their predecessor in the slice and the number of their run there."""
    at = F.col("_at")
    inside = Window.partitionBy(*keys, "_level", "_slice").orderBy("_at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = packets.withColumn("_idle", at - F.lag("_at").over(inside))
    return before.withColumn("_run", F.sum(F.when(F.col("_idle") > gap_us, 1).otherwise(0)).over(so_far)).withColumn(
        "_gap", F.when(F.col("_idle") <= gap_us, F.col("_idle")))


def _gap_sums(gap: Column) -> list[Column]:
    high, low = F.shiftright(gap, GAP_BITS), gap.bitwiseAND(F.lit((1 << GAP_BITS) - 1))
    return [
        F.count(gap).alias("_g_n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(name) for x, name in (
            (gap, "_g_sum"), (high * high, "_g_hh"), (high * low, "_g_hl"), (low * low, "_g_ll"))],
        F.max(gap).alias("_g_max"), F.min(gap).alias("_g_min"),
    ]


def runs(packets: DataFrame, gap_us: int = 3 * MICROS, slice_us: int = 3600 * MICROS, keys: list[str] = FIVE_TUPLE,
         hot: list[DataFrame] | None = None) -> DataFrame:
    """One row per run of packets: those of a key in a slice that follow each other within `gap_us`.

    Columns: keys, RUN and `_inner` (the run's start where runs of its slice stand on both sides of it, so that no
    other slice can touch it; else null). Packets are shuffled once, by key and slice.
    """
    marked = _in_runs(sliced(packets, slice_us, keys, hot), gap_us, keys)
    length, forward = F.col("length").cast("long"), F.col("is_forward")
    sides = (("f", forward), ("b", ~forward), ("a", F.lit(True)))
    grouped = marked.groupBy(*keys, "_level", "_slice", "_run").agg(
        F.min("_at").alias("_start"), F.max("_at").alias("_end"), F.count(F.lit(1)).alias("_n"),
        F.count_if(forward).alias("_nf"), F.count_if(~forward).alias("_nb"),
        F.coalesce(F.sum(F.when(forward, length)), F.lit(0)).alias("_lf"),
        F.coalesce(F.sum(F.when(~forward, length)), F.lit(0)).alias("_lb"),
        F.coalesce(F.sum(length * length), F.lit(0)).alias("_l2"), *_gap_sums(F.col("_gap")),
        *[F.coalesce(F.sum(F.try_element_at("flags", F.lit(name))), F.lit(0)).cast("long").alias(column)
          for name, column in zip(K.FLAG_NAMES, FLAG_SUMS, strict=True)],
        *[fn(F.when(side, length)).alias(f"_{name}_{tag}") for tag, side in sides
          for name, fn in (("max", F.max), ("min", F.min))],
    )
    return _with_inner(grouped, keys).select(*keys, *RUN, "_inner")


def _with_inner(found: DataFrame, keys: list[str]) -> DataFrame:
    last = F.max("_run").over(Window.partitionBy(*keys, "_level", "_slice"))
    return found.withColumn("_inner", F.when((F.col("_run") > 0) & (F.col("_run") < last), F.col("_start")))


def _stitched(found: DataFrame, gap_us: int, keys: list[str]) -> DataFrame:
    """Runs with the start of their session and the gap to the run before them where they continue one. A window
    holds the first and last run of every slice of a key; inner runs are windows of their own."""
    across = Window.partitionBy(*keys, "_inner").orderBy("_start", "_end")
    idle = F.col("_start") - F.lag("_end").over(across)
    joined = found.withColumn("_joint", idle).withColumn("_joint", F.when(F.col("_joint") <= gap_us, F.col("_joint")))
    opened = F.last(F.when(F.col("_joint").isNull(), F.col("_start")), ignorenulls=True)
    return joined.withColumn("_session", opened.over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def merged(found: DataFrame, gap_us: int = 3 * MICROS, keys: list[str] = FIVE_TUPLE) -> DataFrame:
    """Runs -> one run per session (keys, RUN). Sums and extremes merge in any order; what two runs of a session leave
    between them is one more gap."""
    joint = F.col("_joint")
    high, low = F.shiftright(joint, GAP_BITS), joint.bitwiseAND(F.lit((1 << GAP_BITS) - 1))
    more = {"_g_n": F.lit(1), "_g_sum": joint, "_g_hh": high * high, "_g_hl": high * low, "_g_ll": low * low}

    def total(name: str) -> Column:
        own = F.sum(name)
        return own + F.coalesce(F.sum(F.when(joint.isNotNull(), more[name])), F.lit(0)) if name in more else own

    return _stitched(found, gap_us, keys).groupBy(*keys, "_session").agg(
        F.min("_start").alias("_start"), F.max("_end").alias("_end"), *[total(n).alias(n) for n in SUMS],
        *[F.max(F.greatest(n, joint) if n == "_g_max" else F.col(n)).alias(n) for n in MAXIMA],
        *[F.min(F.least(n, joint) if n == "_g_min" else F.col(n)).alias(n) for n in MINIMA],
    ).drop("_session")


def sessionize(
    packets: DataFrame,
    gap_us: int = 3 * MICROS,
    slice_us: int = 3600 * MICROS,
    keys: list[str] = FIVE_TUPLE,
    hot: list[DataFrame] | None = None,
) -> DataFrame:
    """Adds session_us (start of the packet's session) and iat_us (time since its predecessor in
    the session, null for the first). A new session starts after more than `gap_us` idle time.

    Packets are numbered by run inside their slice and looked up in the table of stitched runs, which
    is read from the same shuffle of packets where they have no other columns than keys and time."""
    # one key column that is never null: windows and join then share a partitioning
    key = F.concat_ws("-", *[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys])
    marked = _in_runs(sliced(packets, slice_us, keys, hot).withColumn("_key", key), gap_us, ["_key"])
    place = ["_key", "_level", "_slice", "_run"]
    found = marked.groupBy(*place).agg(F.min("_at").alias("_start"), F.max("_at").alias("_end"))
    table = _stitched(_with_inner(found, ["_key"]), gap_us, ["_key"]).select(*place, "_session", "_joint")
    # the first packet of a run has no gap inside its slice
    return marked.join(table, place).select(
        *packets.columns, F.col("_session").alias("session_us"),
        F.coalesce("_gap", "_joint").alias("iat_us"), F.col("_at").alias("at_us"),
    )


def packet_features() -> dict[str, Column]:
    """The 51 features from the aggregates above, by column name."""
    c = F.col
    duration = F.greatest(c("_end") - c("_start"), F.lit(100)).cast("double")
    seconds = duration / F.lit(1e6)
    n_f, n_b, l_f, l_b = c("_nf"), c("_nb"), c("_lf"), c("_lb")
    packets, total = n_f + n_b, l_f + l_b
    zero = F.lit(0.0)
    mean_f = F.coalesce(F.try_divide(l_f.cast("double"), n_f), zero)
    mean_b = F.coalesce(F.try_divide(l_b.cast("double"), n_b), zero)
    mean = F.coalesce(F.try_divide(total.cast("double"), packets), zero)
    values = [
        duration, n_f, n_b, l_f.cast("double"), l_b.cast("double"),
        c("_max_f"), c("_min_f"), mean_f, c("_max_b"), c("_min_b"), mean_b,
        total / seconds, packets / seconds,
        c("_iat_mean"), c("_iat_std"), c("_iat_max"), c("_iat_min"),
        duration * 0.9, duration * 0.8,
        (c("_psh") > 0).cast("int"), F.lit(0), F.lit(0), F.lit(0),
        n_f * 20, n_b * 20, n_f / seconds, n_b / seconds,
        c("_min_a"), c("_max_a"), mean, c("_length_std"),
        c("_fin"), c("_syn"), c("_rst"), c("_psh"), c("_ack"), c("_urg"),
        n_b / F.greatest(n_f, F.lit(1)), mean, mean_f, mean_b,
        n_f, l_f.cast("double"), n_b, l_b.cast("double"),
        F.lit(29200), F.lit(0),
        F.greatest(n_f - 2, F.lit(0)), F.lit(20), duration * 0.1, duration * 0.2,
    ]
    return dict(zip(K.FEATURE_COLUMNS, values, strict=True))


def flow_metadata() -> list[Column]:
    return [
        flow_id().alias("flow_id"),
        F.col("src_ip").alias("source_ip"), F.col("src_port").alias("source_port"),
        F.col("dst_ip").alias("destination_ip"), F.col("dst_port").alias("destination_port"),
        F.col("protocol"),
        display_time(F.timestamp_micros("_start")).alias("timestamp"),
    ]


def _deviation(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from sums; exact up to the root while the products fit 38 digits."""
    count, whole = n.cast("decimal(20,0)"), total.cast("decimal(20,0)")
    exact = F.try_subtract(
        F.try_multiply(count, squares.cast("decimal(38,0)")), F.try_multiply(whole, whole)).cast("double")
    rough = n.cast("double") * squares.cast("double") - total.cast("double") * total.cast("double")
    return F.coalesce(F.try_divide(F.sqrt(F.greatest(F.coalesce(exact, rough), F.lit(0.0))), n), F.lit(0.0))


def flow_rows(sessions: DataFrame) -> DataFrame:
    """Whole sessions (see `merged`) -> one row per flow: start_us, 7 metadata columns, 51 features."""
    c = F.col
    squares = (
        c("_g_hh").cast("decimal(20,0)") * F.lit(1 << 2 * GAP_BITS) + c("_g_hl").cast("decimal(20,0)") * F.lit(2 << GAP_BITS)
        + c("_g_ll")
    )
    zero = F.lit(0.0)
    found = sessions.withColumns({
        "_length_std": _deviation(c("_n"), c("_lf") + c("_lb"), c("_l2")),
        "_iat_mean": F.coalesce(F.try_divide(c("_g_sum").cast("double"), c("_g_n")), zero),
        "_iat_std": _deviation(c("_g_n"), c("_g_sum"), squares),
        "_iat_max": F.coalesce(c("_g_max").cast("double"), zero), "_iat_min": F.coalesce(c("_g_min").cast("double"), zero),
        **{f"_{kind}_{side}": F.coalesce(c(f"_{kind}_{side}").cast("double"), zero) for kind in ("max", "min") for side in SIDES},
        **{name: c(name).cast("int") for name in FLAG_SUMS},
    })
    return found.select(
        c("_start").alias("start_us"), *flow_metadata(), *[expr.alias(name) for name, expr in packet_features().items()])


def flow_table(
    packets: DataFrame, gap_us: int = 3 * MICROS, slice_us: int = 3600 * MICROS, slice_rows: int | None = SLICE_ROWS
) -> DataFrame:
    """One row per flow: start_us, 7 metadata columns, 51 features.

    Packets are read and shuffled once, as (five-tuple, slice); their runs are what the second shuffle moves. Slices
    of more than `slice_rows` packets, counted beforehand from the key columns alone, are cut finer (None: no count).
    """
    hot = hot_slices(packets, slice_us, FIVE_TUPLE, slice_rows) if slice_rows else None
    return flow_rows(merged(runs(packets, gap_us, slice_us, FIVE_TUPLE, hot), gap_us))
