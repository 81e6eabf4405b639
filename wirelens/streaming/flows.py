"""Streaming sessions of packets, and the flush of flows still open when the stream stops.

Two stateful steps, keyed by shards of five-tuples, as a call for every five-tuple costs more than its packets. The first
keeps the packets of a shard and time bucket in a list that is only appended to; when the watermark has passed the bucket,
its packets become runs (see `operators.flows`) and the list is cleared. A flood on one five-tuple is spread over its
buckets. The second keeps the runs of a shard in such a list too, and emits a session once every bucket that could continue
it has been read. Packets and runs travel and are held as blocks (see `blocks`).

What is open after a stop is read from the state in the query's checkpoint: packets of open buckets and runs of
open sessions merge to the remaining flows. No packet is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from wirelens import constants as K
from wirelens.operators import flows as B

from .blocks import BLOCK, Blocks, pack, unpack, unpacked

#: Setting that stateful steps need: the store that holds lists, maps and timers.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
# stateful steps want column names that do not begin with an underscore
_FLAGS, _FIELDS = [n[1:] for n in B.FLAG_SUMS], [n[1:] for n in B.RUN]
_PLAIN = dict(zip(B.RUN, _FIELDS, strict=True))
_OWN = dict(zip(_FIELDS, B.RUN, strict=True))
_KEY = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int"
_RUN = ", ".join(f"{n} long" for n in _FIELDS)
_KEY_FIELDS = [T.StructField(n, T.StringType() if n.endswith("_ip") else T.IntegerType()) for n in B.FIVE_TUPLE]
_RUN_TYPE = T.StructType([*_KEY_FIELDS, *[T.StructField(n, T.LongType()) for n in B.RUN]])
_PACKET_TYPE = T.StructType([
    *_KEY_FIELDS, T.StructField("at", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("forward", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in _FLAGS]])
#: Five-tuples are dealt to so many keys of the stateful steps.
SHARDS = 512
_LOW = (1 << B.GAP_BITS) - 1


def _gap_columns(gaps: np.ndarray) -> dict[str, np.ndarray]:
    high, low = gaps >> B.GAP_BITS, gaps & _LOW
    return {"_g_n": np.ones_like(gaps), "_g_sum": gaps, "_g_hh": high * high, "_g_hl": high * low, "_g_ll": low * low}


# steps work on arrays of many five-tuples: a call on a small pandas frame costs more than all arithmetic on its few rows
def _codes(frame: pd.DataFrame) -> np.ndarray:
    """Numbers of the five-tuples; rows of a frame without them are of one."""
    codes = np.zeros(len(frame), np.int64)
    for name in B.FIVE_TUPLE:
        if name in frame.columns:
            own, values = pd.factorize(frame[name], use_na_sentinel=False)
            codes = pd.factorize(codes * len(values) + own)[0]
    return codes


def _runs_frame(columns: dict[str, tuple[np.ndarray, np.ndarray]], keys: pd.DataFrame) -> pd.DataFrame:
    """The five-tuples, where they are known, and columns RUN from values and masks (true: missing)."""
    runs = pd.DataFrame({n: pd.arrays.IntegerArray(*columns[n]) for n in B.RUN}, copy=False)
    return runs if keys.empty else pd.concat([keys.reset_index(drop=True), runs], axis=1)


def _keys(frame: pd.DataFrame, rows: np.ndarray) -> pd.DataFrame:
    return frame[[n for n in B.FIVE_TUPLE if n in frame.columns]].iloc[rows]


def _sums(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.add.reduceat(values, starts), np.zeros(len(starts), bool)


def _extreme(of: np.ufunc, values: np.ndarray, known: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per group the least or largest of the known values; missing where none is known."""
    limits = np.iinfo(np.int64)
    neutral = limits.min if of is np.maximum else limits.max
    missing = ~np.logical_or.reduceat(known, starts)
    return np.where(missing, 1, of.reduceat(np.where(known, values, neutral), starts)), missing


def packet_runs(packets: pd.DataFrame, gap_us: int) -> pd.DataFrame:
    """Packets (columns of the first state) -> the runs of their five-tuples, as `operators.flows.runs` gives them."""
    at, codes = packets["at"].to_numpy(np.int64), _codes(packets)
    order = np.lexsort((at, codes))
    codes = codes[order]
    at, length = at[order], packets["length"].to_numpy(np.int64)[order]
    forward = packets["forward"].to_numpy(bool)[order]
    idle = np.diff(at)
    inside = np.append(False, (idle <= gap_us) & (codes[1:] == codes[:-1]))
    starts = np.flatnonzero(~inside)
    gaps = np.where(inside, np.append(0, idle), 0)
    rows = {
        "_n": np.ones(len(at), np.int64), "_nf": forward.astype(np.int64), "_nb": (~forward).astype(np.int64),
        "_lf": np.where(forward, length, 0), "_lb": np.where(forward, 0, length), "_l2": length * length,
        **{n: packets[f].to_numpy(np.int64)[order] for n, f in zip(B.FLAG_SUMS, _FLAGS, strict=True)},
        **{n: np.where(inside, v, 0) for n, v in _gap_columns(gaps).items()},
    }
    every = np.ones(len(at), bool)
    out = {n: _sums(v, starts) for n, v in rows.items()}
    out["_start"], out["_end"] = _extreme(np.minimum, at, every, starts), _extreme(np.maximum, at, every, starts)
    for side, values, known in (("max_f", length, forward), ("max_b", length, ~forward), ("max_a", length, every), ("g_max", gaps, inside)):
        out[f"_{side}"] = _extreme(np.maximum, values, known, starts)
        out[f"_{side.replace('max', 'min')}"] = _extreme(np.minimum, values, known, starts)
    return _runs_frame(out, _keys(packets, order[starts]))


def merge_runs(found: pd.DataFrame, gap_us: int) -> pd.DataFrame:
    """Runs -> the sessions of their five-tuples, as runs again."""
    codes = _codes(found)
    order = np.lexsort([*[found[n].to_numpy(np.int64) for n in ("_end", "_start")], codes])
    codes = codes[order]
    columns = {}
    for n in B.RUN:
        cells = found[n].array
        missing = np.asarray(cells.isna())
        columns[n] = (cells.to_numpy(np.int64, na_value=0) if missing.any() else cells.to_numpy(np.int64))[order], ~missing[order]
    start, end = columns["_start"][0], columns["_end"][0]
    joint = np.append(gap_us + 1, np.where(codes[1:] == codes[:-1], start[1:] - end[:-1], gap_us + 1))
    inside = joint <= gap_us
    starts = np.flatnonzero(~inside)
    bridges = _gap_columns(np.where(inside, joint, 0))
    out = {}
    for n in B.SUMS:
        values, known = columns[n]
        out[n] = _sums(np.where(known, values + np.where(inside, bridges.get(n, 0), 0), 0), starts)
    for of, names in ((np.minimum, ["_start", *B.MINIMA]), (np.maximum, ["_end", *B.MAXIMA])):
        for n in names:
            values, known = columns[n]
            if n in ("_g_min", "_g_max"):
                values = np.where(inside, np.where(known, of(values, joint), joint), values)
                known = known | inside
            out[n] = _extreme(of, values, known, starts)
    return _runs_frame(out, _keys(found, order[starts]))


class PacketBuckets(StatefulProcessor):
    """Key: shard of five-tuples and bucket. Emits the bucket's runs, as blocks, when the watermark has passed it."""

    def __init__(self, gap_us: int, bucket_us: int):
        self.gap_us, self.bucket_us = gap_us, bucket_us

    def init(self, handle) -> None:
        self.handle = handle
        self.packets = Blocks(handle.getListState("packets", BLOCK), _PACKET_TYPE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.packets.exists()
        for frame in rows:
            self.packets.append(frame)
        if fresh:
            self.handle.registerTimer(-(-((key[-1] + 1) * self.bucket_us) // 1000))
        return iter(())  # an empty frame of many columns costs as much as a full one

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = packet_runs(pd.concat(map(unpack, self.packets.get()), ignore_index=True), self.gap_us)
        self.packets.clear()
        # one more millisecond: rows at the watermark itself count as late
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs() + 1, unit="ms")
        blocks = [pack(found[i:i + OUT_ROWS], to_arrow_schema(_RUN_TYPE)) for i in range(0, len(found), OUT_ROWS)]
        yield pd.DataFrame({"shard": key[0], "passed": at, "block": blocks})

    def close(self) -> None:
        pass


class OpenSessions(StatefulProcessor):
    """Key: shard of five-tuples. Holds the runs of open sessions; emits a session when no unread bucket can continue it."""

    def __init__(self, gap_us: int, bucket_us: int):
        self.gap_us, self.bucket_us = gap_us, bucket_us

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = Blocks(handle.getListState("runs", BLOCK), _RUN_TYPE)

    def _closes(self, end) -> np.ndarray:
        """The time in milliseconds at which the bucket that holds end + gap has been read."""
        last = (np.asarray(end, np.int64) + self.gap_us) // self.bucket_us + 1
        return -(-(last * self.bucket_us) // 1000) + 2

    def _keep(self, runs: pd.DataFrame) -> None:
        """Hold more runs and wake when the first session may close. Sessions are merged then, not before."""
        self.runs.append(runs)
        at, timers = int(self._closes(runs["_end"]).min()), list(self.handle.listTimers())
        if not timers or at < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for runs in map(unpack, frame["block"]) if "block" in frame else [frame.rename(columns=_OWN)]:
                self._keep(runs)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs = merge_runs(pd.concat(map(unpack, self.runs.get()), ignore_index=True), self.gap_us)
        self.runs.clear()
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        done = self._closes(runs["_end"]) <= timerValues.getCurrentWatermarkInMs()
        if not done.all():
            self._keep(runs[~done])
        found = runs[done].rename(columns=_PLAIN)
        for i in range(0, len(found), OUT_ROWS):
            yield found[i:i + OUT_ROWS][_names(_SESSION_OUT)]

    def close(self) -> None:
        pass


OUT_ROWS = 50_000
_BUCKET_OUT = "shard int, passed timestamp, block binary"
_SESSION_OUT = f"{_KEY}, {_RUN}"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def stream_flows(packets: DataFrame, gap_us: int = 3 * B.MICROS, delay: str = "10 seconds", bucket_us: int | None = None,
                 shards: int = SHARDS) -> DataFrame:
    """Completed flows, emitted once the watermark has passed every bucket that could continue them.

    Packets older than the watermark are dropped. Run it with the settings in STATE_STORE."""
    bucket_us = bucket_us or 20 * gap_us
    flags = [F.coalesce(F.try_element_at("flags", F.lit(n)), F.lit(0)).cast("long").alias(column)
             for n, column in zip(K.FLAG_NAMES, _FLAGS, strict=True)]
    at = F.unix_micros("ts")
    rows = packets.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64(*B.FIVE_TUPLE), F.lit(shards)).cast("int").alias("shard"),
        F.floor(at / F.lit(bucket_us)).cast("long").alias("bucket"), *B.FIVE_TUPLE, "ts", at.alias("at"),
        F.coalesce(F.col("length"), F.lit(0)).cast("long").alias("length"), F.coalesce("is_forward", F.lit(False)).alias("forward"),
        *flags,
    )
    found = rows.groupBy("shard", "bucket").transformWithStateInPandas(
        PacketBuckets(gap_us, bucket_us), _BUCKET_OUT, "Append", "EventTime", eventTimeColumnName="passed")
    sessions = found.groupBy("shard").transformWithStateInPandas(
        OpenSessions(gap_us, bucket_us), _SESSION_OUT, "Append", "EventTime")
    return B.flow_rows(sessions.withColumnsRenamed(_OWN))


def state_rows(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The state of a stopped query: rows (key, list_element) of a list, (key, value) of a value."""
    steps = spark.read.format("state-metadata").load(checkpoint)
    step = steps.where(F.col("operatorProperties").contains(f'"{variable}"')).select("operatorId").head()
    if step is None:
        raise ValueError(f"no step of {checkpoint} holds {variable}")
    return (
        spark.read.format("statestore").option("operatorId", step.operatorId).option("stateVarName", variable)
        .option("flattenCollectionTypes", True).load(checkpoint)
    )


def open_flows(spark: SparkSession, checkpoint: str, gap_us: int = 3 * B.MICROS, bucket_us: int | None = None) -> DataFrame:
    """The flows that a stopped stream had not emitted, from the state in its checkpoint."""
    bucket_us = bucket_us or 20 * gap_us
    packets, runs = (
        unpacked(state_rows(spark, checkpoint, variable).select("list_element.block"), T.StructType([]), columns)
        for variable, columns in (("packets", _PACKET_TYPE), ("runs", _RUN_TYPE)))
    flags = F.create_map(*[x for n, c in zip(K.FLAG_NAMES, _FLAGS, strict=True) for x in (F.lit(n), F.col(c).cast("int"))])
    packets = packets.select(
        *B.FIVE_TUPLE, F.timestamp_micros("at").alias("ts"), "length", F.col("forward").alias("is_forward"), flags.alias("flags"))
    unread = B.runs(packets, gap_us, bucket_us).drop("_inner")
    # runs of both tables may touch, so none is known to stand apart
    both = unread.unionByName(runs.select(*unread.columns)).withColumn("_inner", F.lit(None).cast("long"))
    return B.flow_rows(B.merged(both, gap_us))
