from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wirelens.operators import flows
from wirelens.sources.tables import packet_stream
from wirelens.streaming import runs
from wirelens.streaming.flows import STATE_STORE, merge_runs, open_flows, packet_runs, stream_flows

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def packets(spark, rows):
    """rows: (src_ip, seconds, length, forward, flag)."""
    return spark.createDataFrame(
        [(ip, "8.8.8.8", 50000, 53, 17, START + timedelta(seconds=t), n, fwd, {flag: 1})
         for ip, t, n, fwd, flag in rows],
        flows.PACKET_SCHEMA,
    )


def test_two_packets(spark):
    df = packets(spark, [("192.168.1.10", 0.0, 60, True, "SYN"),
                         ("192.168.1.10", 1.0, 120, False, "ACK")])
    row = flows.flow_table(df).first()
    expected = {
        "flow_id": "192.168.1.10-8.8.8.8-50000-53-17", "timestamp": "01/01/2026 00:00:00",
        "flow_duration": 1e6, "total_fwd_packets": 1, "total_backward_packets": 1,
        "syn_flag_count": 1, "ack_flag_count": 1, "flow_bytes_s": 180.0, "flow_packets_s": 2.0,
        "packet_length_mean": 90.0, "packet_length_std": 30.0, "flow_iat_mean": 1e6,
        "flow_iat_std": 0.0, "init_win_bytes_forward": 29200, "min_seg_size_forward": 20,
    }
    assert {k: row[k] for k in expected} == expected


def test_single_packet(spark):
    row = flows.flow_table(packets(spark, [("a", 0.0, 60, False, "FIN")])).first()
    assert (row["flow_duration"], row["flow_iat_max"], row["fwd_packet_length_max"]) == (
        100.0, 0.0, 0.0
    )


@pytest.mark.parametrize("slice_seconds", [1, 7, 3600])
def test_sessions_equal_a_plain_scan(spark, slice_seconds):
    """One source holds most packets; slices far smaller and larger than the gap."""
    rng = np.random.default_rng(slice_seconds)
    rows = []
    for ip, n in (("hot", 600), ("b", 40), ("c", 1)):
        times = np.cumsum(rng.choice([0.0, 0.5, 2.9, 3.0, 3.001, 9.0, 40.0], n))
        rows += [(ip, float(t), 100, True, "ACK") for t in times]
    got = flows.sessionize(packets(spark, rows), slice_us=slice_seconds * flows.MICROS)
    found = defaultdict(int)
    for r in got.collect():
        found[r["src_ip"], r["session_us"], r["at_us"], r["iat_us"]] += 1
    want = defaultdict(int)
    base = int(START.timestamp()) * flows.MICROS
    by_ip = defaultdict(list)
    for ip, t, *_ in rows:
        by_ip[ip].append(base + round(t * flows.MICROS))
    for ip, times in by_ip.items():
        start = previous = None
        for t in sorted(times):
            fresh = previous is None or t - previous > 3 * flows.MICROS
            start = t if fresh else start
            want[ip, start, t, None if fresh else t - previous] += 1
            previous = t
    assert found == want


def brute_flows(rows):
    """{(ip, start): (packets, bytes, gaps)} by a plain scan; rows as for `packets`."""
    base = int(START.timestamp()) * flows.MICROS
    by_ip = defaultdict(list)
    for ip, t, n, _, _ in rows:
        by_ip[ip].append((base + round(t * flows.MICROS), n))
    out = {}
    for ip, found in by_ip.items():
        held = []
        for at, n in sorted(found):
            if held and at - held[-1][0] > 3 * flows.MICROS:
                out[ip, held[0][0]] = held
                held = []
            held.append((at, n))
        out[ip, held[0][0]] = held
    return {k: (len(v), sum(n for _, n in v), [b[0] - a[0] for a, b in zip(v, v[1:], strict=False)], [n for _, n in v])
            for k, v in out.items()}


def check_flows(table, rows):
    want = brute_flows(rows)
    got = {(r["source_ip"], r["start_us"]): r for r in table.collect()}
    assert got.keys() == want.keys()
    for key, (count, size, gaps, lengths) in want.items():
        r = got[key]
        assert r["total_fwd_packets"] + r["total_backward_packets"] == count
        assert r["total_length_of_fwd_packets"] + r["total_length_of_bwd_packets"] == size
        assert r["flow_duration"] == max(sum(gaps), 100)
        values = [np.mean(gaps), np.std(gaps), max(gaps), min(gaps)] if gaps else [0] * 4
        assert [r[f"flow_iat_{x}"] for x in ("mean", "std", "max", "min")] == pytest.approx(values, rel=1e-12, abs=1e-9)
        assert [r["packet_length_std"], r["min_packet_length"], r["max_packet_length"]] == pytest.approx(
            [np.std(lengths), min(lengths), max(lengths)], rel=1e-12, abs=1e-9)


def some_rows(seed, n_hot=600):
    rng = np.random.default_rng(seed)
    rows = []
    for ip, n in (("hot", n_hot), ("b", 40), ("c", 1)):
        times = np.cumsum(rng.choice([0.0, 0.5, 2.9, 3.0, 3.001, 9.0, 40.0], n))
        rows += [(ip, float(t), int(rng.integers(40, 1500)), bool(rng.random() < 0.6), "ACK") for t in times]
    return rows


@pytest.mark.parametrize("slice_seconds", [1, 7, 3600])
def test_runs_merge_to_flows(spark, slice_seconds):
    rows = some_rows(slice_seconds)
    check_flows(flows.flow_table(packets(spark, rows), slice_us=slice_seconds * flows.MICROS, slice_rows=None), rows)


def test_flood_is_cut_by_its_counts(spark):
    """One key and one slice hold nearly all packets, half of them in one millisecond."""
    rng = np.random.default_rng(5)
    times = np.concatenate([np.sort(rng.uniform(0, 3000, 800)), 1500 + np.sort(rng.uniform(0, 0.001, 800))])
    rows = [("hot", round(float(t), 6), 100 + i % 7, True, "SYN") for i, t in enumerate(times)] + some_rows(1, 20)
    table = packets(spark, rows)
    hot = flows.hot_slices(table, 3600 * flows.MICROS, slice_rows=100)
    assert len(hot) > 2
    cut = flows.sliced(table, 3600 * flows.MICROS, hot=hot)
    sizes = [r["count"] for r in cut.groupBy("src_ip", "_level", "_slice").count().collect()]
    assert max(sizes) <= 100 and len(sizes) > 20
    # the parts of the flood run in several tasks
    with runs.settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):  # so little data is one task else
        spread_rows = flows.runs(table, hot=hot).where("src_ip = 'hot'").withColumn("task", F.spark_partition_id())
        assert spread_rows.select("task").distinct().count() > 1
    check_flows(flows.flow_table(table, slice_rows=100), rows)


def test_one_scan_and_one_shuffle_of_packets(spark, tmp_path):
    packets(spark, some_rows(2)).write.parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))
    plan = flows.flow_table(table, slice_rows=None)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1
    executed = flows.flow_table(table, slice_rows=None)
    executed.collect()
    plan = executed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in plan.splitlines() if " Exchange hashpartitioning" in line]
    assert len([s for s in shuffles if "_slice" in s]) == 1
    assert all("_start" in s or "_session" in s or "_inner" in s for s in shuffles if "_slice" not in s)


def test_no_plan_sorts_a_whole_source(spark):
    """Windows over packets are keyed by source and time slice."""
    df = packets(spark, [("a", 0.0, 1, True, "ACK")])
    plan = flows.sessionize(df)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Window [" in line and "lag(_at" in line]
    assert lines and all("_slice" in line for line in lines)


def stream_rows():
    rng = np.random.default_rng(11)
    rows = []
    for ip, n in (("hot", 400), ("b", 60)):
        times = np.cumsum(rng.choice([0.0, 0.4, 2.9, 3.5, 30.0], n))
        rows += [(ip, float(t), int(rng.integers(40, 900)), bool(rng.random() < 0.6),
                  str(rng.choice(["SYN", "ACK", "PSH"]))) for t in times]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 4))
    return rows


def stream_of(spark, folder, rows, size):
    for i in range(0, len(rows), size):
        part = packets(spark, rows[i:i + size]).coalesce(1)
        part.write.parquet(f"{folder}/part={i:04d}")
    return packet_stream(spark, f"{folder}/*", packets(spark, rows[:1]).schema, "parquet", maxFilesPerTrigger=1, latestFirst=False)


def flow_values(df, columns):
    return {
        (r["flow_id"], r["start_us"]): [v if isinstance(v, str) else pytest.approx(v, rel=1e-9, abs=1e-6) for v in list(r)[2:]]
        for r in df.select(*columns).collect()
    }


@pytest.mark.parametrize("bucket_seconds", [5, 120])
def test_stream_in_many_batches_equals_batch(spark, tmp_path, bucket_seconds):
    """Files arrive one by one, partly out of order; the watermark closes flows on the way, the rest is in the state."""
    rows, bucket = stream_rows(), bucket_seconds * flows.MICROS
    source = stream_of(spark, str(tmp_path / "in"), rows, 92)
    emitted, state = runs.drain_with_state(stream_flows(source, delay="60 seconds", bucket_us=bucket), "test-flows", conf=STATE_STORE)
    batch = flows.flow_table(packets(spark, rows))
    rest = open_flows(spark, state, bucket_us=bucket)
    whole = emitted.unionByName(rest)
    # neither part is the whole: a dead stream, or a flush that reads no state, would fail
    assert emitted.count() > batch.count() * 0.4 and rest.count() > 0
    got = flow_values(whole, batch.columns)
    want = {k: [getattr(x, "expected", x) for x in v] for k, v in flow_values(batch, batch.columns).items()}
    assert got.keys() == want.keys() and whole.count() == batch.count()
    for key, values in want.items():
        assert values == got[key]


def test_packets_become_the_same_runs_in_both_engines(spark):
    rows = some_rows(8, 120)
    bucket = 30 * flows.MICROS
    want = flows.runs(packets(spark, rows), slice_us=bucket).select("src_ip", *flows.RUN).toPandas()
    base = int(START.timestamp()) * flows.MICROS
    frame = pd.DataFrame([(ip, base + round(t * flows.MICROS), n, f, *[int(x == "_ack") for x in flows.FLAG_SUMS])
                          for ip, t, n, f, _ in rows], columns=["ip", "at", "length", "forward", *[x[1:] for x in flows.FLAG_SUMS]])
    parts = [packet_runs(g, 3 * flows.MICROS).assign(src_ip=ip) for (ip, _), g in frame.groupby(["ip", frame["at"] // bucket])]

    def table(df):
        return sorted(tuple(None if pd.isna(v) else v for v in row) for row in df[["src_ip", *flows.RUN]].itertuples(index=False))

    got = pd.concat(parts)
    assert table(got) == table(want)
    sessions = flows.merged(flows.runs(packets(spark, rows), slice_us=bucket)).select("src_ip", *flows.RUN).toPandas()
    again = pd.concat([merge_runs(g[flows.RUN].sample(frac=1, random_state=1), 3 * flows.MICROS).assign(src_ip=ip)
                       for ip, g in got.groupby("src_ip")])
    assert table(again) == table(sessions)
