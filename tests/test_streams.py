"""Streaming cooldown, counters and history over several batches, out of order and replayed."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wirelens.operators import alerts as A
from wirelens.streaming import alerts as SA
from wirelens.streaming import runs
from wirelens.streaming.flows import STATE_STORE
from wirelens.streaming.snapshots import Snapshots

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = ("flow_key string, ts timestamp, severity string, attack_category string, is_novel_anomaly boolean, risk_score double, "
          "source_ip string, destination_port int")


def alerts(n=240, seed=3):
    draw, at, rows = random.Random(seed), 0.0, []
    for i in range(n):
        at += draw.choice([0.0, 0.0, 1.0, 4.0, 9.5, 30.0])
        rows.append((f"f{i:04d}", START + timedelta(seconds=at), draw.choice(["LOW", "HIGH", "HIGH", "CRITICAL"]),
                     draw.choice(["DDoS", "PortScan"]), draw.random() < 0.05, 10.0 + i % 90, f"10.0.0.{i % 7}", 80))
    return rows


def brute_kept(rows, gap):
    last, kept = {}, set()
    eligible = [r for r in rows if r[2] in ("MEDIUM", "HIGH", "CRITICAL") or r[4]]
    for r in sorted(eligible, key=lambda r: (r[1], r[0])):
        key = f"{r[2]}_{r[3]}"
        if key not in last or (r[1] - last[key]).total_seconds() >= gap:
            last[key] = r[1]
            kept.add(r[0])
    return kept


@pytest.mark.parametrize("files", [1, 5])
def test_cooldown_of_a_stream_keeps_whole_rows(spark, tmp_path, files):
    rows = alerts()
    arrival = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=random.Random(r[0]).uniform(0, 8)), r[0]))
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(arrival[i * size:(i + 1) * size], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    source = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")))
    keyed = SA.cooldown_keyed(source)
    kept, state = runs.drain_with_state(
        SA.stream_kept(keyed, "cooldown_key", "ts", 20_000_000, "flow_key", "30 seconds"), "test-kept", conf=STATE_STORE)
    rest = SA.pending_kept(spark, state, keyed.schema, 20_000_000)
    want = brute_kept(rows, 20)
    assert {r.flow_key for r in kept.collect()} | {r.flow_key for r in rest.collect()} == want
    assert kept.count() + rest.count() == len(want) and rest.count() > 0 and (files == 1 or kept.count() > len(want) / 2)
    batch = A.cooled_down(spark.createDataFrame(rows, SCHEMA).withColumn("at", F.unix_micros("ts")), "at", 20_000_000, ["flow_key"])
    notes = {tuple(r) for r in A.notifications(kept.unionByName(rest), ["flow_key"]).collect()}
    assert notes == {tuple(r) for r in A.notifications(batch, ["flow_key"]).collect()} and len(notes) == len(want)


def scored(spark, low, high):
    return spark.range(low, high).select(
        F.concat(F.lit("k"), F.format_string("%04d", "id")).alias("flow_key"),
        F.when(F.col("id") % 3 == 0, "TIER_1_FAST_SCREENING").otherwise("TIER_2").alias("tier_used"),
        F.when(F.col("id") % 5 == 0, "ATTACK").otherwise("NORMAL").alias("status"), (F.col("id") % 11 == 0).alias("is_novel_anomaly"),
        (F.col("id") % 100).cast("double").alias("risk_score"), (F.col("id") * 7 % 50).alias("at"))


def test_counters_between_and_behind_batches(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "c"), SA.COUNTERS)
    write = SA.counters_writer(spark, str(tmp_path / "c"))
    assert table.read().count() == 0
    write(scored(spark, 0, 40), 0)
    reader = table.read()  # a reader of the version that the next batch replaces
    write(scored(spark, 40, 100), 1)
    assert reader.head().flows_analyzed == 40
    whole = A.monitor_statistics(scored(spark, 0, 100)).head()
    assert A.with_cleared_percent(table.read()).head() == whole
    write(scored(spark, 40, 100), 1)  # a batch that runs again
    write(scored(spark, 0, 40), 0)
    assert A.with_cleared_percent(table.read()).head() == whole
    write(scored(spark, 100, 101), 2)
    assert table.read().head().flows_analyzed == 101 and table.versions() == [1, 2]
    # a version that was not finished is not read and is written anew
    (tmp_path / "c" / "version-3").mkdir()
    assert table.read().head().flows_analyzed == 101
    write(scored(spark, 101, 103), 3)
    assert table.read().head().flows_analyzed == 103


def test_history_is_the_newest_by_time(spark, tmp_path):
    schema = "flow_key string, risk_score double, at long"
    write = SA.history_writer(spark, str(tmp_path / "h"), schema, [F.col("at").desc(), F.col("flow_key").desc()], 7)
    parts = [scored(spark, a, a + 50).select("flow_key", "risk_score", "at") for a in (100, 0, 50)]
    for i, part in enumerate(parts):
        write(part, i)
        write(part, i)
    rows = [tuple(r) for part in parts for r in part.collect() if r.risk_score >= 60]
    want = sorted(rows, key=lambda r: (r[2], r[0]), reverse=True)[:7]
    got = [tuple(r) for r in Snapshots(spark, str(tmp_path / "h"), schema).read().collect()]
    assert sorted(got) == sorted(want)
