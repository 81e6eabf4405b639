import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, normalised

# a cross-section; check.py compares every registered query
CHOSEN = [
    "flow_features", "clean_impute", "clean_stats", "json_records", "label_unseen_to_benign",
    "stratified_split", "replay_batch", "anova_f", "kernel_symmetric", "top_deviations",
    "fused_alerts", "classification_report", "alert_cooldown", "tiered_scoring",
    "stream_cooldown", "stream_history", "stream_stats", "alert_sink",
]


@pytest.fixture(scope="module")
def db(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, sf_dir, db, name):
    got = queries()[name](spark, sf_dir).toPandas()
    want = db.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalised(got) == normalised(want)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 90


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["flow_id", "start_us", "rank", "feature", "observed", "mean", "z"]
    assert rows.count() > 100
