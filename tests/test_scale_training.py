import numpy as np
import pytest

from wirelens.operators.ranking import exact_percentiles
from wirelens.plans import catalog_models, held_out, training


@pytest.mark.parametrize("module,name", [(held_out, "leave_one_out"), (training, "train")])
def test_generated_flows_are_written_before_they_are_trained_on(spark, sf_dir, monkeypatch, module, name):
    given = []
    monkeypatch.setattr(module, name, lambda raw, *args, **more: (given.append(raw), raw))
    query = {"leave_one_out": "leave_one_class_out", "train": "train_all"}[name]
    getattr(catalog_models, query)(spark, sf_dir)
    assert given[0].count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert all("synthetic-" in file for file in given[0].inputFiles())


def test_percentiles_read_their_rows_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(5)
    cells = [(float(a), float(b)) for a, b in zip(rng.normal(0, 1, 2000), rng.integers(0, 4, 2000), strict=True)]
    cells += [(None, float("inf")), (float("nan"), -float("inf"))]
    df = spark.createDataFrame(cells, "a double, b double").mapInArrow(counted, "a double, b double")
    found = {(r.feature, r.share): r.value for r in exact_percentiles(df, ["a", "b"], [0.25, 0.5], accuracy=100).collect()}
    assert read.value == 2 * len(cells)
    for i, name in enumerate("ab"):
        values = np.array([c[i] for c in cells if c[i] is not None and c[i] == c[i]])
        for share in (0.25, 0.5):
            assert found[name, share] == pytest.approx(np.percentile(values, share * 100), abs=1e-12)
