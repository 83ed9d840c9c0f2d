"""Token-budget batches: bounded padding, whole results, order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnloom.operators import batching
from turnloom.plans.evaluation import apply_model


def test_packs_stay_within_the_budget_and_pad_less_than_fixed_batches():
    draw = np.random.default_rng(1)
    lengths = np.concatenate([draw.integers(1, 60, 900), draw.integers(500, 2000, 60), [9000, 0, 0]])
    draw.shuffle(lengths)
    packed = batching.pack(lengths, 4096, 64)
    assert sorted(np.concatenate(packed)) == list(range(len(lengths)))
    for places in packed:
        assert len(places) <= 64
        assert len(places) == 1 or len(places) * lengths[places].max() <= 4096
    fixed = np.array_split(np.arange(len(lengths)), -(-len(lengths) // 16))
    assert batching.padding(lengths, packed) < 0.1 < 0.5 < batching.padding(lengths, fixed)
    assert batching.pack(np.array([], int), 10) == []


@pytest.mark.parametrize("budget", [1, 50, 100_000])
def test_a_model_gives_the_same_results_with_and_without_a_budget(spark, budget):
    rows = spark.range(500).select("id", (F.col("id") * 7919 % 97).alias("size")).repartition(5)
    seen = {"rows": 0}

    def load():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            assert len(batch) == 1 or len(batch) * max(1, batch["size"].max()) <= budget
            return pd.DataFrame({"id": batch["id"], "out": batch["id"] * 3 + batch["size"]})
        return model

    def plain():
        return lambda batch: pd.DataFrame({"id": batch["id"], "out": batch["id"] * 3 + batch["size"]})

    found = apply_model(rows, load, "id long, out long", 32, "size", budget).collect()
    assert found == apply_model(rows, plain, "id long, out long", 32).collect() and seen["rows"] == 0
    for wrong in ((0, "size", 5), (8, None, 5), (8, "size", 0)):
        with pytest.raises(ValueError):
            apply_model(rows, plain, "id long, out long", *wrong)


def test_a_model_that_loses_rows_is_refused(spark):
    with pytest.raises(Exception, match="one result per row"):
        apply_model(spark.range(9).withColumn("size", F.lit(1)), lambda: lambda b: b[["id"]].iloc[1:], "id long", 4, "size", 8).collect()


def test_batches_of_a_table(spark):
    lengths = [1, 2, 3, 15, 16, 17, 18, 31, 32, 33, 34, 1000, 1023, 1025, 70_000, 0] * 20
    rows = spark.createDataFrame(list(enumerate(lengths)), "i long, n long").repartition(4)
    batched = batching.token_batches(rows, F.col("n"), "i", 2048)
    groups = {}
    for r in batched.collect():
        assert r["n"] <= r["padded"] < max(2, r["n"]) * 1.125 + 1
        groups.setdefault((r["padded"], r["batch"]), []).append((r["i"], r["n"]))
    for (padded, _), members in groups.items():
        assert len(members) == 1 or len(members) * padded <= 2048
    for padded in {p for p, _ in groups}:
        order = [i for b in sorted(b for p, b in groups if p == padded) for i, _ in sorted(groups[padded, b])]
        assert order == sorted(order)
    report = {r["padded"]: r for r in batching.batch_report(batched, "n").collect()}
    assert sum(r["rows"] for r in report.values()) == len(lengths) and report[70656 if 70656 in report else max(report)]["batches"] == 20
