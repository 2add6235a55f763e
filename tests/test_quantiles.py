"""Quantiles by brackets against NumPy."""

import numpy as np
import pytest

from chargelens.operators.quantiles import group_quantiles

WANTED = {"low": 0.0, "p1": 0.01, "p50": 0.5, "p995": 0.995, "top": 1.0}


@pytest.mark.parametrize("accuracy", [40, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    """Groups above and below the accuracy; a value that most of a group shares; nulls; a null key."""
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=3000), "b": np.where(rng.random(2500) < 0.9, 7.0, rng.random(2500) * 20), "c": np.array([3.0]), None: rng.integers(0, 5, 400).astype(float), "d": np.full(700, -1.5)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r for r in group_quantiles(df, ["k"], "v", WANTED, mean="mean", accuracy=accuracy).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k].n == len(x)
        assert abs(got[k]["mean"] - x.mean()) < 1e-9
        for name, q in WANTED.items():
            assert abs(got[k][name] - np.quantile(x, q)) < 1e-12, (k, name)


def test_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([(float(x),) for x in range(10)], "v double")
    assert [tuple(r) for r in group_quantiles(df, [], "v", {"m": 0.5}).collect()] == [(10, 4.5)]
    assert group_quantiles(df.limit(0), [], "v", {"m": 0.5}).collect() == []
    assert group_quantiles(df.where("v > 100").selectExpr("v", "1 AS k"), ["k"], "v", {"m": 0.5}).collect() == []
