"""Exact quantiles by refined ranges against numpy; the drift and context queries have SQL."""

import numpy as np
import pandas as pd
import pytest

from hindsight.operators import selection


@pytest.mark.parametrize(("limit", "bins"), [(100_000, 1024), (10, 4), (1, 2)])
def test_quantiles_are_exact(spark, limit, bins):
    g = np.random.default_rng(1)
    groups = {
        "hot": g.normal(size=3000),
        "ties": g.choice([1.0, 1.0, 1.0, 2.0, -5.0], 800),
        "wide": np.concatenate([g.normal(size=200) * 1e-300, g.normal(size=100) * 1e300, [1.7e308, -1.7e308]]),
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
        None: g.exponential(size=60),
    }
    df = pd.DataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("one", None), ("gone", None), ("two", float("nan"))], columns=["k", "v"])
    rows = spark.createDataFrame(list(df.itertuples(index=False, name=None)), "k string, v double").repartition(6)
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r.k: r for r in selection.quantiles(rows, ["k"], "v", at, limit, bins).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k].n == len(x)
        assert [got[k][f"q{i}"] for i in range(len(at))] == pytest.approx(list(np.quantile(x, at)), rel=1e-9)


def test_one_group_and_no_rows(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    (r,) = selection.quantiles(rows, [], "v", (0.5, 0.333), limit=7, bins=3).collect()
    assert (r.n, r.q0, round(r.q1, 9)) == (101, 50.0, 33.3)
    assert selection.quantiles(rows.limit(0), [], "v", (0.5,)).count() == 0


def test_discrepancy_of_equal_and_moved_samples():
    g = np.random.default_rng(2)
    a, b = g.normal(size=(96, 3)), g.normal(size=(96, 3))
    assert selection.mean_discrepancy(a, a) == pytest.approx(0, abs=1e-12)
    assert 0 < selection.mean_discrepancy(a, b) < 0.05 < selection.mean_discrepancy(a, b + 2)
    assert selection.mean_discrepancy(np.zeros((5, 2)), np.zeros((4, 2))) == 0
