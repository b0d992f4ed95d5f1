"""Exact search: ties, repeated rows, and near-equal distances against a plain version."""

import numpy as np
import pytest

from hindsight.operators import nearest


def plain(queries, rows, k):
    out = []
    for i, x in queries:
        d = sorted((round(float(np.sqrt(((np.array(x) - np.array(y)) ** 2).mean())), 6), j) for j, y in rows if j != i)
        out += [(i, j, v, r + 1) for r, (v, j) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "shard_rows": 50}])
def test_nearest_is_brute_force(spark, sizes):
    g = np.random.default_rng(1)
    rows = [(int(i), [0.25, 0.5, 0.125]) for i in g.permutation(300)]  # 300 equal vectors
    rows += [(1000 + i, (np.array([0.3, 0.5, 0.1]) + 1e-7 * g.normal(size=3)).tolist()) for i in range(100)]  # distances equal to six places
    rows += [(2000 + i, (1e4 + g.normal(size=3)).tolist()) for i in range(60)]  # large vectors, near each other
    rows += [(3000 + i, g.normal(size=3).tolist()) for i in range(60)]
    queries = [r for r in rows if r[0] % 9 == 0]
    df = lambda r: spark.createDataFrame(r, "id long, x array<double>")
    got = sorted((r.query_id, r.row_id, r.distance, r["rank"]) for r in nearest.nearest(df(queries), df(rows), 5, **sizes).collect())
    want = plain(queries, rows, 5)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1.1e-6)


def test_fewer_rows_than_asked_for(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, x array<double>")
    assert sorted((r.query_id, r.row_id) for r in nearest.nearest(rows, rows, 5).collect()) == [(1, 2), (2, 1)]


def test_trajectories_of_other_horizons(spark):
    """Stats, horizons, the time that parts memory from forecasts and what counts as high are parameters."""
    t = spark.createDataFrame([(i, i % 3, i * 100, i * 100 - 10) for i in range(40)], "event_id long, pid long, t long, cutoff long")
    o = spark.createDataFrame([(1000 + i, i % 3, "a", float(i % 7), i * 50, i * 50) for i in range(100)], "event_id long, pid long, stat string, value double, t long, avail long")
    cases = nearest.trajectory_cases(t, o, stats=("a", "b"), horizons=(100, 300))
    assert {"f1", "f2", "s1", "s2"} <= set(cases.columns) and "f3" not in cases.columns
    out = nearest.trajectories(cases, split=2000, high_from=3, k=4).collect()
    assert {r.h for r in out} == {1, 2} and all(0 <= r.p_high <= 1 and r.p10 <= r.expected <= r.p90 for r in out)


def test_a_query_meets_few_cells(spark, monkeypatch):
    """Queries go on to the cells within reach only, and of equal vectors no more stay than can be asked for."""
    g, kept = np.random.default_rng(2), {}
    stored = nearest.stored

    def keep(df, name):
        kept[name] = stored(df, name)
        return kept[name]

    monkeypatch.setattr(nearest, "stored", keep)
    rows = [(i, g.random(2).tolist()) for i in range(4000)] + [(5000 + i, [0.5, 0.5]) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    asked = df.where("id % 10 = 0")
    got = nearest.nearest(asked, df, 3, shard_rows=50).collect()
    assert len(got) == 3 * asked.count()
    assert kept["rows"].count() == 4004
    assert kept["others"].count() < 8 * asked.count()
