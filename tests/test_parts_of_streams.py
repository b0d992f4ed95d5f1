"""Folds over a sport's stream give the same rows however finely the stream is cut into parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsight.operators import sequential


@pytest.fixture(scope="module")
def given():
    """Rows whose labels mature out of order, some at one time."""
    g = np.random.default_rng(3)
    return [(s, 1000 * k + i, i + 1, t := int(i // 3 * 10), t + int(g.integers(1, 400)), int(g.random() < 0.4), float(np.round(g.random(), 3)), np.round(g.random(2), 1).tolist()) for k, s in enumerate("ab") for i in range(300 + 90 * k)]


def frame(spark, given):
    return spark.createDataFrame(given, "sport string, match_id long, seq int, t long, mature long, y int, p double, x array<double>")


def pool(given, row, last, most=10**9):
    """The newest rows of a sport that are mature at a row's time and before it."""
    old = [r for r in given if r[0] == row[0] and r[4] <= row[3] and r[3] < row[3] and r[2] <= most]
    return sorted(old, key=lambda r: (r[3], r[1]))[-last:]


@pytest.mark.parametrize("part_rows", [17, 20_000])
def test_local_sets(spark, given, part_rows):
    want = []
    for r in given:
        held = pool(given, r, 25)
        if len(held) < 12:
            want.append((r[1], len(held), None, None, None, "ABSTAIN"))
            continue
        z = np.array([h[7] for h in held])
        d = np.round(np.sqrt((((z - np.array(r[7])) / z.std(axis=0)) ** 2).mean(axis=1)), 9)
        near = np.argsort(d, kind="stable")[:15]
        score = np.array([1 - held[j][6] if held[j][5] == 1 else held[j][6] for j in near])
        p0, p1 = ((1 + (score >= v - 1e-12).sum()) / (len(near) + 1) for v in (r[6], 1 - r[6]))
        want.append((r[1], len(held), round(float(d[near[0]]), 6), round(float(p0), 6), round(float(p1), 6), ("ABSTAIN", "SINGLE", "SET")[int(p0 > 0.1) + int(p1 > 0.1)]))
    got = sequential.local_sets(frame(spark, given), least=12, last=25, k=15, part_rows=part_rows).collect()
    assert sorted((r.match_id, r.pool, *(None if v is None else round(v, 6) for v in (r.nearest, r.p0, r.p1)), r.kind) for r in got) == sorted(want)


@pytest.mark.parametrize("part_rows", [17, 20_000])
def test_frozen_calibration(spark, given, part_rows):
    want, frozen = {}, {}
    for r in given:
        cut = int((300 if r[0] == "a" else 390) * 0.7)
        held = pool(given, r, 60, cut)
        x, y = np.array([h[6] for h in held]), np.array([h[5] for h in held], float)
        if len(held) >= 30 and 0 < y.sum() < len(y):
            a, b = sequential.platt(x[None], y[None], np.ones((1, len(x)), bool))
            fit = (len(held), "FITTED", a[0], b[0])
        else:
            fit = (len(held), "PRIOR", 0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        if r[2] > cut:
            fit = frozen.setdefault(r[0], fit)
        want[r[1]] = (*fit[:2], 1 / (1 + np.exp(-(fit[2] * r[6] + fit[3]))))
    rows = frame(spark, given).withColumns({"x": F.col("p"), "right": F.col("y"), "n": F.when(F.col("sport") == "a", 300).otherwise(390)})
    got = {r.match_id: (r.rows, r.state, r.p) for r in sequential.frozen_calibration(rows, least=30, last=60, part_rows=part_rows).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][:2] == want[i][:2] and got[i][2] == pytest.approx(want[i][2], abs=1e-9) for i in want)


def test_no_part_holds_a_sport(spark, given):
    """A part has its rows and a pool, which is what every earlier row leaves."""
    stream = sequential.matured(frame(spark, given), "p")
    parts = sequential.pooled(stream, 25, 50).groupBy("sport", "part").agg(F.count_if(F.col("kind") >= 0).alias("n"), F.count_if(F.col("kind") < 0).alias("lead")).collect()
    assert len(parts) > 20 and all(r.n <= 50 and r.lead <= 25 for r in parts)
