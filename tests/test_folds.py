"""Chronological refits against plain NumPy versions, and that later labels change no earlier row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from hindsight.operators import folds
from hindsight.sources.roles import predictions

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def matrix(spark):
    return predictions(spark, SF).toPandas().sort_values(["sport", "seq"]).reset_index(drop=True)


def regression(x, y, w, c, linear=False, scaled=True):
    """Slopes, intercept and scaling of a penalised regression, by Newton's method on all rows."""
    mean, std = (x.mean(0), x.std(0)) if scaled else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    std = np.where(std > 0, std, 1)
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    penalty = np.diag([*np.ones(x.shape[1]), 0.0])
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = z @ b if linear else 1 / (1 + np.exp(-(z @ b)))
        v = w if linear else w * p * (1 - p)
        b = b - np.linalg.solve(c * (z.T * v) @ z + penalty, c * z.T @ (w * (p - y)) + penalty @ b)
    return lambda q: (lambda u: u if linear else 1 / (1 + np.exp(-u)))(np.column_stack([(q - mean) / std, np.ones(len(q))]) @ b)


def test_fits_of_all_folds_and_models_are_plain_fits(spark):
    g = np.random.default_rng(1)
    n = 900
    key = g.choice(["a", "b", None], n, p=[0.8, 0.15, 0.05])  # one key holds most rows
    x = g.normal(size=(n, 2)) * [1, 30] + [0, 100]
    y = (g.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    miss = np.where(g.random(n) < 0.3, np.nan, x[:, 0])
    df = pd.DataFrame({"key": key, "x1": x[:, 0], "x2": x[:, 1], "m": miss, "y": y, "w": g.random(n), "train": g.integers(0, 8, n), "fold": g.integers(0, 4, n)})
    rows = spark.createDataFrame(df.astype(object).where(df.notna(), None), "key string, x1 double, x2 double, m double, y int, w double, train long, fold int").repartition(5)
    models = {"both": folds.Model(("x1", "x2")), "weighted": folds.Model(("x1",), c=2.0, weight="w", scaled=False), "gaps": folds.Model(("m", "x2"), missing=True), "line": folds.Model(("x1", "x2"), target="w", linear=True)}
    got = folds.scored(rows, "key", models, folds.fitted(rows, "key", models)).toPandas()
    assert len(got) == n
    for (k, fold), part in got.groupby(["key", "fold"], dropna=False):
        t = df[((df.key == k) | (pd.isna(k) & df.key.isna())) & ((df.train.to_numpy() >> fold & 1) == 1)]
        if fold == 3:  # nothing trains it
            assert part[list(models)].isna().all().all()
            continue
        one = np.ones(len(t))
        fill = lambda f: np.column_stack([f.m.fillna(t.m.mean()), f.x2, f.m.isna(), np.zeros(len(f))])  # noqa: B023, E731
        want = {
            "both": regression(t[["x1", "x2"]].to_numpy(), t.y, one, 0.25)(part[["x1", "x2"]].to_numpy()),
            "weighted": regression(t[["x1"]].to_numpy(), t.y, t.w.to_numpy(), 2.0, scaled=False)(part[["x1"]].to_numpy()),
            "gaps": regression(fill(t), t.y, one, 0.25)(fill(part)),
            "line": regression(t[["x1", "x2"]].to_numpy(), t.w, one, 0.25, linear=True)(part[["x1", "x2"]].to_numpy()),
        }
        for name, v in want.items():
            assert part[name].to_numpy() == pytest.approx(np.asarray(v), abs=1e-6), name


def test_part_of_is_array_split(spark):
    for n in (1, 2, 7, 9, 100, 101, 119):
        for parts in (2, 3, 5):
            want = [k for k, p in enumerate(np.array_split(np.arange(n), parts)) for _ in p]
            got = spark.range(1, n + 1).select(folds.part_of(F.col("id"), F.lit(n), parts).alias("k"), "id").orderBy("id").collect()
            assert [r.k for r in got] == want


def rising(x, y):
    """Isotonic means by the max-min formula."""
    order = np.argsort(x, kind="stable")
    xs, back = np.unique(x[order], return_inverse=True)
    s, n = np.bincount(back, y[order]), np.bincount(back)
    cs, cn = np.concatenate([[0], np.cumsum(s)]), np.concatenate([[0], np.cumsum(n)])
    m = [max(min((cs[k + 1] - cs[j]) / (cn[k + 1] - cn[j]) for k in range(i, len(xs))) for j in range(i + 1)) for i in range(len(xs))]
    return xs, np.clip(m, 1e-6, 1 - 1e-6)


@pytest.mark.parametrize("bins", [1, 7, 256])
def test_isotonic_is_the_max_min_formula(spark, bins):
    g = np.random.default_rng(2)
    x = np.round(g.random(400), 2)
    y = (g.random(400) < x**2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 400 + ["few"] * 100, "x": [*x, *x[:100]], "y": [*y, *y[:100]]}))
    (r,) = folds.isotonic(df, ["k"], bins).collect()
    xs, m = rising(x, y)
    assert r.k == "a" and np.interp(xs, r.xs, r.ys) == pytest.approx(m, abs=1e-9)


def score(y, p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    bins = np.minimum(np.floor(p * 10), 9)
    return (-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(), ((p - y) ** 2).mean(), sum(abs((y - p)[bins == b].sum()) for b in range(10)) / len(y))


def test_c1_is_plain(spark, matrix):
    """Expanding blocks, four methods, the objective and the gate."""
    got = folds.c1(spark, SF).toPandas()
    assert set(got.status) == {"EVALUATED"}
    for sport, f in matrix.groupby("sport"):
        y, p, n = f.y.to_numpy(), np.clip(f.p1.to_numpy(), 1e-6, 1 - 1e-6), len(f)
        ends = [min(n - 30, max(m, int(n * q))) for q, m in ((0.5, 60), (0.67, 90), (0.8, 120))]
        scores = {m: [] for m in folds.METHODS}
        for a, b in zip(ends, [*ends[1:], n], strict=True):
            z = np.log(p / (1 - p))[:, None]
            two, one = np.column_stack([np.log(p), np.log(1 - p)]), np.ones(a)
            xs, m = rising(p[:a], y[:a])
            each = {"none": p[a:b], "sigmoid": regression(z[:a], y[:a], one, 0.25, scaled=False)(z[a:b]), "beta": regression(two[:a], y[:a], one, 0.25, scaled=False)(two[a:b]), "isotonic": np.interp(p[a:b], xs, m)}
            for k, v in each.items():
                scores[k].append(score(y[a:b], v))
        mean = {k: np.mean(v, axis=0) for k, v in scores.items()}
        objective = {k: mean[k][0] + 0.05 * np.std([x[0] for x in v], ddof=1) for k, v in scores.items()}
        best = min(objective, key=lambda k: (objective[k], *mean[k][1:]))
        raw = mean["none"]
        passed = best != "none" and mean[best][0] <= raw[0] - max(0.001, 0.003 * raw[0]) and mean[best][1] <= raw[1] + 0.002 and mean[best][2] <= raw[2] + 0.01
        for r in got[got.sport == sport].itertuples():
            assert [r.logloss, r.brier, r.ece, r.objective] == pytest.approx([*mean[r.method], objective[r.method]], abs=6e-5)
            assert r.folds == 3 and r.chosen == (r.method == best and passed)


def test_v12_forecast_is_plain(spark, matrix):
    got = folds.v12_forecast(spark, SF).toPandas()
    for sport, f in matrix.groupby("sport"):
        q = f[["p1", "p2", "p3"]].to_numpy()
        m, y = q.mean(1), f.y.to_numpy()
        gap = q.std(1)
        ll = -np.where(y == 1, np.log(m), np.log(1 - m))
        future = np.array([ll[i + 1 : i + 6].mean() for i in range(len(f) - 5)])
        x = np.column_stack([2 * abs(m - 0.5), gap, -(m * np.log2(m) + (1 - m) * np.log2(1 - m)), np.abs(np.diff(m, prepend=m[0])), [gap[max(0, i - 4) : i + 1].mean() for i in range(len(f))]])[:-5]
        hard = (np.round(future, 9) > np.round(np.quantile(future, 0.6), 9)).astype(int)
        parts = np.array_split(np.arange(len(x)), 3)
        for k in (1, 2):
            tr, te = np.concatenate(parts[:k]), parts[k]
            want = score(hard[te], regression(x[tr], hard[tr], np.ones(len(tr)), 0.25)(x[te]))
            (r,) = got[(got.sport == sport) & (got.fold == k)].itertuples()
            assert (r.n, r.ones) == (len(te), hard[te].sum()) and [r.logloss, r.brier, r.ece] == pytest.approx(want, abs=6e-5)


def plain_walk(f, first):
    """(fold, trains) of each row of a sport: by whole numbers, as the definition says."""
    n = len(f)
    sel = max(60, int(n * 0.78))
    start = max(80, int(sel * first))
    step = max(80, -(-(sel - start) // 12))
    ends = list(range(start, sel, step))
    fold = np.full(n, -1)
    for k, a in enumerate(ends):
        fold[a : min(a + step, sel)] = k
    fold[sel:] = len(ends)
    return fold, len(ends)


def test_r19_is_plain(spark, matrix):
    """Both levels by hand: what a fold learns from is earlier, out of fold and mature."""
    rows = predictions(spark, SF)
    got = folds.stacked(rows, first=0.4).toPandas()
    day = 86_400_000_000
    for sport, f in list(matrix.groupby("sport"))[:2]:
        f = f.reset_index(drop=True)
        fold, last = plain_walk(f, 0.4)
        mature = np.maximum(f.t + day, f.avail).to_numpy()
        begins = [f.t[fold == k].min() for k in range(last + 1)]
        x = np.log(f[["p1", "p2"]].to_numpy() / (1 - f[["p1", "p2"]].to_numpy()))
        y, base, stack = f.y.to_numpy(), np.full(len(f), np.nan), np.full(len(f), np.nan)
        for k in range(last + 1):
            learn = (fold < k) & (mature <= begins[k])
            base[fold == k] = regression(x[learn], y[learn], np.ones(learn.sum()), 0.25)(x[fold == k])
        seen = (f.match_id % 4 != 0).to_numpy()
        late = np.column_stack([np.where(seen, x[:, 1] - x[:, 0], np.nan), np.where(seen, f.t // 3_600_000_000 % 24 / 24, np.nan)])
        z = np.column_stack([np.log(base / (1 - base)), late])
        for k in range(last + 1):
            learn = (fold >= 0) & (fold < k) & (mature <= begins[k])
            if learn.sum() >= 240:
                full = lambda v: np.hstack([np.where(np.isnan(v), np.nanmean(z[learn], axis=0), v), np.isnan(v)])  # noqa: B023, E731
                stack[fold == k] = regression(full(z[learn]), y[learn], np.ones(learn.sum()), 0.25)(full(z[fold == k]))
        r = got[got.sport == sport].sort_values("seq")
        at = r.seq.to_numpy() - 1
        assert (at == np.flatnonzero(fold >= 0)).all() and (r.fold.to_numpy() == fold[at]).all()
        assert r.base.to_numpy() == pytest.approx(base[at], abs=1e-6)
        assert (r.enabled.to_numpy() == ~np.isnan(stack[at])).all() and r.enabled.any() and not r.enabled.all()
        assert r.stacked.to_numpy() == pytest.approx(np.where(np.isnan(stack), base, stack)[at], abs=1e-6)


def test_later_labels_change_no_earlier_row(spark):
    rows = predictions(spark, SF).where("sport IN ('click', 'view')")
    flipped = rows.withColumn("y", F.when(F.col("seq") > 600, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = (folds.stacked(x, first=0.4).where("fold <= 3").toPandas().sort_values("match_id") for x in (rows, flipped))
    assert a.seq.max() <= 632 and (a.stacked.to_numpy() == pytest.approx(b.stacked.to_numpy(), abs=1e-12))
    a, b = (folds.fused(folds.routed(x)).where("fold <= 3").toPandas().sort_values("match_id") for x in (rows, flipped))
    assert a.routed.to_numpy() == pytest.approx(b.routed.to_numpy(), abs=1e-12)


def test_r20_learns_which_expert_helps(spark):
    """With an expert that knows, the route gains in every fold that has learnt; with none that differ, it stays."""
    g = np.random.default_rng(4)
    n = 1200
    y = g.integers(0, 2, n)
    good = np.clip(0.5 + (y - 0.5) * 0.6 + g.normal(0, 0.1, n), 0.05, 0.95)
    df = pd.DataFrame({"sport": "s", "match_id": np.arange(n), "seq": np.arange(1, n + 1), "t": np.arange(n) * 10**9, "avail": 0, "y": y, "p1": g.uniform(0.3, 0.7, n), "p2": g.uniform(0.3, 0.7, n), "p3": good})
    df["t"] = df.t * 100
    x = folds.fused(folds.routed(spark.createDataFrame(df).withColumns({"seq": F.col("seq").cast("int"), "a": F.col("match_id")}))).toPandas()
    loss = lambda p: -np.where(x.y == 1, np.log(p), np.log(1 - p))
    gain = pd.Series(loss(x.fixed) - loss(x.routed)).groupby(x.fold).mean()
    learnt = x.groupby("fold")["loss_0"].apply(lambda v: v.notna().all())
    assert learnt.any() and (gain[learnt] > 0.03).all() and (gain[~learnt] == 0).all()


def test_l1_works_once_the_session_has_observed_something(spark):
    """A fitted model's summary holds the session, which can't be sent to tasks once it has an observation."""
    seen = Observation()
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 5
    out = folds.l1(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 5 * 6 and all(0 <= r.accuracy <= 1 for r in out)
