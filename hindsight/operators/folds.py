"""Chronological refits: all folds and all models are fitted together, by sums over the rows.

A row says by the bits of `train` which folds learn from it, and by `fold` which one it is scored by. One
pass over the rows gives, for every (key, fold, model), the sums that a Newton step needs; they are added up
in the tasks, then in Spark, and the driver solves systems of a few unknowns. So a fit has no group of rows
in one task, however unevenly keys are spread, no loop over folds or models, and no lineage that grows.

Passed through the driver are (unknowns + 1)**2 numbers for each key, fold and model; keys are segments
such as sports, folds at most 62.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.catalog import query
from ..sources.roles import predictions
from ..sources.work import stored, work_dir
from .predicates import brier, log_loss
from .sequential import maturing, weighted_replicates
from .windows import overlapping, part_of, sized

EPS = 1e-6


@dataclass(frozen=True)
class Model:
    """A regression on columns x: logistic, or linear. Its penalty is half the squared slopes against c times the losses.

    scaled: columns are standardised by the fold's own training rows. missing: a null column takes its
    mean there, and an indicator column is added.
    """

    x: tuple[str, ...]
    c: float = 0.25
    scaled: bool = True
    missing: bool = False
    target: str = "y"
    weight: str | None = None
    linear: bool = False


def _columns(b: pa.RecordBatch, m: Model) -> np.ndarray:
    x = np.column_stack([np.asarray(b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in m.x])
    return np.hstack([x, np.isnan(x).astype(float)]) if m.missing else x


@dataclass
class Fit:
    """One (key, fold, model): what it has learnt from, and its coefficients, the intercept last."""

    n: float
    ones: float
    mean: np.ndarray
    std: np.ndarray
    theta: np.ndarray
    loss: float = np.inf
    last: np.ndarray | None = None

    @property
    def usable(self) -> bool:
        return self.n > 0

    def design(self, x: np.ndarray) -> np.ndarray:
        z = (np.where(np.isnan(x), self.mean, x) - self.mean) / self.std
        return np.hstack([z, np.ones((len(z), 1))])

    def value(self, x: np.ndarray, linear: bool) -> np.ndarray:
        v = self.design(x) @ self.theta
        return v if linear else 1 / (1 + np.exp(-np.clip(v, -35, 35)))


Fits = dict[tuple, Fit]


def _sums(rows: DataFrame, key: str, models: Mapping[str, Model], of) -> dict[tuple, np.ndarray]:
    """The sums over the training rows of each (key, fold, model) of of(key, fold, model, columns, target, weight)."""
    used = list(dict.fromkeys(c for m in models.values() for c in (*m.x, m.target, *([m.weight] if m.weight else []))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            codes = b.column("_key").dictionary_encode("encode")
            names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            train = b.column("train").to_numpy(zero_copy_only=False)
            for name, m in models.items():
                x = _columns(b, m)
                y = np.asarray(b.column(m.target).cast(pa.float64()).to_numpy(zero_copy_only=False), float)
                w = np.asarray(b.column(m.weight).cast(pa.float64()).to_numpy(zero_copy_only=False), float) if m.weight else np.ones(len(y))
                for k, mask in set(zip(codes.tolist(), train.tolist(), strict=True)):
                    at = np.flatnonzero((codes == k) & (train == mask))
                    for fold in (f for f in range(int(mask).bit_length()) if mask >> f & 1):
                        s = of(names[k], fold, name, x[at], y[at], w[at])
                        if s is not None:
                            held[names[k], fold, name] = held[names[k], fold, name] + s if (names[k], fold, name) in held else s
        for (k, fold, name), s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(s), pa.string()), pa.array([fold] * len(s), pa.int32()), pa.array([name] * len(s)), pa.array(range(len(s)), pa.int32()), pa.array(s)], names=["k", "fold", "model", "at", "v"])

    parts = rows.where("train <> 0").select(F.col(key).cast("string").alias("_key"), "train", *used).mapInArrow(task, "k string, fold int, model string, at int, v double")
    out: dict[tuple, list] = {}
    for r in parts.groupBy("k", "fold", "model", "at").agg(F.sum("v").alias("v")).toArrow().sort_by("at").to_pylist():
        out.setdefault((r["k"], r["fold"], r["model"]), []).append(r["v"])
    return {k: np.array(v) for k, v in out.items()}


def fitted(rows: DataFrame, key: str, models: Mapping[str, Model], steps: int = 30, exact: float = 1e-9) -> Fits:
    """Fits of all (key, fold, model) from rows(key, train, ...), a written table, as each step reads it."""

    def first(k, fold, name, x, y, w):
        known = ~np.isnan(x)
        x = np.where(known, x, 0)
        return np.concatenate([[len(y), w.sum(), (y * w).sum()], known.sum(0), x.sum(0), (x * x).sum(0)])

    fits: Fits = {}
    for k, s in _sums(rows, key, models, first).items():
        m = models[k[2]]
        known, total, square = s[3:].reshape(3, -1)
        mean = total / np.maximum(known, 1)
        std = np.sqrt(np.maximum(square - mean * total, 0) / max(s[0], 1))
        std = np.where(std > 1e-12, std, 1.0) if m.scaled else np.ones(len(std))
        fits[k] = Fit(s[0], s[2], mean if m.scaled or m.missing else np.zeros(len(mean)), std, np.zeros(len(mean) + 1))

    def step(k, fold, name, x, y, w):
        if (k, fold, name) not in open_:
            return None
        f, linear = fits[k, fold, name], models[name].linear
        z, p = f.design(x), f.value(x, linear)
        v = w * (1.0 if linear else np.maximum(p * (1 - p), 1e-12))
        loss = 0.5 * (w * (p - y) ** 2).sum() if linear else (w * (np.logaddexp(0, z @ f.theta) - y * (z @ f.theta))).sum()
        return np.concatenate([[loss], z.T @ (w * (p - y)), ((z * v[:, None]).T @ z).ravel()])

    open_ = set(fits)
    for _ in range(steps):
        if not open_:
            break
        for k, s in _sums(rows, key, models, step).items():
            f, c, d = fits[k], models[k[2]].c, len(fits[k].theta)
            slopes = np.append(np.ones(d - 1), 0.0)
            loss = c * s[0] + 0.5 * (slopes * f.theta**2).sum()
            if f.last is not None and loss > f.loss + 1e-9 * abs(f.loss):
                f.theta = (f.theta + f.last) / 2  # the step was too long
                continue
            move = np.linalg.solve(c * s[d + 1 :].reshape(d, d) + np.diag(slopes + 1e-12), c * s[1 : d + 1] + slopes * f.theta)
            f.last, f.loss, f.theta = f.theta, loss, f.theta - move
            if np.abs(move).max() <= exact * (1 + np.abs(f.theta).max()):
                open_.discard(k)
    return fits


def scored(rows: DataFrame, key: str, models: Mapping[str, Model], fits: Fits) -> DataFrame:
    """rows with a column for each model: its value by the row's `fold`, null where that has learnt nothing (of a logistic model: both outcomes)."""
    sent = rows.sparkSession.sparkContext.broadcast(fits)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(name, T.DoubleType()) for name in models)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(key).cast(pa.string()).to_pylist()
            ids = pd.MultiIndex.from_arrays([k, b.column("fold").to_pylist()])
            codes, names = ids.factorize()
            out = []
            for name, m in models.items():
                x, v = _columns(b, m), np.full(b.num_rows, np.nan)
                for i, (group, fold) in enumerate(names):
                    f = sent.value.get((None if pd.isna(group) else group, None if pd.isna(fold) else int(fold), name))
                    if f is not None and (m.linear or 0 < f.ones < f.n):
                        v[codes == i] = f.value(x[codes == i], m.linear)
                out.append(pa.array(v, from_pandas=True))
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, *models])

    return rows.mapInArrow(task, schema)


def bit(fold: Column) -> Column:
    return F.pow(F.lit(2.0), fold).cast("long")


def bits_from(fold: Column, last: Column) -> Column:
    """The bits of folds fold .. last."""
    return bit(last + 1) - bit(fold)


def walk_forward(rows: DataFrame, holdout: float = 0.78, first: float = 0.7, least: int = 80, most_folds: int = 12) -> DataFrame:
    """rows(sport, seq, n) with train and fold of expanding folds: rows up to `first` of those before the holdout train all, then come blocks of at least `least` rows and at most most_folds of them, each scored by what's before; fold `last` learns from all before the holdout and scores that. A row of the first stretch has no fold."""
    sel = F.greatest(F.lit(60), F.floor(F.col("n") * holdout))
    start = F.greatest(F.lit(least), F.floor(sel * first))
    step = F.greatest(F.lit(least), F.ceil((sel - start) / most_folds))
    x = rows.withColumns({"sel": sel.cast("int"), "start": start.cast("int"), "step": step.cast("int")})
    x = x.withColumn("last", F.greatest(F.ceil((F.col("sel") - F.col("start")) / F.col("step")), F.lit(0)).cast("int"))
    i = F.col("seq") - 1
    own = F.floor((i - F.col("start")) / F.col("step")).cast("int")
    fold = F.when(i >= F.col("sel"), F.col("last")).when(i >= F.col("start"), own)
    train = F.when(i >= F.col("sel"), F.lit(0).cast("long")).when(i >= F.col("start"), bits_from(own + 1, F.col("last"))).otherwise(bits_from(F.lit(0), F.col("last")))
    return x.withColumns({"fold": fold.cast("int"), "train": train}).drop("step")


def matured_only(x: DataFrame) -> DataFrame:
    """x(sport, t, mature, train, fold, last) whose rows only train folds that start when their label is mature."""
    starts = x.where("fold IS NOT NULL").groupBy("sport", "fold").agg(F.min("t").alias("start")).groupBy("sport").agg(F.array_agg("start").alias("starts"))
    x = x.join(F.broadcast(starts), "sport", "left")
    late = F.size(F.filter(F.coalesce("starts", F.array().cast("array<bigint>")), lambda s: s < F.col("mature")))
    return x.withColumn("train", F.col("train").bitwiseAND(bits_from(F.least(late, F.col("last") + 1), F.col("last")))).drop("starts")


def every_sport(out: DataFrame, rows: DataFrame, done: str, short: str) -> DataFrame:
    """out with a status, and a row of it for each sport of rows that out lacks."""
    known = out.withColumn("status", F.lit(done))
    return rows.select("sport").distinct().join(known, "sport", "left").withColumn("status", F.coalesce("status", F.lit(short)))


def safe(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))


def logit(p: Column) -> Column:
    return F.ln(safe(p) / (1 - safe(p)))


def metrics(rows: DataFrame, by: list[str], p: str, y: str = "y") -> DataFrame:
    """(*by, n, ones, logloss, brier, ece, accuracy) of a probability; ece over ten equal bins."""
    x = rows.select(*by, F.col(y).alias("_y"), safe(F.col(p)).alias("_p"))
    bins = x.groupBy(*by, F.least(F.floor(F.col("_p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("m"), F.sum("_y").alias("ones"), F.sum("_p").alias("sp"), F.sum(log_loss(F.col("_p"), F.col("_y"), EPS)).alias("ll"), F.sum(brier(F.col("_p"), F.col("_y"))).alias("br"), F.sum(((F.col("_p") >= 0.5) == (F.col("_y") == 1)).cast("int")).alias("hit"))
    n = F.sum("m")
    return bins.groupBy(*by).agg(n.alias("n"), F.sum("ones").alias("ones"), (F.sum("ll") / n).alias("logloss"), (F.sum("br") / n).alias("brier"), (F.sum(F.abs(F.col("ones") - F.col("sp"))) / n).alias("ece"), (F.sum("hit") / n).alias("accuracy"))


# Candidate fits


CANDIDATES = {
    "pair": Model(("l1", "l2"), c=0.25),
    "strict": Model(("l1", "l2"), c=0.01),
    "decayed": Model(("l1", "l2"), c=0.25, weight="w"),
    "gaps": Model(("l1", "l2", "late"), c=0.25, missing=True),
}


@query("l3_parallel_fits")
def l3(spark, sf):
    """Every candidate in every expanding fold: out-of-fold metrics, and the holdout's as the last fold."""
    x = matured_only(walk_forward(sized(maturing(predictions(spark, sf))), first=0.4))
    x = x.withColumns({"l1": logit(F.col("p1")), "l2": logit(F.col("p2")), "late": F.when(F.col("match_id") % 5 != 0, logit(F.col("p2") * F.col("p1"))), "w": F.pow(F.lit(0.5), 2 * (1 - F.col("seq") / F.col("n")))})
    x = stored(x.select("sport", "match_id", "seq", "y", "train", "fold", "last", "l1", "l2", "late", "w"), "fits")
    out = scored(x.where("fold IS NOT NULL"), "sport", CANDIDATES, fitted(x, "sport", CANDIDATES))
    long = out.select("sport", "fold", (F.col("fold") == F.col("last")).alias("holdout"), "y", F.expr("stack(4, " + ", ".join(f"'{m}', {m}" for m in CANDIDATES) + ") AS (model, p)")).where("p IS NOT NULL")
    m = metrics(long, ["sport", "fold", "holdout", "model"], "p")
    return m.select("sport", "fold", "holdout", "model", "n", *(F.round(c, 5).alias(c) for c in ("logloss", "brier", "ece", "accuracy")))


# Model pool


LINEAR_POOL = {
    "logistic": Model(("p1", "p2", "p3"), c=1.0, missing=True, weight="w"),
    "strict": Model(("p1", "p2", "p3"), c=0.05, missing=True, weight="w"),
    "recent": Model(("p1", "p2", "p3"), c=1.0, missing=True, weight="newer"),
    "mirrored": Model(("d1", "d2", "d3"), c=1.0, weight="w"),
}


def tree_pool(train: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with P(1) by a forest and by boosted trees; a missing p3 is its median, beside a flag. Both are written tables."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    filled = Imputer(strategy="median", inputCols=["p3"], outputCols=["p3i"]).fit(train)
    inputs = VectorAssembler(inputCols=["p1", "p2", "p3i", "gap3"], outputCol="features")
    train, rows = (inputs.transform(filled.transform(x.withColumns({"label": F.col("y").cast("double"), "gap3": F.col("p3").isNull().cast("double")}))) for x in (train, rows))
    for name, m in (("forest", RandomForestClassifier(weightCol="w", numTrees=10, maxDepth=4, seed=7)), ("boosted", GBTClassifier(weightCol="w", maxIter=5, maxDepth=3, seed=7))):
        fit, path = m.setProbabilityCol("prob").setRawPredictionCol("raw").setPredictionCol("hit").fit(train), work_dir(train.sparkSession, name)
        fit.write().save(path)
        fit = type(fit).load(path)  # without its summary, which drags the session into its tasks
        rows = fit.transform(rows).withColumn(name, vector_to_array("prob")[1]).drop("prob", "raw", "hit")
    return rows.drop("features", "label", "gap3", "p3i")


@query("l1_model_pool")
def l1(spark, sf):
    """Held-out scores of a pool on the prediction matrix: logistic models of two strengths, on the newer rows alone, and on rows and their mirror images (sides swapped, label flipped), a forest and boosted trees; missing values have indicators, older rows weigh less. All sports are one set."""
    share = F.col("seq") / F.col("n")
    x = sized(predictions(spark, sf)).withColumns({"share": share, "p3": F.when(F.col("match_id") % 9 != 0, F.col("p3")), "w": F.pow(F.lit(0.5), (1 - share) * 2)})
    x = x.withColumns({"newer": F.when(F.col("share") >= 0.35, F.col("w")).otherwise(F.lit(0.0)), **{f"d{i}": F.coalesce(F.col(f"p{i}") - 0.5, F.lit(0.0)) for i in (1, 2, 3)}})
    x = stored(x.select(F.lit("all").alias("whole"), "sport", "match_id", "share", "y", "p1", "p2", "p3", "d1", "d2", "d3", "w", "newer"), "pool")
    train, rows = x.where("share < 0.7").withColumns({"train": F.lit(1).cast("long"), "fold": F.lit(0)}), x.where("share >= 0.7").withColumn("fold", F.lit(0))
    mirror = train.withColumns({**{f"d{i}": -F.col(f"d{i}") for i in (1, 2, 3)}, "y": 1 - F.col("y"), "p1": 1 - F.col("p1"), "p2": 1 - F.col("p2"), "p3": 1 - F.col("p3")})
    own = {k: m for k, m in LINEAR_POOL.items() if k != "mirrored"}
    fits = fitted(train, "whole", own) | fitted(train.unionByName(mirror), "whole", {"mirrored": LINEAR_POOL["mirrored"]})
    out = stored(scored(tree_pool(train, rows), "whole", LINEAR_POOL, fits), "pool")
    names = [*LINEAR_POOL, "forest", "boosted"]
    long = out.select("sport", "y", F.expr(f"stack({len(names)}, " + ", ".join(f"'{m}', {m}" for m in names) + ") AS (model, p)"))
    m = metrics(long, ["sport", "model"], "p")
    return m.select("sport", "model", "n", *(F.round(c, 4).alias(c) for c in ("logloss", "brier", "accuracy")))


# Calibration over expanding blocks


def pooled(x: np.ndarray, low: np.ndarray, high: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent violators pooled: (low, high, sum, rows) of blocks whose means rise, from blocks in order of x."""
    out: list[list[float]] = []
    for i in np.argsort(x, kind="stable").tolist():
        out.append([low[i], high[i], s[i], n[i]])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return tuple(np.array(c) for c in zip(*out, strict=True))


def isotonic(points: DataFrame, by: list[str], bins: int = 256) -> DataFrame:
    """(*by, xs, ys): the rising step function of points(*by, x in 0 .. 1, y), as knots to interpolate between; of at least 120 rows and 25 different x.

    Equal x are summed first, then ranges of x are pooled each by itself, and their blocks together:
    pooling is associative, so this gives the same blocks as all rows at once.
    """
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in by)
    each = points.groupBy(*by, "x").agg(F.sum(F.col("y").cast("double")).alias("s"), F.count("*").cast("double").alias("n"))
    enough = each.groupBy(*by).agg(F.sum("n").alias("rows"), F.count("*").alias("different")).where("rows >= 120 AND different >= 25").select(*by)
    each = each.join(enough, by).select(*by, F.least(F.floor(F.col("x") * bins), F.lit(bins - 1)).cast("int").alias("bin"), "x", "s", "n")

    def some(f: pd.DataFrame) -> pd.DataFrame:
        low, high, s, n = pooled(*(f[c].to_numpy() for c in ("x", "x", "x", "s", "n")))
        return pd.DataFrame({**{c: [f[c].iloc[0]] * len(low) for c in by}, "low": low, "high": high, "s": s, "n": n})

    def all_(f: pd.DataFrame) -> pd.DataFrame:
        low, high, s, n = pooled(*(f[c].to_numpy() for c in ("low", "low", "high", "s", "n")))
        mean = np.clip(s / n, EPS, 1 - EPS)
        return pd.DataFrame({**{c: [f[c].iloc[0]] for c in by}, "xs": [np.column_stack([low, high]).ravel().tolist()], "ys": [np.repeat(mean, 2).tolist()]})

    parts = each.groupBy(*by, "bin").applyInPandas(some, f"{kinds}, low double, high double, s double, n double")
    return parts.groupBy(*by).applyInPandas(all_, f"{kinds}, xs array<double>, ys array<double>")


def interpolated(rows: DataFrame, knots: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """rows with `name`, the knots' value at x, null without knots."""
    rows = rows.join(F.broadcast(knots), by, "left")
    schema = T.StructType([*rows.drop("xs", "ys").schema.fields, T.StructField(name, T.DoubleType())])

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f[name] = [np.nan if xs is None else float(np.interp(v, xs, ys)) for v, xs, ys in zip(f[x], f["xs"], f["ys"], strict=True)]
            yield f[schema.names]

    return rows.mapInPandas(task, schema)


CALIBRATORS = {"sigmoid": Model(("logit",), scaled=False), "beta": Model(("lp", "lq"), scaled=False)}
METHODS = ("none", "sigmoid", "beta", "isotonic")


def expanding_calibration(rows: DataFrame, fractions: tuple[float, ...] = (0.5, 0.67, 0.8), least: tuple[int, ...] = (60, 90, 120)) -> DataFrame:
    """(sport, fold, n, ones, method, p of each row): rows(sport, match_id, seq, y, p) calibrated by what all rows before its block fit; the block after the last fraction is the last fold.

    Blocks of fewer than 25 rows are none.
    """
    n, i = F.col("n"), F.col("seq") - 1
    ends = [F.least(n - 30, F.greatest(F.lit(m), F.floor(n * f))).cast("int") for f, m in zip(fractions, least, strict=True)]
    x = sized(rows).where("n >= 180")
    upper = [*ends[1:], n]
    fold, train = F.lit(None).cast("int"), F.lit(0).cast("long")
    for k, (a, b) in enumerate(zip(ends, upper, strict=True)):
        fold = F.when((i >= a) & (i < b) & (b - a >= 25), F.lit(k)).otherwise(fold)
        train = train + F.when(i < a, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    p = safe(F.col("p"))
    return x.withColumns({"fold": fold, "train": train, "logit": logit(F.col("p")), "lp": F.ln(p), "lq": F.ln(1 - p)})


def calibrated(x: DataFrame) -> DataFrame:
    """The rows that have a fold, in long form: (sport, fold, method, y, p)."""
    x = stored(x.select("sport", "fold", "train", "y", "p", "logit", "lp", "lq"), "calibration")
    rows = scored(x.where("fold IS NOT NULL"), "sport", CALIBRATORS, fitted(x, "sport", CALIBRATORS))
    each = x.select("sport", F.col("p").alias("x"), "y", F.explode(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda k: F.col("train").bitwiseAND(bit(k)) != 0)).alias("fold"))
    rows = interpolated(rows, isotonic(each, ["sport", "fold"]), ["sport", "fold"], "p", "isotonic")
    return rows.select("sport", "fold", "y", F.expr("stack(4, 'none', p, 'sigmoid', sigmoid, 'beta', beta, 'isotonic', isotonic) AS (method, p)")).where("p IS NOT NULL")


def calibration_choice(long: DataFrame) -> DataFrame:
    """One row per (sport, method) with its means over folds, and whether it's the chosen one: of least objective, if it gains enough over none without losing in Brier score or calibration."""
    m = metrics(long, ["sport", "fold", "method"], "p").where("ones > 0 AND ones < n")
    g = m.groupBy("sport", "method").agg(F.count("*").alias("folds"), *(F.avg(c).alias(c) for c in ("logloss", "brier", "ece")), F.coalesce(F.stddev_samp("logloss"), F.lit(0.0)).alias("spread"))
    g = g.withColumn("objective", F.col("logloss") + 0.05 * F.col("spread")).where("folds >= 2")
    none = g.where("method = 'none'").select("sport", F.col("logloss").alias("raw_ll"), F.col("brier").alias("raw_br"), F.col("ece").alias("raw_ece"))
    best = g.groupBy("sport").agg(F.min_by("method", F.struct("objective", "brier", "ece", "method")).alias("best"))
    g = g.join(none, "sport").join(best, "sport")
    gains = F.col("logloss") <= F.col("raw_ll") - F.greatest(F.lit(0.001), 0.003 * F.col("raw_ll"))
    good = (F.col("method") != "none") & gains & (F.col("brier") <= F.col("raw_br") + 0.002) & (F.col("ece") <= F.col("raw_ece") + 0.01)
    return g.withColumn("chosen", (F.col("method") == F.col("best")) & good)


@query("c1_fitted_calibrators")
def c1(spark, sf):
    """Calibrators fitted on expanding blocks, by sport; the one that passes the gate is chosen."""
    rows = predictions(spark, sf).select("sport", "match_id", "seq", "y", F.col("p1").alias("p"))
    g = calibration_choice(calibrated(expanding_calibration(rows)))
    g = every_sport(g.select("sport", "method", "folds", *(F.round(c, 4).alias(c) for c in ("logloss", "brier", "ece", "objective")), "chosen"), rows, "EVALUATED", "INSUFFICIENT_OOS")
    return g.withColumns({"method": F.coalesce("method", F.lit("none")), "chosen": F.coalesce("chosen", F.lit(False))})


@query("c2_tail_calibration")
def c2(spark, sf):
    """Calibration inside the training rows: a logistic base is fitted on their first 80 %, its sigmoid on what it says of the last 20 %, then the base on all of them, and both are applied to what follows."""
    share = F.col("seq") / F.col("n")
    fold = F.when(share > 0.7, 1).when(share > 0.56, 0)
    train = F.when(share <= 0.56, F.lit(3)).when(share <= 0.7, F.lit(2)).otherwise(F.lit(0)).cast("long")
    base = {"base": Model(("p1", "p2"), c=1e4)}
    x = stored(sized(predictions(spark, sf)).select(F.lit("all").alias("whole"), "sport", "match_id", "y", "p1", "p2", fold.alias("fold"), train.alias("train")), "tail")
    x = scored(x.where("fold IS NOT NULL"), "whole", base, fitted(x, "whole", base))
    x = stored(x.withColumns({"z": logit(F.col("base")), "train": F.when(F.col("fold") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long")}), "tail")
    sigmoid = {"calibrated": Model(("z",), c=1e4, scaled=False)}
    out = scored(x.where("fold = 1").withColumn("fold", F.lit(0)), "whole", sigmoid, fitted(x, "whole", sigmoid))
    return out.select("sport", "match_id", F.round("base", 4).alias("base"), F.round("calibrated", 4).alias("calibrated"))


# Forecasts of difficulty


def meta_signals(rows: DataFrame, reach: int = 5) -> DataFrame:
    """rows(sport, seq, y, p1 .. p3) with what is known of a row at its time: margin, disagreement, entropy, speed and persistence; and future, the mean log loss of the next `reach` rows."""
    p = [F.col(f"p{i}") for i in (1, 2, 3)]
    mean = sum(p) / 3
    x = rows.withColumns({"mean": mean, "margin": 2 * F.abs(mean - 0.5), "gap": F.sqrt(sum((q - mean) * (q - mean) for q in p) / 3), "entropy": -(mean * F.log2(mean) + (1 - mean) * F.log2(1 - mean)), "ll": log_loss(mean, F.col("y"), EPS)})
    # a part is led by the rows before it; the rows after it come as the lead of the next, so the future is that of rows already past
    x = overlapping(x, 5000, 2 * reach)
    w = Window.partitionBy("sport", "part").orderBy("seq")
    x = x.withColumns({"speed": F.coalesce(F.abs(F.col("mean") - F.lag("mean").over(w)), F.lit(0.0)), "persistence": F.avg("gap").over(w.rowsBetween(1 - reach, 0))})
    late = x.where("own").withColumn("_s", F.col("seq") - reach)
    ahead = x.withColumn("future", F.when(F.count("*").over(w.rowsBetween(1 - reach, 0)) == reach, F.avg("ll").over(w.rowsBetween(1 - reach, 0)))).where("own").select("sport", (F.col("seq") - reach).alias("seq"), "future")
    return late.drop("_s", "part", "own").join(ahead, ["sport", "seq"], "left")


SIGNALS = ("margin", "gap", "entropy", "speed", "persistence")


def chronological_forecast(rows: DataFrame, x: tuple[str, ...], blocks: int = 3, least: int = 120, least_train: int = 60, least_out: int = 30) -> DataFrame:
    """(sport, fold, p and all of rows(sport, seq, y, *x)): each block but the first predicted from all blocks before; sports without enough rows or outcomes give none."""
    x_ = sized(rows.withColumn("seq", F.row_number().over(Window.partitionBy("sport").orderBy("seq")))).where(F.col("n") >= least)
    part = part_of(F.col("seq"), F.col("n"), blocks)
    data = stored(x_.withColumns({"fold": F.when(part > 0, part), "train": bits_from(part + 1, F.lit(blocks - 1))}), "forecast")
    model = {"p": Model(x)}
    fits = {k: f for k, f in fitted(data, "sport", model).items() if f.n >= least_train}
    out = scored(data.where("fold IS NOT NULL"), "sport", model, fits).where("p IS NOT NULL")
    both = out.groupBy("sport", "fold").agg(F.min("y").alias("a"), F.max("y").alias("b"), F.count("*").alias("m")).where("a < b")
    enough = both.groupBy("sport").agg(F.sum("m").alias("m")).where(F.col("m") >= least_out).select("sport")
    return out.join(both.select("sport", "fold"), ["sport", "fold"]).join(enough, "sport")


@query("v12_meta_forecast")
def v12_forecast(spark, sf):
    """Whether the next five rows will be hard (their mean log loss above the 60th percentile), from signals known at a row's time: metrics of each fold."""
    rows = predictions(spark, sf)
    x = stored(meta_signals(rows).where("future IS NOT NULL").select("sport", "match_id", "seq", "future", *SIGNALS), "signals")
    cut = x.groupBy("sport").agg(F.percentile("future", F.lit(0.6)).alias("cut"))
    x = x.join(cut, "sport").withColumn("y", (F.round("future", 9) > F.round("cut", 9)).cast("int"))
    m = metrics(chronological_forecast(x, SIGNALS), ["sport", "fold"], "p")
    m = m.select("sport", "fold", "n", "ones", *(F.round(c, 4).alias(c) for c in ("logloss", "brier", "ece", "accuracy")))
    return every_sport(m, rows, "EVALUATED", "INSUFFICIENT_OOS")


# Risk of a case


@query("r13_case_risk")
def r13(spark, sf):
    """The chance that the mean of the models is wrong, from its confidence, entropy and the models' spread: each half of the development rows is scored by a model of the other, the holdout by a model of both."""
    m = (F.col("p1") + F.col("p2") + F.col("p3")) / 3
    share = F.col("seq") / F.col("n")
    fold = F.when(share > 0.78, 2).when(share <= 0.39, 0).otherwise(1)
    x = sized(predictions(spark, sf)).withColumns({"mean": m, "sure": F.abs(m - 0.5), "entropy": -m * F.ln(m) - (1 - m) * F.ln(1 - m), "gap": F.greatest("p1", "p2", "p3") - F.least("p1", "p2", "p3"), "wrong": ((m >= 0.5) != (F.col("y") == 1)).cast("int"), "fold": fold})
    x = x.withColumn("train", F.when(F.col("fold") == 0, F.lit(6)).when(F.col("fold") == 1, F.lit(5)).otherwise(F.lit(0)).cast("long"))
    x = stored(x.select(F.lit("all").alias("whole"), "sport", "match_id", "fold", "train", "wrong", "mean", "sure", "entropy", "gap", "p1", "p2", "p3"), "risk")
    model = {"risk": Model(("mean", "sure", "entropy", "gap", "p1", "p2", "p3"), c=1.0, target="wrong")}
    out = scored(x, "whole", model, fitted(x, "whole", model))
    return out.select("sport", "match_id", F.element_at(F.array(*map(F.lit, ("first", "second", "holdout"))), F.col("fold") + 1).alias("fold"), F.round("risk", 4).alias("risk"), "wrong")


# Stacking on earlier out-of-fold rows


def context(rows: DataFrame) -> DataFrame:
    """rows with late context, null where none came in time: how far the later model moved from the earlier, the hour, and how many rows of a side came in the week before."""
    seen = F.col("match_id") % 4 != 0
    return rows.withColumns({"shift": F.when(seen, logit(F.col("p2")) - logit(F.col("p1"))), "hour": F.when(seen, F.floor(F.col("t") / 3_600_000_000) % 24 / 24.0)})


CONTEXT = ("shift", "hour")


def stacked(rows: DataFrame, first: float = 0.7, least_history: int = 240, **walk) -> DataFrame:
    """(sport, match_id, a, seq, y, fold, last, base, stacked, enabled, covered) of each row that has a fold.

    Level one: a base refitted in each expanding fold. Level two: a stack of the base's logit and the
    context, which learns from out-of-fold rows of earlier folds alone, `least_history` and both outcomes
    of them at least; else the base stays. A fold learns from no label that isn't mature when it starts.
    The holdout, fold `last`, is scored and never learnt from.
    """
    x = matured_only(walk_forward(sized(context(maturing(rows))), first=first, **walk)).withColumns({"l1": logit(F.col("p1")), "l2": logit(F.col("p2"))})
    x = stored(x.select("sport", "match_id", "a", "seq", "y", "t", "mature", "train", "fold", "last", "l1", "l2", *CONTEXT), "stack")
    one = {"base": Model(("l1", "l2"))}
    x = scored(x.where("fold IS NOT NULL"), "sport", one, fitted(x, "sport", one)).where("base IS NOT NULL")
    later = F.when(F.col("fold") < F.col("last"), bits_from(F.col("fold") + 1, F.col("last"))).otherwise(F.lit(0).cast("long"))
    x = stored(matured_only(x.withColumns({"z": logit(F.col("base")), "train": later})), "stack")
    two = {"stack": Model(("z", *CONTEXT), missing=True)}
    fits = {k: f for k, f in fitted(x, "sport", two).items() if f.n >= least_history}
    out = scored(x, "sport", two, fits)
    covered = F.greatest(*(F.col(c).isNotNull().cast("int") for c in CONTEXT)) == 1
    return out.select("sport", "match_id", "a", "seq", "y", "fold", "last", safe(F.col("base")).alias("base"), safe(F.coalesce("stack", "base")).alias("stacked"), F.col("stack").isNotNull().alias("enabled"), covered.alias("covered"))


def stack_gate(x: DataFrame, draws: int = 400, seed: int = 20) -> DataFrame:
    """One row per sport: gains of the stack over the base, in all out-of-fold rows, in three blocks of folds and in a bootstrap by cluster, and whether the gate is passed."""
    ll = lambda p: log_loss(F.col(p), F.col("y"), EPS)
    br = lambda p: brier(F.col(p), F.col("y"))
    x = x.withColumns({"dl": ll("base") - ll("stacked"), "db": br("base") - br("stacked")})
    oof = x.where("fold < last")
    block = part_of(F.col("fold") + 1, F.col("last"), 3)
    blocks = oof.groupBy("sport", block.alias("block")).agg(F.avg("dl").alias("dl"), F.avg("db").alias("db"))
    blocks = blocks.groupBy("sport").agg(F.count_if((F.col("dl") > 0) & (F.col("db") >= -0.001)).alias("good_blocks"))
    clusters = oof.groupBy("sport", F.col("a").alias("block")).agg(F.sum("dl").alias("s"), F.count("*").alias("n"))
    boot = weighted_replicates(clusters, "sport", F.lit(1.0), draws, seed).groupBy("sport").agg(F.avg((F.col("value") > 0).cast("double")).alias("likely"), F.percentile("value", F.lit(0.05)).alias("low"))
    g = oof.groupBy("sport").agg(F.count("*").alias("rows"), F.max("last").alias("folds"), F.count_if("enabled").alias("enabled"), F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg("dl").alias("gain"), F.avg("db").alias("brier_gain"))
    hold = x.where("fold = last").groupBy("sport").agg(F.count("*").alias("holdout"), F.avg("dl").alias("holdout_gain"))
    g = g.join(blocks, "sport").join(boot, "sport", "left").join(hold, "sport", "left")
    ok = (F.col("coverage") >= 0.1) & (F.col("gain") >= 0.001) & (F.col("brier_gain") >= -0.001) & (F.col("good_blocks") >= 2) & (F.col("likely") >= 0.9) & (F.col("low") > 0)
    return g.withColumn("passed", F.coalesce(ok, F.lit(False)))


@query("r19_matchday_stacking")
def r19(spark, sf):
    rows = predictions(spark, sf)
    g = every_sport(stack_gate(stacked(rows, first=0.4)), rows, "EVALUATED", "DEFERRED")
    return g.select("sport", "status", "rows", "folds", "enabled", "holdout", "good_blocks", *(F.round(c, 4).alias(c) for c in ("coverage", "gain", "brier_gain", "holdout_gain", "likely", "low")), F.coalesce("passed", F.lit(False)).alias("passed"))


# Routing by predicted loss and value of information


EXPERTS = ("p1", "p2", "p3")
ROUTED = ("p1", "p2", "p3", "gap", "entropy", "mutual", "drift")


def routed(rows: DataFrame, first: float = 0.4, consult: float = 0.35, least_history: int = 120, **walk) -> DataFrame:
    """(sport, match_id, fold, last, y, fixed, routed): a router over experts whose expected losses, and the gain of consulting each at weight `consult`, are regressions on earlier folds' rows alone.

    Weights are 0.8 by expected loss and 0.2 by expected gain; the route's strength grows with the best
    expected gain and shrinks with disagreement and drift. With less history the fixed mean stays.
    """
    p = [safe(F.col(c)) for c in EXPERTS]
    mean = sum(p) / len(p)
    h = lambda q: -(q * F.log2(q) + (1 - q) * F.log2(1 - q))
    y = F.col("y")
    x = walk_forward(sized(maturing(rows)), first=first, **walk).where("fold IS NOT NULL")
    x = x.withColumns({"fixed": mean, "gap": F.sqrt(sum((q - mean) * (q - mean) for q in p) / len(p)), "entropy": h(mean), "mutual": F.greatest(h(mean) - sum(map(h, p)) / len(p), F.lit(0.0)), "drift": F.least(F.abs(F.col("p1") - F.col("p2")), F.lit(1.0))})
    loss = [log_loss(q, y, EPS) for q in p]
    gain = [log_loss(mean, y, EPS) - log_loss((1 - consult) * mean + consult * q, y, EPS) for q in p]
    x = x.withColumns({**{f"loss{i}": v for i, v in enumerate(loss)}, **{f"gain{i}": v for i, v in enumerate(gain)}})
    later = F.when(F.col("fold") < F.col("last"), bits_from(F.col("fold") + 1, F.col("last"))).otherwise(F.lit(0).cast("long"))
    x = stored(matured_only(x.withColumn("train", later)).select("sport", "match_id", "seq", "y", "fold", "last", "train", "fixed", *ROUTED, *(f"{k}{i}" for k in ("loss", "gain") for i in range(len(p)))), "router")
    models = {f"{k}_{i}": Model(ROUTED, c=0.5, target=f"{k}{i}", linear=True) for k in ("loss", "gain") for i in range(len(p))}
    fits = {k: f for k, f in fitted(x, "sport", models).items() if f.n >= least_history}
    return stored(scored(x, "sport", models, fits), "routes")


def fused(x: DataFrame, n: int = 3) -> DataFrame:
    """routed with the fused forecast, in columns alone."""
    e, v, p = ([F.col(f"{k}{i}") for i in range(n)] for k in ("loss_", "gain_", "q"))
    x = x.withColumns({f"q{i}": safe(F.col(c)) for i, c in enumerate(EXPERTS)})
    scale = x.select("sport", "fold", F.explode(F.array(*v)).alias("v")).where("v > 0").groupBy("sport", "fold").agg(F.percentile("v", F.lit(0.75)).alias("scale"))
    x = x.join(scale, ["sport", "fold"], "left").withColumn("scale", F.greatest(F.coalesce("scale", F.lit(0.01)), F.lit(0.005)))
    low = F.least(*e)
    by_loss = [F.exp(-(a - low) / 0.15) for a in e]
    by_gain = [F.exp(F.greatest(a, F.lit(0.0)) / F.col("scale")) for a in v]
    w = [0.75 * (0.8 * a / sum(by_loss) + 0.2 * b / sum(by_gain)) + 0.25 / n for a, b in zip(by_loss, by_gain, strict=True)]
    best = F.greatest(*v, F.lit(0.0))
    doubt = F.least(0.45 * F.col("gap") / 0.2 + 0.25 * F.col("mutual") / 0.08 + 0.3 * F.col("drift"), F.lit(1.0))
    strength = F.least(0.75 * best / (best + 0.01) * (1 - 0.6 * doubt) * (1 - 0.35 * F.col("drift")), F.lit(0.75))
    other = sum(a * b for a, b in zip(w, p, strict=True))
    return x.withColumn("routed", F.when(e[0].isNull(), F.col("fixed")).otherwise(safe(F.col("fixed") + strength * (other - F.col("fixed")))))


@query("r20_uncertainty_router")
def r20(spark, sf):
    """The router against the fixed mean, by fold; the last fold is the holdout."""
    x = fused(routed(predictions(spark, sf)))
    a, b = (metrics(x, ["sport", "fold", "last"], c).select("sport", "fold", "last", "n", F.col("logloss").alias(f"{c}_ll"), F.col("brier").alias(f"{c}_br")) for c in ("fixed", "routed"))
    g = a.join(b.drop("n", "last"), ["sport", "fold"])
    return g.select("sport", "fold", (F.col("fold") == F.col("last")).alias("holdout"), "n", *(F.round(c, 5).alias(c) for c in ("fixed_ll", "routed_ll", "fixed_br", "routed_br")), F.round(F.col("fixed_ll") - F.col("routed_ll"), 5).alias("gain"))
