"""Ordered folds: ratings, expert aggregation, bootstrap, simulation, fitted calibrators."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import DAY, HOUR, PREDICTIONS, admitted_results, matches, predictions, running
from ..sources.work import stored
from .predicates import r6
from .windows import losses, overlapping

START, SCALE = 1500.0, 400.0


def elo(m: DataFrame, key: list[str], k: float = 24.0) -> DataFrame:
    """Ratings of both sides of each match(*key, t, match_id, a, b, outcome, avail), from the results admitted at its cutoff.

    Results and matches stream in the order of `due` and cutoff; the fold is sequential within a key, its
    state one number per participant, and keys run in parallel. Draws and matches of a participant with
    itself change nothing.
    """
    names = [*key, "match_id", "a", "b"]
    results = admitted_results(m).select(*names, F.col("due").alias("at"), F.lit(0).alias("kind"), "t", (F.col("outcome") == "A").cast("int").alias("won"))
    probes = m.select(*names, (F.col("t") - HOUR).alias("at"), F.lit(1).alias("kind"), "t", F.lit(None).cast("int").alias("won"))
    out = ", ".join(f"{c} {m.schema[c].dataType.simpleString()}" for c in key) + ", match_id long, elo_a double, elo_b double"

    def task(frames):
        now, rating = None, {}
        for f in frames:
            rows = []
            for *k_, i, a, b, kind, won in zip(*(f[c] for c in names), f.kind, f.won, strict=True):
                if k_ != now:
                    now, rating = k_, {}
                ra, rb = rating.get(a, START), rating.get(b, START)
                if kind == 1:
                    rows.append((*k_, i, ra, rb))
                else:
                    change = k * (won - 1 / (1 + 10 ** ((rb - ra) / SCALE)))
                    rating[a], rating[b] = ra + change, rb - change
            yield pd.DataFrame(rows, columns=[*key, "match_id", "elo_a", "elo_b"])

    both = results.unionByName(probes).repartition(*key).sortWithinPartitions(*key, "at", "kind", "t", "match_id")
    return both.mapInPandas(task, out)


@query("q1_elo_fold")
def q1(spark, sf):
    return elo(matches(spark, sf), ["sport"]).select("sport", "match_id", r6("elo_a").alias("elo_a"), r6("elo_b").alias("elo_b"))


@query("q2_elo_variants")
def q2(spark, sf):
    """Fast, slow and competition-keyed ratings; momentum is fast minus slow."""
    m = matches(spark, sf).withColumn("competition", F.concat_ws("/", "sport", F.floor(F.col("t") / (7 * DAY))))
    fast, slow = (elo(m, ["sport"], k).select("match_id", F.col("elo_a").alias(n)) for k, n in ((36.0, "fast"), (12.0, "slow")))
    own = elo(m, ["sport", "competition"]).select("match_id", F.col("elo_a").alias("own"))
    return fast.join(slow, "match_id").join(own, "match_id").select("match_id", *(r6(c).alias(c) for c in ("fast", "slow", "own")), r6(F.col("fast") - F.col("slow")).alias("momentum"))


@query("q3_opponent_rating")
def q3(spark, sf):
    """The opponent's rating before each match, by participant."""
    e = elo(matches(spark, sf), ["sport"]).join(matches(spark, sf).select("match_id", "a", "b"), "match_id")
    return e.select("match_id", F.expr("stack(2, a, elo_b, b, elo_a) AS (pid, opponent)")).withColumn("opponent", r6("opponent"))


def matured(rows: DataFrame, *columns: str) -> DataFrame:
    """rows(sport, match_id, t, mature, ...) as a stream per sport: a row's label (kind 0) comes when it's mature, its prediction (kind 1) at t.

    A label that is mature at another row's time may be used there, unless the two have the same time.
    """
    times = F.array(F.struct(F.greatest("mature", F.col("t") + 1).alias("at"), F.lit(0).alias("kind")), F.struct(F.col("t").alias("at"), F.lit(1).alias("kind")))
    both = rows.select("sport", "match_id", "t", *columns, F.explode(times).alias("e")).select("sport", "match_id", "t", *columns, "e.at", "e.kind")
    return both


def in_order(stream: DataFrame) -> DataFrame:
    """A stream whose sports are one task each, in order."""
    return stream.repartition("sport").sortWithinPartitions("sport", "at", "kind", "t", "match_id")


def maturing(x: DataFrame) -> DataFrame:
    """The prediction matrix with the time at which a row's label is known: a day later, or with its source."""
    return x.withColumn("mature", F.greatest(F.col("t") + DAY, "avail"))


class Pool:
    """The `last` newest rows (by time and id) among those that have matured."""

    def __init__(self, last: int):
        self.last, self.rows = last, []

    def add(self, t: int, i: int, *values) -> None:
        heapq.heappush(self.rows, (t, i, *values))
        if len(self.rows) > self.last:
            heapq.heappop(self.rows)


#: Rows of a part of a sport's stream.
STREAM_PART = 20_000


def pooled(stream: DataFrame, last: int, part_rows: int) -> DataFrame:
    """A stream (sport, match_id, t, at, kind, ...) cut into parts of `part_rows` rows, in columns part and kind -1 led by the `last` newest labels (by time and id) of all parts before, so that parts run in parallel."""
    numbered = running(stream.withColumn("_k", F.struct("kind", "t", "match_id")), "sport", "at", "_k", F.lit(1), "_n", "sum")
    rows = stored(numbered.withColumn("part", F.floor((F.col("_n") - 1) / part_rows)).drop("_k", "_n"), "stream")
    newest = Window.partitionBy("sport", "part").orderBy(F.desc("t"), F.desc("match_id"))
    top = rows.where("kind = 0").withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last).drop("_r")
    n_parts = rows.groupBy("sport").agg(F.max("part").alias("_last_part"))

    def task(frames):
        """A sport's labels, at most `last` a part, in the order of its parts: the pool before each part."""
        sport, done, end, pool = None, 0, 0, None
        for f in frames:
            for (s, part, last_part), g in f.groupby(["sport", "part", "_last_part"], sort=False):
                if s != sport:
                    yield from led(pool, done + 1, end)
                    sport, done, end, pool = s, part, last_part, None
                else:
                    yield from led(pool, done + 1, part)
                    done = part
                pool = (g if pool is None else pd.concat([pool, g])).sort_values(["t", "match_id"]).tail(last)
        yield from led(pool, done + 1, end)

    def led(pool, first, until):
        for part in range(first, until + 1):
            yield pool.assign(part=part, kind=-1).drop(columns="_last_part")

    ordered = top.join(n_parts, "sport").repartition("sport").sortWithinPartitions("sport", "part").select(*rows.columns, "_last_part")
    return rows.unionByName(ordered.mapInPandas(task, rows.schema))


class Pools:
    """The pools of a part of a stream, whose rows are given in order: for the predictions (kind 1) the `last` newest labels (by time and id) that came before.

    rows holds the labels' positions from old to new, n how many there are.
    """

    def __init__(self, f: pd.DataFrame, last: int):
        self.last, self.kind = last, f.kind.to_numpy()
        self.labels = np.flatnonzero(self.kind < 1)
        self.labels = self.labels[np.lexsort((f.match_id.to_numpy()[self.labels], f.t.to_numpy()[self.labels]))]
        self.rank = np.zeros(len(f), np.int64)
        self.rank[self.labels] = np.arange(len(self.labels))

    def batches(self, size: int = 256):
        """(rows, n, asking, pool): up to `size` pools at a time, the positions of the predictions that meet them, and the number of the pool that each meets."""
        held, n, new = np.zeros(self.last, np.int64), 0, True
        rows, count, asking, pool = [], [], [], []
        for i, (kind, r) in enumerate(zip(self.kind.tolist(), self.rank.tolist(), strict=True)):
            if kind < 1:
                j = n if n and held[n - 1] < r else int(np.searchsorted(held[:n], r))
                if n < self.last:
                    held[j + 1 : n + 1] = held[j:n].copy()
                    held[j], n, new = r, n + 1, True
                elif j:
                    held[: j - 1] = held[1:j].copy()
                    held[j - 1], new = r, True
                continue
            if new:
                if len(rows) == size:
                    yield self._batch(rows, count, asking, pool)
                    rows, count, asking, pool = [], [], [], []
                rows.append(held.copy())
                count.append(n)
                new = False
            elif not rows:
                rows.append(held.copy())
                count.append(n)
            asking.append(i)
            pool.append(len(rows) - 1)
            if len(asking) == 16 * size:
                yield self._batch(rows, count, asking, pool)
                rows, count, asking, pool = [], [], [], []
        if asking:
            yield self._batch(rows, count, asking, pool)

    def _batch(self, rows, count, asking, pool):
        at = np.stack(rows)
        at = self.labels[at] if len(self.labels) else at
        return at, np.array(count), np.array(asking), np.array(pool)


def by_part(stream: DataFrame, last: int, part_rows: int, fold, out: str) -> DataFrame:
    """fold(rows of a part in order, their pools) of every part of a stream."""

    def task(f: pd.DataFrame) -> pd.DataFrame:
        lead = f[f.kind < 0].sort_values(["t", "match_id"])
        f = pd.concat([lead, f[f.kind >= 0].sort_values(["at", "kind", "t", "match_id"])], ignore_index=True)
        return fold(f, Pools(f, last))

    return pooled(stream, last, part_rows).groupBy("sport", "part").applyInPandas(task, out)


def online_experts(rows: DataFrame, rate: float = 0.05, least: int = 30, vote: float = 0.5, floor: float = 1e-12) -> DataFrame:
    """Weighted votes of prediction sets, whose weights follow what has matured.

    rows(sport, match_id, t, mature, y, sets): sets holds for each model the labels (0, 1) of its set. Each
    row is voted on with the weights so far; a label is in the voted set if the models that hold it weigh
    `vote` or more. Then, if `least` labels have matured, each model's weight is multiplied by
    exp(rate * (its share of matured sets that held the outcome - the best share)); no weight falls below
    `floor`. A sport is one fold, whose state is a count and a sum per model.
    """

    def task(frames):
        sport = None
        for f in frames:
            out = []
            for s, i, kind, y, sets in zip(f.sport, f.match_id, f.kind, f.y, f.sets, strict=True):
                held = np.array([[label in x for label in (0, 1)] for x in sets])
                if s != sport:
                    sport, n, right, w = s, 0, np.zeros(len(sets)), np.full(len(sets), 1 / len(sets))
                if kind == 0:
                    n, right = n + 1, right + held[:, int(y)]
                    continue
                inside = np.round(w @ held, 9) >= vote
                out.append((s, i, n, [k for k in (0, 1) if inside[k]], w.tolist()))
                if n >= max(least, 1):
                    gain = right / n
                    w = np.maximum(w * np.exp(np.clip(rate * (gain - gain.max()), -50, 50)), floor)
                    w = w / w.sum()
            yield pd.DataFrame(out, columns=["sport", "match_id", "n", "voted", "w"])

    return in_order(matured(rows, "y", "sets")).mapInPandas(task, "sport string, match_id long, n long, voted array<int>, w array<double>")


def label_sets(width: float = 0.35) -> Column:
    """Each model's set: the labels that it gives at least `width`."""
    one = lambda p: F.array_compact(F.array(F.when(1 - p >= width, 0), F.when(p >= width, 1)))
    return F.array(*(one(F.col(f"p{i}")) for i in (1, 2, 3)))


@query("q8_online_experts", f"""WITH {PREDICTIONS}, s AS (SELECT *, greatest(t + 86400000000, avail) AS mature FROM preds),
 h AS (SELECT *, {", ".join(f"CAST(CASE WHEN y = 1 THEN p{i} ELSE 1 - p{i} END >= 0.35 AS INTEGER) AS h{i}" for i in (1, 2, 3))} FROM s),
 g AS (SELECT x.sport, x.match_id, x.seq, count(z.match_id) AS n, {", ".join(f"avg(z.h{i}) AS g{i}" for i in (1, 2, 3))} FROM h x LEFT JOIN h z ON z.sport = x.sport AND z.mature <= x.t AND z.t < x.t GROUP BY 1, 2, 3),
 u AS (SELECT *, {", ".join(f"CASE WHEN n >= 30 THEN 0.05 * (g{i} - greatest(g1, g2, g3)) ELSE 0 END AS u{i}" for i in (1, 2, 3))} FROM g),
 c AS (SELECT sport, match_id, n, {", ".join(f"exp(coalesce(sum(u{i}) OVER w, 0)) AS e{i}" for i in (1, 2, 3))} FROM u WINDOW w AS (PARTITION BY sport ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT sport, match_id, n, {", ".join(f"round(e{i} / (e1 + e2 + e3), 5) AS w{i}" for i in (1, 2, 3))} FROM c""")
def q8(spark, sf):
    x = maturing(predictions(spark, sf)).withColumn("sets", label_sets())
    return online_experts(x).select("sport", "match_id", "n", *(F.round(F.col("w")[i - 1], 5).alias(f"w{i}") for i in (1, 2, 3)))


def local_sets(rows: DataFrame, alpha: float = 0.1, least: int = 30, last: int = 200, k: int = 30, part_rows: int = STREAM_PART) -> DataFrame:
    """Conformal sets from a row's neighbours: of the `last` newest matured rows the `k` nearest, by root mean square distance of x scaled to that pool, give p-values.

    rows(sport, match_id, t, mature, y, p, x): p is P(1), x an array of features. A sport's stream is cut
    into parts, each led by the pool that it starts with. Of equal distances the older row is nearer.
    Fewer than `least` rows: ABSTAIN.
    """
    out = "sport string, match_id long, pool long, nearest double, p0 double, p1 double, kind string"
    kinds = np.array(["ABSTAIN", "SINGLE", "SET"], object)

    def fold(f: pd.DataFrame, pools: Pools) -> pd.DataFrame:
        x, p = np.array(f.x.tolist(), float), f.p.to_numpy(float)
        miss = np.where(f.y.to_numpy() == 1, 1 - p, p)  # a label's score is 1 less its probability
        got = []
        for at, n, asking, pool in pools.batches():
            used = np.arange(last) < n[:, None]
            z = np.where(used[:, :, None], x[at], 0.0)
            some = np.maximum(n, 1)[:, None]
            off = np.where(used[:, :, None], z - (z.sum(axis=1) / some)[:, None], 0.0)
            std = np.sqrt((off * off).sum(axis=1) / some)
            std[~(std > 1e-9)] = 1.0
            for i in range(0, len(asking), 256):
                ask, of = asking[i : i + 256], pool[i : i + 256]
                d = np.round(np.sqrt((((z[of] - x[ask][:, None]) / std[of][:, None]) ** 2).mean(axis=2)), 9)
                d[~used[of]] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                found = np.arange(near.shape[1]) < n[of][:, None]
                score = miss[np.take_along_axis(at[of], near, axis=1)]
                size = found.sum(axis=1) + 1
                pv = np.stack([(1 + (found & (score >= v[:, None] - 1e-12)).sum(axis=1)) / size for v in (p[ask], 1 - p[ask])], axis=1)
                enough = n[of] >= least
                g = pd.DataFrame({"match_id": f.match_id.to_numpy()[ask], "pool": n[of], "nearest": d[np.arange(len(ask)), near[:, 0]], "p0": pv[:, 0], "p1": pv[:, 1], "kind": np.where(enough, kinds[(pv > alpha).sum(axis=1)], "ABSTAIN")})
                g.loc[~enough, ["nearest", "p0", "p1"]] = np.nan  # null
                got.append(g)
        if not got:
            return pd.DataFrame(columns=[c.split()[0] for c in out.split(", ")])
        return pd.concat(got).assign(sport=f.sport.iloc[0])[[c.split()[0] for c in out.split(", ")]]

    return by_part(matured(rows, "y", "p", "x"), last, part_rows, fold, out)


@query("n3_local_sets", f"""WITH {PREDICTIONS}, s AS (SELECT *, greatest(t + 86400000000, avail) AS mature, CASE WHEN y = 1 THEN 1 - p1 ELSE p1 END AS score FROM preds),
 j AS (SELECT x.sport, x.match_id, x.p1 AS p, z.t AS zt, z.match_id AS zi, z.score, x.p1 - z.p1 AS d1, x.p2 - z.p2 AS d2, x.p3 - z.p3 AS d3, z.p1 AS z1, z.p2 AS z2, z.p3 AS z3,
   row_number() OVER (PARTITION BY x.match_id ORDER BY z.t DESC, z.match_id DESC) AS rn FROM s x LEFT JOIN s z ON z.sport = x.sport AND z.mature <= x.t AND z.t < x.t),
 k AS (SELECT *, count(score) OVER w AS n, {", ".join(f"CASE WHEN stddev_pop(z{i}) OVER w > 1e-9 THEN stddev_pop(z{i}) OVER w ELSE 1 END AS s{i}" for i in (1, 2, 3))} FROM j WHERE rn <= 200 WINDOW w AS (PARTITION BY match_id)),
 d AS (SELECT *, round(sqrt((pow(d1 / s1, 2) + pow(d2 / s2, 2) + pow(d3 / s3, 2)) / 3), 9) AS d FROM k),
 r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY d, zt, zi) AS nr FROM d),
 v AS (SELECT sport, match_id, any_value(n) AS n, min(d) AS d, (1 + count(*) FILTER (WHERE score >= p - 1e-12)) / (count(*) + 1) AS p0, (1 + count(*) FILTER (WHERE score >= 1 - p - 1e-12)) / (count(*) + 1) AS p1 FROM r WHERE nr <= 30 GROUP BY 1, 2)
SELECT sport, match_id, n AS pool, CASE WHEN n >= 30 THEN round(d, 6) END AS nearest, CASE WHEN n >= 30 THEN round(p0, 6) END AS p0, CASE WHEN n >= 30 THEN round(p1, 6) END AS p1,
 CASE WHEN n < 30 OR (p0 <= 0.1 AND p1 <= 0.1) THEN 'ABSTAIN' WHEN p0 > 0.1 AND p1 > 0.1 THEN 'SET' ELSE 'SINGLE' END AS kind FROM v""")
def n3(spark, sf):
    x = maturing(predictions(spark, sf)).withColumn("x", F.array("p1", "p2", "p3")).withColumn("p", F.col("p1"))
    return local_sets(x).select("sport", "match_id", "pool", r6("nearest").alias("nearest"), r6("p0").alias("p0"), r6("p1").alias("p1"), "kind")


def platt(x: np.ndarray, y: np.ndarray, used: np.ndarray, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept of a logistic fit for each row of x and y (only where used), with half the square of the slope added to the loss; Newton's method on all rows at once."""
    a, b = np.zeros(len(x)), np.zeros(len(x))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a[:, None] * x + b[:, None], -35, 35)))
        e, v = np.where(used, p - y, 0), np.where(used, p * (1 - p), 0) + np.where(used, 1e-12, 0)
        ga, gb = (e * x).sum(1) + a, e.sum(1)
        haa, hab, hbb = (v * x * x).sum(1) + 1, (v * x).sum(1), np.maximum(v.sum(1), 1e-12)
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = np.minimum(1, 4 / np.maximum(np.abs(da) + np.abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if (np.abs(step * da) + np.abs(step * db)).max(initial=0) < 1e-13:
            break
    return a, b


def trailing_platt(rows: DataFrame, window: int = 80, least: int = 30) -> DataFrame:
    """p of each row, refitted on the logits and outcomes of up to `window` earlier rows, `least` of them and both outcomes at least; else p as it is. rows(sport, seq, match_id, y, p)."""
    q = F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6))
    x = overlapping(rows.withColumn("x", F.ln(q / (1 - q))), 5000, window)
    w = Window.partitionBy("sport", "part").orderBy("seq").rowsBetween(-window, -1)
    x = x.withColumn("past", F.collect_list(F.struct("x", "y")).over(w)).where("own")

    def task(frames):
        for f in frames:
            n = np.array([len(v) for v in f.past])
            past = np.zeros((len(f), window, 2))
            for i, v in enumerate(f.past):
                if len(v):
                    past[i, : n[i]] = [(r["x"], r["y"]) for r in v]
            used = np.arange(window) < n[:, None]
            ones = (past[:, :, 1] * used).sum(1)
            a, b = platt(past[:, :, 0], past[:, :, 1], used)
            fit = (n >= least) & (ones > 0) & (ones < n)
            p = np.where(fit, 1 / (1 + np.exp(-(a * f.x.to_numpy() + b))), f.p.to_numpy())
            yield pd.DataFrame({"sport": f.sport, "match_id": f.match_id, "fitted": fit, "p": p})

    return x.select("sport", "match_id", "x", "p", "past").mapInPandas(task, "sport string, match_id long, fitted boolean, p double")


@query("q9_trailing_platt")
def q9(spark, sf):
    return trailing_platt(predictions(spark, sf).withColumn("p", F.col("p1"))).select("sport", "match_id", "fitted", F.round("p", 5).alias("p"))


def frozen_calibration(rows: DataFrame, locked: float = 0.7, least: int = 120, last: int = 600, part_rows: int = STREAM_PART) -> DataFrame:
    """A raw score calibrated to the chance of being right, refitted on the `last` newest matured rows and frozen at the first of the locked rows.

    rows(sport, match_id, seq, n, t, mature, x, right): the rows after the share `locked` of a sport's n
    are locked, and their labels are never learnt from. With fewer than `least` rows or one outcome only
    the calibrated value is (right + 1) / (rows + 2) of what has matured. A sport's stream is cut into
    parts, each led by the pool that it starts with; locked rows take the fit of the first of them.
    """
    out = "sport string, match_id long, x double, first boolean, rows long, state string, a double, b double"

    def fold(f: pd.DataFrame, pools: Pools) -> pd.DataFrame:
        x, right = f.x.to_numpy(float), f.right.to_numpy(float)
        got = []
        for at, n, ask, pool in pools.batches():
            used = np.arange(last) < n[:, None]
            ones = np.where(used, right[at], 0).sum(axis=1)
            fits = (n >= least) & (ones > 0) & (ones < n)
            a, b = np.zeros(len(n)), np.log((ones + 1) / (n - ones + 1))
            if fits.any():
                a[fits], b[fits] = platt(x[at[fits]], right[at[fits]], used[fits])
            got.append(pd.DataFrame({"match_id": f.match_id.to_numpy()[ask], "x": x[ask], "first": f.locked.to_numpy(bool)[ask], "rows": n[pool], "state": np.where(fits, "FITTED", "PRIOR")[pool], "a": a[pool], "b": b[pool]}))
        if not got:
            return pd.DataFrame(columns=[c.split()[0] for c in out.split(", ")])
        return pd.concat(got).assign(sport=f.sport.iloc[0])[[c.split()[0] for c in out.split(", ")]]

    cut = F.floor(F.col("n") * locked)
    rows = rows.withColumn("locked", F.col("seq") > cut).withColumn("later", F.col("seq") > cut + 1)
    stream = matured(rows, "x", "right", "locked", "later").where("kind = 0 AND NOT locked OR kind = 1 AND NOT later").drop("later")
    fits = stored(by_part(stream, last, part_rows, fold, out), "fits")
    frozen = fits.where("first").select("sport", "rows", "state", "a", "b")
    later = rows.where("later").select("sport", "match_id", "x").join(F.broadcast(frozen), "sport")
    both = fits.drop("first").unionByName(later)
    return both.select("sport", "match_id", "rows", "state", (1 / (1 + F.exp(-(F.col("a") * F.col("x") + F.col("b"))))).alias("p"))


@query("q10_frozen_calibration")
def q10(spark, sf):
    x = maturing(predictions(spark, sf))
    x = x.join(x.groupBy("sport").agg(F.count("*").alias("n")), "sport")
    sure = F.abs(F.col("p1") - 0.5) * 2
    rows = x.withColumn("x", sure).withColumn("right", ((F.col("p1") >= 0.5) == (F.col("y") == 1)).cast("int"))
    return frozen_calibration(rows).select("sport", "match_id", "rows", "state", F.round("p", 5).alias("p"))


def weighted_replicates(blocks: DataFrame, key: str, rate: Column, draws: int, seed: int) -> DataFrame:
    """(key, replicate, value) of a bootstrap over blocks(key, block, s, n): each block gets a Poisson weight of the given rate in each replicate from a hash of its name, so replicates are sums and need no gathering."""

    def task(frames):
        for f in frames:
            for k, part in f.groupby(key):
                w = np.stack([np.random.default_rng(int(h) & (2**63 - 1)).poisson(r, draws) for h, r in zip(part.h, part.rate, strict=True)])
                yield pd.DataFrame({key: k, "replicate": np.arange(draws), "s": part.s.to_numpy() @ w, "n": part.n.to_numpy().astype(float) @ w})

    rows = blocks.select(key, F.xxhash64(F.lit(seed), key, "block").alias("h"), rate.cast("double").alias("rate"), "s", "n")
    g = rows.mapInPandas(task, f"{key} string, replicate int, s double, n double").groupBy(key, "replicate").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return g.where("n > 0").select(key, "replicate", (F.col("s") / F.col("n")).alias("value"))


@query("b1_block_bootstrap")
def b1(spark, sf):
    """Seeded bootstrap of the mean loss difference over blocks of 50 rows."""
    d = losses(spark, sf).groupBy("sport", F.floor((F.col("seq") - 1) / 50).alias("block")).agg(F.sum(F.col("l1") - F.col("l3")).alias("s"), F.count("*").alias("n"))
    mean = d.groupBy("sport").agg(r6(F.sum("s") / F.sum("n")).alias("mean"))
    r = weighted_replicates(d, "sport", F.lit(1.0), 500, 7).groupBy("sport").agg(*(r6(F.percentile("value", F.lit(q))).alias(c) for q, c in ((0.025, "low"), (0.975, "high"))))
    return mean.join(r, "sport")


@query("b3_moving_blocks")
def b3(spark, sf):
    """90 % interval of the Brier difference of two models by a moving-block bootstrap: blocks of 12 rows start at every row, and as many are drawn as cover the sport."""
    block = 12
    x = overlapping(losses(spark, sf).withColumn("d", F.pow(F.col("p3") - F.col("y"), F.lit(2)) - F.pow(F.col("p1") - F.col("y"), F.lit(2))), 5000, block - 1)
    w = Window.partitionBy("sport", "part").orderBy("seq").rowsBetween(1 - block, 0)
    starts = x.withColumn("s", F.sum("d").over(w)).withColumn("n", F.count("*").over(w)).where(F.col("own") & (F.col("n") == block)).select("sport", F.col("seq").alias("block"), "s", "n")
    size = starts.groupBy("sport").agg(F.count("*").alias("starts")).where(F.col("starts") >= 2 * block + 1)
    rate = F.ceil((F.col("starts") + block - 1) / block) / F.col("starts")
    r = weighted_replicates(starts.join(size, "sport"), "sport", rate, 300, 11)
    return r.groupBy("sport").agg(F.round(F.avg("value"), 5).alias("mean"), *(F.round(F.percentile("value", F.lit(q)), 5).alias(c) for q, c in ((0.05, "low"), (0.95, "high"))))


@query("d1x_simulated_worlds")
def d1x(spark, sf):
    """Monte-Carlo worlds: each draws a scenario and a strength; the seed is the world's number, so repeated tasks give the same rows."""

    def task(frames):
        for f in frames:
            rows = []
            for i in f.id:
                g = np.random.default_rng(int(i))
                scenario = int(g.integers(0, 3))
                p = float(g.beta(2 + scenario, 3))
                rows.append((int(i), scenario, round(p, 6), int((g.random(5) < p).sum())))
            yield pd.DataFrame(rows, columns=["world", "scenario", "p", "wins"])

    return spark.range(2000).mapInPandas(task, "world long, scenario int, p double, wins int")


@query("d3x_state_primitives", f"WITH {PREDICTIONS} SELECT sport, round((sum(y) + 10 * 0.5) / (count(*) + 10), 6) AS shrunk, round(avg(p1 * p1) - avg(p1) * avg(p1) + avg(p1 * (1 - p1)), 6) AS mixture_variance, round(pow(sum(p2), 2) / sum(p2 * p2), 4) AS effective_n FROM preds GROUP BY 1")
def d3x(spark, sf):
    p, q = F.col("p1"), F.col("p2")
    return predictions(spark, sf).groupBy("sport").agg(r6((F.sum("y") + 10 * 0.5) / (F.count("*") + 10)).alias("shrunk"), r6(F.avg(p * p) - F.avg(p) * F.avg(p) + F.avg(p * (1 - p))).alias("mixture_variance"), F.round(F.pow(F.sum(q), F.lit(2)) / F.sum(q * q), 4).alias("effective_n"))


@query("d4x_forecast_contract", f"WITH {PREDICTIONS} SELECT match_id, t - 3600000000 AS valid_from, t AS expires, CASE WHEN p1 >= 0.7 THEN 'B' WHEN p1 <= 0.3 THEN 'A' ELSE 'NONE' END AS call FROM preds")
def d4x(spark, sf):
    p = F.col("p1")
    return predictions(spark, sf).select("match_id", (F.col("t") - 3_600_000_000).alias("valid_from"), F.col("t").alias("expires"), F.when(p >= 0.7, "B").when(p <= 0.3, "A").otherwise("NONE").alias("call"))
