"""Nearest rows: exact search in tiles, trajectory memory, and routing by similar cases."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import DAY, HOUR, PREDICTIONS, TARGETS, observations, predictions, table, targets
from ..sources.work import stored
from .pit import asof_join, forward_asof
from .predicates import brier, log_loss
from .selection import quantiles

FOUND = "query_id long, row_id long, distance double"


class Tile:
    """A block of queries and, of the rows that they have met, the k nearest to each."""

    def __init__(self, k: int):
        self.k, self.parts, self.found = k, [], None

    def meet(self, ids: np.ndarray, x: np.ndarray, rows: int = 256) -> None:
        if not self.parts:
            return
        qid, q = (np.concatenate(v) for v in zip(*self.parts, strict=True))
        self.parts = [(qid, q)]
        self.dim = x.shape[1]
        got = [] if self.found is None else [self.found]
        for i in range(0, len(qid), rows):
            part = q[i : i + rows]
            d = (part**2).sum(1)[:, None] + (x**2).sum(1) - 2 * part @ x.T
            d[qid[i : i + rows, None] == ids] = np.inf
            row, col = self.close(d, (part**2).sum(1)[:, None] + (x**2).sum(1).max())
            parts = [np.round(np.sqrt(((part[row[j : j + 100_000]] - x[col[j : j + 100_000]]) ** 2).mean(1)), 6) for j in range(0, len(row), 100_000)]
            got.append(self.best(i + row, ids[col], np.concatenate(parts or [np.empty(0)])))
        self.found = self.best(*(np.concatenate(v) for v in zip(*got, strict=True)))

    def close(self, d: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all that may be among the k nearest by their rounded distance: products are only near the squares, by 1e-13 of the vectors' size."""
        blur = 1e-13 * size
        if d.shape[1] > self.k:
            edge = np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            most = (np.sqrt(np.maximum(edge + blur, 0)) + 1.1e-6 * np.sqrt(self.dim)) ** 2 + blur
            return np.nonzero((d <= most) & np.isfinite(d))
        return np.nonzero(np.isfinite(d))

    def best(self, row: np.ndarray, ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids, d, row))
        row, ids, d = row[order], ids[order], d[order]
        pick = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[pick], ids[pick], d[pick]

    def lists(self) -> Iterator[pa.RecordBatch]:
        if self.found is not None:
            row, ids, d = self.found
            yield pa.RecordBatch.from_arrays([pa.array(self.parts[0][0][row]), pa.array(ids), pa.array(d)], names=["query_id", "row_id", "distance"])


class Cells:
    """Cells of space by a tree of medians of a sample."""

    def __init__(self, sample: np.ndarray, most: int):
        self.dim, self.cut, self.down, self.n = [], [], [], 0
        self._grow(sample, most)

    def _grow(self, x: np.ndarray, most: int) -> int:
        """Adds a node and what is below it; a leaf's number is negative, less one."""
        width = x.max(0) - x.min(0) if len(x) > 1 and most > 1 else np.zeros(1)
        if not width.max() > 0:
            self.n += 1
            return -self.n
        c = int(width.argmax())
        cut = np.median(x[:, c])
        if not (x[:, c] > cut).any():
            cut = x[x[:, c] < cut, c].max()
        i = len(self.dim)
        self.dim.append(c)
        self.cut.append(float(cut))
        self.down.append(None)
        low = x[:, c] <= cut
        self.down[i] = (self._grow(x[low], most - most // 2), self._grow(x[~low], most // 2))
        return i

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector, from 0."""
        at = np.zeros(len(x), np.int64) if self.dim else np.full(len(x), -1)
        dim, cut, down = np.array(self.dim, int), np.array(self.cut), np.array(self.down, int).reshape(-1, 2)
        while (go := np.flatnonzero(at >= 0)).size:
            node = at[go]
            at[go] = down[node, (x[go, dim[node]] > cut[node]).astype(int)]
        return -at - 1


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1)


def _in_tiles(queries: DataFrame, rows: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(query_id, row_id, distance): for each of queries(id, x, cell) the k nearest of each of its cells in rows(id, x, cell); a task holds at most about block_rows queries, and a batch of a cell's rows at a time."""

    def task(batches):
        key, tile = None, Tile(k)
        for b in batches:
            cell, block, kind, ids = (b.column(c).to_numpy() for c in ("cell", "block", "kind", "id"))
            if not len(ids):
                continue
            x = _vectors(b)
            change = (np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(ids)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if (cell[i], block[i]) != key:
                    yield from tile.lists()
                    key, tile = (cell[i], block[i]), Tile(k)
                if kind[i] == 0:
                    tile.parts.append((ids[i:j], x[i:j]))
                else:
                    tile.meet(ids[i:j], x[i:j])
        yield from tile.lists()

    blocks = queries.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    asked = queries.join(F.broadcast(blocks), "cell").select("id", "x", "cell", F.expr("pmod(xxhash64(id), blocks)").alias("block"), F.lit(0).alias("kind"))
    met = rows.join(F.broadcast(blocks), "cell").select("id", "x", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"))
    both = asked.unionByName(met).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    return both.mapInArrow(task, FOUND)


def nearest(queries: DataFrame, rows: DataFrame, k: int, block_rows: int = 8192, shard_rows: int = 4096) -> DataFrame:
    """(query_id, row_id, distance, rank): for each of queries(id, x) the k nearest of rows(id, x) but itself, by root mean square distance to six decimals, ties to the smaller id.

    Rows are dealt to cells of about shard_rows by a tree of medians of a sample; of rows with one vector
    the k + 1 smallest ids stay, which is all that can be asked for. A query searches its own cell, then
    every other whose box is no farther than the k-th found, so the result is exact. Distances are
    computed exactly for all that matrix products can't tell from the k nearest, ties included. Vectors
    have one length and no nulls.
    """
    copies = Window.partitionBy("x").orderBy("id")
    zero = lambda df: df.select("id", F.transform("x", lambda v: v + 0.0).alias("x"))  # noqa: E731  (-0.0 is 0.0)
    some = stored(zero(rows).withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n"), "rows")
    n = some.count()
    n_cells = max(1, min(-(-n // shard_rows), 4096))
    sample = some.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // (64 * n_cells)))) == 0).select("x").toPandas().x
    tree = Cells(np.stack(sample.to_list()) if len(sample) else np.zeros((1, 1)), n_cells)

    def dealt(batches):
        for b in batches:
            if b.num_rows:
                yield b.append_column("cell", pa.array(tree.of(_vectors(b))))

    kinds = "id long, x array<double>, cell long"
    some, asked = (stored(df.mapInArrow(dealt, kinds), "cells") for df in (some, zero(queries)))
    near = stored(_in_tiles(asked, some, k, block_rows), "near")
    boxes = some.groupBy("cell").agg(*(f(F.col("x")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(len(sample.iloc[0]) if len(sample) else 1))).toPandas()
    cells, box = boxes["cell"].to_numpy(), boxes.drop(columns="cell").to_numpy(float).reshape(len(boxes), 2, -1)
    reach = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("distance")).alias("reach"))

    def others(batches):
        for b in batches:
            x, r, home = _vectors(b), b.column("reach").to_numpy(zero_copy_only=False).astype(float), b.column("cell").to_numpy()
            r = np.where(np.isnan(r), np.inf, r)
            for i in range(0, len(x), 128):
                q = x[i : i + 128, None]
                far = np.sqrt((np.maximum(np.maximum(box[:, 0] - q, q - box[:, 1]), 0) ** 2).mean(2))
                row, c = np.nonzero((far <= r[i : i + 128, None] * (1 + 1e-9) + 1.1e-6) & (cells != home[i : i + 128, None]))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(i + row)), b.column("x").take(pa.array(i + row)), pa.array(cells[c])], names=["id", "x", "cell"])

    more = stored(asked.join(reach, "id", "left").select("id", "x", "cell", "reach").mapInArrow(others, kinds), "others")
    near = near.unionByName(_in_tiles(more, some, k, block_rows))
    w = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query("j20_knn", "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q.vec_id AS query_id, e.vec_id, round(sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))) / 64), 6) AS distance FROM q JOIN embeddings e ON e.vec_id <> q.vec_id) SELECT query_id, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM d) WHERE rn <= 5")
def j20(spark, sf):
    """The five nearest vectors of every hundredth vector."""
    e = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return nearest(e.where("id % 100 = 0"), e, 5).select("query_id", F.col("row_id").alias("vec_id"), "distance")


HORIZONS = (HOUR, DAY, 3 * DAY)
#: 20 January 2024 parts what the queries remember from what they forecast.
SPLIT = 1_705_708_800_000_000
STATS = ("view", "click", "error")


def trajectory_cases(t: DataFrame, o: DataFrame, stats: tuple[str, ...] = STATS, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(id, t, done, f1 .., s1 ..): a target's features (the latest values of the stats at its cutoff, null if none), its states after each horizon, and when the last of them was seen, a written table. Targets that lack a state are dropped."""
    probes = t.select("event_id", "pid", "cutoff", F.explode(F.array(*map(F.lit, stats))).alias("stat"))
    known = o.select("pid", "stat", F.greatest("t", "avail").alias("known"), F.struct("t", "event_id", "value").alias("v"))
    last = asof_join(probes, known, ["pid", "stat"], "cutoff", "known", ["v"])
    f = last.groupBy("event_id").agg(*(F.max(F.when(F.col("stat") == s, F.col("last_v.value"))).alias(f"f{i}") for i, s in enumerate(stats, 1)))
    ahead = forward_asof(t.select("pid", F.col("event_id").alias("anchor_id"), "t"), o.select("pid", "t", "value"), ["pid"], list(horizons))
    s = ahead.groupBy(F.col("anchor_id").alias("event_id")).agg(F.max("at").alias("done"), *(F.max(F.when(F.col("h") == h, F.col("value"))).alias(f"s{i}") for i, h in enumerate(horizons, 1)))
    cases = t.join(s, "event_id").join(f, "event_id").select(F.col("event_id").alias("id"), "t", "done", *(f"f{i + 1}" for i in range(len(stats))), *(f"s{i + 1}" for i in range(len(horizons))))
    return stored(cases, "cases")


def scaled(cases: DataFrame, memory: DataFrame, names: list[str]) -> DataFrame:
    """cases with x: each feature less the memory's median, by its median absolute deviation (1 if that's tiny), a missing one as the median; then a flag for each that is missing."""
    flat = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in names))).alias("e")).select("e.*")

    def middles(df: DataFrame, prefix: str) -> DataFrame:
        """One row: the exact median of each feature."""
        q = quantiles(stored(flat(df), "flat"), ["f"], "v", (0.5,))
        return q.agg(*(F.max(F.when(F.col("f") == c, F.col("q0"))).alias(f"{prefix}_{c}") for c in names))

    one = stored(middles(memory, "m"), "medians")
    filled = lambda c: F.coalesce(F.col(c), F.col(f"m_{c}"), F.lit(0.0))
    off = memory.crossJoin(F.broadcast(one)).select(*(F.abs(filled(c) - F.coalesce(F.col(f"m_{c}"), F.lit(0.0))).alias(c) for c in names))  # one row
    spread = stored(one.crossJoin(middles(off, "d")), "medians")
    z = [(filled(c) - F.coalesce(F.col(f"m_{c}"), F.lit(0.0))) / F.when(F.col(f"d_{c}") > 1e-6, F.col(f"d_{c}")).otherwise(F.lit(1.0)) for c in names]
    flags = [F.col(c).isNull().cast("double") for c in names]
    return cases.crossJoin(F.broadcast(spread)).select(*cases.columns, F.array(*z, *flags).alias("x"))


def trajectories(cases: DataFrame, split: int, high_from: float = 50, k: int = 20) -> DataFrame:
    """(id, h, state, expected, p10, p90, p_high, prior): forecasts of the cases from `split` on by the whole paths of the k nearest cases that were over by then.

    cases: as trajectory_cases gives them, for any number of features and horizons. Neighbours weigh
    exp(-d / (median d + 0.25, 0.25 at least)); p_high is their weighted share of states above
    `high_from`, prior that of all remembered cases.
    """
    memory = cases.where(F.col("done") < split)
    names, states = ([c for c in cases.columns if re.fullmatch(rf"{k_}\d+", c)] for k_ in "fs")
    whole = scaled(cases, memory, names)
    rows, asked = whole.where(F.col("done") < split), whole.where(F.col("t") >= split)
    near = nearest(asked.select("id", "x"), rows.select("id", "x"), k)
    heat = near.groupBy("query_id").agg(F.percentile("distance", F.lit(0.5)).alias("m"))
    near = near.join(heat, "query_id").withColumn("w", F.exp(-F.col("distance") / F.greatest(F.col("m") + 0.25, F.lit(0.25))))
    paths = lambda df: df.select("id", F.explode(F.array(*(F.struct(F.lit(i).alias("h"), F.col(f"s{i}").alias("state")) for i in range(1, len(states) + 1)))).alias("p")).select("id", "p.*")
    past = paths(memory)
    seen = near.join(past.withColumnRenamed("id", "row_id"), "row_id")
    mean = lambda v: F.sum(F.col("w") * v) / F.sum("w")
    high = (F.col("state") > high_from).cast("double")
    out = seen.groupBy(F.col("query_id").alias("id"), "h").agg(mean(F.col("state")).alias("expected"), F.percentile("state", F.lit(0.1)).alias("p10"), F.percentile("state", F.lit(0.9)).alias("p90"), mean(high).alias("p_high"))
    prior = past.groupBy("h").agg(F.avg(high).alias("prior"))
    return paths(asked).join(out, ["id", "h"]).join(prior, "h")


TRAJECTORIES = f"""{TARGETS},
 k AS (SELECT event_id, pid, stat, t, value, greatest(t, avail) AS known FROM obs),
 l AS (SELECT x.event_id, k.stat, k.value, row_number() OVER (PARTITION BY x.event_id, k.stat ORDER BY k.known DESC, k.t DESC, k.event_id DESC) AS rn FROM targets x JOIN k ON k.pid = x.pid AND k.known <= x.cutoff AND k.stat IN ('view', 'click', 'error')),
 f AS (SELECT x.event_id, {", ".join(f"max(l.value) FILTER (WHERE l.stat = '{s}' AND rn = 1) AS f{i}" for i, s in enumerate(STATS, 1))} FROM targets x LEFT JOIN l USING (event_id) GROUP BY 1),
 g AS (SELECT event_id, pid, t, unnest([1, 2, 3]) AS h, unnest([{", ".join(map(str, HORIZONS))}]) AS lead FROM targets),
 a AS (SELECT g.event_id, g.h, o.t AS seen, o.value, row_number() OVER (PARTITION BY g.event_id, g.h ORDER BY o.t, o.value) AS rn FROM g JOIN obs o ON o.pid = g.pid AND o.t >= g.t + g.lead),
 s AS (SELECT event_id, max(seen) AS done, {", ".join(f"max(value) FILTER (WHERE h = {i}) AS s{i}" for i in (1, 2, 3))} FROM a WHERE rn = 1 GROUP BY 1 HAVING count(*) = 3),
 cases AS (SELECT x.event_id AS id, x.t, s.done, f1, f2, f3, s1, s2, s3 FROM targets x JOIN s USING (event_id) JOIN f USING (event_id)),
 memory AS (SELECT * FROM cases WHERE done < {SPLIT}),
 med AS (SELECT quantile_cont(f1, 0.5) AS m1, quantile_cont(f2, 0.5) AS m2, quantile_cont(f3, 0.5) AS m3 FROM memory),
 mad AS (SELECT any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, {", ".join(f"quantile_cont(abs(coalesce(f{i}, m{i}, 0) - coalesce(m{i}, 0)), 0.5) AS d{i}" for i in (1, 2, 3))} FROM memory, med),
 z AS (SELECT cases.*, {", ".join(f"(coalesce(f{i}, m{i}, 0) - coalesce(m{i}, 0)) / CASE WHEN d{i} > 1e-6 THEN d{i} ELSE 1 END AS z{i}, CAST(f{i} IS NULL AS DOUBLE) AS n{i}" for i in (1, 2, 3))} FROM cases, mad),
 d AS (SELECT q.id, r.id AS rid, r.s1, r.s2, r.s3, round(sqrt(({" + ".join(f"pow(q.z{i} - r.z{i}, 2) + pow(q.n{i} - r.n{i}, 2)" for i in (1, 2, 3))}) / 6), 6) AS d FROM z q JOIN z r ON q.t >= {SPLIT} AND r.done < {SPLIT}),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, rid) AS rn FROM d) WHERE rn <= 20),
 w AS (SELECT *, exp(-d / greatest(quantile_cont(d, 0.5) OVER (PARTITION BY id) + 0.25, 0.25)) AS w FROM n),
 u AS (SELECT id, w, unnest([1, 2, 3]) AS h, unnest([s1, s2, s3]) AS state FROM w),
 e AS (SELECT id, h, sum(w * state) / sum(w) AS expected, quantile_cont(state, 0.1) AS p10, quantile_cont(state, 0.9) AS p90, sum(w * CAST(state > 50 AS INTEGER)) / sum(w) AS p_high FROM u GROUP BY 1, 2),
 pr AS (SELECT h, avg(CAST(state > 50 AS INTEGER)) AS prior FROM (SELECT unnest([1, 2, 3]) AS h, unnest([s1, s2, s3]) AS state FROM memory) GROUP BY 1),
 asked AS (SELECT id, unnest([1, 2, 3]) AS h, unnest([s1, s2, s3]) AS state FROM cases WHERE t >= {SPLIT}),
 forecast AS (SELECT asked.id, asked.h, state, expected, p10, p90, p_high, prior FROM asked JOIN e ON e.id = asked.id AND e.h = asked.h JOIN pr ON pr.h = asked.h)"""


@query("r10_trajectory_memory", f"WITH {TRAJECTORIES} SELECT id, h, round(expected, 4) AS expected, round(p10, 4) AS p10, round(p90, 4) AS p90, round(p_high, 4) AS p_high FROM forecast")
def r10(spark, sf):
    x = trajectories(trajectory_cases(targets(spark, sf), observations(spark, sf)), SPLIT)
    return x.select("id", "h", *(F.round(c, 4).alias(c) for c in ("expected", "p10", "p90", "p_high")))


def _clipped(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))


@query("v10_trajectory_metrics", f"""WITH {TRAJECTORIES}, m AS (SELECT h, abs(expected - state) AS err, CAST(state > 50 AS INTEGER) AS y, greatest(least(p_high, 1 - 1e-6), 1e-6) AS p, prior FROM forecast)
SELECT h, count(*) AS n, round(avg(err), 4) AS mae, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 4) AS logloss, round(avg(CASE WHEN y = 1 THEN -ln(prior) ELSE -ln(1 - prior) END), 4) AS prior_logloss, round(avg(pow(p - y, 2)), 4) AS brier FROM m GROUP BY 1""")
def v10(spark, sf):
    """Error of the expected state and of its chance to be high, by horizon, beside the prior's."""
    x = trajectories(trajectory_cases(targets(spark, sf), observations(spark, sf)), SPLIT)
    y, p = (F.col("state") > 50).cast("int"), _clipped(F.col("p_high"))
    r4 = lambda c, n: F.round(F.avg(c), 4).alias(n)
    return x.groupBy("h").agg(F.count("*").alias("n"), r4(F.abs(F.col("expected") - F.col("state")), "mae"), r4(log_loss(p, y), "logloss"), r4(log_loss(F.col("prior"), y), "prior_logloss"), r4(brier(p, y), "brier"))


def route_by_memory(rows: DataFrame, memory: DataFrame, k: int = 20, parts: int = 32) -> DataFrame:
    """Probabilities of rows(sport, match_id, p, x) routed by what each expert lost on similar remembered cases.

    memory(sport, x, l) holds a bounded number of rows a sport, which goes to each of the sport's parts.
    x is scaled by the memory's medians and median absolute deviations. The k nearest cases weigh
    exp(-d / (median d + 0.15)); experts weigh exp(-(local loss - best) / 0.15); the mean of the experts
    moves to that mixture as far as the losses differ, the cases are near and the memory supports it.
    """
    out = "sport string, match_id long, base double, routed double, strength double, nearest double"

    def task(frames):
        key, held = None, []
        for f in frames:
            got = []
            for (sport, part), g in f.groupby(["sport", "part"], sort=False):
                if (sport, part) != key:
                    key, held, fit = (sport, part), [], None
                old = g[g.kind == 0]
                held += list(zip(old.x, old.l, strict=True))
                new = g[g.kind == 1]
                if not len(new) or not held:
                    continue
                if fit is None:
                    x, loss = np.stack([v for v, _ in held]), np.stack([v for _, v in held])
                    med = np.median(x, axis=0)
                    mad = np.median(np.abs(x - med), axis=0)
                    mad[~(mad > 1e-6)] = 1.0
                    fit = (x - med) / mad, max(float(np.median(np.abs(loss - np.median(loss, axis=0)))), 0.02)
                z, spread = fit
                p, q = np.stack(list(new.p)), (np.stack(list(new.x)) - med) / mad
                n = min(k, len(z))
                for i in range(len(new)):
                    d = np.round(np.sqrt(((z - q[i]) ** 2).mean(axis=1)), 9)
                    near = np.argsort(d, kind="stable")[:n]
                    w = np.exp(-d[near] / max(float(np.median(d[near])) + 0.15, 0.15))
                    local = (w @ loss[near]) / w.sum()
                    e = np.exp(-(local - local.min()) / 0.15)
                    base, other = p[i].mean(), float(e @ p[i] / e.sum())
                    gap = local.max() - local.min()
                    strength = 0.65 * gap / (gap + spread) * np.exp(-d[near[0]] / 1.5) * np.sqrt(n / len(z))
                    got.append((sport, int(new.match_id.iloc[i]), base, min(max(base + strength * (other - base), 1e-6), 1 - 1e-6), strength, d[near[0]]))
            yield pd.DataFrame(got, columns=[c.split()[0] for c in out.split(", ")])

    empty = F.lit(None)
    a = memory.select("sport", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "seq", empty.cast("long").alias("match_id"), empty.cast("array<double>").alias("p"), "x", "l")
    b = rows.select("sport", F.pmod(F.xxhash64("match_id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "seq", "match_id", "p", "x", empty.cast("array<double>").alias("l"))
    both = a.unionByName(b).repartition("sport", "part").sortWithinPartitions("sport", "part", "kind", "seq")
    return both.mapInPandas(task, out)


def memory_routed(spark, sf: str, most: int = 600) -> DataFrame:
    """Holdout rows (the last 22 % of a sport) routed by the `most` newest rows before them."""
    p = [F.col(f"p{i}") for i in (1, 2, 3)]
    mean = sum(p) / 3
    std = F.sqrt(sum((c - mean) * (c - mean) for c in p) / 3)
    x = predictions(spark, sf).select("sport", "match_id", "seq", "y", F.array(*p).alias("p"), F.array(*p, std).alias("x"), F.array(*(log_loss(c, F.col("y")) for c in p)).alias("l"))
    x = x.join(x.groupBy("sport").agg(F.floor(F.max("seq") * 0.78).alias("cut")), "sport")
    memory = x.where(F.col("seq").between(F.col("cut") - most + 1, F.col("cut")))
    return route_by_memory(x.where("seq > cut"), memory).join(x.select("match_id", "y"), "match_id")


ROUTED = f"""{PREDICTIONS}, b AS (SELECT *, CAST(floor(max(seq) OVER (PARTITION BY sport) * 0.78) AS BIGINT) AS cut, sqrt((pow(p1 - (p1 + p2 + p3) / 3, 2) + pow(p2 - (p1 + p2 + p3) / 3, 2) + pow(p3 - (p1 + p2 + p3) / 3, 2)) / 3) AS p4,
   {", ".join(f"CASE WHEN y = 1 THEN -ln(p{i}) ELSE -ln(1 - p{i}) END AS l{i}" for i in (1, 2, 3))} FROM preds),
 mem AS (SELECT * FROM b WHERE seq > cut - 600 AND seq <= cut),
 med AS (SELECT sport, count(*) AS size, {", ".join(f"median(p{i}) AS m{i}" for i in (1, 2, 3, 4))}, median(l1) AS k1, median(l2) AS k2, median(l3) AS k3 FROM mem GROUP BY 1),
 mad AS (SELECT sport, {", ".join(f"median(abs(p{i} - m{i})) AS d{i}" for i in (1, 2, 3, 4))} FROM mem JOIN med USING (sport) GROUP BY 1),
 spr AS (SELECT sport, greatest(median(abs(l - k)), 0.02) AS spread FROM (SELECT sport, unnest([l1, l2, l3]) AS l, unnest([k1, k2, k3]) AS k FROM mem JOIN med USING (sport)) GROUP BY 1),
 sc AS (SELECT sport, {", ".join(f"CASE WHEN d{i} > 1e-6 THEN d{i} ELSE 1 END AS c{i}" for i in (1, 2, 3, 4))} FROM mad),
 d AS (SELECT q.sport, q.match_id, q.y, q.p1, q.p2, q.p3, r.seq, r.l1, r.l2, r.l3, round(sqrt(({" + ".join(f"pow((q.p{i} - r.p{i}) / c{i}, 2)" for i in (1, 2, 3, 4))}) / 4), 9) AS d FROM b q JOIN mem r ON r.sport = q.sport JOIN sc ON sc.sport = q.sport WHERE q.seq > q.cut),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY d, seq) AS rn FROM d) WHERE rn <= 20),
 w AS (SELECT *, exp(-d / greatest(median(d) OVER (PARTITION BY match_id) + 0.15, 0.15)) AS w FROM n),
 loc AS (SELECT sport, match_id, any_value(y) AS y, any_value(p1) AS p1, any_value(p2) AS p2, any_value(p3) AS p3, min(d) AS d, count(*) AS k, {", ".join(f"sum(w * l{i}) / sum(w) AS l{i}" for i in (1, 2, 3))} FROM w GROUP BY 1, 2),
 ex AS (SELECT *, {", ".join(f"exp(-(l{i} - least(l1, l2, l3)) / 0.15) AS e{i}" for i in (1, 2, 3))}, greatest(l1, l2, l3) - least(l1, l2, l3) AS gap, (p1 + p2 + p3) / 3 AS base FROM loc),
 st AS (SELECT ex.*, 0.65 * gap / (gap + spread) * exp(-d / 1.5) * sqrt(k / size) AS strength, (e1 * p1 + e2 * p2 + e3 * p3) / (e1 + e2 + e3) AS other FROM ex JOIN spr USING (sport) JOIN med USING (sport)),
 routed AS (SELECT sport, match_id, y, base, strength, d AS nearest, greatest(least(base + strength * (other - base), 1 - 1e-6), 1e-6) AS routed FROM st)"""


@query("r3_memory_router", f"WITH {ROUTED} SELECT sport, match_id, round(routed, 5) AS routed, round(strength, 5) AS strength, round(nearest, 5) AS nearest FROM routed")
def r3(spark, sf):
    return memory_routed(spark, sf).select("sport", "match_id", *(F.round(c, 5).alias(c) for c in ("routed", "strength", "nearest")))


@query("r21_router_holdout", f"WITH {ROUTED} SELECT sport, count(*) AS n, round(avg(CASE WHEN y = 1 THEN -ln(base) ELSE -ln(1 - base) END), 5) AS base_logloss, round(avg(CASE WHEN y = 1 THEN -ln(routed) ELSE -ln(1 - routed) END), 5) AS routed_logloss, round(avg(pow(base - y, 2)) - avg(pow(routed - y, 2)), 5) AS brier_gain FROM routed GROUP BY 1")
def r21(spark, sf):
    """What routing by memory gains on the holdout, from memory before it alone."""
    x = memory_routed(spark, sf)
    y = F.col("y")
    r5 = lambda c, n: F.round(c, 5).alias(n)
    return x.groupBy("sport").agg(F.count("*").alias("n"), r5(F.avg(log_loss(F.col("base"), y)), "base_logloss"), r5(F.avg(log_loss(F.col("routed"), y)), "routed_logloss"), r5(F.avg(brier(F.col("base"), y)) - F.avg(brier(F.col("routed"), y)), "brier_gain"))
