"""Routing, retrieval and set summaries over the prediction matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import DAY, MIN, PREDICTIONS, matches, observations, predictions
from ..sources.work import stored
from .evaluation import SETS, prediction_sets
from .predicates import brier, r6
from .sequential import maturing, weighted_replicates
from .windows import LOSSES, in_part, losses, overlapping, own, parted


@query("j15_three_way_time", f"WITH {PREDICTIONS} SELECT m.match_id, o.event_id, p.p1 FROM matches m JOIN preds p ON p.match_id = m.match_id JOIN obs o ON o.event_id = m.match_id AND o.avail // 1000000 <= (m.t + 1800000000) // 1000000")
def j15(spark, sf):
    """Match, prediction and observation, the last generated by half an hour after the match, compared in whole seconds."""
    sec = lambda c: F.floor(c / 1_000_000)
    m = matches(spark, sf).select("match_id", "t").join(predictions(spark, sf).select("match_id", "p1"), "match_id")
    o = observations(spark, sf).select("event_id", F.col("event_id").alias("match_id"), F.col("avail").alias("known"))
    return m.join(o, "match_id").where(sec(F.col("known")) <= sec(F.col("t") + 30 * MIN)).select("match_id", "event_id", "p1")


@query("a13_replay_features", f"WITH {PREDICTIONS}, r AS (SELECT sport, a, p1, row_number() OVER (PARTITION BY sport, a ORDER BY seq DESC) AS rn FROM preds) SELECT sport, a, count(*) AS n, round(avg(p1), 6) AS mean, round(arg_min(p1, rn), 6) AS last, round(CASE WHEN count(*) > 1 THEN stddev_pop(p1) ELSE 0 END, 6) AS std, round(arg_min(p1, rn) - arg_max(p1, rn), 6) AS trend FROM r WHERE rn <= 20 GROUP BY 1, 2")
def a13(spark, sf):
    """The five numbers of a bounded history; for one value std and trend are 0, not missing."""
    r = predictions(spark, sf).select("sport", "a", "p1", F.row_number().over(Window.partitionBy("sport", "a").orderBy(F.desc("seq"))).alias("rn")).where("rn <= 20")
    last, first = F.min_by("p1", "rn"), F.max_by("p1", "rn")
    return r.groupBy("sport", "a").agg(F.count("*").alias("n"), r6(F.avg("p1")).alias("mean"), r6(last).alias("last"), r6(F.when(F.count("*") > 1, F.stddev_pop("p1")).otherwise(0.0)).alias("std"), r6(last - first).alias("trend"))


@query("n2_set_metrics", f"""WITH {SETS}, h AS (SELECT sport, kind, CASE kind WHEN 'SET' THEN 1 WHEN 'SINGLE' THEN CAST((p >= 0.5) = (y = 1) AS INTEGER) ELSE 0 END AS hit, CASE kind WHEN 'SET' THEN 2 WHEN 'SINGLE' THEN 1 ELSE 0 END AS size FROM sets)
SELECT sport, round(avg(hit) FILTER (WHERE kind <> 'ABSTAIN'), 6) AS coverage, round(avg(size) FILTER (WHERE kind <> 'ABSTAIN'), 6) AS mean_size, round(avg(CAST(kind = 'ABSTAIN' AS INTEGER)), 6) AS abstained FROM h GROUP BY 1""")
def n2(spark, sf):
    """Coverage of the sets on rows with a threshold, their mean size, and the share of abstentions."""
    x = maturing(predictions(spark, sf)).withColumn("p", F.col("p1"))
    s = prediction_sets(x).join(x.select("match_id", "y", "p1"), "match_id")
    hit = F.when(F.col("kind") == "SET", 1).when(F.col("kind") == "SINGLE", ((F.col("p1") >= 0.5) == (F.col("y") == 1)).cast("int")).otherwise(0)
    size = F.when(F.col("kind") == "SET", 2).when(F.col("kind") == "SINGLE", 1).otherwise(0)
    on = F.col("kind") != "ABSTAIN"
    return s.groupBy("sport").agg(r6(F.avg(F.when(on, hit))).alias("coverage"), r6(F.avg(F.when(on, size))).alias("mean_size"), r6(F.avg((~on).cast("int"))).alias("abstained"))


@query("r2_reference_context", f"WITH {PREDICTIONS}, r AS (SELECT sport, median(p1) AS m, quantile_cont(p1, 0.75) - quantile_cont(p1, 0.25) AS iqr FROM preds WHERE seq <= 300 GROUP BY 1) SELECT match_id, round((p1 - m) / greatest(iqr, 1e-6), 5) AS z FROM preds JOIN r USING (sport) WHERE seq > 300")
def r2(spark, sf):
    """Later rows against a compact reference of the first 300: one row of statistics a sport."""
    x = predictions(spark, sf)
    q = lambda v: F.percentile("p1", F.lit(v))
    ref = x.where("seq <= 300").groupBy("sport").agg(q(0.5).alias("m"), (q(0.75) - q(0.25)).alias("iqr"))
    return x.where("seq > 300").join(ref, "sport").select("match_id", F.round((F.col("p1") - F.col("m")) / F.greatest("iqr", F.lit(1e-6)), 5).alias("z"))


@query("r8_information_targets", f"WITH {LOSSES} SELECT match_id, round(least(l1, l2, l3), 6) AS best, round((l1 + l2 + l3) / 3 - least(l1, l2, l3), 6) AS value, CASE WHEN l1 <= l2 AND l1 <= l3 THEN 1 WHEN l2 <= l3 THEN 2 ELSE 3 END AS expert FROM losses")
def r8(spark, sf):
    """What asking the best expert would have saved against the mean."""
    a, b, c = (F.col(f"l{i}") for i in (1, 2, 3))
    best = F.least(a, b, c)
    return losses(spark, sf).select("match_id", r6(best).alias("best"), r6((a + b + c) / 3 - best).alias("value"), F.when((a <= b) & (a <= c), 1).when(b <= c, 2).otherwise(3).alias("expert"))


@query("r9_retrieval_features", f"""WITH {PREDICTIONS}, j AS (SELECT x.sport, x.match_id, z.seq, z.y, x.p1 - z.p1 AS d1, x.p2 - z.p2 AS d2, x.p3 - z.p3 AS d3, z.p1 AS z1, z.p2 AS z2, z.p3 AS z3 FROM preds x JOIN preds z ON z.sport = x.sport AND z.seq < x.seq AND z.seq >= x.seq - 120),
 k AS (SELECT *, count(*) OVER w AS n, {", ".join(f"greatest(stddev_pop(z{i}) OVER w, 1e-6) AS s{i}" for i in (1, 2, 3))} FROM j WINDOW w AS (PARTITION BY match_id)),
 r AS (SELECT sport, match_id, y, row_number() OVER (PARTITION BY match_id ORDER BY round(sqrt((pow(d1 / s1, 2) + pow(d2 / s2, 2) + pow(d3 / s3, 2)) / 3), 9), seq) AS nr FROM k WHERE n >= 20)
SELECT sport, match_id, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std FROM r WHERE nr <= 5 GROUP BY 1, 2""")
def r9(spark, sf):
    """Mean and spread of the outcomes of the 5 nearest of the 120 rows before (models' probabilities, scaled by those rows); parts of a sport run in parallel, each led by 120 rows."""

    def task(frames):
        key, past = None, []
        for f in frames:
            rows = []
            for s, part, own, i, y, p in zip(f.sport, f.part, f.own, f.match_id, f.y, f[["p1", "p2", "p3"]].to_numpy(), strict=True):
                if (s, part) != key:
                    key, past = (s, part), []
                if own and len(past) >= 20:
                    x = np.array([v for v, _ in past])
                    d = np.round(np.sqrt((((x - p) / np.maximum(x.std(0), 1e-6)) ** 2).mean(1)), 9)
                    near = np.array([past[j][1] for j in np.argsort(d, kind="stable")[:5]])
                    rows.append((s, i, float(near.mean()), float(near.std())))
                past = [*past[-119:], (p, y)]
            yield pd.DataFrame(rows, columns=["sport", "match_id", "mean", "std"])

    x = overlapping(predictions(spark, sf).select("sport", "seq", "match_id", "y", "p1", "p2", "p3"), 5000, 120)
    x = x.repartition("sport", "part").sortWithinPartitions("sport", "part", "seq")
    return x.mapInPandas(task, "sport string, match_id long, mean double, std double").select("sport", "match_id", r6("mean").alias("mean"), r6("std").alias("std"))


@query("r15_horizon_change", f"WITH {PREDICTIONS}, h AS (SELECT a, CASE WHEN seq % 2 = 0 THEN 'T90' ELSE 'T60' END AS horizon, avg(p1) AS p, count(*) AS n FROM preds GROUP BY 1, 2) SELECT x.a, round(x.p, 6) AS p90, round(y.p, 6) AS p60, round(y.p - x.p, 6) AS change, y.n - x.n AS more FROM h x JOIN h y ON y.a = x.a AND x.horizon = 'T90' AND y.horizon = 'T60'")
def r15(spark, sf):
    """Two horizons' features side by side, by conditional aggregates instead of a self-join."""
    late = F.col("seq") % 2 == 0
    g = predictions(spark, sf).groupBy("a").agg(F.avg(F.when(late, F.col("p1"))).alias("x"), F.avg(F.when(~late, F.col("p1"))).alias("y"), F.count_if(late).alias("nx"), F.count_if(~late).alias("ny")).where("nx > 0 AND ny > 0")
    return g.select("a", r6("x").alias("p90"), r6("y").alias("p60"), r6(F.col("y") - F.col("x")).alias("change"), (F.col("ny") - F.col("nx")).alias("more"))


@query("r17_timing_route", f"WITH {PREDICTIONS}, l AS (SELECT sport, (t // 60000000) % 4 AS lead, pow(p1 - y, 2) AS b, pow(p2 - y, 2) AS base, ntile(5) OVER (PARTITION BY sport, (t // 60000000) % 4 ORDER BY seq) AS block FROM preds), k AS (SELECT sport, lead, block, avg(base) - avg(b) AS gain FROM l GROUP BY 1, 2, 3), g AS (SELECT sport, lead, avg(gain) AS gain, count(*) FILTER (WHERE gain >= 0) AS good FROM k GROUP BY 1, 2) SELECT sport, lead, round(gain, 6) AS gain, good, good >= 3 AND gain > 0 AS usable FROM g")
def r17(spark, sf):
    """Leads by their paired gain over a baseline in five chronological blocks."""
    lead, y = F.floor(F.col("t") / MIN) % 4, F.col("y")
    x = predictions(spark, sf).withColumn("lead", lead)
    x = x.select("sport", "lead", brier(F.col("p1"), y).alias("b"), brier(F.col("p2"), y).alias("base"), F.ntile(5).over(Window.partitionBy("sport", "lead").orderBy("seq")).alias("block"))
    k = x.groupBy("sport", "lead", "block").agg((F.avg("base") - F.avg("b")).alias("gain"))
    g = k.groupBy("sport", "lead").agg(F.avg("gain").alias("gain"), F.count_if(F.col("gain") >= 0).alias("good"))
    return g.select("sport", "lead", r6("gain").alias("gain"), "good", ((F.col("good") >= 3) & (F.col("gain") > 0)).alias("usable"))


@query("v12_difficulty_labels", f"WITH {LOSSES}, f AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(l1) OVER w END AS future FROM losses WINDOW w AS (PARTITION BY sport ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)), q AS (SELECT sport, quantile_cont(future, 0.7) AS hard FROM f WHERE seq <= 400 GROUP BY 1) SELECT match_id, CAST(round(future, 9) >= round(hard, 9) AS INT) AS hard FROM f JOIN q USING (sport) WHERE seq > 400")
def v12(spark, sf):
    """Hard futures by a threshold from the training prefix alone."""
    w = in_part().rowsBetween(1, 5)
    f = own(parted(losses(spark, sf), 0, 5).withColumn("future", F.when(F.count("*").over(w) == 5, F.avg("l1").over(w))))
    q = f.where("seq <= 400").groupBy("sport").agg(F.percentile("future", F.lit(0.7)).alias("least"))
    return f.where("seq > 400").join(q, "sport").select("match_id", (F.round("future", 9) >= F.round("least", 9)).cast("int").alias("hard"))


@query("b2_cluster_bootstrap")
def b2(spark, sf):
    """Bootstrap by participant: clusters are summed in Spark, then weighted."""
    d = losses(spark, sf).groupBy("a").agg(F.sum(F.col("l1") - F.col("l3")).alias("s"), F.count("*").alias("n"))
    r = weighted_replicates(d.select(F.lit("all").alias("whole"), F.col("a").alias("block"), "s", "n"), "whole", F.lit(1.0), 200, 5)
    return r.agg(*(F.round(F.percentile("value", F.lit(q)), 4).alias(c) for q, c in ((0.025, "low"), (0.5, "mid"), (0.975, "high"))))


@query("d2x_uncertainty_worlds", None)
def d2x(spark, sf):
    """Beta worlds of each sport's accuracy from its counts; the seed is the world's number."""
    c = predictions(spark, sf).groupBy("sport").agg(F.sum("y").alias("k"), F.count("*").alias("n"))

    def task(frames):
        for f in frames:
            v = [float(np.random.default_rng([int(w), int(n)]).beta(1 + k, 1 + n - k)) for w, k, n in zip(f.world, f.k, f.n, strict=True)]
            yield pd.DataFrame({"sport": f.sport, "world": f.world, "p": np.round(v, 6)})

    return c.select("sport", "k", "n", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("world")).mapInPandas(task, "sport string, world long, p double")


@query("r16_competition_route", f"""WITH {PREDICTIONS}, x AS (SELECT sport, t // 604800000000 AS competition, pow(p1 - y, 2) AS own, pow(p2 - y, 2) AS base, ntile(5) OVER (PARTITION BY sport, t // 604800000000 ORDER BY seq) AS fold FROM preds),
 f AS (SELECT sport, competition, fold, count(*) AS n, sum(own) AS own, sum(base) AS base FROM x GROUP BY 1, 2, 3),
 g AS (SELECT sport, competition, count(*) AS folds, sum(n) AS n, sum(own) / sum(n) AS own, sum(base) / sum(n) AS base, count(*) FILTER (WHERE own / n <= base / n + 1e-12) AS good FROM f GROUP BY 1, 2)
SELECT sport, competition, CAST(n AS BIGINT) AS n, round((base - own) / base, 5) AS gain, good, folds = 5 AND (base - own) / base >= 0.03 AND good >= 0.7 * folds AS accepted FROM g""")
def r16(spark, sf):
    """A competition gets a route of its own if the Brier score falls by 3 % and at least 70 % of five chronological folds aren't worse."""
    y = F.col("y")
    x = predictions(spark, sf).withColumn("competition", F.floor(F.col("t") / (7 * DAY)))
    fold = F.ntile(5).over(Window.partitionBy("sport", "competition").orderBy("seq"))
    f = x.select("sport", "competition", brier(F.col("p1"), y).alias("own"), brier(F.col("p2"), y).alias("base"), fold.alias("fold"))
    f = f.groupBy("sport", "competition", "fold").agg(F.count("*").alias("n"), F.sum("own").alias("own"), F.sum("base").alias("base"))
    g = f.groupBy("sport", "competition").agg(F.count("*").alias("folds"), F.sum("n").alias("n"), (F.sum("own") / F.sum("n")).alias("own"), (F.sum("base") / F.sum("n")).alias("base"), F.count_if(F.col("own") / F.col("n") <= F.col("base") / F.col("n") + 1e-12).alias("good"))
    gain = (F.col("base") - F.col("own")) / F.col("base")
    return g.select("sport", "competition", "n", F.round(gain, 5).alias("gain"), "good", ((F.col("folds") == 5) & (gain >= 0.03) & (F.col("good") >= 0.7 * F.col("folds"))).alias("accepted"))


def _parted(spark, sf):
    """The prediction matrix with losses and each row's place in its sport, from 0 to 1."""
    x = losses(spark, sf)
    return x.join(x.groupBy("sport").agg(F.max("seq").alias("n")), "sport").withColumn("part", F.col("seq") / F.col("n"))


@query("r4_loss_selector")
def r4(spark, sf):
    """Holdout rows routed by the losses that a regression per expert expects from the context: experts weigh exp(-loss / 0.15), shrunk by a quarter to equal weights, and the mean moves to that mixture as far as the losses spread."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    gap = F.greatest("p1", "p2", "p3") - F.least("p1", "p2", "p3")
    context = stored(_parted(spark, sf).select("sport", "match_id", "part", "p1", "p2", "p3", "l1", "l2", "l3", gap.alias("gap")), "context")  # read by each fit, many times
    x = VectorAssembler(inputCols=["p1", "p2", "p3", "gap"], outputCol="features").transform(context)
    train, rows = x.where("part <= 0.78"), x.where("part > 0.78")
    for i in (1, 2, 3):
        rows = GBTRegressor(labelCol=f"l{i}", predictionCol=f"e{i}", maxIter=5, maxDepth=3, seed=7).fit(train).transform(rows)
    best, worst = F.least("e1", "e2", "e3"), F.greatest("e1", "e2", "e3")
    raw = [F.exp(-(F.col(f"e{i}") - best) / 0.15) for i in (1, 2, 3)]
    w = [0.75 * r / sum(raw) + 0.25 / 3 for r in raw]
    p = [F.col(f"p{i}") for i in (1, 2, 3)]
    mean, other = sum(p) / 3, sum(a * b for a, b in zip(w, p, strict=True))
    strength = 0.75 * (worst - best) / (worst - best + 0.1)
    return rows.select("sport", "match_id", F.round(mean + strength * (other - mean), 5).alias("p"), F.round(strength, 5).alias("strength"))
