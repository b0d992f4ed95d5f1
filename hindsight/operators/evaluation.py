"""Metrics, folds, calibration, prediction sets, retrieval, routing and gates over the prediction matrix."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import OBS, PREDICTIONS, observations, predictions, table
from ..sources.store import Store, freeze, with_holdout
from ..sources.work import work_dir
from .aggregates import LEDGER, ledger
from .predicates import brier, r6
from .sequential import Pool, in_order, matured, maturing
from .windows import LOSSES, by_seq, in_part, losses, own, part_of, parted, sized


@query("v1_metric_set", f"WITH {LEDGER} SELECT sport, count(*) AS n, round(avg(ll), 6) AS logloss, round(avg(br), 6) AS brier, round(avg(ok), 6) AS accuracy FROM ledger GROUP BY 1")
def v1(spark, sf):
    return ledger(spark, sf).groupBy("sport").agg(F.count("*").alias("n"), r6(F.avg("ll")).alias("logloss"), r6(F.avg("br")).alias("brier"), r6(F.avg("ok")).alias("accuracy"))


def calibration_error(rows: DataFrame, group: str, bin_: Column) -> DataFrame:
    """Expected calibration error per group over bins of p1; rows whose bin is null count in the total only."""
    b = rows.groupBy(group, bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("p1").alias("p"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("y") / F.col("n") - F.col("p") / F.col("n")) * F.col("n")).otherwise(0)
    return b.groupBy(group).agg(r6(F.sum(gap) / F.sum("n")).alias("ece"))


@query("v2_ece_gapped", f"WITH {PREDICTIONS}, b AS (SELECT sport, y, p1, CASE WHEN p1 >= 0.9 THEN 9 ELSE CASE WHEN p1 < floor(p1 * 10) / 9 AND floor(p1 * 10) >= 1 THEN CAST(floor(p1 * 10) AS INT) END END AS bin FROM preds), g AS (SELECT sport, bin, count(*) AS n, abs(avg(y) - avg(p1)) AS gap FROM b GROUP BY 1, 2) SELECT sport, round(sum(CASE WHEN bin IS NOT NULL THEN n * gap ELSE 0 END) / sum(n), 6) AS ece FROM g GROUP BY 1")
def v2(spark, sf):
    """The gapped variant: only p in [i/10, i/9) for i of 1 to 8, and 0.9 and more."""
    i = F.floor(F.col("p1") * 10)
    bin_ = F.when(F.col("p1") >= 0.9, 9).when((i >= 1) & (F.col("p1") < i / 9), i)
    return calibration_error(predictions(spark, sf), "sport", bin_)


@query("v3_ece_ten_bins", f"WITH {PREDICTIONS}, g AS (SELECT sport, least(floor(p1 * 10), 9) AS bin, count(*) AS n, abs(avg(y) - avg(p1)) AS gap FROM preds GROUP BY 1, 2) SELECT sport, round(sum(n * gap) / sum(n), 6) AS ece FROM g GROUP BY 1")
def v3(spark, sf):
    return calibration_error(predictions(spark, sf), "sport", F.least(F.floor(F.col("p1") * 10), F.lit(9)))


@query("v4_confidence_coverage", f"WITH {LEDGER} SELECT sport, h AS threshold, round(avg(CAST(greatest(p1, 1 - p1) >= h AS INT)), 6) AS coverage, round(avg(ok) FILTER (WHERE greatest(p1, 1 - p1) >= h), 6) AS accuracy FROM ledger, (VALUES (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE)) v(h) GROUP BY 1, 2")
def v4(spark, sf):
    x = ledger(spark, sf).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.6, 0.7, 0.8)))))
    sure = F.greatest("p1", 1 - F.col("p1")) >= F.col("threshold")
    return x.groupBy("sport", "threshold").agg(r6(F.avg(sure.cast("int"))).alias("coverage"), r6(F.avg(F.when(sure, F.col("ok")))).alias("accuracy"))


@query("v5_stability", f"WITH {PREDICTIONS}, d AS (SELECT sport, abs(p1 - lag(p1) OVER (PARTITION BY sport ORDER BY seq)) AS d FROM preds) SELECT sport, round(1 - avg(d), 6) AS stability FROM d GROUP BY 1")
def v5(spark, sf):
    d = own(parted(predictions(spark, sf), 1).select("own", "sport", F.abs(F.col("p1") - F.lag("p1").over(in_part())).alias("d")))
    return d.groupBy("sport").agg(r6(1 - F.avg("d")).alias("stability"))


@query("v6_auc", f"WITH {PREDICTIONS}, r AS (SELECT sport, y, rank() OVER (PARTITION BY sport ORDER BY round(p3, 9)) + (count(*) OVER (PARTITION BY sport, round(p3, 9)) - 1) / 2 AS r FROM preds) SELECT sport, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY 1")
def v6(spark, sf):
    """Area under the ROC curve from mid-ranks; probabilities are first counted per value, so ranks are sums over distinct values."""
    g = predictions(spark, sf).groupBy("sport", F.round("p3", 9).alias("p")).agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("sport").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = g.withColumn("rank", below + (F.col("n") + 1) / 2)
    pos, all_ = F.sum("k"), F.sum("n")
    return r.groupBy("sport").agg(r6((F.sum(F.col("rank") * F.col("k")) - pos * (pos + 1) / 2) / (pos * (all_ - pos))).alias("auc"))


@query("v7_calibration_drift", f"WITH {PREDICTIONS}, h AS (SELECT sport, y, p1, seq > count(*) OVER (PARTITION BY sport) // 2 AS late FROM preds) SELECT sport, round(abs(avg(y) FILTER (WHERE late) - avg(p1) FILTER (WHERE late)) - abs(avg(y) FILTER (WHERE NOT late) - avg(p1) FILTER (WHERE NOT late)), 6) AS drift FROM h GROUP BY 1")
def v7(spark, sf):
    h = predictions(spark, sf).withColumn("late", F.col("seq") > F.floor(F.count("*").over(Window.partitionBy("sport")) / 2))
    gap = lambda m: F.abs(F.avg(F.when(m, F.col("y"))) - F.avg(F.when(m, F.col("p1"))))
    return h.groupBy("sport").agg(r6(gap(F.col("late")) - gap(~F.col("late"))).alias("drift"))


@query("v8_error_correlation", f"WITH {PREDICTIONS} SELECT sport, round(corr(p1 - y, p2 - y), 6) AS c12, round(corr(p1 - y, p3 - y), 6) AS c13, round(corr(p2 - y, p3 - y), 6) AS c23 FROM preds GROUP BY 1")
def v8(spark, sf):
    e = lambda i: F.col(f"p{i}") - F.col("y")
    return predictions(spark, sf).groupBy("sport").agg(*(r6(F.corr(e(i), e(j))).alias(f"c{i}{j}") for i, j in ((1, 2), (1, 3), (2, 3))))


@query("v9_selective_ablation", f"WITH {LEDGER}, m AS (SELECT *, unnest(['all', 'sure', 'agree']) AS policy FROM ledger) SELECT sport, policy, count(*) AS n, round(avg(br), 6) AS brier FROM m WHERE policy = 'all' OR policy = 'sure' AND greatest(p1, 1 - p1) >= 0.7 OR policy = 'agree' AND (p1 >= 0.5) = (p2 >= 0.5) GROUP BY 1, 2 HAVING count(*) >= 20")
def v9(spark, sf):
    m = F.array(F.lit("all"), F.when(F.greatest("p1", 1 - F.col("p1")) >= 0.7, "sure"), F.when((F.col("p1") >= 0.5) == (F.col("p2") >= 0.5), "agree"))
    return ledger(spark, sf).withColumn("policy", F.explode(F.array_compact(m))).groupBy("sport", "policy").agg(F.count("*").alias("n"), r6(F.avg("br")).alias("brier")).where("n >= 20")


@query("v13_channel_value", f"WITH {PREDICTIONS}, b AS (SELECT *, pow((p1 + p2 + p3) / 3 - y, 2) AS full_ FROM preds), u AS (SELECT sport, unnest(['m1', 'm2', 'm3']) AS model, unnest([pow((p2 + p3) / 2 - y, 2), pow((p1 + p3) / 2 - y, 2), pow((p1 + p2) / 2 - y, 2)]) - full_ AS gain FROM b) SELECT sport, model, round(avg(gain), 6) AS value FROM u GROUP BY 1, 2")
def v13(spark, sf):
    """What leaving a model out of the mean costs in Brier score."""
    all_ = F.array("p1", "p2", "p3")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    without = lambda i: F.array(*(f"p{j}" for j in (1, 2, 3) if j != i))
    rows = F.array(*(F.struct(F.lit(f"m{i}").alias("model"), (brier(mean(without(i)), F.col("y")) - brier(mean(all_), F.col("y"))).alias("gain")) for i in (1, 2, 3)))
    return predictions(spark, sf).select("sport", F.explode(rows).alias("r")).groupBy("sport", "r.model").agg(r6(F.avg("r.gain")).alias("value"))


@query("v14_robustness", f"WITH {PREDICTIONS} SELECT sport, round(avg(CAST((p1 + 0.02 >= 0.5) <> (p1 >= 0.5) OR (p1 - 0.02 >= 0.5) <> (p1 >= 0.5) AS INT)), 6) AS shift_flips, round(avg(CAST(((p2 + p3) / 2 >= 0.5) <> ((p1 + p2 + p3) / 3 >= 0.5) AS INT)), 6) AS dropout_flips FROM preds GROUP BY 1")
def v14(spark, sf):
    p, q, s = (F.col(f"p{i}") for i in (1, 2, 3))
    up = lambda c: c >= 0.5
    return predictions(spark, sf).groupBy("sport").agg(r6(F.avg(((up(p + 0.02) != up(p)) | (up(p - 0.02) != up(p))).cast("int"))).alias("shift_flips"), r6(F.avg((up((q + s) / 2) != up((p + q + s) / 3)).cast("int"))).alias("dropout_flips"))


@query("v11_fold_research", f"""WITH {LEDGER}, x AS (SELECT *, (seq - 1) // 150 AS fold, greatest(p1, p2, p3) - least(p1, p2, p3) AS gap, coalesce((p1 >= 0.5) <> (lag(p1) OVER (PARTITION BY sport ORDER BY seq) >= 0.5), false) AS flip FROM ledger),
 f AS (SELECT sport, fold, count(*) AS n, avg(ll) AS ll, avg(br) AS br, avg(ok) AS acc, quantile_cont(gap, 0.95) AS hi, quantile_cont(gap, 0.1) AS lo, count(*) FILTER (WHERE flip) AS flips FROM x GROUP BY 1, 2)
SELECT sport, CAST(fold AS BIGINT) AS fold, n, round(ll, 6) AS logloss, round(br, 6) AS brier, round(acc, 6) AS accuracy, round(hi, 6) AS gap_p95, round(lo, 6) AS gap_p10, flips, round(ll, 9) = max(round(ll, 9)) OVER (PARTITION BY sport) AS worst FROM f""")
def v11(spark, sf):
    """Per block of 150 rows: metrics, the spread of the models' disagreement, flips of the call, and whether it's the sport's worst."""
    flip = F.coalesce((F.col("p1") >= 0.5) != (F.lag("p1").over(in_part()) >= 0.5), F.lit(False))
    x = parted(ledger(spark, sf), 1).withColumns({"fold": F.floor((F.col("seq") - 1) / 150), "gap": F.greatest("p1", "p2", "p3") - F.least("p1", "p2", "p3"), "flip": flip})
    x = own(x)
    q = lambda v: r6(F.percentile("gap", F.lit(v)))
    f = x.groupBy("sport", "fold").agg(F.count("*").alias("n"), F.avg("ll").alias("ll"), r6(F.avg("br")).alias("brier"), r6(F.avg("ok")).alias("accuracy"), q(0.95).alias("gap_p95"), q(0.1).alias("gap_p10"), F.count_if("flip").alias("flips"))
    worst = F.round("ll", 9) == F.max(F.round("ll", 9)).over(Window.partitionBy("sport"))
    return f.select("sport", "fold", "n", r6("ll").alias("logloss"), "brier", "accuracy", "gap_p95", "gap_p10", "flips", worst.alias("worst"))


def walk_forward(rows: DataFrame, start: int, step: int, group: str = "sport", seq: str = "seq") -> DataFrame:
    """(group, fold, train_end, test_start, test_end) of expanding folds: train on rows before train_end, test on the next `step`."""
    n = rows.groupBy(group).agg(F.max(seq).alias("n")).where(F.col("n") > start)
    return n.select(group, "n", F.posexplode(F.sequence(F.lit(start), F.col("n") - 1, F.lit(step))).alias("fold", "train_end")).select(group, "fold", "train_end", (F.col("train_end") + 1).alias("test_start"), F.least(F.col("train_end") + step, "n").alias("test_end"))


@query("f1_walk_forward", f"WITH {LEDGER}, f AS (SELECT sport, unnest(range(200, max(seq), 150)) AS e FROM ledger GROUP BY sport) SELECT f.sport, f.e AS train_end, count(*) AS n, round(avg(ll), 6) AS logloss FROM f JOIN ledger l ON l.sport = f.sport AND l.seq > f.e AND l.seq <= f.e + 150 GROUP BY 1, 2")
def f1(spark, sf):
    """Test metrics per fold; test blocks don't overlap, so a row finds its fold by arithmetic and no range join is needed."""
    x = ledger(spark, sf).where("seq > 200")
    end = 200 + F.floor((F.col("seq") - 201) / 150) * 150
    return x.groupBy("sport", end.alias("train_end")).agg(F.count("*").alias("n"), r6(F.avg("ll")).alias("logloss"))


@query("f2_split_blocks", f"WITH {PREDICTIONS}, b AS (SELECT sport, seq, ntile(7) OVER (PARTITION BY sport ORDER BY seq) AS block FROM preds) SELECT sport, block, count(*) AS n, min(seq) AS first FROM b GROUP BY 1, 2")
def f2(spark, sf):
    b = sized(predictions(spark, sf)).select("sport", "seq", (part_of(F.col("seq"), F.col("n"), 7) + 1).alias("block"))
    return b.groupBy("sport", "block").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@query("f3_frozen_holdout", f"WITH {PREDICTIONS}, n AS (SELECT *, count(*) OVER (PARTITION BY sport) AS n FROM preds) SELECT match_id, seq > CAST(floor(n * 0.78) AS BIGINT) AS holdout FROM n WHERE n >= 120 AND n - floor(n * 0.78) >= 30")
def f3(spark, sf):
    x = predictions(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("sport")))
    cut = F.floor(F.col("n") * 0.78)
    return x.where((F.col("n") >= 120) & (F.col("n") - cut >= 30)).select("match_id", (F.col("seq") > cut).alias("holdout"))


@query("f3_persisted_holdout", f"""WITH {PREDICTIONS}, early AS (SELECT *, count(*) OVER (PARTITION BY sport) AS n FROM preds WHERE match_id % 5 <> 0 OR seq <= 60),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY sport ORDER BY seq) AS i FROM early),
 frozen AS (SELECT sport, match_id FROM ranked WHERE n >= 60 AND n - floor(n * 0.78) >= 12 AND i > floor(n * 0.78))
 SELECT sport, match_id, match_id IN (SELECT match_id FROM frozen) AS holdout FROM preds WHERE sport IN (SELECT sport FROM frozen)""")
def f3_persisted(spark, sf):
    """A holdout frozen on the rows of a first run; a second run with more rows finds the same ids held out."""
    x = predictions(spark, sf).select("sport", "match_id", "seq")
    first = x.where("match_id % 5 <> 0 OR seq <= 60").withColumn("seq", F.row_number().over(by_seq()))
    store = freeze(Store(spark, work_dir(spark, "holdout")), first, least=60, least_holdout=12)
    return with_holdout(freeze(store, x, least=60, least_holdout=12), x).select("sport", "match_id", "holdout")


@query("f4_canonical_cases", f"WITH {PREDICTIONS} SELECT a, match_id FROM (SELECT a, match_id, row_number() OVER (PARTITION BY a ORDER BY t, match_id) AS rn FROM preds) WHERE rn = 1")
def f4(spark, sf):
    return predictions(spark, sf).groupBy("a").agg(F.min(F.struct("t", "match_id")).alias("m")).select("a", "m.match_id")


@query("f5_window_signature", f"WITH {PREDICTIONS}, f AS (SELECT sport, unnest(range(200, max(seq), 150)) AS e, max(seq) AS n FROM preds GROUP BY sport) SELECT sport, sha256(string_agg((e - 200) // 150 || ':' || (e + 1) || ':' || least(e + 150, n), ',' ORDER BY (e - 200) // 150 || ':' || (e + 1) || ':' || least(e + 150, n))) AS signature FROM f GROUP BY 1")
def f5(spark, sf):
    f = walk_forward(predictions(spark, sf), 200, 150)
    s = F.concat_ws(":", "fold", "test_start", "test_end")
    return f.groupBy("sport").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(s)), ","), 256).alias("signature"))


@query("f6_regime_slices", f"WITH {LEDGER}, m AS (SELECT sport, median(p2) AS m, avg(ll) AS base FROM ledger GROUP BY 1), s AS (SELECT l.sport, l.p2 > m.m AS high, avg(l.ll) AS ll, any_value(m.base) AS base FROM ledger l JOIN m USING (sport) GROUP BY 1, 2 HAVING count(*) >= 20) SELECT sport, round(max(ll - base), 6) AS worst_excess FROM s GROUP BY 1")
def f6(spark, sf):
    x = ledger(spark, sf)
    m = x.groupBy("sport").agg(F.percentile("p2", F.lit(0.5)).alias("m"), F.avg("ll").alias("base"))
    s = x.join(m, "sport").groupBy("sport", (F.col("p2") > F.col("m")).alias("high")).agg(F.avg("ll").alias("ll"), F.first("base").alias("base"), F.count("*").alias("n")).where("n >= 20")
    return s.groupBy("sport").agg(r6(F.max(F.col("ll") - F.col("base"))).alias("worst_excess"))


@query("f7_robust_objective", f"WITH {LEDGER}, b AS (SELECT sport, ntile(3) OVER (PARTITION BY sport ORDER BY seq) AS k, ll FROM ledger), m AS (SELECT sport, k, avg(ll) AS m FROM b GROUP BY 1, 2) SELECT sport, round(sum(m * CASE k WHEN 1 THEN 0.2 WHEN 2 THEN 0.3 ELSE 0.5 END) + 0.1 * stddev_pop(m), 6) AS objective FROM m GROUP BY 1")
def f7(spark, sf):
    m = sized(ledger(spark, sf)).withColumn("k", part_of(F.col("seq"), F.col("n"), 3) + 1).groupBy("sport", "k").agg(F.avg("ll").alias("m"))
    w = F.when(F.col("k") == 1, 0.2).when(F.col("k") == 2, 0.3).otherwise(0.5)
    return m.groupBy("sport").agg(r6(F.sum(F.col("m") * w) + 0.1 * F.stddev_pop("m")).alias("objective"))


def applied_sigmoid(p: Column, a: float, b: float) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return 1 / (1 + F.exp(-(a * F.ln(q / (1 - q)) + b)))


def applied_beta(p: Column, a: float, b: float, c: float) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return 1 / (1 + F.exp(-(a * F.ln(q) - b * F.ln(1 - q) + c)))


def applied_isotonic(p: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between the knots, flat beyond them."""
    out = F.when(p <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(p <= x1, y0 + (p - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(F.lit(knots[-1][1]))


KNOTS = [(0.1, 0.2), (0.4, 0.35), (0.6, 0.35), (0.9, 0.8)]


@query("c3_apply_calibrator", f"""WITH {PREDICTIONS} SELECT match_id, round(1 / (1 + exp(-(0.8 * ln(p1 / (1 - p1)) + 0.1))), 6) AS sigmoid, round(1 / (1 + exp(-(0.9 * ln(p1) - 0.7 * ln(1 - p1) + 0.2))), 6) AS beta,
 round(CASE WHEN p1 <= 0.1 THEN 0.2 WHEN p1 <= 0.4 THEN 0.2 + (p1 - 0.1) / 0.3 * 0.15 WHEN p1 <= 0.6 THEN 0.35 WHEN p1 <= 0.9 THEN 0.35 + (p1 - 0.6) / 0.3 * 0.45 ELSE 0.8 END::DOUBLE, 5) AS isotonic FROM preds""")
def c3(spark, sf):
    p = F.col("p1")
    return predictions(spark, sf).select("match_id", r6(applied_sigmoid(p, 0.8, 0.1)).alias("sigmoid"), r6(applied_beta(p, 0.9, 0.7, 0.2)).alias("beta"), F.round(applied_isotonic(p, KNOTS), 5).alias("isotonic"))


def prediction_sets(rows: DataFrame, alpha: float = 0.2, last: int = 240, least: int = 30) -> DataFrame:
    """Split conformal sets from labels that were known: per row the `last` newest matured earlier rows give the score threshold.

    rows(sport, match_id, t, mature, y, p). A label that is mature at the row's time counts, one of the
    same time doesn't. A streaming pass per sport holds the `last` newest matured scores.
    """
    out = "sport string, match_id long, n long, kind string"

    def task(frames):
        sport, pool = None, Pool(last)
        for f in frames:
            got = []
            for s, i, t, kind, y, p in zip(f.sport, f.match_id, f.t, f.kind, f.y, f.p, strict=True):
                if s != sport:
                    sport, pool = s, Pool(last)
                if kind == 0:
                    pool.add(t, i, 1 - p if y == 1 else p)
                    continue
                n = len(pool.rows)
                if n < least:
                    got.append((s, i, n, "ABSTAIN"))
                    continue
                q = sorted(x for *_, x in pool.rows)[min(n, math.ceil((n + 1) * (1 - alpha))) - 1]
                size = (p >= 1 - q - 1e-12) + (1 - p >= 1 - q - 1e-12)
                got.append((s, i, n, "SINGLE" if size == 1 else "SET" if size else "EMPTY"))
            yield pd.DataFrame(got, columns=["sport", "match_id", "n", "kind"])

    return in_order(matured(rows, "y", "p")).mapInPandas(task, out)


SETS = f"""{PREDICTIONS}, s AS (SELECT *, greatest(t + 86400000000, avail) AS mature, CASE WHEN y = 1 THEN 1 - p1 ELSE p1 END AS score FROM preds),
 j AS (SELECT x.match_id, x.sport, x.p1, x.y, z.score, row_number() OVER (PARTITION BY x.match_id ORDER BY z.t DESC, z.match_id DESC) AS rn FROM s x LEFT JOIN s z ON z.sport = x.sport AND z.mature <= x.t AND z.t < x.t),
 q AS (SELECT match_id, any_value(sport) AS sport, any_value(p1) AS p, any_value(y) AS y, count(score) AS n, list_sort(list(score) FILTER (WHERE score IS NOT NULL)) AS l FROM j WHERE rn <= 240 GROUP BY 1),
 z AS (SELECT *, l[least(n, CAST(ceil((n + 1) * 0.8) AS BIGINT))] AS q FROM q),
 sets AS (SELECT sport, match_id, n, y, p, CASE WHEN n < 30 THEN 'ABSTAIN' WHEN (p >= 1 - q - 1e-12)::INT + (1 - p >= 1 - q - 1e-12)::INT = 1 THEN 'SINGLE' WHEN (p >= 1 - q - 1e-12)::INT + (1 - p >= 1 - q - 1e-12)::INT = 2 THEN 'SET' ELSE 'EMPTY' END AS kind FROM z)"""


@query("n1_prediction_sets", f"WITH {SETS} SELECT sport, match_id, n, kind FROM sets")
def n1(spark, sf):
    return prediction_sets(maturing(predictions(spark, sf)).withColumn("p", F.col("p1")))


@query("n4_weighted_vote", f"WITH {PREDICTIONS}, v AS (SELECT match_id, 0.5 * (p1 >= 0.5)::INT + 0.3 * (p2 >= 0.5)::INT + 0.2 * (p3 >= 0.5)::INT AS b FROM preds) SELECT match_id, CASE WHEN 1 - b >= 0.4 AND b >= 0.4 THEN 'A,B' WHEN b >= 0.4 THEN 'B' ELSE 'A' END AS voted FROM v".replace("0.5 * (p1", "0.5::DOUBLE * (p1"))
def n4(spark, sf):
    """Labels whose models' weights reach the least vote."""
    rows = F.array(*(F.struct(F.when(F.col(f"p{i}") >= 0.5, "B").otherwise("A").alias("label"), F.lit(w).alias("w")) for i, w in ((1, 0.5), (2, 0.3), (3, 0.2))))
    v = predictions(spark, sf).select("match_id", F.explode(rows).alias("r")).groupBy("match_id", "r.label").agg(F.sum("r.w").alias("w")).where("round(w, 9) >= 0.4")
    return v.groupBy("match_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("voted"))


@query("n5_block_coverage", f"WITH {PREDICTIONS}, b AS (SELECT sport, ntile(5) OVER (PARTITION BY sport ORDER BY seq) AS block, CAST(abs(p3 - y) <= 0.6 AS INT) AS hit FROM preds) SELECT sport, block, round(avg(hit), 6) AS coverage FROM b GROUP BY 1, 2")
def n5(spark, sf):
    b = sized(predictions(spark, sf)).select("sport", (part_of(F.col("seq"), F.col("n"), 5) + 1).alias("block"), (F.abs(F.col("p3") - F.col("y")) <= 0.6).cast("int").alias("hit"))
    return b.groupBy("sport", "block").agg(r6(F.avg("hit")).alias("coverage"))


@query("r1_router_context", f"WITH {PREDICTIONS}, m AS (SELECT sport, median(p1) AS m FROM preds GROUP BY 1), d AS (SELECT p.sport, m, median(abs(p1 - m)) AS mad FROM preds p JOIN m USING (sport) GROUP BY 1, 2) SELECT match_id, round(abs(p1 - m) / greatest(1.4826 * mad, 1e-6), 5) AS z, round(ln(1 + count(*) OVER (PARTITION BY sport)), 6) AS log_n FROM preds JOIN d USING (sport)")
def r1(spark, sf):
    x = predictions(spark, sf)
    m = x.groupBy("sport").agg(F.percentile("p1", F.lit(0.5)).alias("m"), F.count("*").alias("n"))
    d = x.join(m, "sport").groupBy("sport", "m", "n").agg(F.percentile(F.abs(F.col("p1") - F.col("m")), F.lit(0.5)).alias("mad"))
    return x.join(d, "sport").select("match_id", F.round(F.abs(F.col("p1") - F.col("m")) / F.greatest(1.4826 * F.col("mad"), F.lit(1e-6)), 5).alias("z"), r6(F.log1p("n")).alias("log_n"))


@query("r5_recent_weighted_ensemble", f"WITH {LOSSES}, r AS (SELECT *, row_number() OVER (PARTITION BY sport ORDER BY seq DESC) AS rn FROM losses), w AS (SELECT sport, " + ", ".join(f"exp(-avg(l{i}) FILTER (WHERE rn BETWEEN 51 AND 230) / 0.15) AS w{i}" for i in (1, 2, 3)) + " FROM r GROUP BY 1) SELECT match_id, round((w1 * p1 + w2 * p2 + w3 * p3) / (w1 + w2 + w3), 5) AS p FROM r JOIN w USING (sport) WHERE rn <= 50")
def r5(spark, sf):
    """The last 50 rows by weights from the losses of the 180 before them."""
    r = losses(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("sport").orderBy(F.desc("seq"))))
    w = r.where("rn BETWEEN 51 AND 230").groupBy("sport").agg(*(F.exp(-F.avg(f"l{i}") / 0.15).alias(f"w{i}") for i in (1, 2, 3)))
    return r.where("rn <= 50").join(w, "sport").select("match_id", F.round(sum(F.col(f"w{i}") * F.col(f"p{i}") for i in (1, 2, 3)) / sum(F.col(f"w{i}") for i in (1, 2, 3)), 5).alias("p"))


ENT = "(-{p} * ln({p}) - (1 - {p}) * ln(1 - {p}))"


@query("r6_uncertainty_features", f"WITH {PREDICTIONS}, m AS (SELECT *, (p1 + p2 + p3) / 3 AS m FROM preds) SELECT match_id, round(m, 6) AS mean, round(sqrt((pow(p1 - m, 2) + pow(p2 - m, 2) + pow(p3 - m, 2)) / 3), 6) AS std, round({ENT.format(p='m')}, 6) AS entropy, round({ENT.format(p='m')} - ({ENT.format(p='p1')} + {ENT.format(p='p2')} + {ENT.format(p='p3')}) / 3, 6) AS mutual, round(greatest(p1, p2, p3) - least(p1, p2, p3), 6) AS gap FROM m")
def r6_features(spark, sf):
    h = lambda p: -p * F.ln(p) - (1 - p) * F.ln(1 - p)
    p = [F.col(f"p{i}") for i in (1, 2, 3)]
    m = sum(p) / 3
    std = F.sqrt(sum((x - m) * (x - m) for x in p) / 3)
    return predictions(spark, sf).select("match_id", r6(m).alias("mean"), r6(std).alias("std"), r6(h(m)).alias("entropy"), r6(h(m) - sum(map(h, p)) / 3).alias("mutual"), r6(F.greatest(*p) - F.least(*p)).alias("gap"))


@query("r7_population_drift", f"WITH {PREDICTIONS}, h AS (SELECT sport, p1, seq > count(*) OVER (PARTITION BY sport) - 120 AS recent FROM preds) SELECT sport, round(abs(median(p1) FILTER (WHERE recent) - median(p1) FILTER (WHERE NOT recent)) / greatest(quantile_cont(p1, 0.75) FILTER (WHERE NOT recent) - quantile_cont(p1, 0.25) FILTER (WHERE NOT recent), 1e-6), 6) AS iqr_shift FROM h GROUP BY 1")
def r7(spark, sf):
    h = predictions(spark, sf).withColumn("recent", F.col("seq") > F.count("*").over(Window.partitionBy("sport")) - 120)
    new, old = F.when(F.col("recent"), F.col("p1")), F.when(~F.col("recent"), F.col("p1"))
    q = lambda c, x: F.percentile(c, F.lit(x))
    return h.groupBy("sport").agg(r6(F.abs(q(new, 0.5) - q(old, 0.5)) / F.greatest(q(old, 0.75) - q(old, 0.25), F.lit(1e-6))).alias("iqr_shift"))


@query("r11_disagreement", f"WITH {PREDICTIONS} SELECT match_id, round(greatest(p1, p2, p3) - least(p1, p2, p3), 6) AS spread, CASE WHEN (p1 >= 0.5) = (p2 >= 0.5) AND (p2 >= 0.5) = (p3 >= 0.5) THEN 0 ELSE 1 END AS split, round((abs(p1 - p2) + abs(p1 - p3) + abs(p2 - p3)) / 3, 6) AS pairwise FROM preds")
def r11(spark, sf):
    p, q, s = (F.col(f"p{i}") for i in (1, 2, 3))
    up = [x >= 0.5 for x in (p, q, s)]
    return predictions(spark, sf).select("match_id", r6(F.greatest(p, q, s) - F.least(p, q, s)).alias("spread"), F.when((up[0] == up[1]) & (up[1] == up[2]), 0).otherwise(1).alias("split"), r6((F.abs(p - q) + F.abs(p - s) + F.abs(q - s)) / 3).alias("pairwise"))


@query("r12_strategy", f"WITH {PREDICTIONS}, g AS (SELECT *, greatest(p1, p2, p3) - least(p1, p2, p3) AS gap, (p1 + p2 + p3) / 3 AS m FROM preds) SELECT match_id, CASE WHEN gap > 0.6 THEN 'ABSTAIN' WHEN gap > 0.3 THEN 'SHRINK' ELSE 'BLEND' END AS strategy, round(CASE WHEN gap > 0.6 THEN NULL WHEN gap > 0.3 THEN 0.5 + 0.5 * (m - 0.5) ELSE m END, 6) AS p FROM g")
def r12(spark, sf):
    p = [F.col(f"p{i}") for i in (1, 2, 3)]
    gap, m = F.greatest(*p) - F.least(*p), sum(p) / 3
    return predictions(spark, sf).select("match_id", F.when(gap > 0.6, "ABSTAIN").when(gap > 0.3, "SHRINK").otherwise("BLEND").alias("strategy"), r6(F.when(gap > 0.6, None).when(gap > 0.3, 0.5 + 0.5 * (m - 0.5)).otherwise(m)).alias("p"))


@query("r14_upset_target", f"WITH {PREDICTIONS} SELECT match_id, CAST(greatest(p1, 1 - p1) >= 0.7 AND (p1 >= 0.5) <> (y = 1) AS INT) AS upset, round(((p2 >= 0.5) <> (p1 >= 0.5))::INT / 2 + ((p3 >= 0.5) <> (p1 >= 0.5))::INT / 2, 6) AS dissent FROM preds")
def r14(spark, sf):
    p = F.col("p1")
    other = lambda i: ((F.col(f"p{i}") >= 0.5) != (p >= 0.5)).cast("int")
    return predictions(spark, sf).select("match_id", ((F.greatest(p, 1 - p) >= 0.7) & ((p >= 0.5) != (F.col("y") == 1))).cast("int").alias("upset"), r6((other(2) + other(3)) / 2).alias("dissent"))


@query("r18_route_resolution", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type || '::' || p_brand ELSE p_type END AS route FROM part")
def r18(spark, sf):
    """The most specific usable segment of each row."""
    from .predicates import segments

    p = table(spark, sf, "part").withColumn("s", F.explode(segments("p_type", "p_brand")))
    usable = (F.size(F.split("s", "::")) == 1) | (F.col("p_partkey") % 4 == 0)
    return p.where(usable).groupBy("p_partkey").agg(F.max_by("s", F.size(F.split("s", "::"))).alias("route"))


@query("l2_time_decay_weights", f"WITH {PREDICTIONS} SELECT match_id, round(pow(0.5, (count(*) OVER (PARTITION BY sport) - seq) / 300), 6) AS weight FROM preds")
def l2(spark, sf):
    age = F.count("*").over(Window.partitionBy("sport")) - F.col("seq")
    return predictions(spark, sf).select("match_id", r6(F.pow(F.lit(0.5), age / 300)).alias("weight"))


@query("l4_challenger_gate", f"""WITH {LOSSES}, h AS (SELECT *, least(floor(p1 * 10), 9) AS b1, least(floor(p3 * 10), 9) AS b3 FROM losses),
 m AS (SELECT sport, avg(l1) AS old, avg(l3) AS new, avg(pow(p1 - y, 2)) AS ob, avg(pow(p3 - y, 2)) AS nb, sha256(count(*) || ':' || sum(match_id)) AS holdout FROM h GROUP BY 1),
 e1 AS (SELECT sport, sum(n * g) / sum(n) AS oe FROM (SELECT sport, b1, count(*) AS n, abs(avg(y) - avg(p1)) AS g FROM h GROUP BY 1, 2) GROUP BY 1), e3 AS (SELECT sport, sum(n * g) / sum(n) AS ne FROM (SELECT sport, b3, count(*) AS n, abs(avg(y) - avg(p3)) AS g FROM h GROUP BY 1, 2) GROUP BY 1)
SELECT sport, holdout, round(old - new, 6) AS gain, round(ne, 6) AS ece, old - new >= greatest(0.002, 0.01 * old) AND nb <= ob + 0.01 AND ne <= greatest(0.20, oe + 0.03) AS accepted FROM m JOIN e1 USING (sport) JOIN e3 USING (sport)""")
def l4(spark, sf):
    """A challenger (p3) replaces the champion (p1) only on the same holdout, for a better log loss, without losing in Brier score or calibration."""
    y, x = F.col("y"), losses(spark, sf)
    same = F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum("match_id").cast("string")), 256).alias("holdout")
    m = x.groupBy("sport").agg(same, F.avg("l1").alias("old"), F.avg("l3").alias("new"), F.avg(brier(F.col("p1"), y)).alias("ob"), F.avg(brier(F.col("p3"), y)).alias("nb"))

    def ece(p: str, name: str) -> DataFrame:
        b = x.groupBy("sport", F.least(F.floor(F.col(p) * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("y") - F.avg(p)).alias("gap"))
        return b.groupBy("sport").agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias(name))

    m = m.join(ece("p1", "oe"), "sport").join(ece("p3", "ne"), "sport")
    gain = F.col("old") - F.col("new")
    ok = (gain >= F.greatest(F.lit(0.002), 0.01 * F.col("old"))) & (F.col("nb") <= F.col("ob") + 0.01) & (F.col("ne") <= F.greatest(F.lit(0.20), F.col("oe") + 0.03))
    return m.select("sport", "holdout", r6(gain).alias("gain"), r6("ne").alias("ece"), ok.alias("accepted"))


@query("g1_run_health", "SELECT c_nationkey AS workflow, count(*) AS runs, arg_max(c_mktsegment, c_custkey) AS latest, CASE WHEN arg_max(c_acctbal, c_custkey) < 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE c_acctbal < 0) * 4 > count(*) THEN 'FLAKY' ELSE 'HEALTHY' END AS health FROM customer GROUP BY 1")
def g1(spark, sf):
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("workflow")).agg(F.count("*").alias("runs"), F.max_by("c_mktsegment", "c_custkey").alias("latest"), F.max_by("c_acctbal", "c_custkey").alias("last"), F.count_if(F.col("c_acctbal") < 0).alias("bad"))
    return g.select("workflow", "runs", "latest", F.when(F.col("last") < 0, "FAILED").when(F.col("bad") * 4 > F.col("runs"), "FLAKY").otherwise("HEALTHY").alias("health"))


@query("g3_state_fingerprint", "SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS fingerprint FROM customer")
def g3(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("fingerprint"))


@query("g6_release_gate", f"WITH {LEDGER}, c AS (SELECT sport, count(*) AS n, avg(ok) AS acc FROM ledger GROUP BY 1) SELECT sport, n, CASE WHEN n < 100 THEN 'NO_DATA' WHEN acc >= 0.52 THEN 'RELEASE' ELSE 'HOLD' END AS gate FROM c")
def g6(spark, sf):
    c = ledger(spark, sf).groupBy("sport").agg(F.count("*").alias("n"), F.avg("ok").alias("acc"))
    return c.select("sport", "n", F.when(F.col("n") < 100, "NO_DATA").when(F.col("acc") >= 0.52, "RELEASE").otherwise("HOLD").alias("gate"))


MANIFEST = (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"))


@query("g8_table_manifest", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CAST(sum(CAST(('0x' || md5(CAST({k} AS VARCHAR))[1:8]) AS BIGINT)) AS BIGINT) AS content FROM {t}" for t, k in MANIFEST))
def g8(spark, sf):
    """Rows and a hash of the keys of each table, whatever the order of its rows: digests are summed."""
    part = lambda k: F.conv(F.substring(F.md5(F.col(k).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    one = lambda t, k: table(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.sum(part(k)).alias("content"))
    first, *rest = (one(t, k) for t, k in MANIFEST)
    for r in rest:
        first = first.unionByName(r)
    return first


@query("g9_count_delta", "SELECT event_type, count(*) FILTER (WHERE event_id % 4 <> 0) AS before, count(*) AS after, count(*) FILTER (WHERE event_id % 4 = 0) AS delta FROM events GROUP BY 1")
def g9(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("event_id") % 4 != 0).alias("before"), F.count("*").alias("after"))
    return e.withColumn("delta", F.col("after") - F.col("before"))


@query("g11_shadow_dataset", f"WITH {OBS}, l AS (SELECT pid, stat, arg_max(value, (t, event_id)) AS v FROM obs GROUP BY 1, 2) SELECT pid, string_agg(stat || '=' || printf('%.2f', v), ';' ORDER BY stat) AS features FROM l GROUP BY 1")
def g11(spark, sf):
    last = observations(spark, sf).groupBy("pid", "stat").agg(F.max_by("value", F.struct("t", "event_id")).alias("v"))
    return last.groupBy("pid").agg(F.array_join(F.array_sort(F.collect_list(F.concat("stat", F.lit("="), F.format_string("%.2f", "v")))), ";").alias("features"))
