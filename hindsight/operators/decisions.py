"""Decisions under uncertainty: policies over a grid in one pass, scenario mixtures, and the value of information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import PREDICTIONS, predictions
from .predicates import brier, log_loss, r6
from .windows import part_of, sized

EPS = 1e-6
STRENGTHS = (0.25, 0.5, 0.75, 1.0)
THRESHOLDS = 10


def policy_grid(rows: DataFrame, confident: float = 0.7, blocks: int = 3) -> DataFrame:
    """Every policy of rows(sport, seq, y, p, other, risk): one that shrinks p to a half, and one that moves it to `other` where that calls the other side, each at four strengths and ten thresholds of risk (0 to 1), on rows where p is confident.

    A row's gains go to the bin of its risk; the sums of a threshold are those of all bins from it on, so
    all thresholds come from one pass. A policy is ranked by its mean gain over the blocks, then its
    least, the blocks it helps, its whole gain and what it adds to accuracy; the first that passes the
    gate is chosen.
    """
    p, other, y = F.col("p"), F.col("other"), F.col("y")
    x = sized(rows).withColumns({"block": part_of(F.col("seq"), F.col("n"), blocks), "bin": F.greatest(F.least(F.floor(F.round("risk", 9) * THRESHOLDS), F.lit(THRESHOLDS - 1)), F.lit(0)).cast("int")})
    size = x.groupBy("sport", "block").agg(F.count("*").alias("m"))
    sure = F.greatest(p, 1 - p) >= confident
    turns = (other >= 0.5) != (p >= 0.5)
    kinds = [(k, s) for k in ("shrink", "dissent") for s in STRENGTHS]
    moved = lambda k, s: p + s * (0.5 - p) if k == "shrink" else p + s * (other - p)
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("strength"), moved(k, s).alias("q"), (sure if k == "shrink" else sure & turns).alias("active")) for k, s in kinds))
    r = x.where(sure).select("sport", "block", "bin", "y", "p", F.explode(each).alias("e")).select("sport", "block", "bin", "y", "p", "e.*").where("active")
    q, hit = F.col("q"), lambda c: ((c >= 0.5) == (y == 1)).cast("int")
    r = r.groupBy("sport", "block", "kind", "strength", "bin").agg(F.count("*").alias("active"), F.sum(log_loss(p, y, EPS) - log_loss(q, y, EPS)).alias("dl"), F.sum(brier(p, y) - brier(q, y)).alias("db"), F.sum(hit(q) - hit(p)).alias("da"))
    names = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("strength")) for k, s in kinds)))
    frame = size.select("sport", "block", "m", names.alias("e")).select("sport", "block", "m", "e.*", F.explode(F.sequence(F.lit(0), F.lit(THRESHOLDS - 1))).alias("bin"))
    w = Window.partitionBy("sport", "block", "kind", "strength").orderBy(F.desc("bin"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(w).alias(c)
    g = frame.join(r, ["sport", "block", "kind", "strength", "bin"], "left").select("sport", "block", "kind", "strength", "bin", "m", *map(total, ("active", "dl", "db", "da")))
    nine = lambda c: F.round(c, 9)
    part = F.col("dl") / F.col("m")
    g = g.groupBy("sport", "kind", "strength", (F.col("bin") / THRESHOLDS).alias("threshold")).agg(
        F.sum("active").alias("active"), nine(F.avg(part)).alias("block_mean"), nine(F.min(part)).alias("block_min"), F.count_if((nine(part) > 0) & (nine(F.col("db") / F.col("m")) >= -0.001)).alias("good_blocks"),
        nine(F.sum("dl") / F.sum("m")).alias("gain"), nine(F.sum("db") / F.sum("m")).alias("brier_gain"), nine(F.sum("da") / F.sum("m")).alias("accuracy_gain"))
    order = Window.partitionBy("sport").orderBy(*(F.desc(c) for c in ("block_mean", "block_min", "good_blocks", "gain", "accuracy_gain")), "kind", "strength", "threshold")
    ok = (F.col("gain") > 0) & (F.col("brier_gain") >= -0.001) & (F.col("good_blocks") >= 2) & (F.col("block_mean") > 0) & (F.col("block_min") > -0.005) & ((F.col("kind") == "shrink") | (F.col("accuracy_gain") > 0))
    g = g.withColumns({"rank": F.row_number().over(order), "ok": ok})
    first = F.min(F.when(F.col("ok"), F.col("rank"))).over(Window.partitionBy("sport"))
    return g.withColumn("chosen", F.coalesce(F.col("rank") == first, F.lit(False))).drop("ok")


@query("r14_policy_grid", f"""WITH {PREDICTIONS},
 x AS (SELECT sport, y, p1 AS p, (p2 + p3) / 2 AS o, CAST(greatest(least(floor(round(greatest(p1, p2, p3) - least(p1, p2, p3), 9) * 10), 9), 0) AS INTEGER) AS bin,
   ntile(3) OVER (PARTITION BY sport ORDER BY seq) AS block FROM preds),
 k AS (SELECT kind, strength, t FROM (VALUES ('shrink'), ('dissent')) a(kind), (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) b(strength), range(10) c(t)),
 q AS (SELECT sport, block, y, p, kind, strength, t, greatest(p, 1 - p) >= 0.7 AND bin >= t AND (kind = 'shrink' OR (o >= 0.5) <> (p >= 0.5)) AS active,
   CASE WHEN kind = 'shrink' THEN p + strength * (0.5 - p) ELSE p + strength * (o - p) END AS q FROM x, k),
 c AS (SELECT sport, block, kind, strength, t, active, greatest(least(p, 1 - 1e-6), 1e-6) AS p0, greatest(least(q, 1 - 1e-6), 1e-6) AS q0, p, q, y FROM q),
 d AS (SELECT sport, block, kind, strength, t, count(*) AS m, count(*) FILTER (WHERE active) AS active,
   sum(CASE WHEN active THEN CASE WHEN y = 1 THEN ln(q0) - ln(p0) ELSE ln(1 - q0) - ln(1 - p0) END ELSE 0 END) AS dl,
   sum(CASE WHEN active THEN (p - y) * (p - y) - (q - y) * (q - y) ELSE 0 END) AS db,
   sum(CASE WHEN active THEN CAST((q >= 0.5) = (y = 1) AS INTEGER) - CAST((p >= 0.5) = (y = 1) AS INTEGER) ELSE 0 END) AS da FROM c GROUP BY ALL),
 g AS (SELECT sport, kind, strength, t / 10 AS threshold, CAST(sum(active) AS BIGINT) AS active, round(avg(dl / m), 9) AS block_mean, round(min(dl / m), 9) AS block_min,
   count(*) FILTER (WHERE round(dl / m, 9) > 0 AND round(db / m, 9) >= -0.001) AS good_blocks, round(sum(dl) / sum(m), 9) AS gain, round(sum(db) / sum(m), 9) AS brier_gain, round(sum(da) / sum(m), 9) AS accuracy_gain FROM d GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY sport ORDER BY block_mean DESC, block_min DESC, good_blocks DESC, gain DESC, accuracy_gain DESC, kind, strength, threshold) AS rank,
   gain > 0 AND brier_gain >= -0.001 AND good_blocks >= 2 AND block_mean > 0 AND block_min > -0.005 AND (kind = 'shrink' OR accuracy_gain > 0) AS ok FROM g)
SELECT sport, kind, strength, threshold, active, round(gain, 6) AS gain, round(block_mean, 6) AS block_mean, round(block_min, 6) AS block_min, good_blocks, round(accuracy_gain, 6) AS accuracy_gain,
 coalesce(rank = min(rank) FILTER (WHERE ok) OVER (PARTITION BY sport), false) AS chosen FROM r""")
def r14_grid(spark, sf):
    x = predictions(spark, sf).select("sport", "seq", "y", F.col("p1").alias("p"), ((F.col("p2") + F.col("p3")) / 2).alias("other"), (F.greatest("p1", "p2", "p3") - F.least("p1", "p2", "p3")).alias("risk"))
    g = policy_grid(x)
    return g.select("sport", "kind", "strength", "threshold", "active", *(r6(c).alias(c) for c in ("gain", "block_mean", "block_min")), "good_blocks", r6("accuracy_gain").alias("accuracy_gain"), "chosen")


# Scenarios of one event: columns of their probabilities and weights


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, e: t + e)


def mixture(p: Column, w: Column) -> dict[str, Column]:
    """Mean and variance of arrays of probabilities and weights, within and between the scenarios; null where a probability isn't one or weights don't sum to more than 0."""
    ok = (F.size(p) == F.size(w)) & F.forall(p, lambda e: e.isNotNull() & (e >= 0) & (e <= 1)) & F.forall(w, lambda e: e.isNotNull() & (e >= 0)) & (_sum(w) > 0)
    share = F.transform(w, lambda e: e / _sum(w))
    mean = _sum(F.zip_with(share, p, lambda a, b: a * b))
    within = _sum(F.zip_with(share, p, lambda a, b: a * b * (1 - b)))
    between = _sum(F.zip_with(share, p, lambda a, b: a * (b - mean) * (b - mean)))
    out = {"mean": mean, "within": within, "between": between, "between_share": between / F.greatest(within + between, F.lit(1e-12))}
    return {k: F.when(ok, c) for k, c in out.items()}


def utility(p: Column, right: float = 1.0, wrong: float = -1.0, abstain: float = 0.0) -> Column:
    """The expected utility of the best of calling A (of probability p), calling B, and neither."""
    return F.greatest(p * right + (1 - p) * wrong, (1 - p) * right + p * wrong, F.lit(abstain))


def entropy(p: Column) -> Column:
    """Of two outcomes, in nats."""
    q = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))


def information_value(prior: Column, posterior: Column, weight: Column, cost: float, **utilities: float) -> dict[str, Column]:
    """What it is worth to learn which scenario holds: the expected utility of deciding after, less that of deciding now and the cost; and by how much entropy falls."""
    share = F.transform(weight, lambda e: e / _sum(weight))
    after = _sum(F.zip_with(share, posterior, lambda w, p: w * utility(p, **utilities)))
    left = _sum(F.zip_with(share, posterior, lambda w, p: w * entropy(p)))
    return {"now": utility(prior, **utilities), "after": after, "net": after - utility(prior, **utilities) - cost, "information": entropy(prior) - left}


@query("d3x_information_value", f"""WITH {PREDICTIONS}, s AS (SELECT match_id, [p1, p2, p3] AS p, [1.0::DOUBLE, 2.0, (match_id % 3)::DOUBLE] AS w FROM preds),
 n AS (SELECT match_id, p, list_transform(w, lambda e: e / list_sum(w)) AS w FROM s),
 m AS (SELECT match_id, p, w, list_sum(list_transform(list_zip(w, p), lambda z: z[1] * z[2])) AS mean FROM n),
 v AS (SELECT match_id, mean, list_sum(list_transform(list_zip(w, p), lambda z: z[1] * z[2] * (1 - z[2]))) AS within, list_sum(list_transform(list_zip(w, p), lambda z: z[1] * pow(z[2] - mean, 2))) AS between,
   greatest(abs(2 * mean - 1) * 1.0 - 0.1, 0) AS now, list_sum(list_transform(list_zip(w, p), lambda z: z[1] * greatest(abs(2 * z[2] - 1) - 0.1, 0))) AS after,
   -(mean * ln(mean) + (1 - mean) * ln(1 - mean)) - list_sum(list_transform(list_zip(w, p), lambda z: z[1] * -(z[2] * ln(z[2]) + (1 - z[2]) * ln(1 - z[2])))) AS information FROM m)
SELECT match_id, round(mean, 6) AS mean, round(within, 6) AS within, round(between, 6) AS between, round(between / (within + between), 6) AS between_share, round(after - now - 0.02, 6) AS net, round(information, 6) AS information,
 CASE WHEN round(after - now - 0.02, 9) > 0 THEN 'ACQUIRE' ELSE 'DECIDE' END AS action FROM v""")
def d3x_information(spark, sf):
    """Three models as scenarios of unequal weight: their mixture, and whether learning which of them holds is worth 0.02, where a call wins 0.9 and loses 1.1."""
    p, w = F.array("p1", "p2", "p3"), F.array(F.lit(1.0), F.lit(2.0), (F.col("match_id") % 3).cast("double"))
    x = predictions(spark, sf).withColumns({"p": p, "w": w}).withColumns(mixture(F.col("p"), F.col("w")))
    x = x.withColumns(information_value(F.col("mean"), F.col("p"), F.col("w"), 0.02, right=0.9, wrong=-1.1))
    return x.select("match_id", *(r6(c).alias(c) for c in ("mean", "within", "between", "between_share", "net", "information")), F.when(F.round("net", 9) > 0, "ACQUIRE").otherwise("DECIDE").alias("action"))


def clustered_size(rows: DataFrame, by: list[str], cluster: str, correlation: float) -> DataFrame:
    """(*by, n, clusters, effective): how many independent rows the rows are worth if those of one cluster correlate."""
    g = rows.groupBy(*by, cluster).agg(F.count("*").alias("m")).groupBy(*by).agg(F.sum("m").alias("n"), F.count("*").alias("clusters"))
    design = 1 + (F.col("n") / F.col("clusters") - 1) * correlation
    return g.withColumn("effective", F.col("n") / F.greatest(design, F.lit(1.0)))


@query("d3x_cluster_size", f"WITH {PREDICTIONS}, g AS (SELECT sport, a, count(*) AS m FROM preds GROUP BY 1, 2) SELECT sport, CAST(sum(m) AS BIGINT) AS n, count(*) AS clusters, round(sum(m) / greatest(1 + (avg(m) - 1) * 0.3, 1), 6) AS effective FROM g GROUP BY 1")
def d3x_clusters(spark, sf):
    return clustered_size(predictions(spark, sf), ["sport"], "a", 0.3).select("sport", "n", "clusters", r6("effective").alias("effective"))


@query("d3x_sensitivity", f"""WITH {PREDICTIONS}, l AS (SELECT match_id, p2, (ln(p1 / (1 - p1)) + 2 * ln(p2 / (1 - p2)) + ln(p3 / (1 - p3))) / 4 AS z FROM preds), q AS (SELECT match_id, p2, z, 1 / (1 + exp(-z)) AS p FROM l)
SELECT match_id, round(p, 6) AS p, round(p * (1 - p) * 2 / 4 / (p2 * (1 - p2)), 6) AS slope, round(1 / (1 + exp(-(z + 2 * (ln((p2 + 0.01) / (0.99 - p2)) - ln(p2 / (1 - p2))) / 4))) - p, 6) AS moved FROM q""")
def d3x_sensitivity(spark, sf):
    """How a blend in log odds moves with one model's probability: its exact derivative, and its change for a step of 0.01."""
    odds = lambda c: F.ln(c / (1 - c))
    p2 = F.col("p2")
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    x = predictions(spark, sf).withColumn("z", (odds(F.col("p1")) + 2 * odds(p2) + odds(F.col("p3"))) / 4)
    x = x.withColumn("p", sigmoid(F.col("z")))
    moved = sigmoid(F.col("z") + 2 * (odds(p2 + 0.01) - odds(p2)) / 4) - F.col("p")
    return x.select("match_id", r6("p").alias("p"), r6(F.col("p") * (1 - F.col("p")) * 2 / 4 / (p2 * (1 - p2))).alias("slope"), r6(moved).alias("moved"))
