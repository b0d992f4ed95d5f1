"""Grouped summaries, gates and memories."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import DAY, HOUR, MATCHES, OBS, PREDICTIONS, TARGETS, matches, observations, predictions, table, targets
from .predicates import BUCKET, brier, log_loss, probability_bucket, r6


@query("a1_filtered_counts", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderdate IS NOT NULL) AS timed, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_totalprice > 100000) AS accepted FROM orders GROUP BY 1")
def a1(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count("o_orderdate").alias("timed"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count_if(F.col("o_totalprice") > 100000).alias("accepted"))


def sides(m):
    """One row for each side of each match: pid, won (null for a draw)."""
    return m.select("match_id", "sport", "t", F.expr("stack(2, 'A', a, 'B', b) AS (side, pid)"), "outcome").withColumn("won", F.when(F.col("outcome") != "DRAW", (F.col("outcome") == F.col("side")).cast("int")))


SIDES = MATCHES + ", sides AS (SELECT match_id, sport, t, 'A' AS side, a AS pid, outcome, CASE WHEN outcome <> 'DRAW' THEN CAST(outcome = 'A' AS INT) END AS won FROM matches UNION ALL SELECT match_id, sport, t, 'B', b, outcome, CASE WHEN outcome <> 'DRAW' THEN CAST(outcome = 'B' AS INT) END FROM matches)"


@query("a2_prior_record", f"WITH {SIDES} SELECT pid, count(DISTINCT match_id) AS starts, count(DISTINCT match_id) FILTER (WHERE won = 1) AS wins, round((count(DISTINCT match_id) FILTER (WHERE won = 1) + 1) / (count(DISTINCT match_id) + 2), 6) AS rate FROM sides GROUP BY 1")
def a2(spark, sf):
    s = sides(matches(spark, sf)).groupBy("pid", "match_id").agg(F.max("won").alias("won"))
    g = s.groupBy("pid").agg(F.count("*").alias("starts"), F.count_if(F.col("won") == 1).alias("wins"))
    return g.withColumn("rate", r6((F.col("wins") + 1) / (F.col("starts") + 2)))


@query("a3_two_side_prior", f"WITH {SIDES}, r AS (SELECT pid, (count(*) FILTER (WHERE won = 1) + 1) / (count(*) + 2) AS rate FROM sides GROUP BY 1) SELECT m.match_id, round(greatest(least(y.rate / (x.rate + y.rate), 1 - 1e-6), 1e-6), 6) AS p_b FROM matches m JOIN r x ON x.pid = m.a JOIN r y ON y.pid = m.b")
def a3(spark, sf):
    m = matches(spark, sf)
    rate = sides(m).groupBy("pid").agg(((F.count_if(F.col("won") == 1) + 1) / (F.count("*") + 2)).alias("rate"))
    j = m.join(rate.select(F.col("pid").alias("a"), F.col("rate").alias("ra")), "a").join(rate.select(F.col("pid").alias("b"), F.col("rate").alias("rb")), "b")
    return j.select("match_id", r6(F.greatest(F.least(F.col("rb") / (F.col("ra") + F.col("rb")), F.lit(1 - 1e-6)), F.lit(1e-6))).alias("p_b"))


@query("a4_field_prior", "WITH g AS (SELECT l_returnflag AS field, l_suppkey AS id, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT field, id, round(q / sum(q) OVER (PARTITION BY field), 6) AS p, row_number() OVER (PARTITION BY field ORDER BY q DESC, id) AS rank FROM g")
def a4(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("field"), F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("field")
    return g.select("field", "id", r6(F.col("q") / F.sum("q").over(w)).alias("p"), F.row_number().over(w.orderBy(F.desc("q"), "id")).alias("rank"))


@query("a5_fingerprint", f"WITH {OBS} SELECT stat, sha256(concat_ws('|', count(*), max(event_id), max(t), CAST(round(sum(coalesce(value, 0))) AS BIGINT), sum(length(stat)))) AS fingerprint FROM obs GROUP BY 1")
def a5(spark, sf):
    g = observations(spark, sf).groupBy("stat").agg(F.count("*").alias("n"), F.max("event_id").alias("i"), F.max("t").alias("t"), F.round(F.sum(F.coalesce("value", F.lit(0.0)))).cast("long").alias("s"), F.sum(F.length("stat")).alias("c"))
    return g.select("stat", F.sha2(F.concat_ws("|", "n", "i", "t", "s", "c"), 256).alias("fingerprint"))


@query("a6_independent_mins", f"WITH {OBS} SELECT pid, min(event_id) AS first_id, min(avail) AS first_avail FROM obs GROUP BY 1")
def a6(spark, sf):
    return observations(spark, sf).groupBy("pid").agg(F.min("event_id").alias("first_id"), F.min("avail").alias("first_avail"))


@query("a7_exists_in_case", "SELECT c_mktsegment, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') THEN 1 ELSE 0 END) AS with_open FROM customer GROUP BY 1")
def a7(spark, sf):
    open_ = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(1))
    return table(spark, sf, "customer").join(open_, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("with_open"))


LEDGER = PREDICTIONS + f", ledger AS (SELECT *, {BUCKET.format(p='greatest(p1, 1 - p1)')} AS bucket, CASE WHEN y = 1 THEN -ln(p1) ELSE -ln(1 - p1) END AS ll, (p1 - y) * (p1 - y) AS br, CAST((p1 >= 0.5) = (y = 1) AS INT) AS ok FROM preds)"


def ledger(spark, sf):
    p, y = F.col("p1"), F.col("y")
    return predictions(spark, sf).select("*", probability_bucket(F.greatest(p, 1 - p)).alias("bucket"), log_loss(p, y).alias("ll"), brier(p, y).alias("br"), ((p >= 0.5) == (y == 1)).cast("int").alias("ok"))


@query("a8_metric_grouping_sets", f"WITH {LEDGER} SELECT sport, bucket, count(*) AS n, round(avg(ok), 6) AS accuracy, round(avg(ll), 6) AS logloss, round(avg(br), 6) AS brier FROM ledger GROUP BY GROUPING SETS ((sport), (bucket), (sport, bucket), ())")
def a8(spark, sf):
    x = ledger(spark, sf)
    g = x.groupingSets([[F.col("sport")], [F.col("bucket")], [F.col("sport"), F.col("bucket")], []], F.col("sport"), F.col("bucket"))
    return g.agg(F.count("*").alias("n"), r6(F.avg("ok")).alias("accuracy"), r6(F.avg("ll")).alias("logloss"), r6(F.avg("br")).alias("brier"))


@query("a9_canonical_rows", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def a9(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_totalprice", "o_orderkey")).alias("m"))
    return g.select("o_custkey", "m.o_orderkey", "m.o_totalprice")


@query("a10_error_patterns", f"""WITH {LEDGER}, x AS (SELECT *, CASE WHEN match_id % 3 = 0 THEN 'router' ELSE 'fixed' END AS strategy, greatest(p1, 1 - p1) AS most FROM ledger),
 p AS (SELECT 'pattern' AS kind, sport, strategy, bucket, count(*) AS n, round(avg(most), 4) AS value FROM x WHERE ok = 0 GROUP BY 2, 3, 4 HAVING count(*) >= 3 ORDER BY n DESC, value DESC, sport, strategy, bucket LIMIT 50),
 s AS (SELECT 'signal' AS kind, sport, strategy, bucket, count(*) AS n, round(avg(ok), 6) AS value FROM x GROUP BY 2, 3, 4 HAVING count(*) >= 5 AND avg(ok) < 0.6 ORDER BY value, n DESC, sport, strategy, bucket LIMIT 30)
SELECT * FROM p UNION ALL SELECT * FROM s""")
def a10(spark, sf):
    """The 50 largest groups of errors (3 at least), and the 30 weakest groups (5 rows at least, right in less than 0.6) as signals for the next cycle."""
    x = ledger(spark, sf).withColumns({"strategy": F.when(F.col("match_id") % 3 == 0, "router").otherwise("fixed"), "most": F.greatest("p1", 1 - F.col("p1"))})
    g = x.groupBy("sport", "strategy", "bucket")
    by = ("sport", "strategy", "bucket")
    wrong = x.where("ok = 0").groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("most"), 4).alias("value")).where("n >= 3").orderBy(F.desc("n"), F.desc("value"), *by).limit(50)
    weak = g.agg(F.count("*").alias("n"), F.avg("ok").alias("mean")).where("n >= 5 AND mean < 0.6").withColumn("value", r6("mean")).drop("mean").orderBy("value", F.desc("n"), *by).limit(30)
    return wrong.select(F.lit("pattern").alias("kind"), *by, "n", "value").unionByName(weak.select(F.lit("signal").alias("kind"), *by, "n", "value"))


def wilson_lower(wins: Column, n: Column, z: float = 1.96) -> Column:
    p = wins / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


@query("a11_wilson_memory", f"WITH {LEDGER}, g AS (SELECT sport, bucket, count(*) AS n, sum(ok) AS k FROM ledger GROUP BY 1, 2), w AS (SELECT *, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) AS lower FROM g) SELECT sport, bucket, n, round(lower, 6) AS lower, CASE WHEN n >= 20 AND lower >= 0.5 THEN 'TRUST' WHEN n >= 20 AND lower < 0.4 THEN 'AVOID' ELSE 'LEARN' END AS rule FROM w")
def a11(spark, sf):
    g = ledger(spark, sf).groupBy("sport", "bucket").agg(F.count("*").alias("n"), F.sum("ok").alias("k")).withColumn("lower", wilson_lower(F.col("k"), F.col("n")))
    rule = F.when((F.col("n") >= 20) & (F.col("lower") >= 0.5), "TRUST").when((F.col("n") >= 20) & (F.col("lower") < 0.4), "AVOID").otherwise("LEARN")
    return g.select("sport", "bucket", "n", r6("lower").alias("lower"), rule.alias("rule"))


@query("a12_stat_summary", f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY pid, stat ORDER BY t DESC, event_id DESC) AS rn FROM obs)
SELECT pid, stat, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(CASE WHEN count(*) > 1 THEN stddev_pop(value) END, 6) AS std,
 round(sum(value * exp(-(rn - 1) / 5)) / sum(exp(-(rn - 1) / 5)), 6) AS ewma5 FROM r WHERE rn <= 20 GROUP BY 1, 2""")
def a12(spark, sf):
    r = observations(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("pid", "stat").orderBy(F.desc("t"), F.desc("event_id")))).where("rn <= 20")
    w = F.exp(-(F.col("rn") - 1) / 5)
    q = lambda x: r6(F.percentile("value", F.lit(x)))
    return r.groupBy("pid", "stat").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), r6(F.when(F.count("*") > 1, F.stddev_pop("value"))).alias("std"), r6(F.sum(F.col("value") * w) / F.sum(w)).alias("ewma5"))


@query("a14_activity_delta", f"WITH {MATCHES}, c AS (SELECT pid, count(*) AS posts, count(DISTINCT stat) AS kinds FROM obs GROUP BY 1) SELECT match_id, round(ln(1 + coalesce(x.posts, 0)) - ln(1 + coalesce(y.posts, 0)), 6) AS posts, round(ln(1 + coalesce(x.kinds, 0)) - ln(1 + coalesce(y.kinds, 0)), 6) AS kinds FROM matches LEFT JOIN c x ON x.pid = a LEFT JOIN c y ON y.pid = b")
def a14(spark, sf):
    c = observations(spark, sf).groupBy("pid").agg(F.count("*").alias("posts"), F.countDistinct("stat").alias("kinds"))
    s = sides(matches(spark, sf)).join(c, "pid", "left")
    d = lambda n: r6(F.sum(F.when(F.col("side") == "A", 1).otherwise(-1) * F.log1p(F.coalesce(n, F.lit(0))))).alias(n)
    return s.groupBy("match_id").agg(d("posts"), d("kinds"))


@query("a15_sum_or_mean", f"WITH {OBS} SELECT pid, stat, round(CASE WHEN stat IN ('view', 'click') THEN sum(value) ELSE avg(value) END, 6) AS value FROM obs GROUP BY 1, 2")
def a15(spark, sf):
    return observations(spark, sf).groupBy("pid", "stat").agg(r6(F.when(F.col("stat").isin("view", "click"), F.sum("value")).otherwise(F.avg("value"))).alias("value"))


@query("a16_evidence_quality", f"WITH {OBS} SELECT pid, round(least(count(DISTINCT stat) / 4, 1), 6) AS diversity, round(count(*) FILTER (WHERE value > 100) / count(*), 6) AS conflict, round(avg(exp(-least((avail - t) / 3.6e9, 168) / 24)), 6) AS freshness FROM obs GROUP BY 1")
def a16(spark, sf):
    age = F.least((F.col("avail") - F.col("t")) / 3.6e9, F.lit(168.0))
    return observations(spark, sf).groupBy("pid").agg(r6(F.least(F.countDistinct("stat") / 4, F.lit(1.0))).alias("diversity"), r6(F.count_if(F.col("value") > 100) / F.count("*")).alias("conflict"), r6(F.avg(F.exp(-age / 24))).alias("freshness"))


@query("a17_group_counters", "SELECT 'status' AS dim, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def a17(spark, sf):
    o = table(spark, sf, "orders").select(F.expr("stack(2, 'status', o_orderstatus, 'priority', o_orderpriority) AS (dim, key)"))
    return o.groupBy("dim", "key").agg(F.count("*").alias("n"))


@query("a18_string_aggregate", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS kinds FROM part GROUP BY 1")
def a18(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("kinds"))


@query("a19_recency_counters", f"WITH {OBS}, n AS (SELECT max(t) AS now FROM obs) SELECT stat, count(*) FILTER (WHERE t >= now - 86400000000) AS h24, count(*) FILTER (WHERE t >= now - 7 * 86400000000) AS d7 FROM obs, n GROUP BY 1")
def a19(spark, sf):
    o = observations(spark, sf)
    now = o.agg(F.max("t").alias("now"))
    return o.crossJoin(F.broadcast(now)).groupBy("stat").agg(F.count_if(F.col("t") >= F.col("now") - DAY).alias("h24"), F.count_if(F.col("t") >= F.col("now") - 7 * DAY).alias("d7"))


@query("a20_freshness", f"WITH {OBS}, n AS (SELECT max(avail) AS now FROM obs) SELECT pid, (now - max(avail)) // 3600000000 AS age_hours, (now - max(avail)) > 24 * 3600000000 AS stale FROM obs, n GROUP BY pid, now")
def a20(spark, sf):
    o = observations(spark, sf)
    now = o.agg(F.max("avail").alias("now"))
    g = o.groupBy("pid").agg(F.max("avail").alias("last")).crossJoin(F.broadcast(now))
    return g.select("pid", F.floor((F.col("now") - F.col("last")) / HOUR).alias("age_hours"), (F.col("now") - F.col("last") > DAY).alias("stale"))


@query("a21_segment_fold_matrix", f"WITH {LEDGER}, f AS (SELECT sport, ntile(4) OVER (PARTITION BY sport ORDER BY seq) AS fold, ll FROM ledger), m AS (SELECT sport, fold, avg(ll) AS m FROM f GROUP BY 1, 2) SELECT sport, count(*) AS folds, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM m GROUP BY 1")
def a21(spark, sf):
    f = ledger(spark, sf).withColumn("fold", F.ntile(4).over(Window.partitionBy("sport").orderBy("seq")))
    m = f.groupBy("sport", "fold").agg(F.avg("ll").alias("m"))
    return m.groupBy("sport").agg(F.count("*").alias("folds"), r6(F.avg("m")).alias("mean"), r6(F.stddev_pop("m")).alias("std"))


@query("a22_route_score", "SELECT o_orderpriority AS route, count(*) AS runs, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) + 0.25 / sqrt(1 + count(*)), 6) AS score FROM orders GROUP BY 1")
def a22(spark, sf):
    n = F.count("*")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("route")).agg(n.alias("runs"), r6(F.count_if(F.col("o_orderstatus") == "F") / n + 0.25 / F.sqrt(1 + n)).alias("score"))


@query("a23_daily_counts", f"WITH {OBS} SELECT t // 86400000000 AS day, stat, count(*) AS n FROM obs GROUP BY 1, 2")
def a23(spark, sf):
    return observations(spark, sf).groupBy(F.floor(F.col("t") / DAY).alias("day"), "stat").agg(F.count("*").alias("n"))


@query("a24_exact_ratio", f"WITH {TARGETS}, e AS (SELECT DISTINCT pid FROM obs WHERE event_id % 3 = 0 AND stat = 'error') SELECT count(*) AS n, round(avg(CAST(e.pid IS NOT NULL AS INT)), 6) AS ratio, avg(CAST(e.pid IS NOT NULL AS INT)) >= 0.95 AS passed FROM targets x LEFT JOIN e USING (pid)")
def a24(spark, sf):
    e = observations(spark, sf).where("event_id % 3 = 0 AND stat = 'error'").select("pid").distinct().withColumn("hit", F.lit(1))
    r = F.avg(F.coalesce("hit", F.lit(0)))
    return targets(spark, sf).join(e, "pid", "left").agg(F.count("*").alias("n"), r6(r).alias("ratio"), (r >= 0.95).alias("passed"))


#: The stages in order, and the evidence that each step above PIT_VALIDATED needs.
STAGES = ("DISCOVERED", "METADATA_CHECKED", "DATA_FEASIBLE", "PIT_VALIDATED", "SHADOW", "OOS_ROBUSTNESS", "LIMITED_PRODUCTION", "STABLE_PRODUCTION", "SCALE_UP")
SCOPES = """scopes AS (SELECT l_suppkey % 97 AS scope, count(*) AS events, count(*) FILTER (WHERE l_linestatus = 'F') AS verified, avg(CAST(l_tax <= 0.07 + (l_suppkey % 97 % 3) / 100.0 AS INTEGER)) AS exact, l_suppkey % 97 % 7 AS evidence, l_suppkey % 97 % 5 AS clean_runs FROM lineitem GROUP BY 1, 5, 6)"""


@query("a25_stage_ladder", f"""WITH {SCOPES}, s AS (SELECT *, CASE WHEN events < 120 THEN 1 WHEN verified < 80 OR exact < 0.95 THEN 2 WHEN evidence < 1 THEN 3 WHEN evidence < 2 THEN 4 WHEN evidence < 4 THEN 5 WHEN evidence < 5 OR clean_runs < 3 THEN 6 WHEN evidence < 6 OR clean_runs < 4 THEN 7 ELSE 8 END AS rank FROM scopes)
SELECT scope, rank, ['{"', '".join(STAGES)}'][rank + 1] AS stage, round(rank * 1000 + least(events / 120, 2) * 100 + verified / greatest(events, 1) * 100 + exact * 100, 4) AS priority FROM s""")
def a25(spark, sf):
    """The furthest stage whose steps are all evidenced (events, outcomes, exact sources, then shadow runs, robustness, admission and clean runs), and a priority in which the stage outweighs the data."""
    k = F.col("l_suppkey") % 97
    x = table(spark, sf, "lineitem").withColumn("scope", k)
    x = x.groupBy("scope").agg(F.count("*").alias("events"), F.count_if(F.col("l_linestatus") == "F").alias("verified"), F.avg((F.col("l_tax") <= 0.07 + (k % 3) / 100.0).cast("int")).alias("exact"))
    e, runs = F.col("scope") % 7, F.col("scope") % 5
    rank = F.when(F.col("events") < 120, 1).when((F.col("verified") < 80) | (F.col("exact") < 0.95), 2).when(e < 1, 3).when(e < 2, 4).when(e < 4, 5).when((e < 5) | (runs < 3), 6).when((e < 6) | (runs < 4), 7).otherwise(8)
    score = F.col("rank") * 1000 + F.least(F.col("events") / 120, F.lit(2.0)) * 100 + F.col("verified") / F.greatest("events", F.lit(1)) * 100 + F.col("exact") * 100
    return x.withColumn("rank", rank).select("scope", "rank", F.get(F.array(*map(F.lit, STAGES)), F.col("rank")).alias("stage"), F.round(score, 4).alias("priority"))


@query("a26_world_summary", f"WITH {PREDICTIONS} SELECT sport, round(avg(p2), 6) AS mean, round(quantile_cont(p2, 0.1), 6) AS p10, round(quantile_cont(p2, 0.9), 6) AS p90, round(avg(CAST(p2 < 0.1 AS INT)), 6) AS tail, round(var_pop(p2), 6) AS spread FROM preds GROUP BY 1")
def a26(spark, sf):
    q = lambda x: r6(F.percentile("p2", F.lit(x)))
    return predictions(spark, sf).groupBy("sport").agg(r6(F.avg("p2")).alias("mean"), q(0.1).alias("p10"), q(0.9).alias("p90"), r6(F.avg((F.col("p2") < 0.1).cast("int"))).alias("tail"), r6(F.var_pop("p2")).alias("spread"))
