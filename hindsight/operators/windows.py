"""Window operators: dedup, rolling and causal statistics, streaks, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import DAY, HOUR, KNOWN, MATCHES, OBS, PREDICTIONS, TARGETS, admitted_results, matches, observations, predictions, table, targets
from .aggregates import LEDGER, SIDES, ledger, sides
from .pit import asof_join
from .predicates import r6


def by_seq():
    return Window.partitionBy("sport").orderBy("seq")


#: Rows of a part of a sport's order.
PART = 5000


def overlapping(rows: DataFrame, size: int, overlap: int, ahead: int = 0) -> DataFrame:
    """rows(sport, seq) cut into parts of `size` rows, each led by the `overlap` rows before it and followed by the `ahead` rows after it (own is false), so that windows of bounded reach run in parallel."""
    i = F.col("seq") - 1
    part = F.floor(i / size)
    parts = F.sequence(F.greatest(F.floor((i - ahead) / size), F.lit(0)), F.floor((i + overlap) / size))
    return rows.withColumn("part", F.explode(parts)).withColumn("own", F.col("part") == part)


def parted(rows: DataFrame, before: int, after: int = 0) -> DataFrame:
    return overlapping(rows, PART, before, after)


def sized(rows: DataFrame, key: str = "sport") -> DataFrame:
    """rows with n, how many their key has."""
    return rows.join(rows.groupBy(key).agg(F.count("*").cast("int").alias("n")), key)


def part_of(seq: Column, n: Column, parts: int) -> Column:
    """The number (from 0) of the part that row seq of n falls in, if the first n % parts parts hold one row more."""
    i, small, more = seq - 1, F.floor(n / parts), n % parts
    cut = more * (small + 1)
    return F.when(i < cut, F.floor(i / (small + 1))).otherwise(more + F.floor((i - cut) / F.greatest(small, F.lit(1)))).cast("int")


def in_part():
    """The order of a part of a sport, for rows that are parted far enough."""
    return Window.partitionBy("sport", "part").orderBy("seq")


def own(rows: DataFrame) -> DataFrame:
    """The parts' own rows."""
    return rows.where("own").drop("own", "part")


def trailing(n: int, current: bool = True):
    """Of parted rows the last n, this one included or not."""
    return in_part().rowsBetween(-(n - 1), 0) if current else in_part().rowsBetween(-n, -1)


@query("w1_dedup_five_keys", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_shipdate DESC, l_quantity DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def w1(spark, sf):
    key = F.struct(F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("f"), (-F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)")).alias("d"), (-F.col("l_quantity")).alias("q"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(key).alias("m"))  # as row_number() = 1, with map-side combining
    return g.select("l_orderkey", "m.l_linenumber", "m.l_partkey", "m.l_suppkey")


@query("w2_rank_then_filter", f"WITH {OBS} SELECT pid, stat, event_id FROM (SELECT *, row_number() OVER (PARTITION BY pid, stat ORDER BY CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END, t DESC, event_id DESC) AS rn FROM obs) WHERE rn = 1 AND event_id % 3 = 0")
def w2(spark, sf):
    w = Window.partitionBy("pid", "stat").orderBy(F.when(F.col("event_id") % 3 == 0, 0).otherwise(1), F.desc("t"), F.desc("event_id"))
    return observations(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn = 1").where("event_id % 3 = 0").select("pid", "stat", "event_id")


def result_sides(m: DataFrame) -> DataFrame:
    """Both sides of each admitted result, with the time from which it may be used."""
    return admitted_results(m).select("sport", "t", "match_id", "due", F.expr("stack(2, 'A', a, 'B', b) AS (side, pid)"), "outcome").withColumn("won", (F.col("outcome") == F.col("side")).cast("int"))


def probe_sides(m: DataFrame) -> DataFrame:
    return m.select("sport", "match_id", (F.col("t") - HOUR).alias("cutoff"), F.expr("stack(2, 'A', a, 'B', b) AS (side, pid)"))


def running_form(m: DataFrame) -> DataFrame:
    """Means of each side's last 5, 10 and 20 results admitted at the cutoff: they roll along the results, and each match takes those of the last one admitted."""
    w = Window.partitionBy("sport", "pid").orderBy("t", "match_id")
    form = lambda n: F.avg("won").over(w.rowsBetween(1 - n, 0)).alias(f"form{n}")
    r = result_sides(m).select("sport", "pid", "due", "t", F.col("match_id").alias("result"), *map(form, (5, 10, 20)))
    j = asof_join(probe_sides(m), r, ["sport", "pid"], "cutoff", "due", ["t", "result", "form5", "form10", "form20"])
    return j.select("match_id", "side", "pid", *(F.col(f"last_form{n}").alias(f"form{n}") for n in (5, 10, 20)))


@query("w3_running_form", f"""WITH {KNOWN}, f AS (SELECT match_id, side, any_value(pid) AS pid, avg(won) FILTER (WHERE rn <= 5) AS form5, avg(won) FILTER (WHERE rn <= 10) AS form10, avg(won) FILTER (WHERE rn <= 20) AS form20 FROM past GROUP BY 1, 2)
SELECT match_id, side, pid, round(form5, 6) AS form5, round(form10, 6) AS form10, round(form20, 6) AS form20, round(form5 - form20, 6) AS delta FROM f""")
def w3(spark, sf):
    form = running_form(matches(spark, sf))
    return form.select("match_id", "side", "pid", r6("form5").alias("form5"), r6("form10").alias("form10"), r6("form20").alias("form20"), r6(F.col("form5") - F.col("form20")).alias("delta"))


def streaks(m: DataFrame, most: int = 20) -> DataFrame:
    """The run of equal results, at most `most`, that each side stands in at the cutoff, and whether they were won."""
    w = Window.partitionBy("sport", "pid").orderBy("t", "match_id")
    r = result_sides(m).withColumn("change", (~F.col("won").eqNullSafe(F.lag("won").over(w))).cast("int"))
    r = r.withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.least(F.row_number().over(Window.partitionBy("sport", "pid", "island").orderBy("t", "match_id")), F.lit(most))
    r = r.select("sport", "pid", "due", "t", F.col("match_id").alias("result"), run.alias("run"), "won")
    j = asof_join(probe_sides(m), r, ["sport", "pid"], "cutoff", "due", ["t", "result", "run", "won"])
    return j.select("match_id", "side", "pid", F.coalesce("last_run", F.lit(0)).alias("streak"), F.col("last_won").alias("won"))


@query("w5_streak", f"""WITH {KNOWN}, p AS (SELECT *, max(won) FILTER (WHERE rn = 1) OVER (PARTITION BY match_id, side) AS newest FROM past WHERE rn <= 20),
 s AS (SELECT match_id, side, any_value(pid) AS pid, any_value(newest) AS won, coalesce(min(rn) FILTER (WHERE won <> newest) - 1, count(won)) AS streak FROM p GROUP BY 1, 2)
SELECT match_id, side, pid, CAST(streak AS INTEGER) AS streak, CAST(CASE WHEN won = 1 THEN streak ELSE 0 END AS INTEGER) AS streak_won, CAST(CASE WHEN won = 0 THEN streak ELSE 0 END AS INTEGER) AS streak_lost FROM s""")
def w5(spark, sf):
    part = lambda v: F.when(F.col("won") == v, F.col("streak")).otherwise(0)
    return streaks(matches(spark, sf)).select("match_id", "side", "pid", "streak", part(1).alias("streak_won"), part(0).alias("streak_lost"))


@query("w6_rest_days", f"WITH {TARGETS} SELECT event_id, round((t - lag(t) OVER (PARTITION BY pid ORDER BY t, event_id)) / 8.64e10, 6) AS rest, coalesce((t - lag(t) OVER (PARTITION BY pid ORDER BY t, event_id)) / 8.64e10 < 2, false) AS short FROM targets")
def w6(spark, sf):
    rest = (F.col("t") - F.lag("t").over(Window.partitionBy("pid").orderBy("t", "event_id"))) / 8.64e10
    return targets(spark, sf).select("event_id", r6(rest).alias("rest"), F.coalesce(rest < 2, F.lit(False)).alias("short"))


@query("w7_range_counts", f"WITH {TARGETS}, p AS (SELECT x.event_id, x.t, y.t AS pt, row_number() OVER (PARTITION BY x.event_id ORDER BY y.t DESC, y.event_id DESC) AS rn FROM targets x LEFT JOIN targets y ON y.pid = x.pid AND y.t < x.t) SELECT event_id, " + ", ".join(f"count(pt) FILTER (WHERE pt >= t - {d} * 86400000000) AS d{d}" for d in (7, 14, 30)) + " FROM p WHERE rn <= 100 GROUP BY 1")
def w7(spark, sf):
    """Earlier events within 7, 14 and 30 days, of the newest 100: the smaller of 100 and the count in the range."""
    w = Window.partitionBy("pid").orderBy("t")
    return targets(spark, sf).select("event_id", *(F.least(F.count("*").over(w.rangeBetween(-d * DAY, -1)), F.lit(100)).alias(f"d{d}") for d in (7, 14, 30)))


@query("w8_schedule_counts", f"WITH {TARGETS}, r AS (SELECT event_id, t, list(t) OVER (PARTITION BY pid ORDER BY t, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS past FROM targets) SELECT event_id, " + ", ".join(f"len(list_filter(coalesce(past, []), lambda p: t - p <= {d} * 86400000000)) AS d{d}" for d in (3, 7, 14)) + " FROM r")
def w8(spark, sf):
    past = F.collect_list("t").over(Window.partitionBy("pid").orderBy("t", "event_id").rowsBetween(-20, -1))
    n = lambda d: F.size(F.filter("past", lambda p: F.col("t") - p <= d * DAY)).cast("long")
    return targets(spark, sf).withColumn("past", past).select("event_id", *(n(d).alias(f"d{d}") for d in (3, 7, 14)))


ROWS = "OVER (PARTITION BY sport ORDER BY seq ROWS BETWEEN {} AND {})"
L10 = ROWS.format("9 PRECEDING", "CURRENT ROW")


@query("w9_rolling_mean_std", f"WITH {PREDICTIONS} SELECT match_id, round(avg(p1) {L10}, 6) AS mean, round(stddev_pop(p1) {L10}, 6) AS std FROM preds")
def w9(spark, sf):
    x = parted(predictions(spark, sf), 9)
    return own(x.select("own", "match_id", r6(F.avg("p1").over(trailing(10))).alias("mean"), r6(F.stddev_pop("p1").over(trailing(10))).alias("std")))


def causal_slope(y: str, n: int) -> Column:
    """Least-squares slope over the trailing n rows; 0 for one row."""
    w = trailing(n)
    x = F.col("seq").cast("double")
    cov = F.avg(x * F.col(y)).over(w) - F.avg(x).over(w) * F.avg(y).over(w)
    var = F.avg(x * x).over(w) - F.avg(x).over(w) * F.avg(x).over(w)
    return F.when(F.count("*").over(w) > 1, cov / var).otherwise(F.lit(0.0))


@query("w10_causal_slope", f"WITH {PREDICTIONS} SELECT match_id, round(coalesce(CASE WHEN count(*) {L10} > 1 THEN regr_slope(p1, seq) {L10} END, 0), 5) AS slope FROM preds")
def w10(spark, sf):
    return own(parted(predictions(spark, sf), 9).select("own", "match_id", F.round(causal_slope("p1", 10), 5).alias("slope")))


@query("w11_differences", f"WITH {PREDICTIONS} SELECT match_id, round(p1 - lag(p1) OVER w, 6) AS speed, round(p1 - 2 * lag(p1) OVER w + lag(p1, 2) OVER w, 6) AS acceleration, coalesce((p1 >= 0.5) <> (lag(p1) OVER w >= 0.5), false) AS flip FROM preds WINDOW w AS (PARTITION BY sport ORDER BY seq)")
def w11(spark, sf):
    p, one, two = F.col("p1"), F.lag("p1").over(in_part()), F.lag("p1", 2).over(in_part())
    return own(parted(predictions(spark, sf), 2).select("own", "match_id", r6(p - one).alias("speed"), r6(p - 2 * one + two).alias("acceleration"), F.coalesce((p >= 0.5) != (one >= 0.5), F.lit(False)).alias("flip")))


@query("w12_future_loss", f"WITH {LEDGER} SELECT match_id, round(CASE WHEN count(*) OVER w = 5 THEN avg(ll) OVER w END, 6) AS future FROM ledger WINDOW w AS (PARTITION BY sport ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)")
def w12(spark, sf):
    """The mean loss of the next five rows, a label; null where there are fewer."""
    w = in_part().rowsBetween(1, 5)
    x = parted(ledger(spark, sf), 0, 5)
    return own(x.select("own", "match_id", r6(F.when(F.count("*").over(w) == 5, F.avg("ll").over(w))).alias("future")))


@query("w13_forward_change", f"WITH {PREDICTIONS} SELECT match_id, CAST(lead(p1, 3) OVER w > p1 AS INT) AS rises FROM preds WINDOW w AS (PARTITION BY sport ORDER BY seq)")
def w13(spark, sf):
    return own(parted(predictions(spark, sf), 0, 3).select("own", "match_id", (F.lead("p1", 3).over(in_part()) > F.col("p1")).cast("int").alias("rises")))


P60 = ROWS.format("60 PRECEDING", "1 PRECEDING")


@query("w14_causal_zscore", f"WITH {PREDICTIONS} SELECT match_id, round(CASE WHEN count(*) {P60} >= 5 THEN (p1 - avg(p1) {P60}) / greatest(stddev_pop(p1) {P60}, 1e-6) END, 5) AS z FROM preds")
def w14(spark, sf):
    w = trailing(60, False)
    z = (F.col("p1") - F.avg("p1").over(w)) / F.greatest(F.stddev_pop("p1").over(w), F.lit(1e-6))
    return own(parted(predictions(spark, sf), 60).select("own", "match_id", F.round(F.when(F.count("*").over(w) >= 5, z), 5).alias("z")))


P200 = ROWS.format("200 PRECEDING", "1 PRECEDING")
LOSSES = PREDICTIONS + ", losses AS (SELECT *, " + ", ".join(f"CASE WHEN y = 1 THEN -ln({p}) ELSE -ln(1 - {p}) END AS l{p[1]}" for p in ("p1", "p2", "p3")) + " FROM preds)"


def losses(spark, sf):
    from .predicates import log_loss

    return predictions(spark, sf).select("*", *(log_loss(F.col(f"p{i}"), F.col("y")).alias(f"l{i}") for i in (1, 2, 3)))


@query("w15_safety_gate", f"WITH {LOSSES} SELECT match_id, coalesce(count(*) {P200} >= 20 AND avg(l2 - l1) {P200} <= -0.01, false) AS used, round(CASE WHEN coalesce(count(*) {P200} >= 20 AND avg(l2 - l1) {P200} <= -0.01, false) THEN p2 ELSE p1 END, 6) AS p FROM losses")
def w15(spark, sf):
    """The candidate (p2) is used where it beat the base (p1) by 0.01 over up to 200 earlier rows, 20 at least."""
    w = trailing(200, False)
    use = F.coalesce((F.count("*").over(w) >= 20) & (F.avg(F.col("l2") - F.col("l1")).over(w) <= -0.01), F.lit(False))
    return own(parted(losses(spark, sf), 200).withColumn("used", use)).select("match_id", "used", r6(F.when(F.col("used"), F.col("p2")).otherwise(F.col("p1"))).alias("p"))


P40 = ROWS.format("40 PRECEDING", "1 PRECEDING")


@query("w16_soft_routing", f"WITH {LOSSES}, m AS (SELECT match_id, p1, p2, p3, coalesce(avg(l1) {P40}, 0) AS a, coalesce(avg(l2) {P40}, 0) AS b, coalesce(avg(l3) {P40}, 0) AS c FROM losses), e AS (SELECT *, exp(-a / 0.15) AS x, exp(-b / 0.15) AS y, exp(-c / 0.15) AS z FROM m) SELECT match_id, round((x * p1 + y * p2 + z * p3) / (x + y + z), 5) AS p FROM e")
def w16(spark, sf):
    w = trailing(40, False)
    e = own(parted(losses(spark, sf), 40).select("own", "match_id", "p1", "p2", "p3", *(F.exp(-F.coalesce(F.avg(f"l{i}").over(w), F.lit(0.0)) / 0.15).alias(f"w{i}") for i in (1, 2, 3))))
    return e.select("match_id", F.round(sum(F.col(f"w{i}") * F.col(f"p{i}") for i in (1, 2, 3)) / sum(F.col(f"w{i}") for i in (1, 2, 3)), 5).alias("p"))


@query("w17_recent_loss", f"WITH {LOSSES}, r AS (SELECT sport, l1, row_number() OVER (PARTITION BY sport ORDER BY seq DESC) AS rn, least(count(*) OVER (PARTITION BY sport), 180) AS n FROM losses) SELECT sport, round(sum(l1 * exp(-(rn - 1) / (n - 1))) / sum(exp(-(rn - 1) / (n - 1))), 6) AS loss FROM r WHERE rn <= 180 GROUP BY 1")
def w17(spark, sf):
    """Loss of the last 180 rows with weights from e**-1 (oldest) to 1."""
    w = Window.partitionBy("sport")
    r = losses(spark, sf).select("sport", "l1", F.row_number().over(w.orderBy(F.desc("seq"))).alias("rn"), F.least(F.count("*").over(w), F.lit(180)).alias("n")).where("rn <= 180")
    e = F.exp(-(F.col("rn") - 1) / (F.col("n") - 1))
    return r.groupBy("sport").agg(r6(F.sum(F.col("l1") * e) / F.sum(e)).alias("loss"))


L30 = ROWS.format("29 PRECEDING", "CURRENT ROW")


@query("w18_worst_window", f"WITH {LOSSES}, r AS (SELECT sport, seq, round(avg(l1) {L30}, 9) AS m, count(*) {L30} AS n FROM losses) SELECT sport, round(max(m), 6) AS loss, arg_max(seq, (m, -seq)) AS at_seq FROM r WHERE n = 30 GROUP BY 1")
def w18(spark, sf):
    x = parted(losses(spark, sf), 29)
    r = own(x.select("own", "sport", "seq", F.round(F.avg("l1").over(trailing(30)), 9).alias("m"), F.count("*").over(trailing(30)).alias("n"))).where("n = 30")
    g = r.groupBy("sport").agg(F.max(F.struct("m", (-F.col("seq")).alias("s"))).alias("x"))
    return g.select("sport", r6("x.m").alias("loss"), (-F.col("x.s")).alias("at_seq"))


@query("w19_risk_coverage", f"WITH {LEDGER}, r AS (SELECT sport, 1 - ok AS err, row_number() OVER (PARTITION BY sport ORDER BY least(p1, 1 - p1), seq) AS rn, count(*) OVER (PARTITION BY sport) AS n, sum(1 - ok) OVER (PARTITION BY sport ORDER BY least(p1, 1 - p1), seq ROWS UNBOUNDED PRECEDING) AS e FROM ledger), c AS (SELECT sport, rn / n AS x, e / rn AS risk, lag(rn / n) OVER (PARTITION BY sport ORDER BY rn) AS px, lag(e / rn) OVER (PARTITION BY sport ORDER BY rn) AS pr FROM r) SELECT sport, round(sum((x - px) * (risk + pr) / 2), 6) AS aurc FROM c GROUP BY 1")
def w19(spark, sf):
    """Area under the risk-coverage curve, from the surest prediction on, by the trapezoid rule."""
    w = Window.partitionBy("sport")
    o = w.orderBy(F.least("p1", 1 - F.col("p1")), "seq")
    r = ledger(spark, sf).select("sport", F.row_number().over(o).alias("rn"), F.count("*").over(w).alias("n"), F.sum(1 - F.col("ok")).over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("e"))
    r = r.select("sport", "rn", (F.col("rn") / F.col("n")).alias("x"), (F.col("e") / F.col("rn")).alias("risk"))
    p = w.orderBy("rn")
    return r.select("sport", ((F.col("x") - F.lag("x").over(p)) * (F.col("risk") + F.lag("risk").over(p)) / 2).alias("a")).groupBy("sport").agg(r6(F.sum("a")).alias("aurc"))


@query("w20_quartile_bands", f"WITH {PREDICTIONS}, r AS (SELECT match_id, row_number() OVER (PARTITION BY sport ORDER BY p1, seq) AS rn, count(*) OVER (PARTITION BY sport) AS n FROM preds) SELECT match_id, CASE WHEN rn <= n // 4 THEN 'bottom' WHEN rn > n - n // 4 THEN 'top' ELSE 'middle' END AS band FROM r")
def w20(spark, sf):
    w = Window.partitionBy("sport")
    r = predictions(spark, sf).select("match_id", F.row_number().over(w.orderBy("p1", "seq")).alias("rn"), F.count("*").over(w).alias("n"))
    q = F.floor(F.col("n") / 4)
    return r.select("match_id", F.when(F.col("rn") <= q, "bottom").when(F.col("rn") > F.col("n") - q, "top").otherwise("middle").alias("band"))


@query("w22_recent_context", f"WITH {OBS} SELECT event_id, count(*) FILTER (WHERE event_id % 3 = 0) OVER (PARTITION BY pid ORDER BY t RANGE BETWEEN 30 * 86400000000 PRECEDING AND 1 PRECEDING) AS recent FROM obs")
def w22(spark, sf):
    return observations(spark, sf).select("event_id", F.count_if(F.col("event_id") % 3 == 0).over(Window.partitionBy("pid").orderBy("t").rangeBetween(-30 * DAY, -1)).alias("recent"))


def head_to_head(m: DataFrame, most: int = 20) -> DataFrame:
    """n and value (2 * share won - 1, seen from side A) of the last `most` meetings of the two sides that are admitted at the cutoff; value is 0 without any."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    won = ((F.col("outcome") == "A") == (F.col("a") < F.col("b"))).cast("int")  # by the smaller id
    r = admitted_results(m).select("sport", low.alias("x"), high.alias("y"), "due", "t", F.col("match_id").alias("result"), won.alias("won"))
    w = Window.partitionBy("sport", "x", "y").orderBy("t", "result").rowsBetween(1 - most, 0)
    r = r.select("sport", "x", "y", "due", "t", "result", F.count("*").over(w).alias("n"), F.avg("won").over(w).alias("share"))
    p = m.where("a <> b").select("sport", low.alias("x"), high.alias("y"), "match_id", (F.col("t") - HOUR).alias("cutoff"), (F.col("a") < F.col("b")).alias("ahead"))
    j = asof_join(p, r, ["sport", "x", "y"], "cutoff", "due", ["t", "result", "n", "share"])
    value = (2 * F.col("last_share") - 1) * F.when(F.col("ahead"), 1).otherwise(-1)
    return j.select("match_id", F.coalesce("last_n", F.lit(0)).alias("n"), F.coalesce(value, F.lit(0.0)).alias("value"))


@query("q4_head_to_head", f"""WITH {KNOWN}, h AS (SELECT x.match_id, x.a, k.a AS ka, k.outcome, row_number() OVER (PARTITION BY x.match_id ORDER BY k.t DESC, k.match_id DESC) AS rn
 FROM matches x LEFT JOIN known k ON k.sport = x.sport AND least(k.a, k.b) = least(x.a, x.b) AND greatest(k.a, k.b) = greatest(x.a, x.b) AND k.due <= x.t - 3600000000 WHERE x.a <> x.b)
SELECT match_id, count(outcome) AS n, round(coalesce(2 * avg(CASE WHEN outcome IS NOT NULL THEN CAST((outcome = 'A') = (a = ka) AS INTEGER) END) - 1, 0), 6) AS value FROM h WHERE rn <= 20 GROUP BY 1""")
def q4(spark, sf):
    return head_to_head(matches(spark, sf)).select("match_id", "n", r6("value").alias("value"))


@query("q5_label_maturity", f"WITH {MATCHES} SELECT match_id, greatest(coalesce(CASE WHEN match_id % 2 = 0 THEN t + 7200000000 END, t + 86400000000), CASE WHEN match_id % 3 = 0 THEN avail END) AS realized FROM matches WHERE sport <> 'error' OR match_id % 3 = 0")
def q5(spark, sf):
    """Realised at the end if known, else a day after the start, and not before an exact source; one sport's rows need such a source."""
    i = F.col("match_id")
    end, exact = F.when(i % 2 == 0, F.col("t") + 2 * HOUR), F.when(i % 3 == 0, F.col("avail"))
    return matches(spark, sf).where((F.col("sport") != "error") | (i % 3 == 0)).select("match_id", F.greatest(F.coalesce(end, F.col("t") + DAY), exact).alias("realized"))


@query("q6_eligible_rows", f"WITH {SIDES}, f AS (SELECT pid, min(t) AS first FROM sides GROUP BY 1) SELECT m.match_id FROM matches m JOIN f x ON x.pid = m.a JOIN f y ON y.pid = m.b WHERE least(x.first, y.first) < m.t")
def q6(spark, sf):
    m = matches(spark, sf)
    first = sides(m).groupBy("pid").agg(F.min("t").alias("first"))
    s = sides(m).join(first, "pid").groupBy("match_id", "t").agg(F.min("first").alias("first"))
    return s.where("first < t").select("match_id")


@query("q7_inevent_state", f"""WITH {OBS}, b AS (SELECT pid, stat, t // 86400000000 AS day, (t % 86400000000) // 3600000000 // 6 AS bin, value, t, event_id FROM obs), l AS (SELECT pid, day, bin, stat, arg_max(value, (t, event_id)) AS v FROM b GROUP BY 1, 2, 3, 4)
SELECT pid, day, bin, {', '.join(f"coalesce(max(v) FILTER (WHERE stat = '{s}'), 0) AS {s}, CAST(count(*) FILTER (WHERE stat = '{s}') > 0 AS INT) AS has_{s}" for s in ('view', 'click'))} FROM l GROUP BY 1, 2, 3""")
def q7(spark, sf):
    """Six-hour bins of each participant's day: the latest value of each stat in the bin, with a flag for presence."""
    b = observations(spark, sf).withColumns({"day": F.floor(F.col("t") / DAY), "bin": F.floor((F.col("t") % DAY) / (6 * HOUR))})
    last = lambda s: F.max(F.when(F.col("stat") == s, F.struct("t", "event_id", "value")))["value"]
    return b.groupBy("pid", "day", "bin").agg(*(c for s in ("view", "click") for c in (F.coalesce(last(s), F.lit(0.0)).alias(s), (F.count_if(F.col("stat") == s) > 0).cast("int").alias(f"has_{s}"))))


def spread(values: Column) -> Column:
    """Population standard deviation of an array in its order, by Welford's update, mean first.

    Spark's own stddev_pop rounds an update in another way, which tells at a threshold that values meet exactly.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + (x - mean) * (x - acc["mean"])).alias("m2"))

    return F.aggregate(values, start, add, lambda acc: F.sqrt(acc["m2"] / acc["n"]))


def regimes(rows: DataFrame) -> DataFrame:
    """(match_id, regime, moved) of rows(sport, seq, match_id, p1): what the last ten values look like, and whether that is new."""
    w = trailing(10)
    mean = F.avg("p1").over(w)
    regime = F.when(spread(F.collect_list("p1").over(w)) > 0.28, "volatile").when(mean > 0.52, "up").when(mean < 0.46, "down").otherwise("flat")
    r = parted(rows, 10).withColumn("regime", regime)
    return own(r.select("own", "match_id", "regime", F.coalesce(F.col("regime") != F.lag("regime").over(in_part()), F.lit(False)).alias("moved")))


@query("q11_regime", f"WITH {PREDICTIONS}, r AS (SELECT match_id, sport, seq, CASE WHEN stddev_pop(p1) {L10} > 0.28 THEN 'volatile' WHEN avg(p1) {L10} > 0.52 THEN 'up' WHEN avg(p1) {L10} < 0.46 THEN 'down' ELSE 'flat' END AS regime FROM preds) SELECT match_id, regime, coalesce(regime <> lag(regime) OVER (PARTITION BY sport ORDER BY seq), false) AS moved FROM r")
def q11(spark, sf):
    return regimes(predictions(spark, sf))


@query("q12_revision_metrics", f"WITH {PREDICTIONS}, d AS (SELECT sport, p1 - lag(p1) OVER (PARTITION BY sport ORDER BY seq) AS d FROM preds) SELECT sport, count(d) AS n, round(avg(abs(d)), 6) AS mean_abs, round(max(abs(d)), 6) AS max_abs, count(*) FILTER (WHERE abs(d) > 0.3) AS jumps FROM d GROUP BY 1")
def q12(spark, sf):
    d = own(parted(predictions(spark, sf), 1).select("own", "sport", (F.col("p1") - F.lag("p1").over(in_part())).alias("d")))
    return d.groupBy("sport").agg(F.count("d").alias("n"), r6(F.avg(F.abs("d"))).alias("mean_abs"), r6(F.max(F.abs("d"))).alias("max_abs"), F.count_if(F.abs("d") > 0.3).alias("jumps"))
