"""Point-in-time joins: as-of, bounded history, forward as-of, provenance and admission."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import DAY, HOUR, KNOWN, MATCHES, MIN, OBS, TARGETS, admitted_results, matches, observations, table, targets
from ..sources.store import Store, merge_stores
from ..sources.work import work_dir


def asof_join(probes: DataFrame, builds: DataFrame, keys: list[str], probe_time: str, build_time: str, values: list[str]) -> DataFrame:
    """Each probe with the newest build row of its key at or before its time (nulls, if none).

    One shuffle and one sort: probes and builds are united, and the last build row is carried forward.
    Of builds of one time the largest (by `values`) counts.
    """
    p = probes.select(*keys, F.col(probe_time).alias("_t"), F.lit(1).alias("_kind"), F.struct(*probes.columns).alias("_probe"), F.lit(None).cast(builds.select(F.struct(build_time, *values)).schema[0].dataType).alias("_build"))
    b = builds.select(*keys, F.col(build_time).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(p.schema["_probe"].dataType).alias("_probe"), F.struct(build_time, *values).alias("_build"))
    w = Window.partitionBy(*keys).orderBy("_t", "_kind", "_build").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(b).withColumn("_last", F.last("_build", ignorenulls=True).over(w)).where("_kind = 1")
    return both.select("_probe.*", F.col(f"_last.{build_time}").alias(f"last_{build_time}"), *(F.col(f"_last.{v}").alias(f"last_{v}") for v in values))


class Newest:
    """The newest values of one key that a later probe may ask for.

    A probe asks for the `most` newest values before its time. Every later probe's time is at least `low`,
    so of the values before `low` the `most` newest are kept, and of the others all.
    """

    def __init__(self, most: int):
        self.most, self.old, self.young = most, [], []  # both sorted by (time, id)

    def add(self, t: int, i: int, value: float) -> None:
        bisect.insort(self.young, (t, i, value))

    def settle(self, low: int) -> None:
        k = bisect.bisect_left(self.young, (low,))
        if k:
            self.old = sorted(self.old + self.young[:k])[-self.most :]
            del self.young[:k]

    def before(self, t: int) -> list[float]:
        k = bisect.bisect_left(self.young, (t,))
        return [v for *_, v in (self.old + self.young[:k])[-self.most :]] if k else [v for *_, v in self.old]


def bounded_history(probes: DataFrame, obs: DataFrame, most: int = 20) -> DataFrame:
    """n, mean, last, std and trend of the `most` newest values per (probe, stat) that were known at the cutoff.

    probes(event_id, pid, t, cutoff), obs(event_id, pid, stat, value, t, avail). A value counts if its time
    is before the probe's and it was effective and available at the cutoff, which may be before or after
    the probe's time; of values of one time the larger event_id is the newer. Keys are streamed in the
    order in which values become known, with the state of `Newest`. A probe meets the stats that its
    participant has at all. One value: std and trend are 0.
    """
    stats = obs.select("pid", "stat").distinct()
    known = F.greatest("t", "avail")
    p = probes.join(stats, "pid").select("pid", "stat", F.col("cutoff").alias("at"), F.lit(1).alias("kind"), "event_id", F.col("t"), F.lit(None).cast("double").alias("value"))
    o = obs.select("pid", "stat", known.alias("at"), F.lit(0).alias("kind"), "event_id", "t", "value")
    out = "event_id long, pid long, stat string, n long, mean double, last double, std double, trend double"

    def task(frames):
        key, held = None, Newest(most)
        for f in frames:
            rows = []
            for pid, stat, kind, event_id, t, value, low in zip(f.pid, f.stat, f.kind, f.event_id, f.t, f.value, f.low, strict=True):
                if (pid, stat) != key:
                    key, held = (pid, stat), Newest(most)
                if low is None or low != low:
                    continue  # no later probe
                if kind == 0:
                    held.add(t, event_id, value)
                    held.settle(low)
                else:
                    held.settle(low)
                    if v := held.before(t):
                        n, m = len(v), sum(v) / len(v)
                        rows.append((int(event_id), pid, stat, n, m, v[-1], (sum((x - m) ** 2 for x in v) / n) ** 0.5 if n > 1 else 0.0, v[-1] - v[0] if n > 1 else 0.0))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    w = Window.partitionBy("pid", "stat").orderBy(F.desc("at"), F.desc("kind")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(o).withColumn("low", F.min(F.when(F.col("kind") == 1, F.col("t"))).over(w))
    return both.sortWithinPartitions("pid", "stat", "at", "kind", "t", "event_id").mapInPandas(task, out)


@query("j10_bounded_history", f"""WITH {TARGETS}, h AS (SELECT x.event_id, x.pid, o.stat, o.value, row_number() OVER (PARTITION BY x.event_id, o.stat ORDER BY o.t DESC, o.event_id DESC) AS rn
  FROM targets x JOIN obs o ON o.pid = x.pid AND o.t < x.t AND greatest(o.t, o.avail) <= x.cutoff)
SELECT event_id, pid, stat, count(*) AS n, round(avg(value), 6) AS mean, round(max(value) FILTER (WHERE rn = 1), 6) AS last, round(CASE WHEN count(*) > 1 THEN stddev_pop(value) ELSE 0 END, 6) AS std,
  round(arg_min(value, rn) - arg_max(value, rn), 6) AS trend FROM h WHERE rn <= 20 GROUP BY 1, 2, 3""")
def j10(spark, sf):
    h = bounded_history(targets(spark, sf), observations(spark, sf))
    return h.select("event_id", "pid", "stat", "n", *(F.round(c, 6).alias(c) for c in ("mean", "last", "std", "trend")))


@query("j1_side_pivot", f"WITH {MATCHES}, s AS (SELECT match_id, 'A' AS side, a AS pid FROM matches UNION ALL SELECT match_id, 'B', b FROM matches) SELECT match_id, max(pid) FILTER (WHERE side = 'A') AS side_a, max(pid) FILTER (WHERE side = 'B') AS side_b FROM s GROUP BY 1")
def j1(spark, sf):
    m = matches(spark, sf)
    sides = m.select("match_id", F.expr("stack(2, 'A', a, 'B', b) AS (side, pid)"))
    return sides.groupBy("match_id").agg(*(F.max(F.when(F.col("side") == s, F.col("pid"))).alias(f"side_{s.lower()}") for s in "AB"))


@query("j2_outcome_join", f"WITH {MATCHES} SELECT o.event_id, m.match_id, m.outcome FROM obs o JOIN matches m ON m.match_id = o.event_id WHERE m.outcome IN ('A', 'B')")
def j2(spark, sf):
    m = matches(spark, sf).where(F.col("outcome").isin("A", "B")).select("match_id", "outcome")
    return observations(spark, sf).select("event_id").join(m, F.col("event_id") == F.col("match_id"))


@query("j3_left_names", "SELECT o.o_orderkey, o.o_custkey, coalesce(c.c_name, 'unknown') AS name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0")
def j3(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf, "orders").join(c, "o_custkey", "left").select("o_orderkey", "o_custkey", F.coalesce("c_name", F.lit("unknown")).alias("name"))


def _snapshots(spark, sf):
    """Source snapshots: a stat's value by hour of day as source; every fifth is source-wide (no event time)."""
    o = observations(spark, sf)
    return o.select(F.col("event_id").alias("snap"), F.col("pid").alias("source"), F.when(F.col("event_id") % 5 != 0, F.floor(F.col("t") / DAY)).alias("day"), "avail", F.when(F.col("event_id") % 3 == 0, "EXACT").otherwise("UNVERIFIABLE").alias("status"))


SNAP = TARGETS + ", snaps AS (SELECT event_id AS snap, pid AS source, CASE WHEN event_id % 5 <> 0 THEN t // 86400000000 END AS day, avail, CASE WHEN event_id % 3 = 0 THEN 'EXACT' ELSE 'UNVERIFIABLE' END AS status FROM obs)"


def provenance(rows: DataFrame, snaps: DataFrame) -> DataFrame:
    """Earliest availability for each (source, day) of rows: the wildcard join as two equi-joins, each on pre-aggregated snapshots."""
    exact = snaps.where("status = 'EXACT'")
    dated = exact.where("day IS NOT NULL").groupBy("source", "day").agg(F.min("avail").alias("d_avail"))
    wide = exact.where("day IS NULL").groupBy("source").agg(F.min("avail").alias("w_avail"))
    out = rows.join(dated, ["source", "day"], "left").join(wide, "source", "left")
    return out.withColumn("available", F.least("d_avail", "w_avail")).drop("d_avail", "w_avail")


@query("j4_provenance_wildcard", f"WITH {SNAP} SELECT x.event_id, min(s.avail) AS available FROM targets x LEFT JOIN snaps s ON s.source = x.pid AND s.status = 'EXACT' AND (s.day IS NULL OR s.day = x.t // 86400000000) GROUP BY 1")
def j4(spark, sf):
    rows = targets(spark, sf).select("event_id", F.col("pid").alias("source"), F.floor(F.col("t") / DAY).alias("day"))
    return provenance(rows, _snapshots(spark, sf)).select("event_id", "available")


@query("j5_scalar_min", f"WITH {SNAP} SELECT event_id, (SELECT min(avail) FROM snaps s WHERE s.source = x.pid AND s.status = 'EXACT') AS earliest FROM targets x")
def j5(spark, sf):
    first = _snapshots(spark, sf).where("status = 'EXACT'").groupBy(F.col("source").alias("pid")).agg(F.min("avail").alias("earliest"))
    return targets(spark, sf).join(first, "pid", "left").select("event_id", "earliest")


@query("j6_scalar_count_distinct", "SELECT c_custkey, (SELECT count(DISTINCT o_orderstatus || o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS n_kinds FROM customer")
def j6(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.countDistinct(F.concat("o_orderstatus", "o_orderpriority")).alias("n_kinds"))
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n_kinds", F.lit(0)).alias("n_kinds"))


@query("j7_scalar_latest", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest FROM customer")
def j7(spark, sf):
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", "latest")


@query("j8_semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j8(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("j9_anti_not_exists", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def j9(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return table(spark, sf, "part").join(li, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey", "p_name")


@query("j11_asof_latest_exact", f"""WITH {TARGETS}, e AS (SELECT * FROM obs WHERE event_id % 3 = 0 AND stat = 'view'), r AS (SELECT x.event_id, x.pid, x.cutoff, e.value, e.t AS vt, row_number() OVER (PARTITION BY x.event_id ORDER BY e.t DESC NULLS LAST, e.value DESC) AS rn
  FROM targets x LEFT JOIN e ON e.pid = x.pid AND e.t <= x.cutoff) SELECT event_id, pid, cutoff, vt AS last_t, value AS last_value FROM r WHERE rn = 1""")
def j11(spark, sf):
    e = observations(spark, sf).where("event_id % 3 = 0 AND stat = 'view'")
    return asof_join(targets(spark, sf).select("event_id", "pid", "cutoff"), e.select("pid", "t", "value"), ["pid"], "cutoff", "t", ["value"])


@query("j12_typed_context", f"""WITH {TARGETS}, r AS (SELECT x.event_id, o.stat, o.value, row_number() OVER (PARTITION BY x.event_id, o.stat ORDER BY o.t DESC, o.event_id DESC) AS rn FROM targets x JOIN obs o ON o.pid = x.pid AND o.t <= x.cutoff AND o.stat IN ('view', 'click', 'error'))
SELECT event_id, max(value) FILTER (WHERE stat = 'view') AS view_value, max(value) FILTER (WHERE stat = 'click') AS click_value, max(value) FILTER (WHERE stat = 'error') AS error_value FROM r WHERE rn = 1 GROUP BY 1""")
def j12(spark, sf):
    stats = ("view", "click", "error")
    probes = targets(spark, sf).select("event_id", "pid", "cutoff", F.explode(F.array(*map(F.lit, stats))).alias("stat"))
    o = observations(spark, sf).where(F.col("stat").isin(*stats)).select("pid", "stat", "t", F.struct("event_id", "value").alias("v"))
    r = asof_join(probes, o, ["pid", "stat"], "cutoff", "t", ["v"]).where("last_t IS NOT NULL")
    return r.groupBy("event_id").agg(*(F.max(F.when(F.col("stat") == s, F.col("last_v.value"))).alias(f"{s}_value") for s in stats))


def forward_asof(anchors: DataFrame, rows: DataFrame, keys: list[str], horizons: list[int]) -> DataFrame:
    """For each anchor(keys, anchor_id, t) and horizon the first row(keys, t, value) at or after t + horizon; anchors that lack one are dropped.

    Rows carry backwards through one sort per key, as in asof_join.
    """
    p = anchors.select(*keys, "anchor_id", F.explode(F.array(*map(F.lit, horizons))).alias("h"), "t").withColumn("_t", F.col("t") + F.col("h"))
    both = p.select(*keys, "_t", F.lit(1).alias("_k"), "anchor_id", "h", F.lit(None).cast("struct<t:bigint,value:double>").alias("row"))
    both = both.unionByName(rows.select(*keys, F.col("t").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast("long").alias("anchor_id"), F.lit(None).cast(p.schema["h"].dataType).alias("h"), F.struct("t", "value").alias("row")))
    w = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_k", F.desc("row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = both.withColumn("row", F.last("row", ignorenulls=True).over(w)).where("_k = 1 AND row IS NOT NULL")
    whole = F.count("*").over(Window.partitionBy(*keys, "anchor_id"))
    return hit.withColumn("n", whole).where(F.col("n") == len(horizons)).select("anchor_id", "h", F.col("row.t").alias("at"), F.col("row.value").alias("value"))


@query("j13_forward_asof", f"""WITH {TARGETS}, h AS (SELECT event_id, pid, t, unnest([3600000000, 86400000000, 259200000000]) AS h FROM targets), r AS (SELECT h.event_id AS anchor_id, h.h, o.t AS at, o.value, row_number() OVER (PARTITION BY h.event_id, h.h ORDER BY o.t, o.value) AS rn FROM h JOIN obs o ON o.pid = h.pid AND o.t >= h.t + h.h)
SELECT anchor_id, h, at, value FROM (SELECT *, count(*) OVER (PARTITION BY anchor_id) AS n FROM r WHERE rn = 1) WHERE n = 3""".replace("o.t AS at", "o.t AS att").replace("anchor_id, h, at, value", 'anchor_id, h, att AS "at", value'))
def j13(spark, sf):
    return forward_asof(targets(spark, sf).select("pid", F.col("event_id").alias("anchor_id"), "t"), observations(spark, sf).select("pid", "t", "value"), ["pid"], [HOUR, DAY, 3 * DAY])


@query("j14_nearest_lead", f"""WITH {OBS}, x AS (SELECT event_id, pid, stat, t, (t // 60000000) % 200 AS lead FROM obs), d AS (SELECT x.*, l.target, abs(lead - l.target) AS gap FROM x, (VALUES (60), (90), (120), (180)) l(target) WHERE abs(lead - l.target) <= 6)
SELECT stat, pid, target, arg_min(event_id, gap * 1000000000 + event_id) AS event_id, min(gap) AS gap FROM d GROUP BY 1, 2, 3""")
def j14(spark, sf):
    """The observation nearest to each of a few leads (minutes), at most 6 off; ties keep the first event."""
    x = observations(spark, sf).select("event_id", "pid", "stat", (F.floor(F.col("t") / MIN) % 200).alias("lead"))
    d = x.withColumn("target", F.explode(F.array(*(F.lit(v) for v in (60, 90, 120, 180))))).withColumn("gap", F.abs(F.col("lead") - F.col("target"))).where("gap <= 6")
    return d.groupBy("stat", "pid", "target").agg(F.min(F.struct("gap", "event_id")).alias("m")).select("stat", "pid", "target", "m.event_id", "m.gap")


@query("j16_interval_latest", f"""WITH {TARGETS}, p AS (SELECT event_id AS pred, pid, t AS generated, avail FROM obs WHERE stat = 'click')
SELECT x.event_id, arg_max(p.pred, p.generated * 1000 + p.pred % 1000) FILTER (WHERE p.avail <= x.t) AS latest, count(*) FILTER (WHERE p.avail > x.t) AS late FROM targets x JOIN p ON p.pid = x.pid AND p.generated BETWEEN x.cutoff - 7 * 86400000000 AND x.cutoff + 900000000 GROUP BY 1""".replace("arg_max(p.pred, p.generated * 1000 + p.pred % 1000)", "arg_max(p.pred, (p.generated, p.pred))"))
def j16(spark, sf):
    """Interval join: predictions of a participant generated in the seven days to the cutoff (15 minutes' grace); days are the equi-join's bins."""
    x = targets(spark, sf)
    lo, hi = F.col("cutoff") - 7 * DAY, F.col("cutoff") + 15 * MIN
    x = x.withColumn("day", F.explode(F.sequence(F.floor(lo / DAY), F.floor(hi / DAY))))
    p = observations(spark, sf).where("stat = 'click'").select(F.col("event_id").alias("pred"), "pid", F.col("t").alias("generated"), "avail", F.floor(F.col("t") / DAY).alias("day"))
    j = x.join(p, ["pid", "day"]).where(F.col("generated").between(lo, hi))
    ok = F.col("avail") <= F.col("t")
    return j.groupBy("event_id").agg(F.max(F.when(ok, F.struct("generated", "pred"))).alias("m"), F.count_if(~ok).alias("late")).select("event_id", F.col("m.pred").alias("latest"), "late")


@query("j17_prior_schedule", f"""WITH {TARGETS}, r AS (SELECT x.event_id, x.t, y.t AS pt, row_number() OVER (PARTITION BY x.event_id ORDER BY y.t DESC, y.event_id DESC) AS rn FROM targets x JOIN targets y ON y.pid = x.pid AND y.t < x.cutoff)
SELECT event_id, count(*) AS n_prior, count(*) FILTER (WHERE t - pt <= 3 * 86400000000) AS d3, count(*) FILTER (WHERE t - pt <= 7 * 86400000000) AS d7, count(*) FILTER (WHERE t - pt <= 14 * 86400000000) AS d14 FROM r WHERE rn <= 20 GROUP BY 1""")
def j17(spark, sf):
    """Own earlier events, the 20 newest: of those, the ones within d days are the smaller of 20 and the count in the range, so no self-join is needed."""
    n = lambda first: F.least(F.lit(20), F.count("*").over(Window.partitionBy("pid").orderBy("t").rangeBetween(first, -HOUR - 1)))
    days = [n(-d * DAY).alias(f"d{d}") for d in (3, 7, 14)]
    return targets(spark, sf).select("event_id", n(Window.unboundedPreceding).alias("n_prior"), *days).where("n_prior > 0")


@query("j18_json_unnest", "WITH u AS (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events) SELECT a.event_id, b.event_id AS ref FROM u a JOIN u b ON b.event_id = a.k")
def j18(spark, sf):
    e = table(spark, sf, "events")
    ids = e.select("event_id", F.explode(F.map_values(F.from_json("props", "map<string,bigint>"))).alias("ref"))
    return ids.join(e.select(F.col("event_id").alias("ref")), "ref").select("event_id", "ref")


@query("j19_union_partitions", "SELECT stat, count(*) AS n FROM (SELECT event_type AS stat FROM events UNION ALL SELECT o_orderpriority FROM orders) GROUP BY 1")
def j19(spark, sf):
    a, b = table(spark, sf, "events").select(F.col("event_type").alias("stat")), table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stat"))
    return a.unionByName(b).groupBy("stat").agg(F.count("*").alias("n"))


@query("j19_store_merge", """SELECT event_id, coalesce(b.user_id, a.user_id, c.user_id) AS user_id,
    CASE WHEN b.event_id IS NOT NULL THEN b.value ELSE coalesce(c.value, a.value) END AS value, b.props
    FROM (SELECT event_id, user_id, value FROM events WHERE event_id % 5 = 0) a
    FULL JOIN (SELECT event_id, user_id, value * 2 AS value FROM events WHERE event_id % 3 = 0) c USING (event_id)
    FULL JOIN (SELECT event_id, user_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value, props FROM events WHERE event_id % 2 = 0) b USING (event_id)""")
def j19_merge(spark, sf):
    """A store and two partitions with other columns and values, merged as one version; later partitions override, with nulls, too."""
    e = table(spark, sf, "events")
    home = Store(spark, work_dir(spark, "store")).commit({"event": e.where("event_id % 5 = 0").select("event_id", "user_id", "value")})
    first = Store(spark, work_dir(spark, "store")).commit({"event": e.where("event_id % 3 = 0").select("event_id", "user_id", (F.col("value") * 2).alias("value"))})
    second = e.where("event_id % 2 = 0").select("event_id", "user_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"), "props")
    second = Store(spark, work_dir(spark, "store")).commit({"event": second})
    return merge_stores(home, [first, second], {"event": ["event_id"]}).read("event")


@query("j21_unordered_pair", f"WITH {MATCHES} SELECT least(a, b) AS x, greatest(a, b) AS y, count(*) AS n, count(*) FILTER (WHERE outcome = 'A' AND a < b OR outcome = 'B' AND b < a) AS x_wins FROM matches WHERE a <> b GROUP BY 1, 2")
def j21(spark, sf):
    m = matches(spark, sf).where("a <> b")
    return m.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count("*").alias("n"), F.count_if(F.expr("outcome = 'A' AND a < b OR outcome = 'B' AND b < a")).alias("x_wins"))


@query("j22_paired_baseline", f"WITH {MATCHES} SELECT m.match_id, m.sport FROM matches m JOIN targets2 t ON t.event_id = m.match_id".replace("WITH", "WITH targets2 AS (SELECT event_id FROM events WHERE event_type IN ('purchase', 'click')),", 1))
def j22(spark, sf):
    base = observations(spark, sf).where(F.col("stat").isin("purchase", "click")).select(F.col("event_id").alias("match_id"))
    return matches(spark, sf).join(base, "match_id").select("match_id", "sport")


@query("j23_name_pairs", f"WITH {MATCHES} SELECT x.match_id, y.first, y.n FROM matches x JOIN (SELECT a, b, min(match_id) AS first, count(*) AS n FROM matches GROUP BY 1, 2) y ON x.a = y.a AND x.b = y.b WHERE y.n > 1")
def j23(spark, sf):
    """Matches whose ordered pair of names occurs again, each with the first of them: the pairs of a name pair without writing them all."""
    m = matches(spark, sf)
    g = m.groupBy("a", "b").agg(F.min("match_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return m.join(g, ["a", "b"]).select("match_id", "first", "n")


@query("j24_both_sides_covered", f"""WITH {MATCHES}, f AS (SELECT pid, min(avail) AS first_known FROM obs WHERE stat = 'view' GROUP BY 1)
SELECT m.match_id, coalesce(x.first_known <= m.t - 3600000000, false) AND coalesce(y.first_known <= m.t - 3600000000, false) AS covered FROM matches m LEFT JOIN f x ON x.pid = m.a LEFT JOIN f y ON y.pid = m.b""")
def j24(spark, sf):
    first = observations(spark, sf).where("stat = 'view'").groupBy("pid").agg(F.min("avail").alias("first_known"))
    sides = matches(spark, sf).select("match_id", "t", F.explode(F.array("a", "b")).alias("pid")).join(first, "pid", "left")
    return sides.groupBy("match_id").agg(F.every(F.coalesce(F.col("first_known") <= F.col("t") - HOUR, F.lit(False))).alias("covered"))


def one_per_side(rows: DataFrame) -> DataFrame:
    """rows(match_id, side, pid); raises where a match hasn't exactly one participant on each side."""
    g = rows.groupBy("match_id").agg(F.max(F.when(F.col("side") == "A", F.col("pid"))).alias("a"), F.max(F.when(F.col("side") == "B", F.col("pid"))).alias("b"), F.count_if(F.col("side") == "A").alias("na"), F.count_if(F.col("side") == "B").alias("nb"))
    bad = (F.col("na") != 1) | (F.col("nb") != 1)
    return g.select("match_id", F.when(bad, F.raise_error(F.concat(F.lit("sides of "), F.col("match_id")))).otherwise(F.col("a")).cast("long").alias("a"), "b")


@query("j25_one_per_side", f"WITH {MATCHES} SELECT match_id, a, b FROM matches")
def j25(spark, sf):
    return one_per_side(matches(spark, sf).select("match_id", F.expr("stack(2, 'A', a, 'B', b) AS (side, pid)")))


def admitted(results: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """How many of the results(keys, due) each of the probes(keys, id, cutoff) may use: they are admitted in the order of `due`, which one union and sort counts."""
    m = results.select(*keys, F.col("due").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast("long").alias("probe"))
    p = probes.select(*keys, F.col("cutoff").alias("_t"), F.lit(1).alias("_k"), F.col("id").alias("probe"))
    order = Window.partitionBy(*keys).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.unionByName(p).withColumn("n_admitted", F.count_if(F.col("_k") == 0).over(order)).where("_k = 1").select(F.col("probe").alias("id"), "n_admitted")


@query("w21_head_of_line", f"""WITH {KNOWN}
SELECT x.match_id AS id, (SELECT count(*) FROM known k WHERE k.sport = x.sport AND k.due <= x.t - 3600000000) AS n_admitted FROM matches x""")
def w21(spark, sf):
    m = matches(spark, sf)
    return admitted(admitted_results(m), m.select("sport", F.col("match_id").alias("id"), (F.col("t") - HOUR).alias("cutoff")), ["sport"])
