"""The roles of the event store on the driver's tables, and the same roles as SQL for the oracles.

Times are microseconds since 1970 in UTC, so that no session time zone takes part. Scores and
predictions are fixed formulas of the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN = 60_000_000
HOUR = 60 * MIN
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal observations: event_id, pid, stat, value, t (effective), avail (source available, k minutes later)."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("pid"), F.col("event_type").alias("stat"), "value", micros("ts").alias("t"), (micros("ts") + k * MIN).alias("avail"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as the events to predict, with the cutoff an hour before."""
    o = observations(spark, sf_dir).where("stat = 'purchase'")
    return o.select("event_id", "pid", "t", (F.col("t") - HOUR).alias("cutoff"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided events: consecutive observations of a stat on one day, paired in time order; a and b are the sides, 'A', 'B' or 'DRAW' the outcome."""
    o = observations(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    rn = F.row_number().over(Window.partitionBy("stat", "day").orderBy("t", "event_id"))
    o = o.withColumn("rn", rn).withColumn("pair", F.floor((F.col("rn") + 1) / 2)).withColumn("side", F.when(F.col("rn") % 2 == 1, "A").otherwise("B"))
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    m = o.groupBy(F.col("stat").alias("sport"), "day", "pair").agg(pick("event_id", "A").alias("match_id"), pick("pid", "A").alias("a"), pick("pid", "B").alias("b"), pick("value", "A").alias("score_a"), pick("value", "B").alias("score_b"), F.max("t").alias("t"), F.max("avail").alias("avail"))
    out = F.when(F.col("score_a") > F.col("score_b"), "A").when(F.col("score_a") < F.col("score_b"), "B").otherwise("DRAW")
    return m.where("b IS NOT NULL").select("match_id", "sport", "a", "b", "score_a", "score_b", "t", "avail", out.alias("outcome"))


def running(rows: DataFrame, key: str, time: str, id_: str, value: Column, name: str, kind: str) -> DataFrame:
    """rows with the running sum or max of value per key, in (time, id) order, the row included.

    A key is cut into days: each day runs by itself, after what the days before amount to, so that no key
    is one task. kind: sum or max.
    """
    add = {"sum": F.sum, "max": F.max}[kind]
    x = rows.withColumn("_day", F.floor(F.col(time) / DAY)).withColumn("_v", value)
    days = x.groupBy(key, "_day").agg(add("_v").alias("_d"))
    earlier = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(key, "_day", add("_d").over(earlier).alias("_before"))
    within = add("_v").over(Window.partitionBy(key, "_day").orderBy(time, id_).rowsBetween(Window.unboundedPreceding, 0))
    total = F.coalesce("_before", F.lit(0)) + F.col("_in") if kind == "sum" else F.greatest("_before", "_in")
    return x.withColumn("_in", within).join(days, [key, "_day"]).withColumn(name, total).drop("_day", "_v", "_before", "_in")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction matrix: y is 1 if B wins, p1 .. p3 three models' P(B), seq the order within the sport."""
    m = matches(spark, sf_dir).where("outcome <> 'DRAW'")
    y = (F.col("outcome") == "B").cast("int")
    p1 = F.lit(0.05) + (F.col("a") * 7 + F.col("b") * 13) % 91 / F.lit(100.0)
    p2 = F.lit(0.05) + F.col("match_id") * 31 % 91 / F.lit(100.0)
    p3 = F.lit(0.2) + F.col("match_id") * 17 % 31 / F.lit(100.0) + F.lit(0.3) * y
    m = running(m, "sport", "t", "match_id", F.lit(1), "seq", "sum")
    return m.select("match_id", "sport", "a", "b", "t", "avail", y.alias("y"), p1.alias("p1"), p2.alias("p2"), p3.alias("p3"), F.col("seq").cast("int").alias("seq"))


def admitted_results(m: DataFrame, lead: int = HOUR) -> DataFrame:
    """Decided matches with `due`: from which cutoff on (a match's time less lead) their outcome may be used.

    An outcome is realized a day after the start, or when its source came if that's later. Results are
    admitted in (t, match_id) order per sport, and one that isn't realized holds back all later ones.
    """
    known = m.where("outcome <> 'DRAW' AND a <> b").withColumn("realized", F.greatest(F.col("t") + DAY, "avail"))
    known = running(known, "sport", "t", "match_id", F.col("realized"), "_max", "max")
    return known.withColumn("due", F.greatest("_max", F.col("t") + 1 - lead)).drop("_max")


OBS = "obs AS (SELECT event_id, user_id AS pid, event_type AS stat, value, epoch_us(ts) AS t, epoch_us(ts) + CAST(props->>'$.k' AS BIGINT) * 60000000 AS avail FROM events)"
TARGETS = OBS + ", targets AS (SELECT event_id, pid, t, t - 3600000000 AS cutoff FROM obs WHERE stat = 'purchase')"
MATCHES = OBS + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY stat, t // 86400000000 ORDER BY t, event_id) AS rn FROM obs),
 matches AS (SELECT x.event_id AS match_id, x.stat AS sport, x.pid AS a, y.pid AS b, x.value AS score_a, y.value AS score_b, greatest(x.t, y.t) AS t, greatest(x.avail, y.avail) AS avail,
   CASE WHEN x.value > y.value THEN 'A' WHEN x.value < y.value THEN 'B' ELSE 'DRAW' END AS outcome
   FROM numbered x JOIN numbered y ON x.stat = y.stat AND x.t // 86400000000 = y.t // 86400000000 AND x.rn % 2 = 1 AND y.rn = x.rn + 1)"""
PREDICTIONS = MATCHES + """, preds AS (SELECT match_id, sport, a, b, t, avail, CAST(outcome = 'B' AS INTEGER) AS y, 0.05::DOUBLE + (a * 7 + b * 13) % 91 / 100.0::DOUBLE AS p1, 0.05::DOUBLE + match_id * 31 % 91 / 100.0::DOUBLE AS p2,
   0.2::DOUBLE + match_id * 17 % 31 / 100.0::DOUBLE + 0.3::DOUBLE * CAST(outcome = 'B' AS INTEGER) AS p3, row_number() OVER (PARTITION BY sport ORDER BY t, match_id) AS seq FROM matches WHERE outcome <> 'DRAW')"""
KNOWN = MATCHES + """, known AS (SELECT sport, match_id, t, a, b, outcome,
   greatest(max(greatest(t + 86400000000, avail)) OVER (PARTITION BY sport ORDER BY t, match_id), t + 1 - 3600000000) AS due
   FROM matches WHERE outcome <> 'DRAW' AND a <> b),
 kside AS (SELECT sport, match_id, t, due, a AS pid, CAST(outcome = 'A' AS INTEGER) AS won FROM known
           UNION ALL SELECT sport, match_id, t, due, b, CAST(outcome = 'B' AS INTEGER) FROM known),
 mside AS (SELECT sport, match_id, t, 'A' AS side, a AS pid FROM matches UNION ALL SELECT sport, match_id, t, 'B', b FROM matches),
 past AS (SELECT x.match_id, x.side, x.pid, k.won, row_number() OVER (PARTITION BY x.match_id, x.side ORDER BY k.t DESC, k.match_id DESC) AS rn
   FROM mside x LEFT JOIN kside k ON k.sport = x.sport AND k.pid = x.pid AND k.due <= x.t - 3600000000)"""
