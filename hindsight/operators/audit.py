"""Leakage audit, quality gate and coverage guards over a store with known defects.

The tables hold no replays, so `store` derives snapshots, replays, features and models from the roles by
fixed formulas of their ids, some of which break a rule: every check here has input that fails it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import DAY, HOUR, MIN, TARGETS, observations, table, targets

SPORTS = ("click", "error", "purchase", "signup", "view", "sailing")
STALE = 48 * HOUR


def every(n: int, then: Column, other: Column, at: int = 0) -> Column:
    return F.when(F.col("event_id") % n == at, then).otherwise(other)


def snapshots(spark, sf: str) -> DataFrame:
    """(snap, sport, status, available, retrieved)."""
    none = F.lit(None).cast("long")
    o = observations(spark, sf)
    return o.select(F.col("event_id").alias("snap"), F.col("stat").alias("sport"), every(3, F.lit("EXACT"), F.lit("UNVERIFIABLE")).alias("status"), every(97, none, F.col("avail")).alias("available"), every(89, F.col("avail") - HOUR, F.col("avail") + HOUR).alias("retrieved"))


def replays(spark, sf: str) -> DataFrame:
    """(replay, event_id, event_time, cutoff, leakage)."""
    none = F.lit(None).cast("long")
    cutoff = F.when(F.col("event_id") % 53 == 0, none).when(F.col("event_id") % 47 == 0, F.col("t") - 30 * MIN).when(F.col("event_id") % 43 == 0, F.col("t") + HOUR).otherwise(F.col("cutoff"))
    return targets(spark, sf).select(F.col("event_id").alias("replay"), "event_id", every(59, none, F.col("t")).alias("event_time"), cutoff.alias("cutoff"), every(41, F.lit("UNKNOWN"), F.lit("CLEAN")).alias("leakage"))


def features(spark, sf: str) -> DataFrame:
    """(replay, feature, value, sources): the sources are the snapshots just before an event, by id."""
    value = every(37, F.lit("n/a"), every(61, F.lit(None).cast("string"), (F.col("event_id") / 4).cast("string")))
    sources = F.when(F.col("event_id") % 31 == 0, F.array().cast("array<bigint>")).when(F.col("event_id") % 29 == 0, F.array(F.col("event_id") + 1_000_000_000)).when(F.col("event_id") % 23 == 0, F.array("event_id")).otherwise(F.array(F.col("event_id") - F.col("event_id") % 3, F.col("event_id") - 3 - F.col("event_id") % 3))
    names = F.explode(F.array(F.lit("form"), F.lit("rest")))
    return targets(spark, sf).select(F.col("event_id").alias("replay"), names.alias("feature"), value.alias("value"), sources.alias("sources"))


def models(spark, sf: str) -> DataFrame:
    """(model, artifact, trained_to, status)."""
    k = F.col("s_suppkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("models/../"), "s_name")).when(k % 7 == 0, F.concat(F.lit("other/"), "s_name")).otherwise(F.concat(F.lit("models/"), "s_name"))
    return table(spark, sf, "supplier").select(k.alias("model"), path.alias("artifact"), F.when(k % 6 != 0, k * DAY).alias("trained_to"), F.when(k % 4 == 0, "REJECTED").otherwise("ACCEPTED_SHADOW").alias("status"))


STORE = f"""{TARGETS},
 snaps AS (SELECT event_id AS snap, stat AS sport, CASE WHEN event_id % 3 = 0 THEN 'EXACT' ELSE 'UNVERIFIABLE' END AS status, CASE WHEN event_id % 97 <> 0 THEN avail END AS available, CASE WHEN event_id % 89 = 0 THEN avail - 3600000000 ELSE avail + 3600000000 END AS retrieved FROM obs),
 replays AS (SELECT event_id AS replay, event_id, CASE WHEN event_id % 59 <> 0 THEN t END AS event_time, CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 47 = 0 THEN t - 1800000000 WHEN event_id % 43 = 0 THEN t + 3600000000 ELSE cutoff END AS cutoff, CASE WHEN event_id % 41 = 0 THEN 'UNKNOWN' ELSE 'CLEAN' END AS leakage FROM targets),
 feats AS (SELECT event_id AS replay, unnest(['form', 'rest']) AS feature, CASE WHEN event_id % 37 = 0 THEN 'n/a' WHEN event_id % 61 = 0 THEN NULL ELSE CAST(event_id / 4 AS VARCHAR) END AS value,
   CASE WHEN event_id % 31 = 0 THEN CAST([] AS BIGINT[]) WHEN event_id % 29 = 0 THEN [event_id + 1000000000] WHEN event_id % 23 = 0 THEN [event_id] ELSE [event_id - event_id % 3, event_id - 3 - event_id % 3] END AS sources FROM targets),
 models AS (SELECT s_suppkey AS model, CASE WHEN s_suppkey % 5 = 0 THEN 'models/../' WHEN s_suppkey % 7 = 0 THEN 'other/' ELSE 'models/' END || s_name AS artifact, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey * 86400000000 END AS trained_to, CASE WHEN s_suppkey % 4 = 0 THEN 'REJECTED' ELSE 'ACCEPTED_SHADOW' END AS status FROM supplier),
 used AS (SELECT replay, feature, unnest(sources) AS snap FROM feats)"""

AUDIT = f"""WITH {STORE}
SELECT 'invalid_cutoff' AS rule, replay AS id FROM replays WHERE cutoff IS NULL
UNION SELECT 'invalid_event_time', replay FROM replays WHERE event_time IS NULL
UNION SELECT 'gap_under_60m', replay FROM replays WHERE event_time - cutoff < 3600000000
UNION SELECT 'cutoff_not_before_event', replay FROM replays WHERE coalesce(cutoff >= event_time, true)
UNION SELECT 'replay_not_clean', replay FROM replays WHERE leakage NOT IN ('CLEAN', 'PASS')
UNION SELECT 'non_numeric_feature', replay FROM feats WHERE value IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NULL
UNION SELECT 'empty_source_ids', replay FROM feats WHERE len(sources) = 0
UNION SELECT 'missing_source_snapshot', snap FROM used WHERE snap NOT IN (SELECT snap FROM snaps)
UNION SELECT 'non_exact_source', snap FROM used JOIN snaps USING (snap) WHERE status <> 'EXACT' OR available IS NULL
UNION SELECT 'future_source', replay FROM used JOIN snaps USING (snap) JOIN replays USING (replay) WHERE status = 'EXACT' AND available > cutoff
UNION SELECT 'same_event_feature', replay FROM used JOIN replays USING (replay) WHERE snap = event_id
UNION SELECT 'impossible_exact_snapshot', snap FROM snaps WHERE status = 'EXACT' AND (available IS NULL OR retrieved IS NULL OR available > retrieved)
UNION SELECT 'model_artifact_invalid', model FROM models WHERE status LIKE 'ACCEPTED%' AND (NOT starts_with(artifact, 'models/') OR contains(artifact, '..'))
UNION SELECT 'model_cutoff_missing', model FROM models WHERE status LIKE 'ACCEPTED%' AND trained_to IS NULL"""


def broken(rows: DataFrame, id_: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, id) for every rule whose condition a row meets; a null condition counts as unmet."""
    hit = F.array(*(F.when(condition, F.lit(name)) for name, condition in rules.items()))
    return rows.select(F.explode(F.array_compact(hit)).alias("rule"), F.col(id_).alias("id"))


@query("g4_leakage_audit", AUDIT)
def g4(spark, sf):
    """Fourteen rules over replays, features, their sources, snapshots and accepted models: one pass over each table."""
    time, cut = F.col("event_time"), F.col("cutoff")
    r = replays(spark, sf)
    out = broken(r, "replay", {"invalid_cutoff": cut.isNull(), "invalid_event_time": time.isNull(), "gap_under_60m": time - cut < HOUR, "cutoff_not_before_event": F.coalesce(cut >= time, F.lit(True)), "replay_not_clean": ~F.col("leakage").isin("CLEAN", "PASS")})
    f = features(spark, sf)
    out = out.union(broken(f, "replay", {"non_numeric_feature": F.col("value").isNotNull() & F.expr("try_cast(value AS double)").isNull(), "empty_source_ids": F.size("sources") == 0}))
    s = snapshots(spark, sf)
    used = f.select("replay", F.explode("sources").alias("snap")).distinct().join(s.withColumn("there", F.lit(True)), "snap", "left").join(r.select("replay", "event_id", "cutoff"), "replay")
    exact = (F.col("status") == "EXACT") & F.col("available").isNotNull()
    out = out.union(broken(used, "snap", {"missing_source_snapshot": F.col("there").isNull(), "non_exact_source": F.col("there") & ~exact}))
    out = out.union(broken(used, "replay", {"future_source": exact & (F.col("available") > F.col("cutoff")), "same_event_feature": F.col("snap") == F.col("event_id")}))
    impossible = (F.col("status") == "EXACT") & (F.col("available").isNull() | F.col("retrieved").isNull() | (F.col("available") > F.col("retrieved")))
    out = out.union(broken(s, "snap", {"impossible_exact_snapshot": impossible}))
    m = models(spark, sf).where(F.col("status").startswith("ACCEPTED"))
    safe = F.col("artifact").startswith("models/") & ~F.contains("artifact", F.lit(".."))
    out = out.union(broken(m, "model", {"model_artifact_invalid": ~safe, "model_cutoff_missing": F.col("trained_to").isNull()}))
    return out.distinct()


GATE = f"""WITH {STORE}, sports AS (SELECT unnest([{", ".join(f"'{s}'" for s in SPORTS)}]) AS sport),
 counts AS (SELECT sport, count(snap) AS n, count(*) FILTER (WHERE status = 'EXACT' AND available IS NOT NULL) AS exact, max(retrieved) AS latest FROM sports LEFT JOIN snaps USING (sport) GROUP BY 1),
 clock AS (SELECT max(retrieved) AS now FROM snaps),
 checks AS (
  SELECT 'events_present' AS name, 'fatal' AS level, count(*) = 0 AS failed, count(*) AS n FROM obs
  UNION ALL SELECT 'sports_present', 'pending', count(*) > 0, count(*) FROM counts WHERE n = 0
  UNION ALL SELECT 'event_time_sanity', 'fatal', count(*) > 0, count(*) FROM obs WHERE t < -631152000000000
  UNION ALL SELECT 'exact_source_timing', 'fatal', count(*) > 0, count(*) FROM snaps WHERE status = 'EXACT' AND available IS NULL
  UNION ALL SELECT 'unverifiable_sources', 'info', false, count(*) FROM snaps WHERE status = 'UNVERIFIABLE'
  UNION ALL SELECT 'snapshot_freshness', 'pending', count(*) > 0, count(*) FROM counts, clock WHERE latest IS NULL OR now - latest > {STALE}
  UNION ALL SELECT 'participant_integrity', 'fatal', count(*) > 0, count(*) FROM obs WHERE pid IS NULL
  UNION ALL SELECT 'exact_context', 'pending', count(*) > 0, count(*) FROM counts WHERE exact = 0
  UNION ALL SELECT 'leakage', 'fatal', count(*) > 0, count(*) FROM replays WHERE leakage NOT IN ('PASS', 'UNKNOWN', 'CLEAN')
  UNION ALL SELECT 'clean_replays', 'pending', count(*) = 0, count(*) FROM replays WHERE leakage IN ('PASS', 'CLEAN') AND cutoff IS NOT NULL
  UNION ALL SELECT 'accepted_models', 'pending', count(*) = 0, count(*) FROM models WHERE status LIKE 'ACCEPTED%'
  UNION ALL SELECT 'unique_snapshots', 'fatal', count(*) <> count(DISTINCT snap), count(DISTINCT snap) FROM snaps)
SELECT name, level, NOT failed AS passed, n FROM checks
UNION ALL SELECT 'status', CASE WHEN bool_or(failed AND level = 'fatal') THEN 'FAIL' WHEN bool_or(failed AND level = 'pending') THEN 'PASS_WITH_PENDING' ELSE 'PASS' END, NOT bool_or(failed AND level = 'fatal'), count(*) FILTER (WHERE failed) FROM checks"""


@query("g5_quality_gate", GATE)
def g5(spark, sf):
    """Twelve checks, fatal or pending, and the status that follows: each table is aggregated once, to a row or a row a sport."""
    o = observations(spark, sf).agg(F.count("*").alias("events"), F.count_if(F.col("t") < -631_152_000_000_000).alias("insane"), F.count_if(F.col("pid").isNull()).alias("nobody"))
    s = snapshots(spark, sf)
    exact = (F.col("status") == "EXACT") & F.col("available").isNotNull()
    per = s.groupBy("sport").agg(F.count("*").alias("n"), F.count_if(exact).alias("exact"), F.max("retrieved").alias("latest"))
    now = per.agg(F.max("latest").alias("now"))
    named = spark.createDataFrame([(x,) for x in SPORTS], "sport string")
    per = named.join(per, "sport", "left").crossJoin(F.broadcast(now))  # a row a sport, and one row
    c = per.agg(F.count_if(F.col("n").isNull()).alias("absent"), F.count_if(F.col("latest").isNull() | (F.col("now") - F.col("latest") > STALE)).alias("stale"), F.count_if(F.coalesce("exact", F.lit(0)) == 0).alias("inexact"))
    t = s.agg(F.count_if((F.col("status") == "EXACT") & F.col("available").isNull()).alias("untimed"), F.count_if(F.col("status") == "UNVERIFIABLE").alias("unverifiable"), (F.count("*") - F.countDistinct("snap")).alias("repeated"), F.countDistinct("snap").alias("snaps"))
    r = replays(spark, sf).agg(F.count_if(~F.col("leakage").isin("PASS", "UNKNOWN", "CLEAN")).alias("leaking"), F.count_if(F.col("leakage").isin("PASS", "CLEAN") & F.col("cutoff").isNotNull()).alias("clean"))
    m = models(spark, sf).agg(F.count_if(F.col("status").startswith("ACCEPTED")).alias("accepted"))
    one = o.crossJoin(c).crossJoin(t).crossJoin(r).crossJoin(m)  # single rows
    none, some = (lambda c: F.col(c) == 0), (lambda c: F.col(c) > 0)
    checks = [
        ("events_present", "fatal", none("events"), "events"), ("sports_present", "pending", some("absent"), "absent"), ("event_time_sanity", "fatal", some("insane"), "insane"), ("exact_source_timing", "fatal", some("untimed"), "untimed"),
        ("unverifiable_sources", "info", F.lit(False), "unverifiable"), ("snapshot_freshness", "pending", some("stale"), "stale"), ("participant_integrity", "fatal", some("nobody"), "nobody"), ("exact_context", "pending", some("inexact"), "inexact"),
        ("leakage", "fatal", some("leaking"), "leaking"), ("clean_replays", "pending", none("clean"), "clean"), ("accepted_models", "pending", none("accepted"), "accepted"), ("unique_snapshots", "fatal", some("repeated"), "snaps"),
    ]
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(level).alias("level"), failed.alias("failed"), F.col(c).cast("long").alias("n")) for n, level, failed, c in checks))).alias("c")).select("c.*")
    bad = lambda level: F.bool_or(F.col("failed") & (F.col("level") == level))
    status = rows.agg(F.lit("status").alias("name"), F.when(bad("fatal"), "FAIL").when(bad("pending"), "PASS_WITH_PENDING").otherwise("PASS").alias("level"), (~bad("fatal")).alias("passed"), F.count_if("failed").alias("n"))
    return rows.select("name", "level", (~F.col("failed")).alias("passed"), "n").unionByName(status)


@query("g7_bridge_coverage", f"""WITH {STORE}, s AS (SELECT sport, count(*) FILTER (WHERE status = 'EXACT' AND available IS NOT NULL) AS exact, count(*) FILTER (WHERE status = 'EXACT' AND available IS NOT NULL AND snap % 7 = 0 AND sport <> 'error') AS pinned FROM snaps GROUP BY 1),
 u AS (SELECT o.stat AS sport, count(DISTINCT x.snap) AS repointed FROM used x JOIN obs o ON o.event_id = x.snap WHERE o.stat <> 'view' GROUP BY 1)
SELECT s.sport, exact, pinned, coalesce(repointed, 0) AS repointed, CASE WHEN pinned > 0 AND coalesce(repointed, 0) > 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM s LEFT JOIN u USING (sport)""")
def g7(spark, sf):
    """A provenance bridge counts as applied only if snapshots are pinned to a revision (here: ids divisible by 7, no errors) and features use them (here: no views)."""
    s = snapshots(spark, sf)
    exact = (F.col("status") == "EXACT") & F.col("available").isNotNull()
    have = s.groupBy("sport").agg(F.count_if(exact).alias("exact"), F.count_if(exact & (F.col("snap") % 7 == 0) & (F.col("sport") != "error")).alias("pinned"))
    used = features(spark, sf).select(F.explode("sources").alias("snap")).distinct()
    u = s.where("sport <> 'view'").join(used, "snap", "left_semi").groupBy("sport").agg(F.count("*").alias("repointed"))
    x = have.join(u, "sport", "left").withColumn("repointed", F.coalesce("repointed", F.lit(0)))
    return x.withColumn("status", F.when((F.col("pinned") > 0) & (F.col("repointed") > 0), "PASS").otherwise("BLOCKED"))


@query("g10_collection_guard", f"""WITH {STORE}, sports AS (SELECT unnest([{", ".join(f"'{s}'" for s in SPORTS)}]) AS sport),
 o AS (SELECT stat AS sport, count(*) AS events, count(DISTINCT pid) AS participants FROM obs GROUP BY 1), s AS (SELECT sport, count(*) FILTER (WHERE available IS NOT NULL AND snap % 2 = 0 AND sport <> 'signup') AS snapshots FROM snaps GROUP BY 1)
SELECT sport, coalesce(events, 0) AS events, coalesce(participants, 0) AS participants, coalesce(snapshots, 0) AS snapshots,
 CASE WHEN events IS NULL THEN 'DEFERRED' WHEN coalesce(snapshots, 0) = 0 THEN 'INCOMPLETE' ELSE 'OK' END AS status FROM sports LEFT JOIN o USING (sport) LEFT JOIN s USING (sport)""")
def g10(spark, sf):
    """Per expected sport what was collected: nothing defers it, events without usable snapshots leave it incomplete."""
    o = observations(spark, sf).groupBy(F.col("stat").alias("sport")).agg(F.count("*").alias("events"), F.countDistinct("pid").alias("participants"))
    s = snapshots(spark, sf).where("available IS NOT NULL AND snap % 2 = 0 AND sport <> 'signup'").groupBy("sport").agg(F.count("*").alias("snapshots"))
    x = spark.createDataFrame([(v,) for v in SPORTS], "sport string").join(o, "sport", "left").join(s, "sport", "left")
    status = F.when(F.col("events").isNull(), "DEFERRED").when(F.coalesce("snapshots", F.lit(0)) == 0, "INCOMPLETE").otherwise("OK")
    return x.select("sport", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "participants", "snapshots")), status.alias("status"))
