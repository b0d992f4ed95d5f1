"""Rules that combine several signals of a row: causal routing, eligibility, timing with a holdout, contracts, content manifests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import KNOWN, MIN, PREDICTIONS, matches, observations, predictions, table
from .pit import asof_join
from .predicates import brier, log_loss, r6
from .windows import in_part, own, part_of, parted, probe_sides, result_sides

MODELS = (1, 2, 3)


def causal_router(rows: DataFrame, window: int = 40, risk_window: int = 10, floor: float = 0.7) -> DataFrame:
    """(sport, match_id, p, w1, w2, w3) of rows(sport, seq, match_id, y, p1 .. p3): a mixture whose weights use outcomes of earlier rows alone.

    A model's score is the negative of its mean log loss over up to `window` rows before (that of a coin
    with fewer than two), less 0.75 times its risk: how often it was sure (`floor`) and wrong in the
    `risk_window` rows before. The more the models disagree, the nearer the weights are to equal; a sport's
    first row has equal ones.
    """
    p = [F.col(f"p{i}") for i in MODELS]
    mean = sum(p) / len(p)
    x = parted(rows, max(window, risk_window)).withColumn("gap", F.sqrt(sum((q - mean) * (q - mean) for q in p) / len(p)))
    past, near = (in_part().rowsBetween(-n, -1) for n in (window, risk_window))
    wrong = lambda q: ((F.greatest(q, 1 - q) >= floor) & ((q >= 0.5) != (F.col("y") == 1))).cast("double")
    loss = [F.when(F.count("*").over(past) >= 2, F.avg(log_loss(q, F.col("y"), 1e-6)).over(past)).otherwise(F.lit(math.log(2))) for q in p]
    risk = [F.coalesce(F.avg(wrong(q)).over(near), F.lit(0.0)) for q in p]
    heat = 1 + 2 * F.least(F.col("gap"), F.lit(0.5))
    x = x.select("own", "sport", "match_id", "seq", *(f"p{i}" for i in MODELS), *(((-a - 0.75 * b) / heat).alias(f"s{i}") for i, a, b in zip(MODELS, loss, risk, strict=True)))
    best = F.greatest(*(f"s{i}" for i in MODELS))
    e = [F.when(F.col("seq") == 1, F.lit(1.0)).otherwise(F.exp(F.col(f"s{i}") - best)) for i in MODELS]
    x = own(x).withColumns({f"w{i}": v / sum(e) for i, v in zip(MODELS, e, strict=True)})
    return x.select("sport", "match_id", sum(F.col(f"w{i}") * F.col(f"p{i}") for i in MODELS).alias("p"), *(f"w{i}" for i in MODELS))


_PAST, _NEAR = (f"OVER (PARTITION BY sport ORDER BY seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (40, 10))


@query("w16_causal_router", f"""WITH {PREDICTIONS}, l AS (SELECT *, {", ".join(f"CASE WHEN y = 1 THEN -ln(p{i}) ELSE -ln(1 - p{i}) END AS l{i}, CAST(greatest(p{i}, 1 - p{i}) >= 0.7 AND (p{i} >= 0.5) <> (y = 1) AS DOUBLE) AS k{i}" for i in MODELS)},
   sqrt((pow(p1 - (p1 + p2 + p3) / 3, 2) + pow(p2 - (p1 + p2 + p3) / 3, 2) + pow(p3 - (p1 + p2 + p3) / 3, 2)) / 3) AS gap FROM preds),
 s AS (SELECT *, {", ".join(f"(-(CASE WHEN count(*) {_PAST} >= 2 THEN avg(l{i}) {_PAST} ELSE ln(2) END) - 0.75 * coalesce(avg(k{i}) {_NEAR}, 0)) / (1 + 2 * least(gap, 0.5)) AS s{i}" for i in MODELS)} FROM l),
 e AS (SELECT *, {", ".join(f"CASE WHEN seq = 1 THEN 1 ELSE exp(s{i} - greatest(s1, s2, s3)) END AS e{i}" for i in MODELS)} FROM s)
SELECT sport, match_id, round((e1 * p1 + e2 * p2 + e3 * p3) / (e1 + e2 + e3), 5) AS p, {", ".join(f"round(e{i} / (e1 + e2 + e3), 5) AS w{i}" for i in MODELS)} FROM e""")
def w16_full(spark, sf):
    return causal_router(predictions(spark, sf)).select("sport", "match_id", *(F.round(c, 5).alias(c) for c in ("p", "w1", "w2", "w3")))


@query("q6_eligible_evidence", f"""WITH {KNOWN}, h AS (SELECT match_id, count(won) AS n FROM past GROUP BY 1),
 e AS (SELECT m.match_id, count(*) FILTER (WHERE o.event_id IS NOT NULL) AS n FROM matches m LEFT JOIN obs o ON o.pid IN (m.a, m.b) AND o.event_id % 3 = 0 AND o.stat = 'purchase' AND greatest(o.t, o.avail) <= m.t - 3600000000 GROUP BY 1)
SELECT match_id, e.n > 0 AS evidence, h.n > 0 AS history FROM h JOIN e USING (match_id) WHERE e.n > 0 OR h.n > 0""")
def q6_evidence(spark, sf):
    """Matches with strict evidence of either side known at the cutoff, or with an admitted result of either side."""
    m = matches(spark, sf)
    p = probe_sides(m)
    seen = observations(spark, sf).where("event_id % 3 = 0 AND stat = 'purchase'").groupBy("pid").agg(F.min(F.greatest("t", "avail")).alias("known"))
    e = p.join(seen, "pid", "left").groupBy("match_id").agg(F.max(F.coalesce(F.col("known") <= F.col("cutoff"), F.lit(False))).alias("evidence"))
    r = result_sides(m).select("sport", "pid", "due", F.col("match_id").alias("result"))
    h = asof_join(p, r, ["sport", "pid"], "cutoff", "due", ["result"]).groupBy("match_id").agg(F.max(F.col("last_result").isNotNull()).alias("history"))
    return e.join(h, "match_id").where("evidence OR history").select("match_id", "evidence", "history")


@query("r17_timing_holdout", f"""WITH {PREDICTIONS}, l AS (SELECT sport, (t // 60000000) % 4 AS lead, seq, pow(p1 - y, 2) AS b, pow(p2 - y, 2) AS base, seq > floor(count(*) OVER (PARTITION BY sport) * 0.78) AS held FROM preds),
 d AS (SELECT *, row_number() OVER (PARTITION BY sport, lead ORDER BY seq) AS i, count(*) OVER (PARTITION BY sport, lead) AS n FROM l WHERE NOT held),
 k AS (SELECT sport, lead, CASE WHEN i - 1 < (n % 5) * (n // 5 + 1) THEN (i - 1) // (n // 5 + 1) ELSE n % 5 + (i - 1 - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS block, avg(base - b) AS gain FROM d GROUP BY 1, 2, 3),
 g AS (SELECT sport, lead, round(avg(gain), 9) AS gain, count(*) FILTER (WHERE round(gain, 9) >= 0) AS good FROM k GROUP BY 1, 2),
 h AS (SELECT sport, lead, avg(base - b) AS gain FROM l WHERE held GROUP BY 1, 2),
 r AS (SELECT g.*, h.gain AS held, row_number() OVER (PARTITION BY g.sport ORDER BY g.good >= 3 AND g.gain > 0 DESC, g.gain DESC, g.lead) AS rn FROM g LEFT JOIN h ON h.sport = g.sport AND h.lead = g.lead)
SELECT sport, lead, round(gain, 6) AS gain, good, round(held, 6) AS holdout_gain, good >= 3 AND gain > 0 AND rn = 1 AS selected, good >= 3 AND gain > 0 AND rn = 1 AND coalesce(held, 0) >= 0 AS confirmed FROM r""")
def r17_holdout(spark, sf):
    """The lead of the largest paired gain in five blocks before the holdout, and whether the holdout, which doesn't choose it, confirms it."""
    y = F.col("y")
    x = predictions(spark, sf).withColumn("lead", F.floor(F.col("t") / MIN) % 4)
    x = x.join(x.groupBy("sport").agg(F.count("*").alias("all")), "sport")
    x = x.select("sport", "lead", "seq", (brier(F.col("p2"), y) - brier(F.col("p1"), y)).alias("d"), (F.col("seq") > F.floor(F.col("all") * 0.78)).alias("held"))
    w = Window.partitionBy("sport", "lead")
    d = x.where("NOT held").select("sport", "lead", "d", F.row_number().over(w.orderBy("seq")).alias("i"), F.count("*").over(w).alias("n"))
    k = d.groupBy("sport", "lead", part_of(F.col("i"), F.col("n"), 5).alias("block")).agg(F.avg("d").alias("gain"))
    g = k.groupBy("sport", "lead").agg(F.round(F.avg("gain"), 9).alias("gain"), F.count_if(F.round("gain", 9) >= 0).alias("good"))
    g = g.join(x.where("held").groupBy("sport", "lead").agg(F.avg("d").alias("held")), ["sport", "lead"], "left")
    usable = (F.col("good") >= 3) & (F.col("gain") > 0)
    rn = F.row_number().over(Window.partitionBy("sport").orderBy(F.desc("usable"), F.desc("gain"), "lead"))
    g = g.withColumn("usable", usable).withColumn("selected", F.col("usable") & (rn == 1))
    return g.select("sport", "lead", r6("gain").alias("gain"), "good", r6("held").alias("holdout_gain"), "selected", (F.col("selected") & (F.coalesce("held", F.lit(0.0)) >= 0)).alias("confirmed"))


@query("d4x_contract_fields", f"""WITH {PREDICTIONS}, u AS (SELECT match_id, (p1 + p2 + p3) / 3 AS p, least(greatest(p1, p2, p3) - least(p1, p2, p3), 1) AS uncertainty FROM preds)
SELECT match_id, round(p, 6) AS probability, CAST(round(p, 9) >= 0.5 AS INTEGER) AS direction, round(1 - uncertainty, 6) AS confidence, greatest(1, CAST(round_even(round(1 + 5 * (1 - uncertainty), 6), 0) AS BIGINT)) AS ttl_rows,
 CASE WHEN round(uncertainty, 9) > 0.6 THEN 'abstain_candidate' WHEN round(uncertainty, 9) > 0.3 THEN 'interval' ELSE 'point' END AS format, round(uncertainty, 9) > 0.6 AS abstain FROM u""")
def d4x_fields(spark, sf):
    """The fields of a forecast's contract: how long it holds falls with its uncertainty, and its format follows it."""
    p = [F.col(f"p{i}") for i in MODELS]
    u = F.least(F.greatest(*p) - F.least(*p), F.lit(1.0))
    x = predictions(spark, sf).select("match_id", (sum(p) / 3).alias("p"), u.alias("u"))
    wide = F.round("u", 9)
    ttl = F.greatest(F.lit(1).cast("long"), F.bround(F.round(1 + 5 * (1 - F.col("u")), 6), 0).cast("long"))
    return x.select("match_id", r6("p").alias("probability"), (F.round("p", 9) >= 0.5).cast("int").alias("direction"), r6(1 - F.col("u")).alias("confidence"), ttl.alias("ttl_rows"), F.when(wide > 0.6, "abstain_candidate").when(wide > 0.3, "interval").otherwise("point").alias("format"), (wide > 0.6).alias("abstain"))


CONTENT = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
}


@query("g8_content_manifest", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CAST(sum(CAST(('0x' || md5({chr(39) + '|' + chr(39)} || {(' || ' + chr(39) + '|' + chr(39) + ' || ').join(f'coalesce(CAST({c} AS VARCHAR), chr(92))' for c in cols)})[1:8]) AS BIGINT)) AS BIGINT) AS content FROM {t}" for t, cols in CONTENT.items()))
def g8_content(spark, sf):
    """Rows and a hash of the contents of each table, whatever the order of its rows; a changed value changes it."""
    out = None
    for t, cols in CONTENT.items():
        text = F.concat(F.lit("|"), *(x for i, c in enumerate(cols) for x in ([F.lit("|")] if i else []) + [F.coalesce(F.col(c).cast("string"), F.lit("\\"))]))
        one = table(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")).alias("content"))
        out = one if out is None else out.unionByName(one)
    return out
