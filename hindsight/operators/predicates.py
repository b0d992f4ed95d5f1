"""Projections, filters, classifiers and validations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import HOUR, KNOWN, MATCHES, MIN, OBS, PREDICTIONS, TARGETS, admitted_results, matches, observations, predictions, table, targets
from .pit import admitted


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def normalised(text: Column | str) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


@query("p1_text_normalise", r"SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '   ' || p_type || ' ', '\s+', ' ', 'g'))) AS name FROM part")
def p1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", normalised(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))).alias("name"))


@query("p2_keyword_scope", "SELECT p_partkey FROM part WHERE p_name LIKE '%red%' OR p_name LIKE '%ring%'")
def p2(spark, sf):
    return table(spark, sf, "part").where(F.contains("p_name", F.lit("red")) | F.contains("p_name", F.lit("ring"))).select("p_partkey")


@query("p3_status_not_in", "SELECT o_orderkey FROM orders WHERE upper(coalesce(nullif(o_orderstatus, 'P'), '')) NOT IN ('F', 'X')")
def p3(spark, sf):
    s = F.upper(F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("")))
    return table(spark, sf, "orders").where(~s.isin("F", "X")).select("o_orderkey")


@query("p4_status_bucket", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'hot' ELSE 'open' END AS bucket FROM orders")
def p4(spark, sf):
    b = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "hot").otherwise("open")
    return table(spark, sf, "orders").select("o_orderkey", b.alias("bucket"))


#: Lower edges of the probability buckets and their names.
EDGES = ((0.9, "0.90-1.00"), (0.8, "0.80-0.90"), (0.7, "0.70-0.80"), (0.6, "0.60-0.70"), (0.55, "0.55-0.60"), (0.5, "0.50-0.55"))


def probability_bucket(p: Column) -> Column:
    out = F.when(p.isNull(), "unknown")
    for edge, name in EDGES:
        out = out.when(p >= edge, name)
    return out.otherwise("0.00-0.50")


BUCKET = "CASE WHEN {p} IS NULL THEN 'unknown' " + " ".join(f"WHEN {{p}} >= {e} THEN '{n}'" for e, n in EDGES) + " ELSE '0.00-0.50' END"


@query("p5_probability_bucket", f"WITH {PREDICTIONS} SELECT match_id, {BUCKET.format(p='p1')} AS bucket FROM preds")
def p5(spark, sf):
    return predictions(spark, sf).select("match_id", probability_bucket(F.col("p1")).alias("bucket"))


@query("p6_case_profile", f"WITH {OBS} SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' ELSE 'high' END AS evidence, CASE WHEN avail - t <= 1800000000 THEN 'fresh' WHEN avail - t <= 3600000000 THEN 'aging' ELSE 'stale' END AS freshness FROM obs")
def p6(spark, sf):
    v, lag = F.col("value"), F.col("avail") - F.col("t")
    return observations(spark, sf).select("event_id", F.when(v.isNull(), "unknown").when(v < 20, "low").when(v < 60, "medium").otherwise("high").alias("evidence"), F.when(lag <= 30 * MIN, "fresh").when(lag <= HOUR, "aging").otherwise("stale").alias("freshness"))


def confidence(p: Column, evidence: Column, conflict: Column, freshness: Column) -> Column:
    """HIGH needs a probability of 0.8, evidence and fresh sources; a conflict above a half is LOW, whatever the probability; an unknown conflict or freshness doesn't count against it."""
    most = F.greatest(p, 1 - p)
    high = (most >= 0.8) & (evidence >= 1) & F.coalesce(freshness >= 0.5, F.lit(True))
    return F.when(conflict > 0.5, "LOW").when(high, "HIGH").when(most >= 0.65, "MEDIUM").otherwise("LOW")


def with_situation(preds: DataFrame) -> DataFrame:
    """The prediction matrix with the state of its evidence, from fixed formulas: conflict and freshness are unknown for some rows."""
    i = F.col("match_id")
    conflict, freshness = F.when(i % 6 != 0, (i % 9) / 10.0), F.when(i % 5 != 0, (i % 11) / 10.0)
    return preds.withColumns({"evidence": i % 4, "conflict": conflict, "freshness": freshness}).withColumn("confidence", confidence(F.col("p1"), F.col("evidence"), F.col("conflict"), F.col("freshness")))


SITUATION = PREDICTIONS + """, sit AS (SELECT *, match_id % 4 AS evidence, CASE WHEN match_id % 6 <> 0 THEN match_id % 9 / 10.0::DOUBLE END AS conflict, CASE WHEN match_id % 5 <> 0 THEN match_id % 11 / 10.0::DOUBLE END AS freshness FROM preds),
 sure AS (SELECT *, CASE WHEN conflict > 0.5 THEN 'LOW' WHEN greatest(p1, 1 - p1) >= 0.8 AND evidence >= 1 AND (freshness IS NULL OR freshness >= 0.5) THEN 'HIGH' WHEN greatest(p1, 1 - p1) >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM sit)"""


def experience_class(correct: Column, confidence: Column, most: Column) -> Column:
    """Right or wrong by how sure the prediction was."""
    right = F.when(most >= 0.8, "CORRECT_HIGH_CONF").otherwise("CORRECT_NONHIGH_CONF")
    return F.when(correct, right).when(most >= 0.8, "WRONG_OVERCONFIDENT").when((confidence == "MEDIUM") | (most >= 0.65), "WRONG_MODERATE").otherwise("WRONG_LOW_CONF")


@query("p7_experience_class", f"WITH {SITUATION}, c AS (SELECT match_id, confidence, (p1 >= 0.5) = (y = 1) AS ok, greatest(p1, 1 - p1) AS c FROM sure) SELECT match_id, CASE WHEN ok THEN CASE WHEN c >= 0.8 THEN 'CORRECT_HIGH_CONF' ELSE 'CORRECT_NONHIGH_CONF' END WHEN c >= 0.8 THEN 'WRONG_OVERCONFIDENT' WHEN confidence = 'MEDIUM' OR c >= 0.65 THEN 'WRONG_MODERATE' ELSE 'WRONG_LOW_CONF' END AS class FROM c")
def p7(spark, sf):
    p = F.col("p1")
    return with_situation(predictions(spark, sf)).select("match_id", experience_class((p >= 0.5) == (F.col("y") == 1), F.col("confidence"), F.greatest(p, 1 - p)).alias("class"))


@query("p8_lifecycle", f"WITH {MATCHES}, n AS (SELECT max(t) - 5 * 86400000000 AS now FROM matches) SELECT match_id, CASE WHEN outcome <> 'DRAW' AND avail <= now THEN 'COMPLETED' WHEN t <= now THEN 'PENDING_RESULT' ELSE 'SCHEDULED' END AS status FROM matches, n")
def p8(spark, sf):
    m = matches(spark, sf)
    now = m.agg((F.max("t") - 5 * 24 * HOUR).alias("now"))  # one row
    status = F.when((F.col("outcome") != "DRAW") & (F.col("avail") <= F.col("now")), "COMPLETED").when(F.col("t") <= F.col("now"), "PENDING_RESULT").otherwise("SCHEDULED")
    return m.crossJoin(F.broadcast(now)).select("match_id", status.alias("status"))


@query("p9_regex_tier", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)econ|std') THEN 'low' WHEN regexp_matches(p_name, '(?i)\\b(red|blue)\\b') THEN 'mid' ELSE 'top' END AS tier FROM part".replace("\\\\", "\\"))
def p9(spark, sf):
    t = F.when(F.col("p_type").rlike("(?i)econ|std"), "low").when(F.col("p_name").rlike(r"(?i)\b(red|blue)\b"), "mid").otherwise("top")
    return table(spark, sf, "part").select("p_partkey", t.alias("tier"))


@query("p10_lead_window", f"WITH {TARGETS}, n AS (SELECT max(t) - 3 * 86400000000 AS now FROM targets) SELECT event_id, (t - now) // 60000000 AS lead FROM targets, n WHERE (t - now) / 6e7 BETWEEN 45 AND 1440")
def p10(spark, sf):
    x = targets(spark, sf)
    now = x.agg((F.max("t") - 72 * HOUR).alias("now"))
    lead = F.col("t") - F.col("now")
    return x.crossJoin(F.broadcast(now)).where((lead / 6e7).between(45, 1440)).select("event_id", F.floor(lead / MIN).alias("lead"))


@query("p11_timing_label", f"WITH {OBS} SELECT event_id, CASE WHEN avail < t + 600000000 THEN 'EARLY' WHEN avail <= t + 720000000 THEN 'ON_TIME' ELSE 'LATE' END AS timing FROM obs")
def p11(spark, sf):
    """Generated before the cutoff, within two minutes after it, or later."""
    cut = F.col("t") + 10 * MIN
    return observations(spark, sf).select("event_id", F.when(F.col("avail") < cut, "EARLY").when(F.col("avail") <= cut + 2 * MIN, "ON_TIME").otherwise("LATE").alias("timing"))


@query("p12_publication_gate", f"WITH {OBS} SELECT event_id FROM obs WHERE avail <= t + 7200000000 - 3600000000")
def p12(spark, sf):
    """Published an hour or more before the event, which is here two hours after the observation."""
    return observations(spark, sf).where(F.col("avail") <= F.col("t") + 2 * HOUR - HOUR).select("event_id")


def error_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first failing check, null for a valid row. A check that is null fails."""
    out = F.lit(None).cast("string")
    for ok, name in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


@query("p13_snapshot_validation", f"WITH {OBS} SELECT event_id, CASE WHEN value IS NULL OR value <= 0 THEN 'value' WHEN avail > t + 3600000000 THEN 'late_source' WHEN stat = 'error' THEN 'kind' END AS error_reason FROM obs")
def p13(spark, sf):
    return observations(spark, sf).select("event_id", error_reason((F.col("value") > 0, "value"), (F.col("avail") <= F.col("t") + HOUR, "late_source"), (F.col("stat") != "error", "kind")).alias("error_reason"))


def valid_probabilities(p: Column, tolerance: float = 1e-6) -> Column:
    """An array of finite numbers in [0, 1] that sums to 1."""
    ok = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(9.0)))
    return F.coalesce(ok & (F.size(p) > 1) & (F.abs(total - 1) <= tolerance), F.lit(False))


@query("p14_probability_validation", f"WITH {PREDICTIONS} SELECT match_id, match_id % 7 <> 0 AND match_id % 11 <> 0 AS valid FROM preds")
def p14(spark, sf):
    p = F.col("p1")
    q = F.when(F.col("match_id") % 7 == 0, F.array(p, 1.1 - p)).when(F.col("match_id") % 11 == 0, F.array(p + 1, -p)).otherwise(F.array(p, 1 - p))
    return predictions(spark, sf).select("match_id", valid_probabilities(q).alias("valid"))


#: Aliases in order of precedence, as a small dimension.
ALIASES = (("red", "warm"), ("blue", "cold"), ("ring", "jewel"), ("widget", "tool"), ("small", "mini"))


@query("p15_alias_profile", "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(p_name, '{a}') THEN '{b}'" for a, b in ALIASES) + " ELSE 'dyn_' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') END AS profile FROM part")
def p15(spark, sf):
    """First matching alias in list order; else a slug of the name."""
    first = F.coalesce(*(F.when(F.contains("p_name", F.lit(a)), F.lit(b)) for a, b in ALIASES))
    slug = F.expr("trim(BOTH '_' FROM regexp_replace(lower(p_name), '[^a-z0-9]+', '_'))")
    return table(spark, sf, "part").select("p_partkey", F.coalesce(first, F.concat(F.lit("dyn_"), slug)).alias("profile"))


def segments(*levels: str) -> Column:
    """The prefixes of a hierarchy, the most specific first."""
    parts = F.array(*levels)
    return F.transform(F.sequence(F.lit(len(levels)), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))


@query("p16_segment_hierarchy", "SELECT p_partkey, unnest([p_type || '::' || p_brand || '::' || p_size, p_type || '::' || p_brand, p_type]) AS segment, unnest([3, 2, 1]) AS depth FROM part")
def p16(spark, sf):
    p = table(spark, sf, "part").withColumn("size", F.col("p_size").cast("string"))
    return p.select("p_partkey", F.posexplode(segments("p_type", "p_brand", "size")).alias("i", "segment")).select("p_partkey", "segment", (3 - F.col("i")).alias("depth"))


@query("p17_decision_table", f"""WITH {SITUATION}, g AS (SELECT *, abs(p1 - p2) AS gap FROM sure),
 s AS (SELECT *, greatest(0, least(1, 1 - 0.65 * -(p1 * ln(p1) + (1 - p1) * ln(1 - p1)) / ln(2) - 0.35 * least(greatest(gap * 4, 0), 1))) AS predictability FROM g),
 u AS (SELECT *, CASE WHEN predictability < 0.5 OR gap >= 0.05 OR confidence = 'LOW' THEN 'HIGH' WHEN predictability < 0.7 OR confidence = 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS uncertainty FROM s)
SELECT match_id, confidence, round(predictability, 6) AS predictability, uncertainty,
 CASE WHEN confidence = 'LOW' THEN 'abstain_or_fallback' WHEN uncertainty = 'HIGH' THEN 'prediction_set_or_scenario' WHEN uncertainty = 'MEDIUM' THEN 'probability_plus_uncertainty' ELSE 'single_probability' END AS output,
 CASE WHEN confidence = 'LOW' OR uncertainty = 'HIGH' THEN 'PASS' WHEN uncertainty = 'MEDIUM' THEN 'SECONDARY' ELSE 'PRIMARY' END AS action,
 CASE WHEN conflict > 0.5 THEN 'verify_or_resolve_conflicting_sources' WHEN freshness < 0.5 THEN 'refresh_pit_safe_sources' WHEN uncertainty = 'HIGH' THEN 'acquire_high_value_information_candidate' ELSE 'maintain' END AS information,
 CASE WHEN confidence = 'LOW' THEN 'abstain_or_fallback' WHEN uncertainty = 'HIGH' THEN 'recompute_candidate' WHEN uncertainty = 'MEDIUM' THEN 'revise_when_new_information_arrives' ELSE 'maintain' END AS next FROM u""")
def p17(spark, sf):
    """What to do with a prediction: its predictability falls with its entropy and the models' disagreement, its uncertainty follows, and both choose form, action and the next step."""
    p, gap = F.col("p1"), F.abs(F.col("p1") - F.col("p2"))
    entropy = -(p * F.ln(p) + (1 - p) * F.ln(1 - p)) / F.ln(F.lit(2.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.65 * entropy - 0.35 * F.least(gap * 4, F.lit(1.0))))
    low, medium = F.col("confidence") == "LOW", F.col("confidence") == "MEDIUM"
    x = with_situation(predictions(spark, sf)).withColumn("score", score)
    x = x.withColumn("uncertainty", F.when((F.col("score") < 0.5) | (gap >= 0.05) | low, "HIGH").when((F.col("score") < 0.7) | medium, "MEDIUM").otherwise("LOW"))
    high, mid = F.col("uncertainty") == "HIGH", F.col("uncertainty") == "MEDIUM"
    output = F.when(low, "abstain_or_fallback").when(high, "prediction_set_or_scenario").when(mid, "probability_plus_uncertainty").otherwise("single_probability")
    action = F.when(low | high, "PASS").when(mid, "SECONDARY").otherwise("PRIMARY")
    information = F.when(F.col("conflict") > 0.5, "verify_or_resolve_conflicting_sources").when(F.col("freshness") < 0.5, "refresh_pit_safe_sources").when(high, "acquire_high_value_information_candidate").otherwise("maintain")
    following = F.when(low, "abstain_or_fallback").when(high, "recompute_candidate").when(mid, "revise_when_new_information_arrives").otherwise("maintain")
    return x.select("match_id", "confidence", r6("score").alias("predictability"), "uncertainty", output.alias("output"), action.alias("action"), information.alias("information"), following.alias("next"))


def log_loss(p: Column, y: Column, eps: float = 1e-9) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.when(y == 1, -F.ln(q)).otherwise(-F.ln(1 - q))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


@query("p18_score_binary", f"WITH {PREDICTIONS} SELECT match_id, round(CASE WHEN y = 1 THEN -ln(p1) ELSE -ln(1 - p1) END, 6) AS logloss, round((p1 - y) * (p1 - y), 6) AS brier, (p1 >= 0.5) = (y = 1) AS correct FROM preds")
def p18(spark, sf):
    p, y = F.col("p1"), F.col("y")
    return predictions(spark, sf).select("match_id", r6(log_loss(p, y)).alias("logloss"), r6(brier(p, y)).alias("brier"), ((p >= 0.5) == (y == 1)).alias("correct"))


@query("p19_score_multiclass", f"WITH {PREDICTIONS}, n AS (SELECT match_id, y, p1 + p2 + p3 AS s, p1, p2, p3 FROM preds) SELECT match_id, round(pow(p1 / s - (y = 0)::INT, 2) + pow(p2 / s - (y = 1)::INT, 2) + pow(p3 / s, 2) + 1e-9, 6) AS brier, CASE WHEN p3 >= p2 AND p3 >= p1 THEN 'm3' WHEN p2 >= p1 THEN 'm2' ELSE 'm1' END AS top FROM n")
def p19(spark, sf):
    """Brier score over a field, and its favourite; of equal probabilities the larger id. Scores are fractions that often end half-way between two roundings: both sides move them off by 1e-9."""
    p = predictions(spark, sf).withColumn("f", F.array(*(F.struct((F.col(f"p{i}") / (F.col("p1") + F.col("p2") + F.col("p3"))).alias("p"), F.lit(f"m{i}").alias("id")) for i in (1, 2, 3))))
    won = F.when(F.col("y") == 0, "m1").otherwise("m2")
    score = F.aggregate("f", F.lit(0.0), lambda a, x: a + F.pow(x["p"] - (x["id"] == won).cast("int"), F.lit(2)))
    top = F.array_max(F.array(*(F.struct(F.col(f"p{i}").alias("p"), F.lit(f"m{i}").alias("id")) for i in (1, 2, 3))))["id"]
    return p.select("match_id", r6(score + 1e-9).alias("brier"), top.alias("top"))


@query("p20_side_difference", f"WITH {MATCHES} SELECT match_id, round(score_a - score_b, 6) AS diff, round((score_a - score_b) / (abs(score_a) + abs(score_b) + 1e-6), 6) AS relative FROM matches")
def p20(spark, sf):
    a, b = F.col("score_a"), F.col("score_b")
    return matches(spark, sf).select("match_id", r6(a - b).alias("diff"), r6((a - b) / (F.abs(a) + F.abs(b) + 1e-6)).alias("relative"))


INTERACTIONS = PREDICTIONS + """, parts AS (SELECT match_id, p1 - p2 AS elo, CASE WHEN match_id % 4 <> 0 THEN p3 - 0.5 END AS form, p2 - p3 AS momentum, CASE WHEN match_id % 3 <> 0 THEN p1 END AS cov_a, CASE WHEN match_id % 5 <> 0 THEN p2 END AS cov_b,
  CASE WHEN match_id % 7 <> 0 THEN p3 END AS fresh, CAST(match_id % 2 AS DOUBLE) AS rest, CASE WHEN match_id % 8 <> 0 THEN 2 * p3 - 1 END AS h2h FROM preds)"""


@query("p21_interactions", f"""WITH {INTERACTIONS} SELECT match_id, round(elo * form, 6) AS elo_x_form, round(elo * coalesce((cov_a + cov_b) / 2, cov_a, cov_b), 6) AS elo_x_coverage, round(momentum * form, 6) AS momentum_x_form,
 round(momentum * fresh, 6) AS momentum_x_freshness, round(form * rest, 6) AS form_x_short_rest, round(h2h * elo, 6) AS h2h_x_elo FROM parts""")
def p21(spark, sf):
    """Six products of features, null where a factor is; coverage is the mean of the sides that have one."""
    i, p = F.col("match_id"), [F.col(f"p{k}") for k in (1, 2, 3)]
    known = F.array_compact(F.array(F.when(i % 3 != 0, p[0]), F.when(i % 5 != 0, p[1])))
    coverage = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    x = {"elo": p[0] - p[1], "form": F.when(i % 4 != 0, p[2] - 0.5), "momentum": p[1] - p[2], "coverage": coverage, "freshness": F.when(i % 7 != 0, p[2]), "short_rest": (i % 2).cast("double"), "h2h": F.when(i % 8 != 0, 2 * p[2] - 1)}
    pairs = (("elo", "form"), ("elo", "coverage"), ("momentum", "form"), ("momentum", "freshness"), ("form", "short_rest"), ("h2h", "elo"))
    return predictions(spark, sf).select("match_id", *(r6(x[a] * x[b]).alias(f"{a}_x_{b}") for a, b in pairs))


def mirrored(df: DataFrame, label: str) -> DataFrame:
    """Both orientations: A__x and B__x swapped, D__x negated, the label flipped."""
    swap = {c: ("B" if c[0] == "A" else "A") + c[1:] for c in df.columns if c[:3] in ("A__", "B__")}
    other = df.select(*(F.col(swap[c]).alias(c) if c in swap else (-F.col(c)).alias(c) if c[:3] == "D__" else (1 - F.col(c)).alias(c) if c == label else F.col(c) for c in df.columns))
    return df.withColumn("mirror", F.lit(False)).unionByName(other.withColumn("mirror", F.lit(True)))


@query("p22_mirror_sides", f"""WITH {PREDICTIONS}, f AS (SELECT m.match_id, score_a AS "A__v", score_b AS "B__v", round(score_a - score_b, 6) AS "D__v", y FROM matches m JOIN preds p USING (match_id))
SELECT match_id, "A__v", "B__v", "D__v", y, false AS mirror FROM f UNION ALL SELECT match_id, "B__v", "A__v", -"D__v", 1 - y, true FROM f""")
def p22(spark, sf):
    m = matches(spark, sf).where("outcome <> 'DRAW'")
    f = m.select("match_id", F.col("score_a").alias("A__v"), F.col("score_b").alias("B__v"), r6(F.col("score_a") - F.col("score_b")).alias("D__v"), (F.col("outcome") == "B").cast("int").alias("y"))
    return mirrored(f, "y")


def missing_columns(df: DataFrame, required: dict[str, str]) -> list[str]:
    """Names of required columns that are absent or of another type; an empty list means the contract holds."""
    have = dict(df.dtypes)
    return sorted(c for c, t in required.items() if have.get(c) != t)


CONTRACT = {"events": ["event_id", "ts", "stadium", "value"], "orders": ["o_orderkey", "o_season"], "lineitem": ["l_tax", "l_orderkey"], "part": ["p_weight"]}


@query("p23_schema_contract", "WITH need AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in CONTRACT.items() for c in cs) + ") v(name, missing)) SELECT name, missing FROM need WHERE (name, missing) NOT IN (SELECT (table_name, column_name) FROM information_schema.columns)")
def p23(spark, sf):
    """Columns that a contract needs and a table lacks."""
    bad = [(t, c) for t, cs in CONTRACT.items() for c in sorted(set(cs) - set(table(spark, sf, t).columns))]
    return spark.createDataFrame(bad, "name string, missing string")


@query("p24_knowledge_order", f"""WITH {KNOWN}, c AS (SELECT x.match_id, x.sport, (SELECT count(*) FROM known k WHERE k.sport = x.sport AND k.t < x.t) AS earlier, (SELECT count(*) FROM known k WHERE k.sport = x.sport AND k.due <= x.t - 3600000000) AS known FROM matches x)
SELECT sport, count(*) AS n, CAST(sum(earlier) AS BIGINT) AS earlier, CAST(sum(known) AS BIGINT) AS known, CAST(max(earlier - known) AS BIGINT) AS most_unknown FROM c GROUP BY 1""")
def p24(spark, sf):
    """What a hypothesis may remember: per sport, results before each match, and how many of them were known at its cutoff."""
    m = matches(spark, sf)
    r = admitted_results(m)
    at = lambda when: m.select("sport", F.col("match_id").alias("id"), when.alias("cutoff"))
    earlier = admitted(r.withColumn("due", F.col("t") + 1), at(F.col("t")), ["sport"]).withColumnRenamed("n_admitted", "earlier")
    known = admitted(r, at(F.col("t") - HOUR), ["sport"]).withColumnRenamed("n_admitted", "known")
    x = m.select("sport", F.col("match_id").alias("id")).join(earlier, "id").join(known, "id")
    return x.groupBy("sport").agg(F.count("*").alias("n"), F.sum("earlier").alias("earlier"), F.sum("known").alias("known"), F.max(F.col("earlier") - F.col("known")).alias("most_unknown"))
