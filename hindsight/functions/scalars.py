"""Functions of columns that the engine's operators share, each with a query that checks it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import OBS, PREDICTIONS, micros, observations, predictions, table

#: Hours from UTC of the time zone names that pages write.
ZONES = {"UTC": 0, "GMT": 0, "CET": 1, "CEST": 2, "MSK": 3, "IST": 5.5, "JST": 9, "KST": 9, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7}
#: Centimetres and kilograms of the units that pages write.
UNITS = {"cm": 1.0, "m": 100.0, "in": 2.54, "ft": 30.48, "kg": 1.0, "g": 0.001, "lb": 0.45359237}


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))


def entropy(p: Column) -> Column:
    """Of a yes or no, in nats; 0 where it's certain."""
    part = lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(0.0)
    return part(p) + part(1 - p)


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two chances of the same event, in nats."""
    return entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2


@query("fn_information", f"""WITH {PREDICTIONS}, h AS (SELECT match_id, p1, p2, (p1 + p2) / 2 AS m FROM preds)
SELECT match_id, round(ln(p1 / (1 - p1)), 6) AS logit, round(-p1 * ln(p1) - (1 - p1) * ln(1 - p1), 6) AS entropy,
 round(-m * ln(m) - (1 - m) * ln(1 - m) - (-p1 * ln(p1) - (1 - p1) * ln(1 - p1) - p2 * ln(p2) - (1 - p2) * ln(1 - p2)) / 2, 6) AS divergence FROM h""")
def information(spark, sf):
    p, q = F.col("p1"), F.col("p2")
    return predictions(spark, sf).select("match_id", F.round(logit(p), 6).alias("logit"), F.round(entropy(p), 6).alias("entropy"), F.round(js_divergence(p, q), 6).alias("divergence"))


def searchsorted(x: Column, edges: list[float], right: bool = False) -> Column:
    """How many of the sorted edges lie before x (right: or at it)."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x if right else e < x))


EDGES = [1.0, 10.0, 25.0, 50.0]


@query("fn_searchsorted", f"SELECT l_orderkey, l_linenumber, len(list_filter({EDGES}, lambda e: e < l_quantity)) AS left_at, len(list_filter({EDGES}, lambda e: e <= l_quantity)) AS right_at FROM lineitem")
def sorted_places(spark, sf):
    x = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", searchsorted(x, EDGES).cast("long").alias("left_at"), searchsorted(x, EDGES, right=True).cast("long").alias("right_at"))


@query("fn_half_even", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS half FROM lineitem")
def half_even(spark, sf):
    """Halves go to the even neighbour."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2, 0).cast("long").alias("half"))


def sorted_json(doc: Column) -> Column:
    """A flat JSON object with its keys in order and its values as text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(doc, "map<string,string>")))))


@query("fn_sorted_json", """SELECT p_partkey, '{"brand":"' || p_brand || '","size":"' || p_size || '","type":"' || p_type || '"}' AS doc FROM part""")
def sorted_keys(spark, sf):
    doc = F.format_string('{"type": "%s", "size": %d, "brand": "%s"}', "p_type", "p_size", "p_brand")
    return table(spark, sf, "part").select("p_partkey", sorted_json(doc).alias("doc"))


def measured(text: Column) -> Column:
    """The first number with a known unit in a text, in centimetres or kilograms; null without one."""
    number = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)\s*([a-z]+)\b", 1)
    unit = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)\s*([a-z]+)\b", 2)
    table_ = F.create_map(*(F.lit(v) for kv in UNITS.items() for v in kv))
    return F.when(number != "", number.cast("double") * F.try_element_at(table_, unit))


@query("fn_units", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN round(p_size * 2.54, 6) WHEN 2 THEN round(p_size * 0.45359237, 6) END::DOUBLE AS value FROM part")
def units(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("height: "), n, F.lit("cm tall"))).when(k == 1, F.concat(n, F.lit(" in"))).when(k == 2, F.concat(F.lit("about "), n, F.lit(".0 lb"))).otherwise(F.concat(n, F.lit(" stone")))
    return table(spark, sf, "part").select("p_partkey", F.round(measured(text), 6).alias("value"))


def zoned_seconds(text: Column) -> Column:
    """Seconds since 1970 of 'yyyy-MM-dd HH:mm ZONE'; null for unknown zones and other texts."""
    at = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d \d\d:\d\d) ([A-Z]+)$", 1), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    zone = F.try_element_at(F.create_map(*(F.lit(v) for k, h in ZONES.items() for v in (k, int(h * 3600)))), F.regexp_extract(text, r" ([A-Z]+)$", 1))
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)
    return seconds - zone


@query("fn_zoned_times", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch(date_trunc('day', o_orderdate)) + 45000 WHEN 1 THEN epoch(date_trunc('day', o_orderdate)) + 45000 - 32400 WHEN 2 THEN epoch(date_trunc('day', o_orderdate)) + 45000 + 18000 END::BIGINT AS seconds FROM orders")
def zones(spark, sf):
    zone = F.get(F.array(*map(F.lit, ("GMT", "JST", "EST", "XYZ"))), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", zoned_seconds(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 12:30 "), zone)).alias("seconds"))


@query("fn_truncation", "SELECT event_id, epoch_us(date_trunc('hour', ts)) AS hour, epoch_us(date_trunc('day', ts)) AS day, epoch_us(date_trunc('week', ts)) AS week FROM events")
def truncation(spark, sf):
    e = table(spark, sf, "events")
    units_ = {u: F.date_trunc(u, F.col("ts").cast("timestamp_ntz")) for u in ("hour", "day", "week")}
    return e.select("event_id", *(c.alias(u) for u, c in units_.items())).select("event_id", *(micros(u).alias(u) for u in units_))


@query("fn_deviation", f"WITH {OBS} SELECT stat, round(mad(value), 6) AS mad FROM obs GROUP BY 1")
def deviation(spark, sf):
    """Median absolute deviation per stat."""
    o = observations(spark, sf)
    m = o.groupBy("stat").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    return o.join(m, "stat").groupBy("stat").agg(F.round(F.percentile(F.abs(F.col("value") - F.col("m")), F.lit(0.5)), 6).alias("mad"))
