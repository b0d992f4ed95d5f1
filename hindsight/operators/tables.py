"""Sorts and limits, upserts, ledgers, merges and maintenance of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import DAY, OBS, PREDICTIONS, matches, observations, predictions, table


@query("t1_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def t1(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("t2_newest_per_key", f"WITH {OBS} SELECT pid, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY t DESC, event_id DESC) AS rn FROM obs) WHERE rn <= 20")
def t2(spark, sf):
    w = Window.partitionBy("pid").orderBy(F.desc("t"), F.desc("event_id"))
    return observations(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("pid", "event_id", "rn")


@query("t3_argmin_composite", "SELECT p_brand, arg_min(p_partkey, (p_retailprice, -p_size, p_partkey)) AS best FROM part GROUP BY 1")
def t3(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min(F.struct("p_retailprice", (-F.col("p_size")).alias("s"), "p_partkey")).alias("m")).select("p_brand", F.col("m.p_partkey").alias("best"))


@query("t4_combinations", "WITH m AS (SELECT unnest(range(1, 7)) AS i) SELECT a.i AS a, b.i AS b, c.i AS c, w.w AS weight FROM m a JOIN m b ON a.i < b.i JOIN m c ON b.i < c.i, (VALUES (0.25), (0.5), (0.75)) w(w)")
def t4(spark, sf):
    m = spark.range(1, 7).select(F.collect_list("id").alias("ids"))
    pick = lambda c, after: F.filter("ids", lambda x: x > F.col(after))
    out = m.select("ids", F.explode("ids").alias("a")).select("*", F.explode(pick("ids", "a")).alias("b")).select("*", F.explode(pick("ids", "b")).alias("c"))
    return out.select("a", "b", "c", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("weight"))


@query("t6_stable_order", f"WITH {OBS} SELECT event_id, row_number() OVER (PARTITION BY stat ORDER BY t, event_id) AS seq FROM obs")
def t6(spark, sf):
    return observations(spark, sf).select("event_id", F.row_number().over(Window.partitionBy("stat").orderBy("t", "event_id")).alias("seq"))


def upserted(old: DataFrame, new: DataFrame, key: list[str], keep: bool = True) -> DataFrame:
    """Old rows updated by new ones of the same key. keep: a null of the new row keeps the old value; else it overwrites."""
    rest = [c for c in old.columns if c not in key]
    j = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), key, "full_outer")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if keep else F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return j.select(*key, *(pick(c).alias(c) for c in rest))


def _versions(spark, sf, odd: int):
    o = table(spark, sf, "orders")
    if odd == 0:
        return o.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.where("o_orderkey % 3 <> 1").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))


VERSIONS = "old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) END AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 1)"


@query("s21_upsert_coalesce", f"WITH {VERSIONS} SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM old o FULL JOIN new n ON n.o_orderkey = o.o_orderkey")
def s21(spark, sf):
    return upserted(_versions(spark, sf, 0), _versions(spark, sf, 1), ["o_orderkey"])


def last_write(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key in the given order, with map-side combining."""
    rest = [c for c in rows.columns if c not in key]
    g = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


@query("s22_insert_or_replace", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def s22(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return last_write(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("s23_insert_or_ignore", f"WITH {VERSIONS} SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.o_orderkey = n.o_orderkey)")
def s23(spark, sf):
    old, new = _versions(spark, sf, 0), _versions(spark, sf, 1)
    return old.unionByName(new.join(old, "o_orderkey", "left_anti"))


@query("s24_append_daily", f"WITH {OBS} SELECT t // 86400000000 AS day, count(*) AS added FROM obs WHERE event_id % 4 <> 0 GROUP BY 1")
def s24(spark, sf):
    """What a day's ledger gains: events whose id isn't in it."""
    o = observations(spark, sf)
    known = o.where("event_id % 4 = 0").select("event_id")
    return o.join(known, "event_id", "left_anti").groupBy(F.floor(F.col("t") / 86_400_000_000).alias("day")).agg(F.count("*").alias("added"))


@query("m1_merge_overwrite", f"WITH {VERSIONS} SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE o.o_totalprice END AS o_totalprice FROM old o FULL JOIN new n ON n.o_orderkey = o.o_orderkey")
def m1(spark, sf):
    return upserted(_versions(spark, sf, 0), _versions(spark, sf, 1), ["o_orderkey"], keep=False)


def last_non_null(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Per key and column the last value that isn't null."""
    rest = [c for c in rows.columns if c not in (*key, order)]
    return rows.groupBy(*key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest))


@query("m2_merge_coalesce", f"WITH {VERSIONS}, u AS (SELECT *, 1 AS ord FROM old UNION ALL SELECT *, 2 FROM new) SELECT o_orderkey, arg_max(o_orderstatus, ord) FILTER (WHERE o_orderstatus IS NOT NULL) AS o_orderstatus, arg_max(o_totalprice, ord) FILTER (WHERE o_totalprice IS NOT NULL) AS o_totalprice FROM u GROUP BY 1")
def m2(spark, sf):
    u = _versions(spark, sf, 0).withColumn("ord", F.lit(1)).unionByName(_versions(spark, sf, 1).withColumn("ord", F.lit(2)))
    return last_non_null(u, ["o_orderkey"], "ord")


def append_only(rows: DataFrame, key: str) -> DataFrame:
    """One row per key; exact duplicates are skipped, and a key with different contents raises."""
    rest = [c for c in rows.columns if c != key]
    h = F.xxhash64(*rest)
    g = rows.groupBy(key).agg(F.min(h).alias("_a"), F.max(h).alias("_b"), F.first(F.struct(*rest)).alias("_r"))
    ok = F.when(F.col("_a") == F.col("_b"), F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("conflict at "), F.col(key).cast("string"))))
    return g.select(key, ok.alias("_r")).select(key, "_r.*")


@query("m3_append_only_merge", "SELECT event_id, user_id, value FROM events")
def m3(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return append_only(e.unionByName(e.where("event_id % 5 = 0")), "event_id")


@query("m4_snapshot_dedup", f"WITH {OBS} SELECT pid, t // 86400000000 AS day, arg_max(event_id, (t, event_id)) AS event_id FROM obs GROUP BY 1, 2")
def m4(spark, sf):
    o = observations(spark, sf).select("pid", F.floor(F.col("t") / 86_400_000_000).alias("day"), "t", "event_id")
    return last_write(o, ["pid", "day"], ["t", "event_id"]).drop("t")


@query("m5_outcome_precedence", f"WITH {OBS} SELECT pid, event_id FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY event_id % 3 = 0 DESC, avail DESC, event_id DESC) AS rn FROM obs) WHERE rn = 1")
def m5(spark, sf):
    o = observations(spark, sf).select("pid", "event_id", "avail")
    return last_write(o, ["pid"], [(F.col("event_id") % 3 == 0).alias("v"), "avail", "event_id"]).drop("avail")


@query("m6_queue_compaction", f"WITH {OBS} SELECT pid, stat, min(event_id) AS first_seen, arg_max(value, event_id) AS value FROM obs GROUP BY 1, 2")
def m6(spark, sf):
    return observations(spark, sf).groupBy("pid", "stat").agg(F.min("event_id").alias("first_seen"), F.max_by("value", "event_id").alias("value"))


@query("m7_id_sets", "SELECT o_custkey AS id, 'in_both' AS state FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'unused' FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def m7(spark, sf):
    o, c = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return o.intersect(c).withColumn("state", F.lit("in_both")).unionByName(c.subtract(o).withColumn("state", F.lit("unused")))


@query("m8_settlement", f"WITH {PREDICTIONS} SELECT m.match_id, CASE WHEN p.match_id IS NOT NULL AND p.match_id % 2 = 0 THEN 'SETTLED' ELSE 'OPEN' END AS status, CASE WHEN p.match_id % 2 = 0 THEN p.y END AS result FROM matches m LEFT JOIN preds p USING (match_id)")
def m8(spark, sf):
    done = predictions(spark, sf).where("match_id % 2 = 0").select("match_id", F.col("y").alias("result"))
    return matches(spark, sf).select("match_id").join(done, "match_id", "left").select("match_id", F.when(F.col("result").isNotNull(), "SETTLED").otherwise("OPEN").alias("status"), "result")


@query("m9_delete_counts", "SELECT count(*) AS before, count(*) FILTER (WHERE NOT (l_returnflag = 'R' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10))) AS after FROM lineitem")
def m9(spark, sf):
    li = table(spark, sf, "lineitem")
    gone = li.where("l_returnflag = 'R'").join(table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").agg(F.count("*").alias("gone"))
    return li.agg(F.count("*").alias("before")).crossJoin(gone).select("before", (F.col("before") - F.col("gone")).alias("after"))  # two single rows


REVISIONS = OBS + """, seen AS (SELECT pid, t // 86400000000 AS rev, stat, count(*) AS n, min(CAST(floor(value / 25) AS BIGINT)) AS print FROM obs WHERE stat IN ('view', 'click') GROUP BY 1, 2, 3),
 revs AS (SELECT * FROM seen WHERE n = 1), want AS (SELECT pid, stat, arg_max(print, rev) AS print FROM revs GROUP BY 1, 2)"""


@query("m10_first_provenance", f"WITH {REVISIONS}, b AS (SELECT r.pid, r.rev FROM revs r JOIN want w ON w.pid = r.pid AND w.stat = r.stat AND w.print = r.print GROUP BY 1, 2 HAVING count(*) = 2) SELECT pid, min(rev) AS first_rev, count(*) AS n FROM b GROUP BY 1")
def m10(spark, sf):
    """The first revision (day) in which both rows of a participant have the fingerprints that they have last; keys with several rows in a revision are ambiguous and left out."""
    o = observations(spark, sf).where(F.col("stat").isin("view", "click"))
    g = o.groupBy("pid", F.floor(F.col("t") / DAY).alias("rev"), "stat").agg(F.count("*").alias("n"), F.min(F.floor(F.col("value") / 25)).alias("print"))
    revs = g.where("n = 1").drop("n")
    want = revs.groupBy("pid", "stat").agg(F.max_by("print", "rev").alias("print"))
    both = revs.join(want, ["pid", "stat", "print"]).groupBy("pid", "rev").agg(F.count("*").alias("n")).where("n = 2")
    return both.groupBy("pid").agg(F.min("rev").alias("first_rev"), F.count("*").alias("n"))


@query("m11_incremental_skip", f"WITH {OBS}, g AS (SELECT pid, count(*) AS n, max(event_id) AS last FROM obs GROUP BY 1), s AS (SELECT pid, count(*) AS n, max(event_id) AS last FROM obs WHERE event_id < 9000 GROUP BY 1) SELECT g.pid FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.pid = g.pid AND s.n = g.n AND s.last = g.last)")
def m11(spark, sf):
    """Participants whose fingerprint isn't stored yet."""
    prints = lambda o: o.groupBy("pid").agg(F.sha2(F.concat_ws("|", F.count("*"), F.max("event_id")), 256).alias("print"))
    o = observations(spark, sf)
    return prints(o).join(prints(o.where("event_id < 9000")), ["pid", "print"], "left_anti").select("pid")


def twelve_digits(x: Column) -> Column:
    """A number with twelve significant digits and no closing zeros, as %.12g writes it."""
    text = F.regexp_replace(F.format_string("%.12g", x), r"(\.\d*?)0+(e|$)", "$1$2")
    return F.regexp_replace(text, r"\.(e|$)", "$1")


@query("m12_float_fingerprint", "SELECT l_orderkey, l_linenumber, printf('%.12g', l_extendedprice / 7) AS a, sha256(l_partkey || '|' || printf('%.12g', l_extendedprice / 7 * 1e9) || '|' || printf('%.12g', l_quantity / 1e6)) AS fingerprint FROM lineitem")
def m12(spark, sf):
    """A hash that ignores float noise."""
    x = F.col("l_extendedprice") / 7
    g = twelve_digits
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", g(x).alias("a"), F.sha2(F.concat_ws("|", "l_partkey", g(x * 1e9), g(F.col("l_quantity") / 1e6)), 256).alias("fingerprint"))


def vectors_match(x: Column, y: Column) -> Column:
    """Whether two multisets of numbers are equal up to 1e-12 of a value, or 1e-9."""
    near = F.zip_with(F.array_sort(x), F.array_sort(y), lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1e-9), 1e-12 * F.greatest(F.abs(a), F.abs(b))))
    return (F.size(x) == F.size(y)) & F.forall(near, lambda v: F.coalesce(v, F.lit(False)))


@query("m13_vectors_match", """WITH v AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS x, list_sort(list(l_quantity + CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 1 THEN 1e-3 ELSE 1e-12 END) FILTER (WHERE l_orderkey % 11 <> 0 OR l_linenumber <> 2)) AS y FROM lineitem GROUP BY 1)
SELECT l_orderkey, coalesce(len(x) = len(y) AND len(list_filter(list_zip(x, y), lambda z: abs(z[1] - z[2]) > greatest(1e-9, 1e-12 * greatest(abs(z[1]), abs(z[2]))))) = 0, false) AS same FROM v""")
def m13(spark, sf):
    """An order's quantities against a second reading of them, in which some orders have another value or lack a line."""
    moved = F.col("l_quantity") + F.when((F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") == 1), 1e-3).otherwise(1e-12)
    other = F.when((F.col("l_orderkey") % 11 != 0) | (F.col("l_linenumber") != 2), moved)
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("x"), F.collect_list(other).alias("y"))
    return g.select("l_orderkey", vectors_match(F.col("x"), F.col("y")).alias("same"))
