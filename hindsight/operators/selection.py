"""Exact quantiles of many groups of any size, and drift and routing context made of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.roles import PREDICTIONS, predictions
from ..sources.work import stored
from .predicates import r6


def quantiles(rows: DataFrame, by: list[str], value: str, at: Sequence[float], limit: int = 100_000, bins: int = 1024) -> DataFrame:
    """(*by, n, q0, q1, ...): exact quantiles of a column, as percentile() gives them, without a buffer of a whole group.

    The rank of each quantile is looked for in a range of values. A range of more than `limit` values is
    cut into `bins`, whose counts (map-side combined) tell the one that holds the rank, until what is left
    can be sorted. Each round reads rows once: pass a written table. Nulls are left out, as are NaNs;
    groups of nulls alone have no row; a null in `by` is a group of its own.
    """
    keys = [F.struct(*by).alias("_g")] if by else [F.struct(F.lit(0).alias("_")).alias("_g")]
    x = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    x = x.withColumn("_g", F.to_json("_g", {"ignoreNullFields": "false"}))
    stats = stored(x.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "ranks")
    pos = [(F.col("n") - 1) * F.lit(float(q)) for q in at]
    ranks = F.array_distinct(F.array(*(f(p) for p in pos for f in (F.floor, F.ceil))))
    ranges = stats.select("_g", F.explode(ranks).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("m"))
    wide = (F.col("m") > limit) & (F.col("lo") < F.col("hi"))

    def inside(r: DataFrame) -> DataFrame:
        r = r.withColumnRenamed("_g", "_h")
        return x.join(r, (F.col("_g") == F.col("_h")) & F.col("_v").between(F.col("lo"), F.col("hi"))).drop("_h")

    while not (large := ranges.where(wide)).isEmpty():
        part = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        h = inside(large).groupBy("_g", "k", F.least(F.floor(part * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.first("below").alias("below"))
        w = Window.partitionBy("_g", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        h = h.withColumn("below", F.col("below") + F.coalesce(F.sum("m").over(w), F.lit(0)))
        found = h.where((F.col("below") <= F.col("k")) & (F.col("below") + F.col("m") > F.col("k"))).select("_g", "k", "lo", "hi", "below", "m")
        ranges = stored(ranges.where(~wide).unionByName(found), "ranks")
    nth = F.row_number().over(Window.partitionBy("_g", "k").orderBy("_v"))
    sorted_ = inside(ranges.where("lo < hi")).withColumn("nth", nth).where(F.col("nth") == F.col("k") - F.col("below") + 1).select("_g", "k", F.col("_v").alias("v"))
    held = sorted_.unionByName(ranges.where("lo = hi").select("_g", "k", F.col("lo").alias("v")))
    held = held.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("v"))
    out = stats.select("_g", "n").join(held, "_g")
    for i, p in enumerate(pos):
        a, b = F.floor(p), F.ceil(p)
        low, high = F.element_at("v", a), F.element_at("v", b)
        out = out.withColumn(f"q{i}", F.when(a == b, low).otherwise((b - p) * low + (p - a) * high))
    names = rows.select(*keys).schema["_g"].dataType
    g = F.from_json("_g", names, {"mode": "FAILFAST"})
    return out.select(*(g[c].alias(c) for c in by), "n", *(f"q{i}" for i in range(len(at))))


FEATURES = ("p1", "p2", "p3")


def long(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, f, v): a row for each feature."""
    return rows.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in FEATURES))).alias("e")).select(*by, "e.f", "e.v")


def mean_discrepancy(r: np.ndarray, c: np.ndarray) -> float:
    """The squared maximum mean discrepancy of two small samples by a Gaussian kernel, as wide as the median of their distances."""
    square = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(2)
    cross = square(r, c)
    width = max(float(np.sqrt(np.median(cross[cross > 0]))) if (cross > 0).any() else 1.0, 0.25)
    k = lambda d: float(np.exp(-d / (2 * width * width)).mean())
    return k(square(r, r)) + k(square(c, c)) - 2 * k(cross)


def drift(rows: DataFrame, most: int = 96) -> DataFrame:
    """(sport, location, missing, mmd), each from 0 to 1, of rows(sport, seq, recent, *FEATURES): how far medians moved in units of the older rows' quartile range, how much the shares of missing values differ, and the discrepancy of at most `most` evenly spaced rows a side."""
    x = stored(rows.select("sport", "seq", "recent", *FEATURES), "drift")
    old = quantiles(stored(long(x.where("NOT recent"), ["sport"]), "drift"), ["sport", "f"], "v", (0.5, 0.25, 0.75))
    new = quantiles(stored(long(x.where("recent"), ["sport"]), "drift"), ["sport", "f"], "v", (0.5,))
    share = long(x, ["sport", "recent"]).groupBy("sport", "f").agg(*(F.avg(F.when(F.col("recent") == side, F.col("v").isNotNull().cast("double"))).alias(n) for side, n in ((True, "s1"), (False, "s0"))))
    each = share.join(old.select("sport", "f", F.col("q0").alias("m"), F.greatest(F.col("q2") - F.col("q1"), F.lit(1e-6)).alias("scale")), ["sport", "f"], "left").join(new.select("sport", "f", F.col("q0").alias("now")), ["sport", "f"], "left")
    each = each.withColumns({"scale": F.coalesce("scale", F.lit(1.0)), "m": F.coalesce("m", F.lit(0.0))})
    each = stored(each.withColumn("now", F.coalesce("now", "m")), "drift")
    moved = each.groupBy("sport").agg(F.avg(F.least(F.abs(F.col("now") - F.col("m")) / F.col("scale"), F.lit(5.0)) / 5).alias("location"), F.avg(F.abs(F.coalesce("s1", F.lit(0.0)) - F.coalesce("s0", F.lit(0.0)))).alias("missing"))
    place = Window.partitionBy("sport", "recent").orderBy("seq")
    size = x.groupBy("sport", "recent").agg(F.count("*").alias("n"))
    i = F.col("i")
    # row i is taken if some j of 0 .. most - 1 has floor(j * (n - 1) / (most - 1)) = i
    taken = (F.col("n") <= most) | (F.floor(F.ceil(i * (most - 1) / (F.col("n") - 1)) * (F.col("n") - 1) / (most - 1)) == i)
    few = x.withColumn("i", F.row_number().over(place) - 1).join(size, ["sport", "recent"]).where(taken)
    few = few.join(each.groupBy("sport").pivot("f", list(FEATURES)).agg(F.first(F.struct("m", "scale"))).select("sport", *(F.col(c).alias(f"s_{c}") for c in FEATURES)), "sport")
    z = [F.coalesce(F.greatest(F.least((F.col(c) - F.col(f"s_{c}.m")) / F.col(f"s_{c}.scale"), F.lit(8.0)), F.lit(-8.0)), F.lit(0.0)).alias(c) for c in FEATURES]

    def gram(f: pd.DataFrame) -> pd.DataFrame:
        r, c = (f[f.recent == side][list(FEATURES)].to_numpy() for side in (False, True))
        m = max(mean_discrepancy(r, c), 0.0) if len(r) and len(c) else 0.0
        return pd.DataFrame({"sport": [f.sport.iloc[0]], "mmd": [m / (m + 0.05)]})

    mmd = few.select("sport", "recent", *z).groupBy("sport").applyInPandas(gram, "sport string, mmd double")  # 2 * most rows a sport
    return moved.join(mmd, "sport")


DRIFT = f"""WITH {PREDICTIONS}, x AS (SELECT sport, seq, seq > count(*) OVER (PARTITION BY sport) - 40 AS recent, p1, CASE WHEN match_id % 9 <> 0 THEN p2 END AS p2, CASE WHEN match_id % 4 <> 0 OR seq < 50 THEN p3 END AS p3 FROM preds),
 l AS (SELECT sport, seq, recent, unnest(['p1', 'p2', 'p3']) AS f, unnest([p1, p2, p3]) AS v FROM x),
 e AS (SELECT sport, f, median(v) FILTER (NOT recent) AS m, greatest(quantile_cont(v, 0.75) FILTER (NOT recent) - quantile_cont(v, 0.25) FILTER (NOT recent), 1e-6) AS scale, median(v) FILTER (recent) AS now,
   avg(CAST(v IS NOT NULL AS DOUBLE)) FILTER (recent) AS s1, avg(CAST(v IS NOT NULL AS DOUBLE)) FILTER (NOT recent) AS s0 FROM l GROUP BY 1, 2),
 moved AS (SELECT sport, avg(least(abs(now - m) / scale, 5) / 5) AS location, avg(abs(s1 - s0)) AS missing FROM e GROUP BY 1),
 i AS (SELECT *, row_number() OVER (PARTITION BY sport, recent ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY sport, recent) AS n FROM x),
 few AS (SELECT sport, recent, seq FROM i WHERE n <= 96 OR i IN (SELECT (j * (n - 1)) // 95 FROM range(96) t(j))),
 z AS (SELECT l.sport, l.recent, l.seq, list(coalesce(greatest(least((v - m) / scale, 8), -8), 0) ORDER BY f) AS z FROM l JOIN few USING (sport, recent, seq) JOIN e USING (sport, f) GROUP BY 1, 2, 3),
 d AS (SELECT a.sport, a.recent AS ra, b.recent AS rb, list_sum(list_transform(list_zip(a.z, b.z), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d FROM z a JOIN z b ON a.sport = b.sport),
 w AS (SELECT sport, greatest(sqrt(median(d)), 0.25) AS w FROM d WHERE NOT ra AND rb AND d > 0 GROUP BY 1),
 k AS (SELECT sport, avg(exp(-d / (2 * w * w))) FILTER (NOT ra AND NOT rb) + avg(exp(-d / (2 * w * w))) FILTER (ra AND rb) - 2 * avg(exp(-d / (2 * w * w))) FILTER (NOT ra AND rb) AS m FROM d JOIN w USING (sport) GROUP BY 1)
SELECT sport, round(location, 6) AS location, round(missing, 6) AS missing, round(greatest(m, 0) / (greatest(m, 0) + 0.05), 6) AS mmd FROM moved JOIN k USING (sport)"""


def _gappy(spark, sf: str) -> DataFrame:
    """The prediction matrix with missing values, which later rows have more of."""
    return predictions(spark, sf).withColumns({"p2": F.when(F.col("match_id") % 9 != 0, F.col("p2")), "p3": F.when((F.col("match_id") % 4 != 0) | (F.col("seq") < 50), F.col("p3"))})


@query("r7_drift_state", DRIFT)
def r7_state(spark, sf):
    """The last 40 rows of each sport against all before."""
    x = _gappy(spark, sf)
    x = x.join(x.groupBy("sport").agg(F.count("*").alias("n")), "sport").withColumn("recent", F.col("seq") > F.col("n") - 40)
    return drift(x).select("sport", *(r6(c).alias(c) for c in ("location", "missing", "mmd")))


def router_context(rows: DataFrame, recent: int = 120) -> DataFrame:
    """The context of each row of rows(sport, seq, train, *FEATURES) that isn't `train`, from its features and its sport's training rows: their number and share of missing values; the row's missing share, median and mean distance to the training medians in median absolute deviations, and spread; the training rows' spread; how far the medians of the `recent` newest training rows lie from all; the row's median distance to those; and their spread."""
    x = stored(rows.select("sport", "match_id", "seq", "train", *FEATURES), "context")
    cut = x.where("train").groupBy("sport").agg(F.max("seq").alias("end"), F.count("*").alias("n"), F.avg(sum(F.col(c).isNull().cast("double") for c in FEATURES) / len(FEATURES)).alias("train_missing"))
    flat = stored(long(x.where("train").join(cut.select("sport", "end"), "sport").withColumn("new", F.col("seq") > F.col("end") - recent), ["sport", "new"]), "context")
    med = stored(quantiles(flat, ["sport", "f"], "v", (0.5,)).select("sport", "f", F.col("q0").alias("m")), "context")
    off = stored(flat.join(med, ["sport", "f"]).withColumn("off", F.abs(F.col("v") - F.col("m"))), "context")
    mad = quantiles(off, ["sport", "f"], "off", (0.5,)).select("sport", "f", F.when(F.col("q0") > 1e-9, F.col("q0")).otherwise(1.0).alias("scale"))
    new = quantiles(flat.where("new"), ["sport", "f"], "v", (0.5,)).select("sport", "f", F.col("q0").alias("now"))
    std = flat.groupBy("sport", "f").agg(F.stddev_pop("v").alias("s"), F.stddev_pop(F.when(F.col("new"), F.col("v"))).alias("sn"))
    each = med.join(mad, ["sport", "f"]).join(new, ["sport", "f"], "left").join(std, ["sport", "f"]).withColumn("now", F.coalesce("now", "m"))
    mid = lambda a: F.expr(f"array_sort(filter({a}, x -> x IS NOT NULL))")

    def median(a):
        s, n = mid(a), F.expr(f"size(filter({a}, x -> x IS NOT NULL))")
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    side = each.groupBy("sport").agg(*(F.transform(F.array_sort(F.collect_list(F.struct("f", F.col(c).alias("v")))), lambda e: e["v"]).alias(c) for c in ("m", "scale", "now", "s", "sn")))
    r = x.where("NOT train").join(F.broadcast(side.join(cut, "sport")), "sport").withColumn("v", F.array(*FEATURES))
    far = lambda centre: F.zip_with(F.zip_with("v", centre, lambda v, m: F.abs(F.coalesce(v, m) - m)), F.col("scale"), lambda d, s: d / s)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, e: t + e) / F.size(a)
    r = r.withColumns({"z": far("m"), "zr": far("now"), "filled": F.zip_with("v", "m", lambda v, m: F.coalesce(v, m)), "shift": F.zip_with(F.zip_with("now", "m", lambda a, b: F.abs(a - b)), F.col("scale"), lambda d, s: d / s)})
    r = r.withColumn("fm", mean("filled"))
    spread = F.sqrt(F.aggregate("filled", F.lit(0.0), lambda t, e: t + (e - F.col("fm")) * (e - F.col("fm"))) / F.size("filled"))
    gaps = F.size(F.filter("v", lambda e: e.isNull())) / F.size("v")
    return r.select("sport", "match_id", F.log1p("n").alias("train_size"), "train_missing", gaps.alias("row_missing"), median("z").alias("row_shift"), mean("z").alias("row_distance"), spread.alias("row_spread"), F.coalesce(median("s"), F.lit(0.0)).alias("train_spread"), median("shift").alias("regime_shift"), median("zr").alias("recent_shift"), F.coalesce(median("sn"), median("s"), F.lit(0.0)).alias("recent_spread"))


@query("r1_router_context_full", f"""WITH {PREDICTIONS}, x AS (SELECT sport, match_id, seq, seq <= floor(count(*) OVER (PARTITION BY sport) * 0.78) AS train, p1, CASE WHEN match_id % 9 <> 0 THEN p2 END AS p2, CASE WHEN match_id % 4 <> 0 OR seq < 50 THEN p3 END AS p3 FROM preds),
 c AS (SELECT sport, count(*) AS n, avg((CAST(p1 IS NULL AS INT) + CAST(p2 IS NULL AS INT) + CAST(p3 IS NULL AS INT)) / 3.0::DOUBLE) AS miss, max(seq) AS e FROM x WHERE train GROUP BY 1),
 l AS (SELECT sport, seq > e - 120 AS new, unnest(['p1', 'p2', 'p3']) AS f, unnest([p1, p2, p3]) AS v FROM x JOIN c USING (sport) WHERE train),
 m AS (SELECT sport, f, median(v) AS m, median(v) FILTER (new) AS now, stddev_pop(v) AS s, stddev_pop(v) FILTER (new) AS sn FROM l GROUP BY 1, 2),
 a AS (SELECT sport, f, median(abs(v - m)) AS d FROM l JOIN m USING (sport, f) GROUP BY 1, 2),
 g AS (SELECT sport, f, m, now, s, sn, CASE WHEN d > 1e-9 THEN d ELSE 1 END AS sc FROM m JOIN a USING (sport, f)),
 r AS (SELECT sport, match_id, unnest(['p1', 'p2', 'p3']) AS f, unnest([p1, p2, p3]) AS v FROM x WHERE NOT train)
SELECT sport, match_id, round(ln(1 + any_value(n)), 6) AS train_size, round(any_value(miss), 6) AS train_missing, round(avg(CAST(v IS NULL AS DOUBLE)), 6) AS row_missing,
 round(median(abs(coalesce(v, m) - m) / sc), 6) AS row_shift, round(avg(abs(coalesce(v, m) - m) / sc), 6) AS row_distance, round(stddev_pop(coalesce(v, m)), 6) AS row_spread, round(median(s), 6) AS train_spread,
 round(median(abs(now - m) / sc), 6) AS regime_shift, round(median(abs(coalesce(v, now) - now) / sc), 6) AS recent_shift, round(median(sn), 6) AS recent_spread
FROM r JOIN g USING (sport, f) JOIN c USING (sport) GROUP BY 1, 2""")
def r1_full(spark, sf):
    """Routing context of the holdout rows from all rows before them."""
    x = _gappy(spark, sf)
    x = x.join(x.groupBy("sport").agg(F.count("*").alias("n")), "sport").withColumn("train", F.col("seq") <= F.floor(F.col("n") * 0.78))
    out = router_context(x)
    return out.select("sport", "match_id", *(r6(c).alias(c) for c in out.columns[2:]))
