r"""URL filters with dated lists: a temporal list join.

Entries (list, kind, pattern, verdict, action, at) add a pattern to a list or remove it at a time in
seconds. Per list and pattern they become validity intervals [since, until). Every capture
(url, fetched_at) is evaluated by the entries active at its fetch time: its host's suffixes and its
path's prefixes are the keys of an equi-join with the intervals, both cut into slabs of time, so the
as-of condition is only checked within a key's slab. The most specific pattern decides: a prefix before
a domain, then the longer one, a block before an allow, then the list's name.

A verdict depends on (url, fetched_at) only, so it is found once for each distinct pair and joined back;
a hot host is a skewed equi-join on the captures' side, whose intervals are few per slab.

Kinds: domain (host and all its subdomains), prefix (host and path up to a path segment).

Defined cases: a url that is null or has no scheme and host, or a null fetch time, has verdict none; hosts are
lower-cased, ports, user names, queries, fragments and closing slashes don't count; entries with a null
list, kind, pattern or time are left out; of entries of one list, pattern and time an add wins; repeated adds don't
start a new interval; a removal without an add does nothing; repeated captures keep their rows; extra
columns of the captures are kept, except those named as the result's, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)"
ADDED = ("host", "verdict", "list", "pattern", "since")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, verdict, since, until): when each pattern is active; until is null while it lasts."""
    e = entries.where("list IS NOT NULL AND kind IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL")
    e = e.groupBy("list", "kind", "pattern", "verdict", "at").agg(F.min("action").alias("action"))  # add before remove
    w = Window.partitionBy("list", "kind", "pattern", "verdict").orderBy("at")
    e = e.withColumn("was", F.lag("action", 1, "remove").over(w)).where("action <> was")
    return e.withColumn("until", F.lead("at").over(w)).where("action = 'add'").select("list", "kind", "pattern", "verdict", F.col("at").alias("since"), "until")


def judged(captures: DataFrame, entries: DataFrame, slab: int = 30 * 86_400) -> DataFrame:
    """captures(url, fetched_at, ...) with host, verdict (block, allow or none), and the deciding list, pattern and since."""
    base = captures.drop(*ADDED)
    fetches = base.select("url", "fetched_at").where("url IS NOT NULL AND fetched_at IS NOT NULL").distinct()
    host = F.lower(F.rtrim(F.regexp_extract("url", URL, 1), F.lit(".")))
    path = F.rtrim(F.regexp_extract("url", URL, 2), F.lit("/"))
    fetches = fetches.select("url", "fetched_at", host.alias("host"), path.alias("path")).where("host <> ''")
    label, part = F.split("host", r"\."), F.split(F.concat("host", "path"), "/")
    ends = lambda a, n: F.transform(F.sequence(F.lit(1), F.size(a)), n)
    domains = ends(label, lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(label, i, F.size(label)), ".").alias("pattern")))
    prefixes = ends(part, lambda i: F.struct(F.lit("prefix").alias("kind"), F.array_join(F.slice(part, 1, i), "/").alias("pattern")))
    keys = fetches.withColumn("k", F.explode(F.concat(domains, prefixes))).select("url", "fetched_at", "k.kind", "k.pattern", F.floor(F.col("fetched_at") / slab).alias("slab"))
    span = fetches.agg(F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last"))  # one row
    active = intervals(entries).crossJoin(F.broadcast(span)).where("since <= last AND (until IS NULL OR until > first)")
    begin, end = F.greatest("since", "first"), F.least(F.coalesce(F.col("until") - 1, F.col("last")), F.col("last"))
    active = active.withColumn("slab", F.explode(F.sequence(F.floor(begin / slab), F.floor(end / slab)))).drop("first", "last")
    hits = keys.join(active, ["kind", "pattern", "slab"]).where("since <= fetched_at AND (until IS NULL OR fetched_at < until)")
    order = F.struct(F.when(F.col("kind") == "prefix", 0).otherwise(1).alias("kind"), (-F.length("pattern")).alias("n"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("b"), "list", "pattern", "since", "verdict")
    best = hits.groupBy("url", "fetched_at").agg(F.min(order).alias("best")).select("url", "fetched_at", "best.list", "best.pattern", "best.since", "best.verdict")
    out = base.join(best, ["url", "fetched_at"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("none"))).withColumn("host", F.nullif(host, F.lit("")))
    return out.select(*base.columns, *ADDED)


def _captures(pages: DataFrame) -> DataFrame:
    """The pages have no fetch time: one in the first 90 days of 2024, from the id."""
    return pages.select("page_id", "url", (F.lit(1_704_067_200) + F.pmod(F.col("page_id") * 7919, F.lit(90 * 24)) * 3600).alias("fetched_at"))


def _entries(pages: DataFrame) -> DataFrame:
    """Dated lists over the pages' own hosts and first path parts, by the md5 of the host: no list is among the tables."""
    h = pages.select(F.lower(F.regexp_extract("url", URL, 1)).alias("h"), F.split_part(F.regexp_extract("url", URL, 2), F.lit("/"), F.lit(2)).alias("p")).where("h <> ''").distinct()
    k = F.conv(F.substring(F.md5("h"), 1, 4), 16, 10).cast("long")
    day = lambda n: F.lit(1_704_067_200) + (n) * 86_400
    row = lambda name, kind, pattern, verdict, action, at: F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), at.alias("at"))
    parent = F.substring_index("h", ".", -3)
    rows = F.array(
        F.when(k % 3 == 0, row("adult", "domain", F.col("h"), "block", "add", day(k % 20))),
        F.when(k % 3 == 0, row("adult", "domain", F.col("h"), "block", "remove", day(k % 20 + 30))),
        F.when(k % 6 == 0, row("adult", "domain", F.col("h"), "block", "add", day(k % 20 + 50))),
        F.when(k % 5 == 1, row("spam", "domain", parent, "block", "add", day(k % 40))),
        F.when(k % 4 == 1, row("trusted", "prefix", F.concat_ws("/", "h", "p"), "allow", "add", day(k % 10))),
        F.when(k % 8 == 1, row("trusted", "prefix", F.concat_ws("/", "h", "p"), "allow", "remove", day(k % 10 + 45))),
    )
    return h.select(F.explode(F.array_compact(rows)).alias("e")).select("e.*").distinct()


def op9_url_lists(spark, sf_dir: str) -> DataFrame:
    """Every page under the dated lists as of its fetch time."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(_captures(pages), _entries(pages))


ORACLE = r"""
WITH c AS (SELECT page_id, url, CAST(1704067200 + (page_id * 7919) % 2160 * 3600 AS BIGINT) AS fetched_at,
                  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)', 1)) AS host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)', 2) AS path FROM pages),
     h AS (SELECT DISTINCT host AS h, split_part(path, '/', 2) AS p, CAST(('0x' || md5(host)[1:4]) AS BIGINT) AS k, regexp_extract(host, '([^.]*\.)?([^.]*\.)?[^.]*$') AS parent FROM c WHERE host <> ''),
     e AS (SELECT 'adult' AS list, 'domain' AS kind, h AS pattern, 'block' AS verdict, 'add' AS action, 1704067200 + k % 20 * 86400 AS t FROM h WHERE k % 3 = 0
           UNION SELECT 'adult', 'domain', h, 'block', 'remove', 1704067200 + (k % 20 + 30) * 86400 FROM h WHERE k % 3 = 0
           UNION SELECT 'adult', 'domain', h, 'block', 'add', 1704067200 + (k % 20 + 50) * 86400 FROM h WHERE k % 6 = 0
           UNION SELECT 'spam', 'domain', parent, 'block', 'add', 1704067200 + k % 40 * 86400 FROM h WHERE k % 5 = 1
           UNION SELECT 'trusted', 'prefix', h || '/' || p, 'allow', 'add', 1704067200 + k % 10 * 86400 FROM h WHERE k % 4 = 1
           UNION SELECT 'trusted', 'prefix', h || '/' || p, 'allow', 'remove', 1704067200 + (k % 10 + 45) * 86400 FROM h WHERE k % 8 = 1),
     s AS (SELECT *, lag(action) OVER w AS was, lead(t) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY list, kind, pattern, verdict ORDER BY t)),
     f AS (SELECT * FROM s WHERE action IS DISTINCT FROM coalesce(was, 'remove')),
     i AS (SELECT list, kind, pattern, verdict, action, t AS since, lead(t) OVER (PARTITION BY list, kind, pattern, verdict ORDER BY t) AS until FROM f),
     j AS (SELECT c.page_id, i.list, i.pattern, i.verdict, i.since,
                  row_number() OVER (PARTITION BY c.page_id ORDER BY i.kind = 'domain', length(i.pattern) DESC, i.verdict = 'allow', i.list, i.pattern, i.since) AS r
           FROM c JOIN i ON action = 'add' AND since <= fetched_at AND (until IS NULL OR fetched_at < until)
            AND CASE kind WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern) ELSE rtrim(host || path, '/') = pattern OR starts_with(host || path, pattern || '/') END)
SELECT c.page_id, c.url, c.fetched_at, nullif(c.host, '') AS host, coalesce(j.verdict, 'none') AS verdict, j.list, j.pattern, CAST(j.since AS BIGINT) AS since
FROM c LEFT JOIN j ON j.page_id = c.page_id AND j.r = 1
"""
