"""Sources and parsers: table scans, JSON lines, CSV, nested JSON, XML, and web pages as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.catalog import query
from .roles import OBS, observations, table


@query("s2_filtered_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate IS NOT NULL ORDER BY o_orderkey")
def s2(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O' AND o_orderdate IS NOT NULL").select("o_orderkey", "o_custkey").orderBy("o_orderkey")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """A directory of JSON lines. strict: a bad line fails the scan; else bad lines come back whole in `_bad`."""
    reader = spark.read.schema(schema)
    if strict:
        return reader.option("mode", "FAILFAST").json(path)
    full = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*full.fields, T.StructField("_bad", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def csv_rows(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A CSV with a header whose columns are found by alias lists (case and punctuation ignored); absent ones are null."""
    raw = spark.read.option("header", True).csv(path)
    have = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in raw.columns}
    pick = lambda names: next((F.col(f"`{have[n]}`") for n in names if n in have), F.lit(None).cast("string"))
    return raw.select(*(pick(names).alias(c) for c, names in aliases.items()))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def deterministic_sides(a: Column, b: Column) -> Column:
    """Side A is the lexically smaller name, never the winner."""
    return F.struct(F.least(F.lower(a), F.lower(b)).alias("a"), F.greatest(F.lower(a), F.lower(b)).alias("b"))


@query("s6_side_assignment", "SELECT p_partkey, least(lower(p_name), lower(p_brand)) AS a, greatest(lower(p_name), lower(p_brand)) AS b FROM part")
def s6(spark, sf):
    return table(spark, sf, "part").select("p_partkey", deterministic_sides(F.col("p_name"), F.col("p_brand")).alias("s")).select("p_partkey", "s.*")


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """(line, row, error): JSON lines(line, value) parsed leniently; error holds what isn't an object of the schema, and row is null then."""
    read = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return lines.select("line", "value", read.alias("r")).select("line", F.when(~bad, F.col("r").dropFields("_bad")).alias("row"), F.when(bad, F.col("value")).alias("error"))


@query("s4_error_ledger", """WITH l AS (SELECT event_id AS line, CASE WHEN event_id % 11 = 0 THEN substr(props, 1, length(props) - 1) WHEN event_id % 13 = 0 THEN 'k: 1' ELSE props END AS value, event_id % 11 = 0 OR event_id % 13 = 0 AS bad, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
SELECT line, CASE WHEN NOT bad THEN k END AS k, CASE WHEN bad THEN value END AS error FROM l""")
def s4(spark, sf):
    """Lines of which some are cut off or no JSON: the rows, and the ledger of errors."""
    i = F.col("event_id")
    value = F.when(i % 11 == 0, F.expr("substr(props, 1, length(props) - 1)")).when(i % 13 == 0, "k: 1").otherwise(F.col("props"))
    return parsed_lines(table(spark, sf, "events").select(i.alias("line"), value.alias("value")), "k bigint").select("line", "row.k", "error")


@query("s7_nested_json", """WITH l AS (SELECT l_orderkey AS id, CASE l_linenumber WHEN 1 THEN 'A' ELSE 'B' END AS side, l_partkey AS competitor, l_quantity, l_tax FROM lineitem WHERE l_linenumber <= 2)
SELECT id, side, competitor, unnest(['quantity', 'tax']) AS stat, unnest([l_quantity, l_tax]) AS value FROM l""")
def s7(spark, sf):
    """A nested payload: events hold competitions, these competitors with a side, these statistics. The documents are written from order lines, then parsed."""
    li = table(spark, sf, "lineitem").where("l_linenumber <= 2")
    stats = F.array(F.struct(F.lit("quantity").alias("name"), F.col("l_quantity").alias("value")), F.struct(F.lit("tax").alias("name"), F.col("l_tax").alias("value")))
    side = F.when(F.col("l_linenumber") == 1, "home").otherwise("away")
    doc = F.struct(F.col("l_orderkey").alias("id"), F.array(F.struct(F.collect_list(F.struct(F.col("l_partkey").alias("id"), side.alias("homeAway"), stats.alias("statistics"))).alias("competitors"))).alias("competitions"))
    docs = li.groupBy("l_orderkey").agg(F.to_json(doc).alias("doc"))
    return competitor_stats(docs)


def competitor_stats(docs: DataFrame) -> DataFrame:
    """(id, side, competitor, stat, value) of docs(doc): one row for each statistic of each competitor."""
    d = F.from_json("doc", "id bigint, competitions array<struct<competitors:array<struct<id:bigint,homeAway:string,statistics:array<struct<name:string,value:double>>>>>>")
    x = docs.select(d.alias("d")).select("d.id", F.explode("d.competitions").alias("c")).select("id", F.explode("c.competitors").alias("k"))
    side = F.when(F.col("k.homeAway") == "home", "A").otherwise("B")
    return x.select("id", side.alias("side"), F.col("k.id").alias("competitor"), F.explode("k.statistics").alias("s")).select("id", "side", "competitor", F.col("s.name").alias("stat"), F.col("s.value").alias("value"))


def endpoints_to_stats(doc: Column) -> Column:
    """Nested endpoints as an array of (stat, value), stat being endpoint.key; keys without a value are left out."""
    ends = F.map_entries(F.from_json(doc, "map<string,map<string,string>>"))
    rows = F.flatten(F.transform(ends, lambda e: F.transform(F.map_entries(e["value"]), lambda kv: F.struct(F.concat_ws(".", e["key"], kv["key"]).alias("stat"), kv["value"].alias("value")))))
    return F.filter(rows, lambda r: r["value"].isNotNull())


@query("s8_json_to_eav", "SELECT s_suppkey, unnest(['profile.name', 'profile.nation', 'account.balance']) AS stat, unnest([s_name, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_nationkey AS VARCHAR) END, CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR)]) AS value FROM supplier QUALIFY value IS NOT NULL".replace("SELECT s_suppkey, unnest", "SELECT * FROM (SELECT s_suppkey, unnest", 1).replace(" FROM supplier QUALIFY value IS NOT NULL", " FROM supplier) WHERE value IS NOT NULL"))
def s8(spark, sf):
    nation = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey").cast("string"))
    doc = F.to_json(F.struct(F.struct(F.col("s_name").alias("name"), nation.alias("nation")).alias("profile"), F.struct(F.round("s_acctbal").cast("bigint").cast("string").alias("balance")).alias("account")))
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(endpoints_to_stats(doc)).alias("r")).select("s_suppkey", "r.*")


def resolved(doc: Column, relation: str, attribute: str) -> Column:
    """The attribute of the included resource that a JSON:API document's relation names by type and id; null without one."""
    ref = "struct<data:struct<type:string,id:string>>"
    d = F.from_json(doc, f"data struct<id:string,relationships:struct<{relation}:{ref}>>, included array<struct<type:string,id:string,attributes:map<string,string>>>")
    want = d["data"]["relationships"][relation]["data"]
    hit = F.filter(d["included"], lambda r: (r["type"] == want["type"]) & (r["id"] == want["id"]))
    return F.get(hit, F.lit(0))["attributes"][attribute]


@query("s9_included_lookup", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN c_name END AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def s9(spark, sf):
    """Documents with a related customer, resolved among resources of which some share its id, and some documents lack it."""
    x = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    key = F.col("o_custkey").cast("string")
    resource = lambda kind, name: F.struct(F.lit(kind).alias("type"), key.alias("id"), F.create_map(F.lit("name"), name).alias("attributes"))
    decoy = resource("supplier", F.lit("someone else"))
    included = F.when(F.col("o_orderkey") % 5 != 0, F.array(decoy, resource("customer", F.col("c_name")))).otherwise(F.array(decoy))
    link = F.struct(F.struct(F.struct(F.lit("customer").alias("type"), key.alias("id")).alias("data")).alias("buyer"))
    doc = F.to_json(F.struct(F.struct(F.col("o_orderkey").cast("string").alias("id"), link.alias("relationships")).alias("data"), included.alias("included")))
    return x.select("o_orderkey", resolved(doc, "buyer", "name").alias("name"))


@query("s11_page_title", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def s11(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


def event_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, html): the pages with what event pages have and these lack: JSON-LD scripts (some broken or of other types), a publication tag, labels and numbers."""
    i = F.col("page_id")
    n = i.cast("string")
    kind = F.when(i % 4 == 0, "Organization").otherwise("SportsEvent")
    start = F.concat(F.lit("2024-02-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("T18:30:00Z"))
    doc = F.concat(F.lit('{"@type": "'), kind, F.lit('", "name": "Game '), n, F.lit('", "startDate": "'), start, F.lit('", "location": {"name": "Hall '), n, F.lit('"}, "homeTeam": {"name": "H'), n, F.lit('"}, "awayTeam": {"name": "A'), n, F.lit('"}'), F.when(i % 9 == 0, "").otherwise("}"))
    clock = F.when(i % 3 == 0, "").otherwise("T09:15:00Z")
    meta = F.concat(F.lit('<meta property="article:published_time" content="2024-01-'), F.lpad((i % 28 + 1).cast("string"), 2, "0"), clock, F.lit('">'))
    facts = F.concat(F.lit("<dl><dt>Attendance</dt><dd> "), (i * 37 % 5000).cast("string"), F.lit(" people</dd><dt>Score</dt><dd>"), (i % 5).cast("string"), F.lit(" - "), (i % 3).cast("string"), F.lit("</dd></dl>"))
    extra = F.concat(F.lit('<script type="application/ld+json">'), doc, F.lit("</script>"), meta, facts)
    return table(spark, sf, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), extra).alias("html"))


def json_ld(html: Column) -> Column:
    """The bodies of a page's JSON-LD scripts."""
    return F.regexp_extract_all(html, F.lit(r'(?s)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))


def json_ld_event(doc: Column) -> Column:
    """Name, start, venue and teams of a JSON-LD sports event; null where it isn't one."""
    d = F.from_json(doc, "`@type` string, name string, startDate string, location struct<name:string>, homeTeam struct<name:string>, awayTeam struct<name:string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(F.contains(d["@type"], F.lit("Event")) & d["_bad"].isNull(), F.struct(d["name"].alias("name"), d["startDate"].alias("start"), d["location"]["name"].alias("venue"), d["homeTeam"]["name"].alias("home"), d["awayTeam"]["name"].alias("away")))


@query("s12_json_ld_event", """SELECT page_id, 'Game ' || page_id AS name, '2024-02-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T18:30:00Z' AS start, 'Hall ' || page_id AS venue, 'H' || page_id AS home, 'A' || page_id AS away FROM pages WHERE page_id % 4 <> 0 AND page_id % 9 <> 0""")
def s12(spark, sf):
    """Sports events of the pages' JSON-LD; scripts of other types or that don't parse give none."""
    p = event_pages(spark, sf).select("page_id", F.explode(json_ld(F.col("html"))).alias("doc"))
    return p.select("page_id", json_ld_event(F.col("doc")).alias("e")).where("e IS NOT NULL").select("page_id", "e.*")


def text_lines(html: Column) -> Column:
    """A page's text as non-empty trimmed lines, without scripts and styles."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", "\n")
    return F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")


@query("s13_text_lines", r"SELECT page_id, len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '<[^>]+>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS n_lines FROM pages")
def s13(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(text_lines(F.col("html"))).cast("long").alias("n_lines"))


def label_value(lines: Column, label: str) -> Column:
    """The line after the first that equals the label, ignoring case."""
    return F.get(lines, F.array_position(F.transform(lines, F.lower), label.lower()).cast("int"))


def nearest_number(lines: Column, label: str) -> Column:
    """The first number at or after the line that holds the label, ignoring case."""
    after = F.slice(lines, F.greatest(F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lit(label.lower()))), True), F.lit(1)).cast("int"), F.size(lines))
    number = F.regexp_extract(F.array_join(after, " "), r"-?\d+(?:\.\d+)?", 0)
    return F.when(F.exists(lines, lambda x: F.contains(F.lower(x), F.lit(label.lower()))), F.nullif(number, F.lit("")).cast("double"))


@query("s13_label_numbers", "SELECT page_id, CAST(page_id * 37 % 5000 AS DOUBLE) AS attendance, page_id % 5 || ' - ' || page_id % 3 AS score FROM pages")
def s13_labels(spark, sf):
    """A number beside its label, and the value after another, from the pages' text."""
    lines = text_lines(F.col("html"))
    return event_pages(spark, sf).select("page_id", nearest_number(lines, "attendance").alias("attendance"), label_value(lines, "score").alias("score"))


def publication_time(html: Column) -> Column:
    """datePublished or a published_time meta tag, only if it holds a clock time."""
    raw = F.coalesce(*(F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (r'"datePublished"\s*:\s*"([^"]+)"', r'<meta[^>]+published_time"[^>]+content="([^"]+)"')))
    return F.when(raw.rlike(r"T\d\d:\d\d"), F.try_to_timestamp(raw))


@query("s15_publication_time", "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN epoch_us(TIMESTAMP '2024-01-01 09:15:00') // 1000000 + page_id % 28 * 86400 END AS seconds FROM pages")
def s15(spark, sf):
    """When a page was published, in seconds; a date without a clock time isn't a time."""
    return event_pages(spark, sf).select("page_id", F.unix_seconds(publication_time(F.col("html"))).alias("seconds"))


def epoch_seconds(x: Column) -> Column:
    """Numbers above 1e10 are milliseconds."""
    return F.when(x > 10_000_000_000, F.floor(x / 1000)).otherwise(x)


@query("s16_epoch_units", f"WITH {OBS} SELECT event_id, t // 1000000 AS seconds FROM obs")
def s16(spark, sf):
    x = F.when(F.col("event_id") % 2 == 0, F.floor(F.col("t") / 1000)).otherwise(F.floor(F.col("t") / 1_000_000))
    return observations(spark, sf).select("event_id", epoch_seconds(x).alias("seconds"))


@query("s27_payload_status", f"WITH {OBS} SELECT event_id, pid, CASE WHEN c_name IS NULL THEN 'UNKNOWN_AUTHOR' WHEN avail - t <= 3600000000 THEN 'ELIGIBLE' ELSE 'LATE' END AS status FROM obs LEFT JOIN customer ON c_custkey = pid AND c_acctbal > 0")
def s27(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("pid"), "c_name")
    status = F.when(F.col("c_name").isNull(), "UNKNOWN_AUTHOR").when(F.col("avail") - F.col("t") <= 3_600_000_000, "ELIGIBLE").otherwise("LATE")
    return observations(spark, sf).join(c, "pid", "left").select("event_id", "pid", status.alias("status"))


def links(html: Column) -> Column:
    """The targets of a page's links, without query and fragment."""
    return F.transform(F.regexp_extract_all(html, F.lit(r'<a\s+href="([^"]*)"'), F.lit(1)), lambda u: F.regexp_extract(u, r"^[^?#]*", 0))


@query("s28_link_extraction", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS u FROM pages) SELECT page_id, regexp_extract(u, '^[^?#]*') AS link, count(*) AS n FROM l WHERE regexp_matches(regexp_extract(u, '^[^?#]*'), '^/[A-Za-z]{3,}$') GROUP BY 1, 2""")
def s28(spark, sf):
    """Links of pages that match a path pattern."""
    p = table(spark, sf, "pages").select("page_id", F.explode(links(F.col("html"))).alias("link"))
    return p.where(F.col("link").rlike("^/[A-Za-z]{3,}$")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("s29_page_status", r"SELECT page_id, CASE WHEN regexp_matches(html, '\b\d+\s*[-:]\s*\d+\b') AND contains(html, 'final') THEN 'FINAL' WHEN length(html) < 3000 THEN 'STUB' ELSE 'OPEN' END AS status FROM pages")
def s29(spark, sf):
    """A page is final only if it shows a score."""
    s = F.when(F.col("html").rlike(r"\b\d+\s*[-:]\s*\d+\b") & F.contains("html", F.lit("final")), "FINAL").when(F.length("html") < 3000, "STUB").otherwise("OPEN")
    return table(spark, sf, "pages").select("page_id", s.alias("status"))


@query("ident_stable_ids", "SELECT o_orderkey, substring(sha256(o_custkey || '|' || coalesce(nullif(o_orderstatus, 'P'), '') || '|' || o_orderpriority), 1, 32) AS id FROM orders")
def ident(spark, sf):
    """Identities: 32 hex digits of the hash of the parts, null as empty."""
    return table(spark, sf, "orders").select("o_orderkey", stable_id(F.col("o_custkey"), F.nullif("o_orderstatus", F.lit("P")), F.col("o_orderpriority")).alias("id"))


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)
