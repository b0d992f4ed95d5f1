r"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed by SHA-256. The ledger is an append-only table of
(blob, rules scanned, findings); a run scans each unseen (blob, rule version) pair once, whatever number
of paths or versions share the blob, appends what it found, and joins findings back to all paths.

A rule's matches are found leftmost first without overlap: the text is split at the pattern and the
lengths of pieces and matches are summed, which gives offsets in code points.

Defined cases: a null text is the empty blob; rows that repeat a path stay rows of their own; a null path
is kept; matches whose value is too short are dropped after matching, so they still hide what they cover;
extra columns of the versions are kept unless they are named blob or findings, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_dir


@dataclass(frozen=True)
class Rule:
    """pattern: its group `value` is the secret itself, of `least` characters or more; needle: a literal that every match holds.

    A pattern must not scan a run of characters again from every place in it: runs without a bounded
    start are anchored by what may not stand before them.
    """

    kind: str
    version: int
    pattern: str
    value: int = 0
    least: int = 1
    needle: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The patterns of the kinds, in the order in which spans list them.
ASSIGN_REST = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", 1, r"(?i:(password|passwd|secret|token|api_?key))" + ASSIGN_REST, value=2, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", needle="AKIA"),  # the 20 characters or more of AKIA[A-Z0-9]+
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # the 24 or more of [0-9a-f]+
)
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
RULES = (
    *BASE,
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needle="PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needle="gh"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", needle="xox"),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])" + JWT, needle="eyJ"),  # anchored: once a run
)
FINDING = "array<struct<start:int,ord:int,kind:string,end:int,secret:int>>"


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _hits(text: Column, rule: Rule, ord_: int, todo: Column | None) -> Column:
    """Null where the rule has no match or isn't due, else its pieces, matches and values."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.value)), F.char_length) if rule.value else F.transform(found, F.char_length)
    hit = text.rlike(rule.pattern)
    if rule.needle:
        hit = F.contains(text, F.lit(rule.needle)) & hit
    if todo is not None:
        hit = F.array_contains(todo, rule.key) & hit
    gap = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    return F.when(hit, F.struct(F.lit(ord_).alias("ord"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), F.arrays_zip(gap.alias("gap"), F.transform(found, F.char_length).alias("found"), value.alias("value")).alias("parts")))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans the unseen pairs of versions(text) and appends one batch to the ledger; gives the ledger's findings(blob, findings) under these rules."""
    spark = versions.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = versions.select(blob(F.col("text")).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*(F.lit(r.key) for r in rules))
    old = _read(spark, ledger)
    if old is None:
        blobs, todo = blobs.withColumn("todo", every), None
    else:
        seen = old.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
        todo = F.col("todo")
    hits = F.array_compact(F.array(*(_hits(F.col("text"), r, i, todo) for i, r in enumerate(rules))))
    rows = blobs.select("blob", "todo", F.explode_outer(hits).alias("hit"))
    rows = rows.select("blob", "todo", "hit.ord", "hit.kind", "hit.least", F.posexplode_outer("hit.parts").alias("pos", "part"))
    found = F.coalesce("part.found", F.lit(0))
    end = F.sum(F.col("part.gap") + found).over(Window.partitionBy("blob", "ord").orderBy("pos"))
    rows = rows.select("*", end.cast("int").alias("end")).where(F.col("part.found").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    keep = F.when(F.col("part.value") >= F.col("least"), F.struct((F.col("end") - F.col("part.found")).alias("start"), "ord", "kind", "end", (F.col("end") - F.col("part.value")).alias("secret")))
    batch = rows.groupBy("blob").agg(F.first("todo").alias("rules"), F.sort_array(F.collect_list(keep)).cast(FINDING).alias("findings"))
    batch.write.mode("append").parquet(ledger)
    kinds = {r.kind: r.version for r in rules}
    now = _read(spark, ledger).where(F.arrays_overlap("rules", every))
    now = now.select("blob", "rules", F.filter("findings", lambda f: f["kind"].isin(*kinds)).alias("findings"))
    due = F.filter("findings", lambda f: F.exists(F.col("rules"), lambda r: F.array_contains(every, r) & (F.substring_index(r, "@", 1) == f["kind"])))
    return now.where(F.size("findings") > 0).select("blob", due.alias("findings")).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("findings"))).alias("findings")).where(F.size("findings") > 0)


def _read(spark, ledger: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(f"blob binary, rules array<string>, findings {FINDING}").parquet(ledger) if there else None


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of versions with its blob and the findings of that blob (an empty array, if none).

    Only blobs with findings are joined; a hot blob is a skewed equi-join, which AQE splits.
    """
    found = scan(versions, ledger, rules)
    rows = versions.drop("blob", "findings").withColumn("blob", blob(F.col("text")))
    return rows.join(found, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FINDING)))


def redacted(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, mask: str = "[REDACTED]") -> DataFrame:
    """versions with each secret's value replaced by the mask; overlapping values become one mask. Texts without secrets stay as they are."""
    rows = versions.select(F.struct(*versions.columns).alias("row"), "text")
    f = findings(rows, ledger, rules)
    spans = F.array_sort(F.transform("findings", lambda x: F.struct(x["secret"].alias("a"), x["end"].alias("b"))))
    upto = lambda i: F.coalesce(F.array_max(F.transform(F.slice("spans", F.lit(1), i), lambda x: x["b"])), F.lit(0))
    part = lambda x, i: F.when(x["a"] >= upto(i), F.concat(F.col("text").substr(upto(i) + 1, x["a"] - upto(i)), F.lit(mask))).otherwise(F.lit(""))
    tail = F.expr("substring(text, array_max(transform(spans, s -> s.b)) + 1)")
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("spans", part), ""), tail)).otherwise(F.col("text"))
    done = f.withColumn("spans", spans).select("row", text.alias("text"))
    return done.select(*((F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in versions.columns))


def _joined(f: Column) -> Column:
    return F.array_join(F.transform(f, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def history(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text): the documents have no history, so each gets an older version of its first line."""
    older = F.struct(F.lit(1).alias("version"), F.substring_index("text", "\n", 1).alias("text"))
    now = F.struct(F.lit(2).alias("version"), F.col("text").alias("text"))
    return docs.select("doc_id", F.explode(F.array(older, now)).alias("v")).select("doc_id", "v.version", "v.text")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """The findings of every document's latest version; a first run scans the older versions, the second what it hasn't seen."""
    versions, ledger = history(spark.read.parquet(f"{sf_dir}/documents.parquet")), new_dir(spark, "ledger")
    scan(versions.where("version = 1"), ledger)
    rows = findings(versions, ledger).where("version = 2")
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda x: x["ord"] < len(BASE))
    return rows.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))


def _oracle() -> str:
    words = ("password", "passwd", "secret", "token", "api_?key")
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)
    parts = []
    for i, r in enumerate(RULES):
        text, value, lead = "text", r.value, 0
        p = f"({either})" + ASSIGN_REST if r.kind == "assign" else r.pattern
        if r.kind == "jwt":  # DuckDB's patterns can't look back: the character before is part of the match
            text, p, value, lead = "(' ' || text)", f"[^A-Za-z0-9_-]({JWT})", 1, 1
        p = p.replace("'", "''")
        parts.append(f"SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, {r.least} AS least, {lead} AS lead, string_split_regex({text}, '{p}') AS gaps, regexp_extract_all({text}, '{p}') AS found, regexp_extract_all({text}, '{p}', {value}) AS vals FROM t")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     r AS ({' UNION ALL '.join(parts)}),
     u AS (SELECT doc_id, ord, kind, least, lead, generate_subscripts(gaps, 1) AS pos, unnest(gaps) AS gap, unnest(list_append(found, NULL)) AS hit, unnest(list_append(vals, NULL)) AS val FROM r WHERE len(found) > 0),
     w AS (SELECT *, CAST(sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, ord ORDER BY pos) AS INTEGER) AS stop FROM u),
     f AS (SELECT doc_id, ord, kind, stop - length(hit) AS start, stop - lead AS stop FROM w WHERE hit IS NOT NULL AND length(val) >= least),
     g AS (SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
                  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE ord < {len(BASE)}) AS base,
                  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle()
