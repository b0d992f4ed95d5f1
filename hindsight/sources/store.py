"""Stores of several tables whose versions change by one rename, their merge, and holdouts that stay frozen.

Tables are written first, each under a new name; then a manifest that names them is renamed to the next
version's name, which fails if that is taken. So a writer that dies leaves the version before, and of two
writers one is told that it came second.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has committed the version."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_once(spark: SparkSession, path: str, text: str) -> None:
    """Makes a small file appear whole, or raises Conflict if there is one of that name."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    draft, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    target, _ = _fs(spark, path)
    how = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(target), how)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(target):
            raise Conflict(path) from e
        raise


class Store:
    """Tables by name in a folder; `version` is the one that was current when it was opened, 0 before the first."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.version = self._last() if version is None else version
        self.tables: dict[str, str] = json.loads("".join(r.value for r in spark.read.text(self._manifest(self.version)).collect())) if self.version else {}

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest-{version:08d}.json"

    def _last(self) -> int:
        p, fs = _fs(self.spark, self.root)
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.tables[name]}")

    def commit(self, changed: Mapping[str, DataFrame]) -> Store:
        """Writes the changed tables and makes them, with all others as they are, the next version."""
        tables = dict(self.tables)
        for name, df in changed.items():
            tables[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{tables[name]}")
        commit_once(self.spark, self._manifest(self.version + 1), json.dumps(tables, sort_keys=True))
        return Store(self.spark, self.root, self.version + 1)


def merged(versions: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """One table of several of the same key, the later ones over the earlier: a row takes each column from the last table that has the column and the key, nulls included, and keys of any table stay.

    Of rows of one table that share a key the smallest counts; a key with a null matches none, and its rows
    stay as they are. A column must have one type everywhere.
    """
    types: dict[str, str] = {}
    for c, t in (x for df in versions for x in df.dtypes):
        if types.setdefault(c, t) != t:
            raise ValueError(f"column {c} is {types[c]} and {t}")
    rest = [c for c in types if c not in key]
    whole = " AND ".join(f"`{c}` IS NOT NULL" for c in key)
    rows, odd = None, None
    for i, df in enumerate(versions):
        own = [c for c in rest if c in df.columns]
        one = df.where(whole).groupBy(*key).agg(F.min(F.struct(F.lit(0).alias("_"), *own)).alias("r"))
        one = one.select(*key, *((F.struct(F.lit(i).alias("i"), F.col("r")[c].alias("v")) if c in own else F.lit(None).cast(f"struct<i:int,v:{types[c]}>")).alias(c) for c in rest))
        loose = df.where(f"NOT ({whole})").select(*key, *((F.col(c) if c in own else F.lit(None).cast(types[c])).alias(c) for c in rest))
        rows, odd = (one, loose) if rows is None else (rows.unionByName(one), odd.unionByName(loose))
    out = rows.groupBy(*key).agg(*(F.max_by(c, F.col(c)["i"])["v"].alias(c) for c in rest)) if rest else rows.distinct()
    return out.unionByName(odd)


def merge_stores(target: Store, sources: Sequence[Store], keys: Mapping[str, Sequence[str]]) -> Store:
    """Merges the sources' tables over the target's, in order, and commits them all as one version; tables without a key in `keys` are left alone."""
    changed = {}
    for name, key in keys.items():
        held = [s.read(name) for s in (target, *sources) if name in s.tables]
        held = [df for df in held if set(key) <= set(df.columns)]
        if held:
            changed[name] = merged(held, key)
    return target.commit(changed)


def freeze(store: Store, rows: DataFrame, share: float = 0.78, least: int = 120, least_holdout: int = 30) -> Store:
    """Freezes the holdout of each sport of rows(sport, match_id, seq) that has none yet: its rows after `share`, if there are `least` rows and `least_holdout` of those; what is frozen never changes."""
    n = rows.groupBy("sport").agg(F.count("*").alias("n"))
    cut = F.floor(F.col("n") * share)
    new = rows.join(n.where((F.col("n") >= least) & (F.col("n") - cut >= least_holdout)), "sport").where(F.col("seq") > cut).select("sport", "match_id", F.col("n").alias("rows_at_freeze"))
    if "holdout" in store.tables:
        old = store.read("holdout")
        new = new.join(old.select("sport").distinct(), "sport", "left_anti")
        if new.isEmpty():
            return store
        new = old.unionByName(new)
    return store.commit({"holdout": new})


def frozen_status(store: Store, rows: DataFrame) -> DataFrame:
    """(sport, status, frozen, missing): OK, INVALID if frozen ids are gone from rows(sport, match_id), or DEFERRED where nothing is frozen yet."""
    sports = rows.select("sport").distinct()
    if "holdout" not in store.tables:
        return sports.select("sport", F.lit("DEFERRED").alias("status"), F.lit(0).cast("long").alias("frozen"), F.lit(0).cast("long").alias("missing"))
    here = rows.select("sport", "match_id", F.lit(1).alias("here")).distinct()
    g = store.read("holdout").join(here, ["sport", "match_id"], "left").groupBy("sport").agg(F.count("*").alias("frozen"), F.count_if(F.col("here").isNull()).alias("missing"))
    out = sports.join(g, "sport", "full").select("sport", F.coalesce("frozen", F.lit(0)).alias("frozen"), F.coalesce("missing", F.lit(0)).alias("missing"))
    return out.select("sport", F.when(F.col("frozen") == 0, "DEFERRED").when(F.col("missing") > 0, "INVALID").otherwise("OK").alias("status"), "frozen", "missing")


def with_holdout(store: Store, rows: DataFrame) -> DataFrame:
    """rows with `holdout`, of sports that have a frozen one; raises if frozen ids are gone."""
    gone = frozen_status(store, rows).where("status = 'INVALID'").orderBy("sport").limit(5).collect()
    if gone:
        raise ValueError("frozen holdout rows are gone: " + ", ".join(f"{r.sport} ({r.missing} of {r.frozen})" for r in gone))
    held = store.read("holdout").select("sport", "match_id", F.lit(True).alias("holdout"))
    known = held.select("sport").distinct()
    return rows.join(known, "sport", "left_semi").join(held, ["sport", "match_id"], "left").withColumn("holdout", F.coalesce("holdout", F.lit(False)))
