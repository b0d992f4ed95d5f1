"""Sinks: a daily ledger that grows by unknown ids, reports written only on change, and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_daily(rows: DataFrame, path: str, key: str, day: str) -> int:
    """Appends the rows whose key the ledger at path lacks, one folder a day; gives how many. Of rows that share a key the first day's counts, of one day the first by their contents; null is a key like others.

    An id is known whatever day it comes under. The ledger's own key column, the only one that is read, is
    the index of its ids, so there is none to repair; a batch that is written again adds nothing.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c != key]
    new = rows.groupBy(key).agg(F.min(F.struct(day, *(c for c in rest if c != day))).alias("r")).select(key, "r.*")
    if _there(spark, path):
        old = spark.read.schema(rows.schema).parquet(path).select(F.col(key).alias("_known")).distinct()
        new = new.join(old, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.repartition(day).write.mode("append").partitionBy(day).parquet(path)
    finally:
        new.unpersist()
    return n


class ConflictingRows(Exception):
    """A key came again with other contents."""


def first_write(batch: DataFrame, path: str, key: list[str], number: int) -> None:
    """A micro-batch's sink in which the first write of a key wins: rows that are known alike are skipped, and one that differs from what is known, in the table or in the batch, fails the batch. Batch `number` replaces itself if it comes again."""
    spark, rest = batch.sparkSession, [c for c in batch.columns if c not in key]
    content = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    one = batch.withColumn("_c", content).groupBy(*key).agg(F.min(F.struct("_c", *rest)).alias("r"), F.min("_c").alias("lo"), F.max("_c").alias("hi"))
    same = lambda a, b: F.expr(" AND ".join(f"{a}.`{k}` <=> {b}.`{k}`" for k in key))
    if _there(spark, path):
        known = spark.read.parquet(path).where(F.col("batch") != number).select(*key, content.alias("known"))
        one = one.alias("n").join(known.alias("o"), same("n", "o"), "left").select("n.*", "known")
    else:
        one = one.withColumn("known", F.lit(None).cast("string"))
    bad = one.where("lo <> hi OR lo <> known").select(F.to_json(F.struct(*key))).limit(3).collect()
    if bad:
        raise ConflictingRows(", ".join(r[0] for r in bad))
    one.where("known IS NULL").select(*key, *(f"r.{c}" for c in rest)).write.mode("overwrite").parquet(f"{path}/batch={number}")


def content_print(rows: DataFrame, volatile: tuple[str, ...] = ()) -> str:
    """A fingerprint of a table's rows, whatever their order, without its volatile columns."""
    kept = [c for c in sorted(rows.columns) if c not in volatile]
    h = F.sha2(F.to_json(F.struct(*kept)), 256)
    part = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("decimal(38,0)")
    r = rows.agg(F.count("*").alias("n"), *(F.sum(part(i)).alias(f"p{i}") for i in (1, 9, 17, 25))).first()
    return ":".join(str(v or 0) for v in r)


def write_if_changed(rows: DataFrame, path: str, volatile: tuple[str, ...] = ()) -> bool:
    """Writes a report as the next version under path unless the last one holds the same but for volatile columns; gives whether it wrote.

    A version counts only once the writer's success marker is there, so readers never meet half a report.
    """
    spark = rows.sparkSession
    found = latest(spark, path)
    if found is not None and content_print(found, volatile) == content_print(rows, volatile):
        return False
    rows.write.parquet(f"{path}/v{len(versions(spark, path)):08d}")
    return True


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole versions under path, in order."""
    if not _there(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in names if _there(spark, f"{path}/{n}/_SUCCESS"))


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    names = versions(spark, path)
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def save_state(states: DataFrame, path: str) -> None:
    """Appends states(sport, scope, at, cursor, completed) to the log of checkpoints."""
    states.select("sport", "scope", "at", "cursor", "completed").write.mode("append").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each (sport, scope); of one time the furthest cursor."""
    log = spark.read.schema("sport string, scope string, at long, cursor string, completed boolean").parquet(path)
    return log.groupBy("sport", "scope").agg(F.max(F.struct("at", "cursor", "completed")).alias("s")).select("sport", "scope", "s.*")
