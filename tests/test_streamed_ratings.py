"""Streams against the batch operators: ratings with head-of-line admission over restarts, and gates by versioned cutoffs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hindsight.operators.sequential import elo
from hindsight.sources.roles import matches
from hindsight.streaming import streams

SF = "/root/testdata/sf0.001"
DAY = 86_400_000_000


def drained(q):
    try:
        q.processAllAvailable()
    finally:
        q.stop()


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, old)


def test_ratings_of_a_stream_are_those_of_the_batch(rocksdb, tmp_path):
    """Three runs from one checkpoint, rows out of order within the watermark, results that hold others back."""
    spark, src, out = rocksdb, str(tmp_path / "in"), str(tmp_path / "out")
    m = matches(spark, SF).where("sport IN ('click', 'view')")
    m = m.withColumn("avail", F.when(F.col("match_id") % 7 == 0, F.col("avail") + 3 * DAY).otherwise(F.col("avail")))  # held back for days
    want = {(r.sport, r.match_id): (round(r.elo_a, 6), round(r.elo_b, 6)) for r in elo(m, ["sport"]).collect()}
    first, last = m.agg(F.min("t"), F.max("t")).first()
    rows = m.select("match_id", "sport", "a", "b", "outcome", F.timestamp_micros("t").alias("ts"), F.timestamp_micros("avail").alias("avail"), "t").orderBy("t")
    cuts = [first, first + (last - first) // 3, first + 2 * (last - first) // 3, last + 1]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = rows.where((F.col("t") >= a) & (F.col("t") < b)).drop("t")
        part.orderBy(F.desc("ts")).coalesce(1).write.mode("append").parquet(src)
        q = streams.streamed_ratings(streams.match_stream(spark, src, files=1)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(out)
        drained(q)
    end = dt.datetime(2030, 1, 1)
    flush = spark.createDataFrame([(-1, "end", 1, 2, "DRAW", end, end)], streams.MATCH)
    flush.coalesce(1).write.mode("append").parquet(src)
    drained(streams.streamed_ratings(streams.match_stream(spark, src, files=1)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(out))
    got = [(r.sport, r.match_id, round(r.elo_a, 6), round(r.elo_b, 6)) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(want) == len({g[:2] for g in got})
    assert {g[:2]: g[2:] for g in got} == want and len({v for v in want.values()}) > 20


def test_gated_pairs_are_those_of_the_batch(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    obs = [(i, i % 3, at(i), at(i + (i % 5) * 4)) for i in range(60)]
    cut = [(100 + i, i % 3, v, at(10 * i + 12), at(10 * i + 11 - 6 * v)) for i in range(5) for v in range(1 + i % 3)]
    o = spark.createDataFrame(obs, "event_id long, pid long, ts timestamp, known timestamp")
    c = spark.createDataFrame(cut, "target_id long, pid long, version long, start timestamp, cutoff timestamp")
    for name, df, order in (("o", o, "ts"), ("c", c, "start")):
        df.orderBy(order).coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    drained(streams.gated_pairs(read("o", o), read("c", c), reach="2 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out")))
    pairs = spark.read.parquet(str(tmp_path / "out"))
    want = {(t, v, e): max(ts, known) <= cutoff for t, p, v, start, cutoff in cut for e, q, ts, known in obs if p == q and start - dt.timedelta(days=2) <= ts < start}
    assert {(r.target_id, r.version, r.event_id): r.allowed for r in pairs.collect()} == want and set(want.values()) == {True, False}
    newest = {t: max(x[2] for x in cut if x[0] == t) for t, *_ in cut}
    assert {(r.target_id, r.event_id) for r in streams.in_force(pairs).collect()} == {(t, e) for (t, v, e), ok in want.items() if ok and v == newest[t]}
