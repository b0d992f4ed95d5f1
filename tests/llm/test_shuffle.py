"""What the n-gram join shuffles of rows that no pair needs."""

import numpy as np
import pyarrow as pa
import pytest

from hindsight.llm import jaccard
from hindsight.llm.common import Scratch, likely


def shuffled(spark) -> int:
    """Bytes that stages have written for shuffles so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def no_small_tables(spark):
    """Tables of pairs are too large to be broadcast, as at size."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_likely_keeps_all_keys_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("id AS k", "cast(id AS string) AS other")
    keys = spark.range(0, 20_000, 100).selectExpr("id AS k")
    found = {r.k for r in likely(rows, keys, "k", 200).collect()}
    assert {*range(0, 20_000, 100)} <= found and len(found) < 3000
    assert likely(rows, keys.where("k < 0"), "k", 0).count() == 0
    assert {r.k for r in likely(rows, keys, "k", 1, room=1).collect()} >= {*range(0, 20_000, 100)}


def test_prefixes_of_members_without_pairs_are_not_shuffled(spark, no_small_tables):
    rng, n = np.random.default_rng(5), 4000
    lists = lambda kind, size: pa.array([*rng.integers(0, 2**31 - 1, (n, size)).astype(kind)], pa.list_(pa.from_numpy_dtype(kind)))
    light, other = lists(np.int64, 100), lists(np.int32, 100)
    members = spark.createDataFrame(pa.table({"node": pa.array(range(n)), "size": pa.array([900] * n, pa.int32()), "light": light, "dense": pa.array([[]] * n, pa.list_(pa.int64())), "second": other, "third": other}))
    work = Scratch(spark, "test")
    members = work.put("members", members.unionByName(members.where("node < 40").withColumn("node", members.node + n)))
    pairs = spark.range(40).selectExpr("id AS a", f"id + {n} AS b").unionByName(spark.range(40).selectExpr("id AS a", "id + 100 AS b"))
    before = shuffled(spark)
    kept = jaccard._filtered(pairs, members, 90, work, "kept")
    moved = shuffled(spark) - before
    assert sorted(map(tuple, kept.collect())) == [(i, i + n) for i in range(40)]
    assert moved < 1_500_000  # the prefixes of all members take about 6 MB
