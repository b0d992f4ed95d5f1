"""Hard negatives against a plain version: ties, repeated rows, hot vectors, several dimensions, huge components, many tiny shards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsight.llm import common, hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, score string, v int"


def plain(rows, every=5, positives=5, negatives=3):
    kept = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or not v or any(x is None or not math.isfinite(x) or not math.isfinite(256 * float(np.float32(x))) for x in v):
            continue
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, (a, label, v) in enumerate(kept):
        if a % every:
            continue
        score = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w, strict=True)))), b, other) for j, (b, other, w) in enumerate(kept) if j != i and len(w) == len(v)]
        for s, p, _ in sorted(x for x in score if x[2] == label)[:positives]:
            fits = sorted(x for x in score if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, every=5, **sizes):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)
    work = common.Scratch(spark, "t12")
    q = work.put("rows", hardneg.quantised(df))
    return sorted(tuple(r) for r in hardneg.mined(q, q.where(f"vec_id % {every} = 0"), **sizes).collect())


def vectors(g, n, dim, centres=3, spread=0.3):
    c = g.normal(size=(centres, dim))
    x = c[g.integers(0, centres, n)] + spread * g.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float).tolist()


def hostile():
    g = np.random.default_rng(5)
    rows = [(i, v, int(g.integers(0, 3))) for i, v in enumerate(vectors(g, 150, 6))]
    rows += rows[:12] + rows[:3]  # repeated rows, anchors among them
    rows += [(500 + i, rows[7][1], i % 4) for i in range(120)]  # a hot vector: ties
    rows += [(5, rows[9][1], 1), (1000, [0.0] * 6, 0), (1005, [0.0] * 6, 1)]
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2005, [], 1), (2010, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (2015, [float("nan")] * 6, 1), (2020, [float("inf")] * 6, 1), (2025, rows[0][1], None)]
    rows += [(3000 + i, v, i % 2) for i, v in enumerate(vectors(g, 25, 3))] + [(4000, [1.0], 0), (4005, [0.9], 0), (4006, [0.6], 1)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 8, "most_shards": 7, "sampled": 4, "block_rows": 3}])
def test_mined_is_brute_force(spark, sizes):
    rows = hostile()
    want = plain(rows)
    assert len(want) > 200
    assert mined(spark, rows, **sizes) == want


def test_huge_components(spark):
    g = np.random.default_rng(6)
    rows = [(i, [float(x) for x in g.choice([1e15, 3e17, 1e10, 1e30, 2.5, 0.25], 2)], i % 2) for i in range(60)]
    assert mined(spark, rows, shard_rows=8, sampled=4) == plain(rows)


def test_empty_and_single(spark):
    assert mined(spark, [(0, [1.0, 0.0], 1)]) == []
    df = spark.createDataFrame([], SCHEMA)
    work = common.Scratch(spark, "t12")
    q = work.put("rows", hardneg.quantised(df))
    assert hardneg.mined(q, q).count() == 0


def test_bounds_hold_and_prune():
    """No row scores beyond its leaf's bounds, rows are found by the way they were put, and near data leave most leaves unasked."""
    g = np.random.default_rng(7)
    v = np.floor(256 * np.array(vectors(g, 4000, 16, centres=40, spread=0.05)))
    m2 = float((v * v).sum(axis=1).max())
    tree = hardneg.Tree(hardneg.augmented(v, m2), 64)
    most, least = tree.reach(v[:50], m2)
    s = v[:50] @ v.T
    for k, rows in enumerate(tree.leaves):
        assert (s[:, rows] <= most[:, [k]]).all() and (s[:, rows] >= least[:, [k]]).all()
    leaf, _ = tree.route(hardneg.augmented(v, m2))
    assert all((leaf[rows] == k).all() for k, rows in enumerate(tree.leaves))
    fifth = -np.sort(-s, axis=1)[:, 5]
    assert (most >= fifth[:, None]).mean() < 0.4


def test_only_needed_copies_are_indexed(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(1000)] + [(2000 + i, [0.5, 0.5], 0) for i in range(10)]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).withColumn("label", F.col("label"))
    work = common.Scratch(spark, "t12")
    q = work.put("rows", hardneg.quantised(df))
    assert hardneg.Index(q, work, 6).points.count() == 6 * 3
