"""The multi-index Hamming join: its guarantee on signatures, and classes against a plain version."""

import random

import numpy as np
import pytest

from hindsight.llm import common, hamming

from .test_operators import brute_groups


def test_reach_is_the_tail_of_the_binomial():
    g = np.random.default_rng(1)
    for codes, share, miss in ((64, 85, 0.01), (128, 80, 0.05), (32, 90, 0.002)):
        t = hamming.reach(codes, share, miss)
        apart = g.binomial(codes, 1 - share / 100, 400_000)
        assert (apart > t).mean() <= miss * 1.15 and (apart > t - 1).mean() > miss * 0.85
    assert hamming.reach(128, 85, 1e-9) == 47


@pytest.mark.parametrize("codes,distance", [(128, 47), (64, 20), (10, 3), (16, 0), (9, 1)])
def test_pairs_within_the_distance_share_a_key(codes, distance):
    """Whatever the places of the errors: spread evenly over the chunks, in one heap, or at random."""
    g = np.random.default_rng(2)
    parts = hamming.chunks(codes, distance)
    assert [i for p in parts for i in p] == list(range(codes))
    x = g.integers(0, 2**16, codes).astype(np.uint16)
    even = [p[i] for i in range(codes) for p in parts if i < len(p)]
    for order in (even, list(range(codes)), *(g.permutation(codes) for _ in range(200))):
        y = x.copy()
        y[order[:distance]] ^= 1
        a, b = hamming.keys(np.stack([x, y]), parts)
        assert (a == b).any()


def test_codes_differ_as_the_sets_do():
    """Pairs of sets of a known similarity: the share of equal codes is that similarity, for small and large sets."""
    g, hashes = np.random.default_rng(3), hamming.Hashes(128)
    for size in (8, 60, 9000):
        same = []
        for _ in range(150):
            s = g.integers(0, 2**59, size + size // 4).astype(np.uint64)
            a, b = s[:size], s[size // 4 :]
            same.append((hashes.signature(a) == hashes.signature(b)).mean())
        similar = (size - size // 4) / (size + size // 4)
        assert np.mean(same) == pytest.approx(similar, abs=0.012)
        assert np.std(same) < 1.35 * (similar * (1 - similar) / 128) ** 0.5


def copies(seed=4):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()) + str(r.randrange(300))
    rows = [(None, None), (1, ""), (2, "one two"), (3, "ONE\ttwo"), (4, "one"), (None, "one two"), (5, " \n")]
    for size in (5, 7, 9, 11, 40, 120):
        base = [word() for _ in range(size)]
        for i in range(12):
            w = list(base)
            for _ in range(i % 4 * max(1, size // 60)):
                w[r.randrange(len(w))] = word()
            rows.append((r.randrange(10, 10_000), " ".join(w)))
    passage = [word() for _ in range(60)]
    rows += [(20_000 + i, " ".join([*passage, *(word() for _ in range(3 + i))])) for i in range(25)]
    crowd = [word() for _ in range(90)]
    for i in range(60):  # near copies in a large group, each with some words of its own, and chains between them
        w = list(crowd)
        for k in range(i % 5):
            w[(17 * i + 23 * k) % 90] = f"own{i // 2}x{k}"
        rows.append((30_000 + i, " ".join(w)))
    return rows + rows[8:12]


@pytest.mark.parametrize("small", [1000, 4])
def test_classes_are_brute_force(spark, small):
    rows = copies()
    df = spark.createDataFrame([(i, t, "n", 1, "s") for i, t in rows], "doc_id int, text string, node string, size int, signature string")
    got = hamming.near_duplicates(df, small=small).collect()
    ids = lambda x: -1 if x is None else x
    assert sorted((ids(x.doc_id), x.n_shingles, ids(x.component_id)) for x in got) == brute_groups(rows, 5, 85)
    assert all(x.kept == (ids(x.doc_id) == ids(x.component_id)) for x in got)
    assert hamming.near_duplicates(df.limit(0)).count() == 0


def test_sift_goes_by_distance(spark):
    g = np.random.default_rng(5)
    x = g.integers(0, 2**16, 32).astype("<u2")
    far = [x.copy() for _ in range(20)]
    for k, y in enumerate(far):
        y[:k] ^= 7
    nodes = spark.createDataFrame([(100, bytearray(x.tobytes())), *((k, bytearray(y.tobytes())) for k, y in enumerate(far))], "node long, signature binary")
    pairs = spark.createDataFrame([(k, 100) for k in range(20)], "a long, b long")
    kept = hamming._within(nodes, 32, 6, common.Scratch(spark, "t11"))(pairs, "kept")
    assert sorted(r.a for r in kept.collect()) == list(range(7))
