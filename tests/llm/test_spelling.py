"""Spelling variants against a plain version: hostile words, hot segments, null and repeated rows, chains of forms."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsight.llm import common, spelling


def near(x, y):
    """Whether two words differ by exactly one code point."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain(rows, typo, least_points=6, least_n=5, times=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_points and c >= least_n}
    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(around[w]), n[form[w]] if form[w] else -1) for w in n)


def found(rows):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in rows.collect())


def test_crc32_of_many_pieces():
    g = np.random.default_rng(3)
    data = g.integers(0, 256, 5000).astype(np.uint8)
    a, n = g.integers(0, 4900, 300), g.integers(0, 90, 300)
    state = g.integers(0, 2**32, 300).astype(np.uint32)
    want = [zlib.crc32(data[i : i + k].tobytes(), int(s)) for i, k, s in zip(a, n, state, strict=True)]
    assert spelling.crc32(state, data, a, n).tolist() == want


TEXTS = [
    (None, "Colour colour colour color"),
    (1, None),
    (2, ""),
    (3, "12 ;; \n"),
    (4, "straße STRASSE straßen Straßen ÄÖÜäöüß× ÷ÿÀÀÀÀ " * 6),
    (4, "straße STRASSE straßen Straßen ÄÖÜäöüß× ÷ÿÀÀÀÀ " * 6),
    (5, "colour " * 40 + "colours " * 6 + "color1color " * 7 + "x" * 30_000 + " colovr" * 5 + "日本colour語 " * 3),
    (6, ("a" * 300 + " ") * 5 + ("a" * 299 + " ") * 30 + ("a" * 150 + "b" + "a" * 149 + " ") * 6),
    (7, "chains " * 5 + "chainss " * 25 + "chainsss " * 125 + "chainssss " * 625 + "achains " * 25),
    (8, " ".join(f"prefix{a}{b}" for a in "abcdefgh" for b in "abcdefgh") + " "),
]


@pytest.mark.parametrize("typo", [0, 7, 199])
def test_variants_are_brute_force(spark, typo):
    rows = TEXTS + [(100 + i, TEXTS[-1][1] * (1 + i)) for i in range(4)]
    docs = spark.createDataFrame([(i, t, "n", "word") for i, t in rows], "doc_id int, text string, n string, word string")
    for most in (4096, 2):
        assert found(spelling.variants(docs, typo=typo, most=most)) == plain(rows, typo)
    assert spelling.variants(docs.limit(0), typo=typo).count() == 0


def test_every_place_of_an_edit(spark):
    """Each insertion, deletion and replacement of a word is near it, at every place, and no other pair."""
    words = {"abcdefg", "aaaaaaa", "abababab"}
    for w in list(words):
        for i in range(len(w) + 1):
            words |= {w[:i] + "é" + w[i:], w[:i] + "é" + w[i + 1 :], w[:i] + w[i + 1 :]}
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = {frozenset((x, y)) for x in words for y in words if near(x, y)}
    for most in (1, 50, 10**6):
        got = [frozenset((r.x, r.y)) for r in spelling.near_pairs(df, common.Scratch(spark, "t13"), most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_hot_segment_makes_no_square(spark):
    """Words that share a half are cut on until a group is small; what is compared stays near the number of words."""
    words = [f"commonprefix{a}{b}{c}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" for c in "abcdefghijklmnop"]
    work = common.Scratch(spark, "t13")
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), work, most=1000)
    assert got.count() == len(words) * 45 // 2
    compared = sum(spark.read.parquet(f"{work.path}/{n}").count() for n in work.names if n.startswith("pairs"))
    assert compared < 60 * len(words)


def test_counts_don_t_depend_on_slices(spark):
    text = "Zürich zürich wandern Wandern " * 50_000
    docs = spark.createDataFrame([(1, text), (2, text[:-9])], "doc_id long, text string").repartition(2)
    got = {r.word: r.n for r in spelling.vocabulary(docs.withColumn("n", F.lit(1))).collect()}
    assert got == {"zürich": 200_000, "wandern": 199_999}
