"""Benchmark decontamination by greedy string tiling.

1. Seeds: every run of `least` words of every benchmark item, and of every text; an item of fewer words
   is one seed. A text's seeds are looked up in a filter of fixed size over the items' seeds; only texts
   with hits go on. Equal texts and equal items are compared once.
2. A leak shares a least number of an item's seeds, so among all but so many of them one is shared: each
   item is joined with the texts by its rarest seeds only, as many as that bound leaves.
3. Pairs that share as many seeds as the threshold forces are tiled: running Karp-Rabin finds the matches
   of the current search length between words that are not yet marked, the longest are marked first, and
   the search length falls to `least`. Tiles don't overlap, in either text, and may stand in any order,
   so that reordered passages count.
4. A pair is a leak if the tiles cover `share` hundredths of the item's words or more.

Words are runs of letters and digits, lower-cased; punctuation and line ends don't matter.

Defined cases: null and empty texts and items take no part; items of fewer than `shortest` words aren't
looked for (by default `least`; such an item leaks where all its words stand in a row); rows that repeat
doc_id and text, or item_id and text, count once; rows that share an id but not the text are compared
each by itself, with a row for each leak; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import Scratch

BITS = 22
TILE = pa.struct([("item_at", pa.int32()), ("text_at", pa.int32()), ("words", pa.int32())])


def hashed_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order)."""
    column = pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string()))
    for first, rows, data, off in shingles.text_slices(column):
        h, at, _, _ = shingles.words(data, off, shingles.PLAIN)
        for i in range(rows):
            yield first + i, h[at[i] : at[i + 1]]


def _windows(h: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of n unmarked words, and their Karp-Rabin hashes."""
    if len(h) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[n:] == taken[:-n])
    base = np.full(len(h) + 1, 0x9E3779B97F4A7C15, np.uint64)
    base[0] = 1
    power = np.cumprod(base, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)])
    return at, (sums[at + n] - sums[at]) * power[len(h) - at]


def tiling(item: np.ndarray, text: np.ndarray, least: int, first: int = 32) -> list[tuple[int, int, int]]:
    """Greedy string tiles (start in item, start in text, words) of at least `least` words, longest first."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    search = max(least, min(first, len(item)))
    aligned = len(item) - len(text)  # hashes carry the power of their distance to the text's end
    scale = np.uint64(pow(0x9E3779B97F4A7C15, abs(aligned), 2**64))
    while True:
        at_t, h_t = _windows(text, free_t, search)
        at_i, h_i = _windows(item, free_i, search)
        if aligned > 0:
            h_t = h_t * scale
        else:
            h_i = h_i * scale
        hit = np.isin(h_t, h_i)
        places: dict[int, list[int]] = {}
        for j, h in zip(at_t[hit].tolist(), h_t[hit].tolist(), strict=True):
            places.setdefault(h, []).append(j)
        matches, longest = [], 0
        for i, h in zip(at_i.tolist(), h_i.tolist(), strict=True):
            for j in places.get(h, ()):
                if i and j and free_i[i - 1] and free_t[j - 1] and item[i - 1] == text[j - 1]:
                    continue  # inside a longer match
                n = 0
                while i + n < len(item) and j + n < len(text) and free_i[i + n] and free_t[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n >= search:
                    matches.append((n, i, j))
                    longest = max(longest, n)
        if longest > 2 * search:
            search = longest
            continue
        for n, i, j in matches:
            if n == longest and free_i[i : i + n].all() and free_t[j : j + n].all():
                free_i[i : i + n] = free_t[j : j + n] = False
                tiles.append((i, j, n))
        if matches:
            continue  # the next longest, of which the marks may have cut some
        if search == least:
            return tiles
        search = max(least, search // 2)


def _probe(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (s >> np.uint64(64 - BITS)).astype(np.int64), (s & np.uint64((1 << BITS) - 1)).astype(np.int64)


def text_key(text: Column) -> Column:
    """What names a text."""
    return F.sha2(text, 256)


def item_seeds(items: DataFrame, least: int, shortest: int) -> DataFrame:
    """(item, words, run, seed, times) of the items(item, item_text) of at least `shortest` words; run: words of a seed."""
    names = ["item", "words", "run", "seed", "times"]

    def task(batches):
        for b in batches:
            keys = b.column("item").to_pylist()
            for i, h in hashed_words(b.column("item_text")):
                if len(h) >= max(shortest, 1):
                    run = min(least, len(h))
                    seed, times = np.unique(shingles.shingle_hashes(h, run), return_counts=True)
                    k = len(seed)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i]] * k, pa.string()), pa.array(np.full(k, len(h), np.int32)), pa.array(np.full(k, run, np.int32)), pa.array(seed.view(np.int64)), pa.array(times.astype(np.int32))], names=names)

    return items.select("item", "item_text").mapInArrow(task, "item string, words int, run int, seed long, times int")


def fewest_seeds(words: int, run: int, share: int) -> int:
    """Seeds (with repetition) that tiles of at least `run` words which cover an item hold at least."""
    return -(-share * words // (100 * run))


def rarest(seeds: DataFrame, hits: DataFrame, share: int) -> DataFrame:
    """(seed, item): of each item its rarest seeds among the hits, all but as many as a leak can do without."""
    count = hits.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("df"))
    w = Window.partitionBy("item").orderBy("df", "seed")
    before = F.sum("times").over(w) - F.col("times")
    ranked = seeds.join(count, "seed", "left").select("seed", "item", "words", "run", before.alias("before"), "df")
    needed = F.expr(f"ceil({share} * words / (100 * run))")
    return ranked.where(F.col("df").isNotNull() & (F.col("before") < F.col("words") - F.col("run") + 1 - needed + 1)).select("seed", "item")


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps of 2**BITS places over the seeds: of fixed size, whatever the benchmark's."""

    def task(batches):
        maps = np.zeros((2, 1 << BITS), bool)
        for b in batches:
            for m, at in zip(maps, _probe(b.column("seed").to_numpy().view(np.uint64)), strict=True):
                m[at] = True
        for k, m in enumerate(maps):
            at = np.flatnonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32))], names=["k", "at"])

    at = seeds.select("seed").mapInArrow(task, "k int, at int").distinct().toArrow()
    k, at = at.column("k").to_numpy(), at.column("at").to_numpy()
    maps = np.zeros((2, 1 << BITS), bool)
    maps[k, at] = True
    return maps[0], maps[1]


def matched(docs: DataFrame, items: DataFrame, least: int, share: int, shortest: int) -> tuple[DataFrame, DataFrame]:
    """(key, item, covered, item_words, tiles) of every pair of different texts that is a leak, and (doc_id, key) of the texts with hits; docs(doc_id, text), items(item, item_text)."""
    spark = docs.sparkSession
    work = Scratch(spark, "decontam")
    items = work.put("items", items.where("item IS NOT NULL").dropDuplicates(["item"]))
    seeds = work.put("seeds", item_seeds(items, least, shortest))
    runs = sorted(r.run for r in seeds.select("run").distinct().collect())  # least of them at most
    maps = spark.sparkContext.broadcast(seed_filter(seeds))

    def found(batches):
        high, low = maps.value
        for b in batches:
            rows, hits = [], []
            for i, h in hashed_words(b.column("text")):
                s = np.concatenate([shingles.shingle_hashes(h, run) for run in runs]) if runs else np.empty(0, np.uint64)
                a, c = _probe(s)
                hit = high[a] & low[c]
                if hit.any():
                    rows.append(i)
                    hits.append(np.unique(s[hit]))
            off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in hits])]).astype(np.int32))
            flat = pa.array((np.concatenate(hits) if hits else np.empty(0, np.uint64)).view(np.int64))
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("text"), pa.ListArray.from_arrays(off, flat)], names=["doc_id", "text", "seeds"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = work.put("hits", texts.mapInArrow(found, "doc_id long, text string, seeds array<long>").withColumn("key", text_key(F.col("text"))))
    once = hits.select("key", "text", "seeds").dropDuplicates(["key"])
    pairs = once.select("key", F.explode("seeds").alias("seed")).join(rarest(seeds, hits, share), "seed").select("key", "item").distinct()
    pairs = once.select("key", "text").join(pairs, "key").join(items, "item")

    def tiled(batches):
        for b in batches:
            items_, texts_ = (dict(hashed_words(b.column(c))) for c in ("item_text", "text"))
            rows = []
            for i, (key, item) in enumerate(zip(b.column("key").to_pylist(), b.column("item").to_pylist(), strict=True)):
                x, y = items_[i], texts_[i]
                run = min(least, len(x))
                if np.isin(shingles.shingle_hashes(x, run), shingles.shingle_hashes(y, run)).sum() < fewest_seeds(len(x), run, share):
                    continue
                t = tiling(x, y, run)
                covered = sum(n for _, _, n in t)
                if 100 * covered >= share * len(x):
                    rows.append({"key": key, "item": item, "covered": covered, "item_words": len(x), "tiles": [dict(zip(("item_at", "text_at", "words"), v, strict=True)) for v in t]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("item", pa.string()), ("covered", pa.int32()), ("item_words", pa.int32()), ("tiles", pa.list_(TILE))]))

    schema = "key string, item string, covered int, item_words int, tiles array<struct<item_at:int,text_at:int,words:int>>"
    found_pairs = work.put("pairs", pairs.select("key", "item", "text", "item_text").mapInArrow(tiled, schema))
    ids = work.put("ids", hits.select("doc_id", "key").join(found_pairs.select("key").distinct(), "key", "left_semi").distinct())
    work.keep("pairs", "ids")
    return found_pairs, ids


def _items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), text_key(F.col("text")).alias("item"), F.col("text").alias("item_text"))


def leaks(docs: DataFrame, items: DataFrame, least: int = 5, share: int = 80, shortest: int = 5) -> DataFrame:
    """(doc_id, item_id, covered, item_words, tiles): a row for each pair of a text of docs(doc_id, text) and an item of items(item_id, text) that it leaks."""
    named = _items(items)
    pairs, ids = matched(docs, named.select("item", "item_text"), least, share, shortest)
    rows = pairs.join(ids, "key").join(named.select("item_id", "item").distinct(), "item")
    return rows.select("doc_id", "item_id", "covered", "item_words", "tiles")


def leaking_texts(docs: DataFrame, items: DataFrame, least: int = 5, share: int = 80, shortest: int = 5) -> DataFrame:
    """(key): the text_key of every text that leaks an item."""
    return matched(docs, _items(items).select("item", "item_text"), least, share, shortest)[0].select("key").distinct()


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """The leaking pairs only: documents that are not in the result are clean."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, items).withColumn("n_tiles", F.size("tiles")).drop("tiles")
