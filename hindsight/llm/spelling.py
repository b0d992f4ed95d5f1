r"""Groups of spelling variants: words one edit apart, found by an even-partition pigeonhole join.

1. Runs of letters are cut and counted on the Arrow buffers of whole texts; tasks pass on partial counts
   of distinct words, which Spark sums.
2. A word of l code points is cut into two even segments. If another word differs from it by one
   inserted, deleted or replaced code point, the edit spares one of the two. So the segments are indexed
   under l, and a word of l or l + 1 code points probes the index with its substrings at the same place,
   or one further on behind the edit.
3. What a segment that many words share leaves open is cut in two again, as the edit is in the rest: the
   pairs of a group are only made once the group is small, or the rest is one code point, of which there
   are as many as the alphabet has letters. No group is cut short.
4. Candidates are met once and verified by their edit distance.
5. A word's form is its most frequent near word, if that is frequent enough; roots follow the forms by
   pointer jumping, in as many rounds as the logarithm of the longest chain.

Defined cases: a null text has no words, a null doc_id is the empty text in the hash of a run; repeated
rows count again; ties go to the word that is first in code-point order; extra columns are ignored; an
empty table gives no rows. Groups are keyed by a 64-bit hash; what shares one by chance fails step 4.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import Scratch, counted, drop_dir, new_dir
from .words import KEPT, ragged

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
#: The first of the two UTF-8 bytes of U+00C0 to U+00FF, and of no other character.
_LEAD = 0xC3
#: Longer runs are counted one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def crc32(state: np.ndarray, data: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """zlib.crc32(data[a : a + n], state) of many pieces at once, byte by byte over all pieces that are long enough."""
    order = np.argsort(-n, kind="stable")
    at, left, c = a[order], -n[order], ~state[order]
    for k in range(int(n.max(initial=0))):
        m = int(np.searchsorted(left, -k))  # pieces of more than k bytes
        c[:m] = CRC[(c[:m] ^ data[at[:m] + k]) & 255] ^ (c[:m] >> 8)
    out = np.empty_like(c)
    out[order] = ~c
    return out


def runs(data: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes, code points) of the maximal runs of letters of at least `least` code points."""
    lead = data == _LEAD
    inner = _LETTER[data] | lead
    inner[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start, stop = inner.copy(), inner.copy()
    start[1:] &= ~inner[:-1] | edge[1:-1]
    stop[:-1] &= ~inner[1:] | edge[1:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    two = np.concatenate([[0], np.cumsum(lead)])
    points = b - a - (two[b] - two[a])
    keep = points >= least
    return a[keep], (b - a)[keep], points[keep]


def _dropped(word: str, at: int) -> str:
    return word[:at] + word[at + 1 :]


def counted_words(data: np.ndarray, off: np.ndarray, ids: list, least: int, typo: int) -> tuple[pa.Array, np.ndarray]:
    """The words of some rows and how often they occur; a word may come in several parts of its count.

    Of a run whose hash with its row's id `typo` divides, one code point is left out.
    """
    a, n, points = runs(data, off, least)
    data = shingles.WORDS.fold[data]
    state = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    state = state[np.searchsorted(off, a, "right") - 1]
    h, short = np.zeros(len(a), np.uint32), n <= LONG
    h[short] = crc32(state[short], data, a[short], n[short])
    odd: Counter[str] = Counter()
    for i in np.flatnonzero(~short).tolist():
        h[i] = zlib.crc32(data[a[i] : a[i] + n[i]].tobytes(), int(state[i]))
    hit = h % typo == 0 if typo else np.zeros(len(h), bool)
    for i in np.flatnonzero(hit | (n > KEPT)).tolist():
        word = data[a[i] : a[i] + n[i]].tobytes().decode()
        if hit[i]:
            word = _dropped(word, int(h[i]) % len(word))
        if len(word) >= least:
            odd[word] += 1
    rest = np.flatnonzero(~hit & (n <= KEPT))
    a, n, x = a[rest], n[rest], shingles.lanes(data)
    key = [shingles.lane(x, a + k, n - k) for k in range(0, KEPT, 8)]  # letters are never zero bytes: these are the whole word
    mixed = key[0]
    for i, k in enumerate(key[1:]):
        mixed = shingles.mix(mixed, i) ^ k
    order = np.argsort(mixed, kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
    first = np.flatnonzero(new)
    times, one = np.diff(np.append(first, len(order))), order[first]
    off = np.concatenate([[0], np.cumsum(n[one])]).astype(np.int32)
    common = pa.StringArray.from_buffers(len(one), pa.py_buffer(off), pa.py_buffer(data[ragged(a[one], n[one])]))
    return pa.concat_arrays([common, pa.array(list(odd), pa.string())]), np.concatenate([times, np.fromiter(odd.values(), np.int64, len(odd))])


def vocabulary(docs: DataFrame, least_points: int = 6, least_n: int = 5, typo: int = 0, held: int = 400_000) -> DataFrame:
    """(word, n) of the words of at least least_points code points that occur at least least_n times in docs(doc_id, text).

    typo: the divisor of the hash by which runs lose a code point (0: none). held: rows of counts that a task sums before it passes them on.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def summed():
            t = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            return t.combine_chunks()

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for first, rows, data, off in shingles.text_slices(b.column("text")):
                word, n = counted_words(data, off, ids[first : first + rows], least_points, typo)
                parts.append(pa.table({"word": word, "n": pa.array(n, pa.int64())}))
                size += len(word)
                if size >= held:
                    parts = [summed()]
                    size = parts[0].num_rows
                    if size >= held // 2:
                        yield from parts[0].to_batches(max_chunksize=10_000)
                        parts, size = [], 0
        if parts:
            yield from summed().to_batches(max_chunksize=10_000)

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _split(rows: DataFrame) -> DataFrame:
    """Cuts the open part [a, b) of each word in two: either half may hold the edit. Places are those of the shorter word, of l code points; d is 1 for a word that has one more in its open part."""
    mid = F.col("a") + F.floor((F.col("b") - F.col("a")) / 2).cast("int")
    half = F.explode(F.array(F.struct(mid.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), mid.alias("b"))))
    rows = rows.select("word", "l", "d", half.alias("open")).select("word", "l", "d", "open.a", "open.b")
    head = F.expr("substring(word, 1, a)")
    tail = F.expr("substring(word, b + d + 1)")
    return rows.withColumn("g", F.xxhash64("l", "a", "b", head, tail))


def near_pairs(words: DataFrame, work: Scratch, most: int = 4096) -> DataFrame:
    """The pairs (x, y) of words(word) that differ by exactly one code point, each once, a written table; groups that would make more than `most` candidates are cut further."""
    n = F.char_length("word")
    sides = F.explode(F.array(F.struct(n.alias("l"), F.lit(0).alias("d")), F.struct((n - 1).alias("l"), F.lit(1).alias("d"))))
    rows = words.select("word", sides.alias("s")).select("word", "s.l", "s.d", F.lit(0).alias("a"), F.col("s.l").alias("b")).where("l > 0")
    level, found = 0, []
    while True:
        rows = work.put(f"segments{level}", _split(rows))
        sizes = rows.groupBy("g").agg(F.count_if(F.col("d") == 0).alias("n0"), F.count("*").alias("n")).where("n0 > 0 AND n > 1")
        rows = rows.join(sizes.withColumn("most", F.col("n0") * F.col("n")).select("g", "most"), "g")
        small = (F.col("most") <= most) | (F.col("b") - F.col("a") <= 1)
        left, right = (rows.where(small).select("g", F.col("word").alias(c), F.col("d").alias(f"d_{c}")) for c in "xy")
        found.append(work.put(f"pairs{level}", left.where("d_x = 0").join(right, "g").where("d_y = 1 OR x < y").select("x", "y")))
        rows, left_over = counted(rows.where(~small).select("word", "l", "d", "a", "b"), f"{work.path}/open{level}")
        work.names.add(f"open{level}")
        if not left_over:
            break
        level += 1
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return work.put("near", pairs.distinct().where(F.levenshtein("x", "y", 1) == 1))


def rooted(forms: DataFrame, work: Scratch) -> DataFrame:
    """(word, root): the end of each chain of forms(word, form), which has no cycles; words without a form aren't listed."""
    chain, step, moved = work.put("chain0", forms.select("word", F.col("form").alias("root"))), 0, 1
    while moved:
        step += 1
        up = chain.select(F.col("word").alias("root"), F.col("root").alias("above"))
        next_ = chain.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        next_, moved = counted(next_, f"{work.path}/chain{step}", "moved")
        work.names.add(f"chain{step}")
        work.drop(f"chain{step - 1}")
        chain = next_.select("word", "root")
    return chain


def variants(docs: DataFrame, least_points: int = 6, least_n: int = 5, times: int = 5, typo: int = 0, most: int = 4096) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs(doc_id, text); times: how much more often than a word its form occurs at least."""
    work = Scratch(docs.sparkSession, "spelling")
    words = work.put("words", vocabulary(docs, least_points, least_n, typo))
    near = near_pairs(words, work, most)
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y")))
    other: Column = F.struct((-F.col("n")).alias("rank"), F.col("y").alias("word"))
    best = both.join(words.withColumnRenamed("word", "y"), "y").groupBy(F.col("x").alias("word")).agg(F.count("*").alias("n_near"), F.min(other).alias("best"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    fits = -F.col("best.rank") >= times * F.col("n")
    rows = work.put("forms", rows.select("word", F.when(fits, F.col("best.word")).alias("form"), "n", "n_near", F.when(fits, -F.col("best.rank")).alias("form_n")))
    roots = rooted(rows.where("form IS NOT NULL"), work)
    out = rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = work.put("variants", out)
    work.keep("variants")
    return out


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), typo=199)


#: The table of crc32 comes from its polynomial; a run's bytes are those of code points below U+0100 in UTF-8.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) t(i)
                        UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
     crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE step = 8),
     r AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents),
     c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY 1, 2),
     b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
                                                 lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)) AS bytes FROM c),
     h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) AS h FROM b, crc),
     d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
     w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
     del AS (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM w, unnest(range(1, length(word) + 1)) t(i)),
     pairs AS (SELECT a.word AS x, b.word AS y FROM del a JOIN del b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
               UNION SELECT del.word, w.word FROM del JOIN w ON del.less = w.word
               UNION SELECT w.word, del.word FROM del JOIN w ON del.less = w.word),
     best AS (SELECT x, y, m.n AS m, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY m.n DESC, y) AS rank FROM pairs JOIN w m ON m.word = y),
     f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.y END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n
           FROM w LEFT JOIN best b ON b.x = w.word AND b.rank = 1),
     chain AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
     last AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY 1)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
"""
