r"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

1. A set of word shingles gets `codes` min-hashes, each cut to b = 16 bits. Two sets of Jaccard similarity
   J differ in a code with a probability of at most 1 - J, so `reach` is the distance that a link exceeds
   with a probability of at most `miss`. Texts of one set are one node.
2. Signatures are split into (reach + 1) / 2 chunks. Of two signatures within the distance, at least one
   chunk differs in at most one code (pigeonhole); the allowed errors of a chunk are enumerated by leaving
   out each of its codes in turn. So every pair within the distance shares a key: (chunk, code left out,
   hash of the others).
3. Keys are counted first, and only those that several nodes have make groups; a group's pivot is its
   smallest node, found by a map-side combined aggregate. Groups are joined as in the n-gram Jaccard join:
   each node with the pivot, then small groups pairwise, then what is still larger by the differences to a
   pivot (see that module). No group or partner is capped.
4. Candidates must be within the distance by their whole signatures; links are confirmed on whole sets.

The join finds all pairs under the signature distance; a link of exactly the least similarity is missed
with a probability of `miss`, and more similar ones with far less. Sets so small that only an equal set
can be similar enough need no keys.

Defined cases: a text that is null or has no words has an empty set and links with nothing; of fewer than
n words the whole sequence is the set's one token; rows that repeat a text link with each other; a null
doc_id takes part, and a component's id is the smallest id known, null if there is none; such a row is
kept if its component has no id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, shingles
from .common import Scratch, frugal, partitions

BLOCK = 4096


def reach(codes: int, share: int, miss: float) -> int:
    """The least distance that the signatures of two sets of similarity share/100 exceed with a probability of at most `miss`."""
    p, above = 1 - share / 100, 0.0
    for k in range(codes, -1, -1):
        above += math.comb(codes, k) * p**k * (1 - p) ** (codes - k)
        if above > miss:
            return k
    return 0


def chunks(codes: int, distance: int) -> list[range]:
    """Even chunks of which two signatures within the distance have one with at most one difference."""
    m = (distance + 2) // 2
    ends = [codes * i // m for i in range(m + 1)]
    return [range(a, b) for a, b in zip(ends, ends[1:], strict=False)]


class Hashes:
    """As many hash functions of tokens, and their codes."""

    def __init__(self, codes: int):
        seed = shingles.mix(np.arange(codes, dtype=np.uint64), 40)
        self.flip, self.times = (seed >> np.uint64(32)).astype(np.uint32), seed.astype(np.uint32) | np.uint32(1)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """The b-bit min-hashes of a non-empty set of tokens."""
        x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
        low = np.full(len(self.times), 2**32 - 1, np.uint32)
        for i in range(0, len(x), BLOCK):
            np.minimum(low, ((x[None, i : i + BLOCK] ^ self.flip[:, None]) * self.times[:, None]).min(axis=1), out=low)
        return (shingles.mix(low.astype(np.uint64), 41) >> np.uint64(48)).astype("<u2")


def keys(signatures: np.ndarray, parts: list[range]) -> np.ndarray:
    """A row of keys for each row of signatures: one for each code that is left out of its chunk."""
    out = np.empty(signatures.shape, np.uint64)
    at = np.arange(signatures.shape[1], dtype=np.uint64)
    each = shingles.mix((at << np.uint64(16)) | signatures.astype(np.uint64), 42)
    for part in parts:
        own = each[:, part.start : part.stop]
        out[:, part.start : part.stop] = own.sum(axis=1, keepdims=True, dtype=np.uint64) - own
    return shingles.mix(out + at * np.uint64(0x9E3779B97F4A7C15), 43)


def alone(size: int, share: int) -> bool:
    """Whether only an equal set can be similar enough to one of so many tokens."""
    return share * (size + 1) > 100 * size


def _signed(docs: DataFrame, n: int, codes: int, share: int) -> DataFrame:
    """(doc_id, key, row, node, size, signature) of each row of docs; no signature for sets that have none or need none."""

    @frugal
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(codes)
        for b in batches:
            node, size, sign = [], [], []
            for _, s, _ in shingles.sets(b.column("text"), n):
                size.append(len(s))
                node.append(jaccard._node(s) if len(s) else None)
                sign.append(None if alone(len(s), share) else hashes.signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), b.column("row"), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(sign, pa.binary())], names=["doc_id", "key", "row", "node", "size", "signature"])

    return docs.select("doc_id", "key", "row", "text").mapInArrow(task, "doc_id long, key long, row string, node long, size int, signature binary")


def _codes(column: pa.Array, codes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, codes)


def _keyed(nodes: DataFrame, codes: int, distance: int) -> DataFrame:
    """(g, node, size): all keys of each node(node, size, signature)."""

    @frugal
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = chunks(codes, distance)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                g = keys(_codes(c.column("signature"), codes), parts).view(np.int64).ravel()
                node, size = (np.repeat(c.column(x).to_numpy(), codes) for x in ("node", "size"))
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(node), pa.array(size)], names=["g", "node", "size"])

    return nodes.select("node", "size", "signature").mapInArrow(task, "g long, node long, size int")


def _within(nodes: DataFrame, codes: int, distance: int, work: Scratch) -> Callable[[DataFrame, str], DataFrame]:
    """A filter of pairs(a, b) by the distance of their signatures."""

    @frugal
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = (_codes(b.column("x"), codes) != _codes(b.column("y"), codes)).sum(axis=1)
            yield b.select(["a", "b"]).filter(pa.array(apart <= distance))

    def sift(pairs: DataFrame, name: str) -> DataFrame:
        pairs = work.put(f"{name}_pairs", pairs)
        x, y = (nodes.select(F.col("node").alias(c), F.col("signature").alias(s)) for c, s in (("a", "x"), ("b", "y")))
        kept = work.put(name, pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(task, "a long, b long"))
        work.drop(f"{name}_pairs")
        return kept

    return sift


def classes(docs: DataFrame, n: int = 5, share: int = 85, codes: int = 128, miss: float = 1e-9, small: int = 32) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, chosen) of each row of docs(doc_id, text, and if there is one row, a string that names rows): texts whose sets of n-word shingles have a Jaccard similarity of share/100 or more are linked. chosen: see jaccard.classes."""
    spark = docs.sparkSession
    work = Scratch(spark, "hamming")
    doc_id = F.col("doc_id").cast("long")
    row = F.col("row") if "row" in docs.columns else F.lit(None).cast("string").alias("row")
    docs = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64("text")).alias("key"), "text", row)
    distance = reach(codes, share, miss)
    members = work.put("members", _signed(docs, n, codes, share))
    nodes = members.where("signature IS NOT NULL").groupBy("node").agg(F.first("size").alias("size"), F.first("signature").alias("signature"))
    nodes = work.put("nodes", nodes.repartition(partitions(spark), "node"))  # a row becomes `codes` rows: no few large files
    keyed = _keyed(nodes, codes, distance)
    several = work.put("several", keyed.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    groups = work.put("groups", keyed.join(several, "g"))
    hub = groups.groupBy("g").agg(F.min(F.struct("node", "size")).alias("hub"))
    rows = groups.join(hub, "g")
    star = rows.where("node <> hub.node").select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("size").alias("size_a"), F.col("hub.size").alias("size_b"))
    star = star.where(jaccard._sized(share)).select("a", "b").distinct()
    rows = rows.select("g", "node", "size", F.lit(0).alias("pos"), F.col("hub.node").alias("pivot"))
    known = spark.sparkContext.broadcast((None,))
    out = jaccard.linked(docs, members.drop("signature"), rows, star, n, share, small, known, work, _within(nodes, codes, distance, work), placed=False)
    known.unpersist()
    return out


def near_duplicates(docs: DataFrame, n: int = 5, share: int = 85, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs(doc_id, text)."""
    out = classes(docs.select("doc_id", "text"), n, share, **how)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash_hamming(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents by five-word shingles at a similarity of 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
SELECT *, doc_id = component_id AS kept FROM ({jaccard.ORACLE.replace("len(w) < 3", "len(w) < 5").replace("len(w) - 1", "len(w) - 3").replace("w[i:i+2]", "w[i:i+4]").replace("90 *", "85 *")})
"""
