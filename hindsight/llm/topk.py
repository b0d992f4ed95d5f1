"""Exact top-k inner-product search.

Queries are dealt into blocks and candidates into shards of bounded size; a task works on tiles, each one
(block, shard) pair, so it holds a block and a part of a shard, however many queries there are. A tile is
a matrix product; its k best per query are selected partially and folded into those of the tile before,
and the lists of the shards are merged in a tree of `fan` lists per node. Sent are block_rows / n of all
pairs for the candidates and shard_rows / n for the queries.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, nor do rows
with a null id or an empty vector, or with a component whose scale-fold isn't finite; rows are what is
searched: each row of a repeated vec_id is a candidate (and a query) of its own, and a query leaves out
only its own row; rows alike in id and vector are counted, not copied. Only vectors of the query's
dimension are compared; ties go to the smaller id; a query without candidates has no row; scores beyond a
long become the largest or smallest long. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

TOP = "query_id long, query_key long, shard long, vec_id long, score long, times long"
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, key, dim, v, times): floor(scale * x) of each component, as a double, and how many rows are alike; rows that take no part are left out."""
    x = F.transform("embedding", lambda e: e.cast("double") * scale)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    ok = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(ok)
    v = F.transform("x", lambda e: F.when(F.abs(e) < 2**53, F.floor(e).cast("double")).otherwise(e))
    rows = rows.select("vec_id", v.alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    return rows.select("vec_id", F.xxhash64("vec_id", "v").alias("key"), F.size("v").alias("dim"), "v", "times")


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as longs: in float64 where no partial sum can pass 2**53, else in int64 where none can pass 2**62, else in Python's integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    ints = lambda x: np.array([[int(e) for e in row] for row in x.tolist()], object).reshape(x.shape)
    return np.clip(ints(q) @ ints(c).T, LEAST, MOST).astype(np.int64)


def best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each row, ties to the smaller id, in order of row and rank."""
    order = np.lexsort((ids, ~score, row))  # ~score falls as score rises, without overflow
    row = row[order]
    first = np.searchsorted(row, row)
    return order[np.arange(len(row)) - first < k]


def tile(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) positions of each query's k best in a matrix of scores: a partial selection, then a sort of what it leaves."""
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero(scores >= edge[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    pick = best(row, scores[row, col], ids[col], k)
    return row[pick], col[pick]


class Block:
    """The queries of one tile, and the best of the candidates that they have met."""

    def __init__(self, k: int):
        self.k, self.parts, self.found = k, [], None

    def add_queries(self, ids: np.ndarray, keys: np.ndarray, v: np.ndarray) -> None:
        self.parts.append((ids, keys, v))

    def meet(self, ids: np.ndarray, keys: np.ndarray, v: np.ndarray, times: np.ndarray, rows: int = 512) -> None:
        if not self.parts:
            return
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]
        qid, qkey, q = self.parts[0]
        got = [] if self.found is None else [self.found]
        for i in range(0, len(qid), rows):
            s = product(q[i : i + rows], v)
            row, col = tile(s, ids, self.k + 1)  # one more, as the query itself may be among them
            own = (ids[col] == qid[i + row]) & (keys[col] == qkey[i + row])
            n = times[col] - own
            keep = n > 0
            row, col, n = row[keep], col[keep], n[keep]
            got.append((i + row, s[row, col], ids[col], n))
        row, score, ids, n = (np.concatenate(x) for x in zip(*got, strict=True))
        pick = best(row, score, ids, self.k)
        self.found = row[pick], score[pick], ids[pick], n[pick]

    def lists(self, shard: int) -> pa.RecordBatch | None:
        if self.found is None:
            return None
        row, score, ids, n = self.found
        qid, qkey, _ = self.parts[0]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (qid[row], qkey[row], np.full(len(row), shard), ids, score, n)], names=[x.split()[0] for x in TOP.split(", ")])


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, shard_rows: int = 65_536, block_rows: int = 16_384, fan: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score) of quantised queries against quantised vectors."""
    spark = vectors.sparkSession
    n, m = vectors.count(), queries.count()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(1, min(max(least, -(-n // shard_rows)), -(-n // 1024)))
    n_blocks = max(1, -(-m // block_rows))
    place = lambda count: F.pmod(F.xxhash64("key"), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    def dealt(rows: DataFrame, kind: int, block: Column, shard: Column) -> DataFrame:
        rows = rows.select("*", block.alias("block"))
        return rows.select("dim", "block", shard.alias("shard"), F.lit(kind).alias("kind"), "vec_id", "key", "v", "times")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: per (dim, block, shard) the queries first, then candidates."""
        key, block = None, Block(k)
        for b in batches:
            names = ("dim", "block", "shard", "kind", "vec_id", "key", "times")
            c = {name: b.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in names}
            flat, start = b.column("v").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(c["dim"])])
            change = np.any([np.diff(c[x]) != 0 for x in ("dim", "block", "shard", "kind")], axis=0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(change) + 1] if b.num_rows else [0]
            for i, j in zip(cuts, cuts[1:], strict=False):
                now = (c["dim"][i], c["block"][i], c["shard"][i])
                if now != key:
                    if (out := block.lists(key[2] if key else 0)) is not None:
                        yield out
                    key, block = now, Block(k)
                v = flat[start[i] : start[j]].reshape(j - i, int(now[0]))
                if c["kind"][i] == 0:
                    block.add_queries(c["vec_id"][i:j], c["key"][i:j], v)
                else:
                    block.meet(c["vec_id"][i:j], c["key"][i:j], v, c["times"][i:j])
        if (out := block.lists(key[2] if key else 0)) is not None:
            yield out

    both = dealt(queries, 0, place(n_blocks), every(n_shards)).unionByName(dealt(vectors, 1, every(n_blocks), place(n_shards)))
    both = both.repartition(min(n_blocks * n_shards, 100_000), "block", "shard").sortWithinPartitions("dim", "block", "shard", "kind")
    top = both.mapInArrow(task, TOP)
    groups = n_shards
    while groups > 1:  # the merging tree: its depth is the logarithm of the number of shards to base fan
        groups = -(-groups // fan)
        w = Window.partitionBy("query_id", "query_key", "shard").orderBy(F.desc("score"), "vec_id")
        top = top.withColumn("shard", F.floor(F.col("shard") / fan)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    alike = lambda n: F.sequence(F.lit(1).cast("long"), n)
    w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    top = top.withColumn("copy", F.explode(alike(F.least("times", F.lit(k))))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    repeated = queries.where("times > 1").select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"), F.col("times").alias("asked"))
    top = top.join(repeated, ["query_id", "query_key"], "left").withColumn("copy", F.explode(alike(F.coalesce("asked", F.lit(1)))))
    return top.select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector among all."""
    work = Scratch(spark, "topk")
    v = work.put("vectors", quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return top_k(v.where("vec_id % 50 = 0"), v, k=5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     q AS (SELECT vec_id AS query_id, v AS qv FROM v WHERE vec_id % 50 = 0),
     s AS (SELECT query_id, vec_id, CAST(list_sum(list_transform(list_zip(qv, v), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM q JOIN v ON query_id <> vec_id),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
