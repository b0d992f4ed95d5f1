r"""Hard negatives by vantage-point trees over norm-augmented vectors.

A row v gets the component sqrt(M**2 - |v|**2), M being the largest norm, and an anchor a gets 0. Then
|a - v|**2 = |a|**2 + M**2 - 2 a.v: nearer means a higher score, and a window of scores is an annulus of
distances around the anchor.

1. A top tree of at most `most_shards` leaves is fitted on a bounded sample, `sampled` rows a leaf. Every
   row goes down it to a shard; the distances to the vantage points on the way give each shard's bounds.
   Shards beyond `shard_rows` rows are dealt into pieces.
2. A search asks the nearest shard of each annulus first. What it finds bounds the rest: only shards that
   can hold a better row, by the triangle inequality on all vantage points of their path, are asked then.
3. A task builds a tree over its piece of a shard and streams the searches through it, nearest leaf first:
   a search ends when no further leaf can hold a better row. Searches that want the same leaf at the same
   time share one matrix product.
4. The positives are a search without a window for the same label; each distinct positive score gives a
   window for different labels.

Scores are exact integers; bounds only leave out leaves, with a margin for rounding, so results are exact
whatever the sample. Where distances don't tell rows apart (independent vectors of many dimensions) every
search asks every shard, and the work is that of all anchors against all rows, in tiles.

Defined cases: rows with a null id, label or vector, an empty vector, or a component that is null or not
finite (also after scaling) take no part; rows alike in id, label and vector are counted, not copied, and
each is a row, as anchor, positive and negative; a row leaves out only itself; of rows alike in label and
vector only the smallest ids that can be asked for are searched; only vectors of one dimension are
compared; scores beyond a long become the largest or smallest long; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .topk import LEAST, best, product

FOUND = "vec_id long, key long, lo long, hi long, found_id long, score long, times long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v, times, n2) of vectors(vec_id, embedding, label): floor(scale * x) of each component as a double, rows alike counted, and the squared norm."""
    x = F.transform("embedding", lambda e: e.cast("double") * scale)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    ok = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND size(x) > 0").where(ok)
    v = F.transform("x", lambda e: F.when(F.abs(e) < 2**53, F.floor(e).cast("double")).otherwise(e))
    rows = rows.select("vec_id", "label", v.alias("v")).groupBy("vec_id", "label", "v").agg(F.count("*").alias("times"))
    return rows.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def augmented(v: np.ndarray, m2: float) -> np.ndarray:
    """Rows with the component that gives all of them the norm sqrt(m2)."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.hstack([v, np.sqrt(np.maximum(m2 - (v * v).sum(axis=1, keepdims=True), 0))])


def apart(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances between rows of two matrices, row by row (p may be one row)."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(((x - p) ** 2).sum(axis=1))


class Tree:
    """A vantage-point tree: inner nodes hold a point and the median distance to it, leaves the way that leads to them."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.vantage, self.radius, self.child, self.leaves, ways = [], [], [], [], []
        todo = [(np.arange(len(points)), [], None)]
        while todo:
            rows, way, above = todo.pop()
            far = None
            if len(rows) > leaf:
                x = points[rows]
                p = x[np.argmax(apart(x, x[0]))]
                d = apart(x, p)
                mu = float(np.median(d))
                far = d > mu
                if not far.any():  # more than half of the rows lie at the largest distance
                    mu = float(d[d < mu].max(initial=-1.0))
                    far = d > mu
            here = len(self.vantage)
            if far is None or far.all() or not far.any():
                here = ~len(self.leaves)
                self.leaves.append(rows)
                ways.append(way)
            else:
                self.vantage.append(p)
                self.radius.append(mu)
                self.child.append([0, 0])
                for side, part in enumerate((~far, far)):
                    todo.append((rows[part], [*way, (here, float(d[part].min()), float(d[part].max()))], (here, side)))
            if above is not None:
                self.child[above[0]][above[1]] = here
        self.vantage, self.child = np.array(self.vantage).reshape(len(self.vantage), points.shape[1]), np.array(self.child, np.int64).reshape(-1, 2)
        self.depth = max(map(len, ways))
        pad = (-1, 0.0, np.inf)
        full = [[*w, *[pad] * (self.depth - len(w))] for w in ways]
        self.way, self.low, self.high = (np.array([[step[i] for step in w] for w in full], kind).reshape(len(ways), self.depth) for i, kind in enumerate((np.int64, float, float)))

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distances to the vantage points on its way (NaN beyond)."""
        node = np.full(len(x), 0 if len(self.vantage) else -1)
        seen = np.full((len(x), self.depth), np.nan)
        for k in range(self.depth):
            go = np.flatnonzero(node >= 0)
            d = apart(x[go], self.vantage[node[go]])
            seen[go, k] = d
            node[go] = self.child[node[go], (d > np.array(self.radius)[node[go]]).astype(int)]
        return ~node, seen

    def reach(self, q: np.ndarray, m2: float) -> tuple[np.ndarray, np.ndarray]:
        """The highest and lowest scores that each leaf can hold for each anchor, with a margin for rounding."""
        q2 = (q * q).sum(axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            near, far = np.zeros((len(q), len(self.way))), np.full((len(q), len(self.way)), np.inf)
            if len(self.vantage):
                d = np.sqrt(np.maximum(q2[:, None] + m2 - 2 * (q @ self.vantage[:, :-1].T), 0))
                for k in range(self.depth):
                    on = np.flatnonzero(self.way[:, k] >= 0)
                    dk = d[:, self.way[on, k]]
                    near[:, on] = np.maximum(near[:, on], np.maximum(dk - self.high[on, k], self.low[on, k] - dk))
                    far[:, on] = np.minimum(far[:, on], dk + self.high[on, k])
            total = (q2 + m2)[:, None]
            blur, margin = 1e-6 * (np.sqrt(q2)[:, None] + np.sqrt(m2)), 1e-9 * total + 1
            most = (total - np.maximum(near - blur, 0) ** 2) / 2 + margin
            least = (total - (far + blur) ** 2) / 2 - margin
        return np.nan_to_num(most, nan=np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(least, nan=-np.inf, posinf=np.inf, neginf=-np.inf)


class Forest:
    """A top tree for each dimension of the sample; shards are numbered through, those of other dimensions are -dimension."""

    def __init__(self, sample: list, m2: float, leaf: int):
        self.m2, self.trees, first = m2, {}, 0
        by_dim: dict[int, list] = {}
        for v in sample:
            by_dim.setdefault(len(v), []).append(v)
        for dim, rows in sorted(by_dim.items()):
            tree = Tree(augmented(np.array(rows, float), m2), leaf)
            self.trees[dim] = (tree, first)
            first += len(tree.way)

    def tighten(self, bounds: list) -> None:
        """Takes bounds(shard, at, low, high) of all rows in place of the sample's."""
        held = {(r.shard, r.at): (r.low, r.high) for r in bounds}
        for tree, first in self.trees.values():
            for leaf in range(len(tree.way)):
                for k in np.flatnonzero(tree.way[leaf] >= 0).tolist():
                    tree.low[leaf, k], tree.high[leaf, k] = held.get((first + leaf, k), (0.0, np.inf))


def placed(points: DataFrame, forest: Forest) -> DataFrame:
    """points(vec_id, label, v, times) with a shard, and seen, the distances on the way to it."""
    sent = points.sparkSession.sparkContext.broadcast(forest)
    names = ("vec_id", "label", "v", "times")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for b in batches:
            size = pa.compute.list_value_length(b.column("v")).to_numpy()
            for dim in np.unique(size).tolist():
                part = b.take(pa.array(np.flatnonzero(size == dim)))
                shard, seen = np.full(part.num_rows, -dim), np.empty((part.num_rows, 0))
                if dim in forest.trees:
                    tree, first = forest.trees[dim]
                    leaf, seen = tree.route(augmented(_matrix(part.column("v"), dim), forest.m2))
                    shard = first + leaf
                seen = pa.FixedSizeListArray.from_arrays(pa.array(seen.ravel()), seen.shape[1]).cast(pa.list_(pa.float64())) if seen.shape[1] else pa.array([[]] * part.num_rows, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(shard, pa.int64()), seen], names=[*names, "shard", "seen"])

    return points.select(*names).mapInArrow(task, "vec_id long, label long, v array<double>, times long, shard long, seen array<double>")


def _slack(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """What a window's ends may lose as doubles; open ends lose nothing."""
    ends = np.abs(np.stack([lo, hi]).astype(float))
    return 1 + 1e-15 * np.where(ends < 2.0**63, ends, 0).max(axis=0)


def _asked(queries: DataFrame, sent, first: bool) -> DataFrame:
    """(vec_id, key, lo, hi, shard): the nearest shard of each query's annulus, or all others that can hold a score of `enough` or more."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for b in batches:
            size = pa.compute.list_value_length(b.column("v")).to_numpy()
            for dim in np.unique(size).tolist():
                part = b.take(pa.array(np.flatnonzero(size == dim)))
                lo, hi, enough = (part.column(c).to_numpy(zero_copy_only=False).astype(float)[:, None] for c in ("lo", "hi", "enough"))
                if dim in forest.trees:
                    tree, base = forest.trees[dim]
                    most, least = tree.reach(_matrix(part.column("v"), dim), forest.m2)
                else:
                    base, most, least = -dim, np.full((len(lo), 1), np.inf), np.full((len(lo), 1), -np.inf)
                slack = _slack(lo, hi)
                fits = (most >= lo - slack) & (least <= hi + slack)
                hope = np.where(fits, np.minimum(most, hi), -np.inf)
                near = np.arange(hope.shape[1]) == hope.argmax(axis=1)[:, None]
                row, col = np.nonzero(fits & (near if first else ~near & (hope + slack >= enough)))
                part = part.select(["vec_id", "key", "lo", "hi"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(base + col, pa.int64())], names=["vec_id", "key", "lo", "hi", "shard"])

    return queries.mapInArrow(task, "vec_id long, key long, lo long, hi long, shard long")


class Piece:
    """The rows of one piece of a shard, as a tree of its own."""

    def __init__(self, parts: list[tuple], m2: float, leaf: int = 256):
        self.ids, self.key, self.label, self.times, self.v = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.m2, self.tree = m2, Tree(augmented(self.v, m2), leaf)

    def search(self, ids, key, label, lo, hi, q, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """(query, row, score) of the k best of each query's window, of its label or of others."""
        most, least = self.tree.reach(q, self.m2)
        slack = _slack(lo, hi)[:, None]
        hope = np.where((most >= lo[:, None] - slack) & (least <= hi[:, None] + slack), np.minimum(most, hi[:, None] + slack), -np.inf)
        order = np.argsort(-hope, axis=1, kind="stable")
        enough = np.full(len(q), LEAST)
        got = [np.empty(0, np.int64)] * 3
        live = np.arange(len(q))
        for step in range(order.shape[1]):
            leaf = order[live, step]
            left = hope[live, leaf]
            go = (left > -np.inf) & ((enough[live] == LEAST) | (left >= enough[live]))
            live, leaf = live[go], leaf[go]
            if not len(live):
                break
            new = []
            for one in np.unique(leaf).tolist():
                at, rows = live[leaf == one], self.tree.leaves[one]
                s = product(q[at], self.v[rows])
                fit = (s >= np.maximum(lo[at], enough[at])[:, None]) & (s <= hi[at][:, None]) & ((self.label[rows] == label[at][:, None]) == same)
                a, c = np.nonzero(fit)
                new.append((at[a], rows[c], s[a, c]))
            row, col, s = (np.concatenate(x) for x in zip(*new, strict=True))
            if same:  # of rows like the anchor itself, one is the anchor
                other = (self.times[col] > 1) | (self.ids[col] != ids[row]) | (self.key[col] != key[row])
                row, col, s = row[other], col[other], s[other]
            row, col, s = (np.concatenate([x, y]) for x, y in zip(got, (row, col, s), strict=True))
            pick = best(row, s, self.ids[col], k)
            got = [row[pick], col[pick], s[pick]]
            full, n = np.unique(got[0], return_counts=True)
            last = np.cumsum(n) - 1
            enough[full[n == k]] = got[2][last[n == k]]
        return tuple(got)


def _met(asked: DataFrame, queries: DataFrame, points: DataFrame, sizes: DataFrame, m2: float, k: int, same: bool, block_rows: int) -> DataFrame:
    """FOUND: what the asked shards hold for their queries, a list for each piece."""
    spark = points.sparkSession
    load = asked.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    plan = sizes.join(load, "shard")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda key, n: F.pmod(key, F.col(n))
    names = ["shard", "piece", "block", "kind", "vec_id", "key", "label", "times", "lo", "hi", "v"]
    none = F.lit(0).cast("long")
    rows = points.join(plan, "shard").select("*", F.lit(0).alias("kind"), own(F.col("key"), "pieces").alias("piece"), none.alias("lo"), none.alias("hi"), spread("blocks").alias("block")).select(*names)
    to = asked.join(queries.drop("enough"), ["vec_id", "key", "lo", "hi"]).join(plan, "shard")
    to = to.select("*", F.lit(1).alias("kind"), none.alias("times"), own(F.xxhash64("vec_id", "key", "lo"), "blocks").alias("block"), spread("pieces").alias("piece")).select(*names)
    tiles = rows.unionByName(to).repartition(partitions(spark), "shard", "piece", "block").sortWithinPartitions("shard", "piece", "block", "kind")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, piece = None, [], None
        for b in batches:
            c = {n: b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names[:-1]}
            size = pa.compute.list_value_length(b.column("v")).to_numpy()
            flat, start = b.column("v").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            change = np.any([np.diff(c[x]) != 0 for x in names[:4]], axis=0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(change) + 1] if b.num_rows else [0]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if (at := tuple(c[x][i] for x in names[:3])) != now:
                    now, parts, piece = at, [], None
                v = flat[start[i] : start[j]].reshape(j - i, size[i])
                if c["kind"][i] == 0:
                    parts.append((c["vec_id"][i:j], c["key"][i:j], c["label"][i:j], c["times"][i:j], v))
                elif parts or piece:
                    if piece is None:
                        piece, parts = Piece(parts, m2), []
                    row, col, s = piece.search(*(c[x][i:j] for x in ("vec_id", "key", "label", "lo", "hi")), v, k, same)
                    mine = (piece.ids[col] == c["vec_id"][i:j][row]) & (piece.key[col] == c["key"][i:j][row])
                    out = [*(c[x][i:j][row] for x in ("vec_id", "key", "lo", "hi")), piece.ids[col], s, piece.times[col] - (mine & same)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[x.split()[0] for x in FOUND.split(", ")])

    return tiles.mapInArrow(task, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller id."""
    w = Window.partitionBy("vec_id", "key", "lo", "hi").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Index:
    """All rows in shards of vantage-point trees, written in the shared folder."""

    def __init__(self, rows: DataFrame, work: Scratch, copies: int, shard_rows: int = 8192, most_shards: int = 1024, sampled: int = 16, block_rows: int = 65_536):
        """rows: a written table as quantised gives it. copies: how many rows alike in label and vector can be asked for."""
        self.work, self.block_rows, self.runs = work, block_rows, 0
        w = Window.partitionBy("label", "v").orderBy("vec_id")
        points = rows.withColumn("copy", F.row_number().over(w)).where(F.col("copy") <= copies)
        n, m2 = rows.agg(F.count("*"), F.max("n2")).first()
        shards = max(1, min(most_shards, -(-n // shard_rows)))
        few = points.select("v").orderBy(F.xxhash64("v", "label")).limit(shards * sampled) if shards > 1 else points.select("v").limit(0)
        self.forest = Forest([r.v for r in few.collect()], m2 or 0.0, sampled + sampled // 2)
        at = work.put("placed", placed(points, self.forest).withColumn("key", F.xxhash64("vec_id", "label", "v")))
        bounds = at.select("shard", F.posexplode("seen").alias("at", "d")).where("NOT isnan(d)").groupBy("shard", "at").agg(F.min("d").alias("low"), F.max("d").alias("high"))
        self.forest.tighten(bounds.collect())
        self.points = at.drop("seen")
        self.sizes = work.put("sizes", at.groupBy("shard").agg(F.ceil(F.count("*") / (2 * shard_rows)).alias("pieces")))
        self.sent = rows.sparkSession.sparkContext.broadcast(self.forest)

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows in the windows [lo, hi] of queries(vec_id, key, label, v, lo, hi), of the query's label or of others: FOUND and rank, a written table."""
        self.runs += 1
        name = f"search{self.runs}"
        queries = self.work.put(f"{name}_queries", queries)
        meet = lambda asked: _met(asked, queries, self.points, self.sizes, self.forest.m2, k, same, self.block_rows)
        asked = self.work.put(f"{name}_near", _asked(queries.withColumn("enough", F.lit(LEAST)), self.sent, first=True))
        found = self.work.put(f"{name}_found", _first(meet(asked), k))
        enough = found.groupBy("vec_id", "key", "lo", "hi").agg(F.when(F.count("*") == k, F.min("score")).alias("enough"))
        rest = queries.join(enough, ["vec_id", "key", "lo", "hi"], "left").withColumn("enough", F.coalesce("enough", F.lit(LEAST)))
        asked = self.work.put(f"{name}_rest", _asked(rest, self.sent, first=False))
        return self.work.put(name, _first(found.drop("rank").unionByName(meet(asked)), k))


def mined(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, **sizes) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of the anchors' best rows of their label, the best of other labels whose scores lie between least and most hundredths of it.

    rows and anchors: written tables as quantised gives them, the anchors being some of the rows.
    """
    work = Scratch(rows.sparkSession, "hardneg")
    index = Index(rows, work, max(positives + 1, negatives), **sizes)
    anchors = anchors.select("vec_id", F.xxhash64("vec_id", "label", "v").alias("key"), "label", "v", "times")
    lowest, highest = F.lit(LEAST), F.lit(2**63 - 1)
    near = index.search(anchors.select("vec_id", "key", "label", "v", lowest.alias("lo"), highest.alias("hi")), positives, same=True)
    copies = lambda n, k: F.explode(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(k).cast("long"))))
    w = Window.partitionBy("vec_id", "key").orderBy("rank", "copy")
    near = near.select("vec_id", "key", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank", copies("times", positives).alias("copy"))
    p = F.col("positive_score").cast("decimal(20,0)")
    lo, hi = F.ceil(p * least / 100).cast("long"), F.floor(p * most / 100).cast("long")
    near = work.put("positives", near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= positives).withColumn("lo", lo).withColumn("hi", hi).drop("rank", "copy"))
    windows = near.where("lo <= hi").select("vec_id", "key", "lo", "hi").distinct()
    hard = index.search(windows.join(anchors.select("vec_id", "key", "label", "v"), ["vec_id", "key"]), negatives, same=False)
    w = Window.partitionBy("vec_id", "key", "nth").orderBy("rank", "copy")
    hard = hard.select("vec_id", "key", "lo", "hi", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank", copies("times", negatives).alias("copy"))
    out = near.join(hard, ["vec_id", "key", "lo", "hi"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    asked = anchors.where("times > 1").select("vec_id", "key", F.col("times").alias("asked"))
    out = out.join(asked, ["vec_id", "key"], "left").withColumn("asked", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("asked", F.lit(1).cast("long")))))
    out = work.put("mined", out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    work.keep("mined")
    index.sent.unpersist()
    return out


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """The hard negatives of every fiftieth vector; every seventh one's label is moved on first."""
    work = Scratch(spark, "vectors")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = work.put("rows", quantised(vectors.withColumn("label", moved)))
    out = mined(rows, rows.where("vec_id % 50 = 0"))
    work.drop("rows")
    return out


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS anchor_id, v.vec_id, q.label = v.label AS same,
                  CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
           FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
