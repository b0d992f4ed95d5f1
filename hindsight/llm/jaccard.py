"""Exact Jaccard join of texts by word n-grams with several global token orders.

1. Words and n-grams are counted over all texts (per-task counts of what repeats, summed in Spark); the
   `heavy` most frequent of each, a fixed number, are broadcast. Every token order goes by bands of the
   frequency of an n-gram's rarest word, which bounds its own, with heavy n-grams last; within a band
   each order has a sequence of its own.
2. A set that overlaps another enough shares a token with it among its first
   |set| - ceil(share * |set|) + 1 tokens under every order. Texts of one n-gram set are one node; nodes
   are grouped by the tokens of their first-order prefix (heavy tokens are salted).
3. Star round: each node is paired with the smallest node of its groups. Pairs whose sizes fit must
   share, under each of the three orders, as many prefix tokens as a link would force them to; what
   passes all the filters is verified.
4. Rest: groups of up to `small` nodes that are not yet in one component give pairs of different
   components. All that two sets share stands at or after their first shared token, so a pair comes only
   from where both have enough tokens left. Larger groups are cut into windows of two neighbouring bands
   of size first, as sizes of a pair differ by the share at most.
5. Windows that are still larger and share nodes form an area, whose smallest set P is its pivot. The
   symmetric difference of two sets is that of their differences to P, so each node is written as its few
   tokens that differ from P's (`_delta`): a link needs |dx| + |dy| - 2 |dx & dy| to be small, and two
   sets of which one isn't linked with P link only if their differences share something. This is the
   prefix filter again, over the differences, by exact counts within the area; differences that only one
   component has can't count. One star round on them joins what is dense, then the rest is paired. What
   near copies have in common is gone from it, so their pairs come from shared edits only.

Candidates of every round pass the filters of all three orders, then whole sets are compared, in
integers. Components come from `components`. No group or partner is capped: every pair that can link is
verified, or joined by links already. A group of sets that share edits without linking still costs its
pairs. A light token stands in fewer than one in `heavy` of all rows of the table of tokens.

A set's id has 63 bits and a token 59: about one pair of different sets among 10**10 texts is expected to
be taken for equal five times over.

Defined cases: a text that is null or has no words has an empty set and links with nothing; of fewer
than n words the whole sequence is the set's one token; rows that repeat a text link with each other;
a null doc_id takes part, and a component's id is the smallest id known, null if there is none; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import Scratch, components, drop_dir, frugal, likely, new_dir, stored

ORDERS = 3


def prefix_size(n: int, share: int) -> int:
    """Tokens of a set of n of which one must be shared at a Jaccard similarity of share hundredths."""
    return n - -(-n * share // 100) + 1


Heavy = tuple[shingles.Rarity, np.ndarray, np.ndarray]


def heavy_tokens(docs: DataFrame, n: int, most: int, window: int = 1_500_000, least: int = 3) -> Heavy:
    """Up to `most` words, as bands, and up to `most` n-grams by document frequency (sorted hashes, counts), counted over all texts.

    A task counts `window` tokens at a time and passes on what occurs `least` times among them; the
    orders made from these counts steer speed only, never results.
    """

    @frugal
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], []), 0

        def counted():
            for kind in (0, 1):
                t, c = np.unique(np.concatenate(held[kind]), return_counts=True)
                total, t, c = c.sum(), t[c >= least], c[c >= least]
                t, c = np.append(t, np.uint64(0)), np.append(c, total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), kind, np.int32)), pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], names=["kind", "token", "n"])

        for b in batches:
            for _, s, h in shingles.sets(b.column("text"), n):
                held[0].append(h)
                held[1].append(s)
                size += len(s)
                if size >= window:
                    yield from counted()
                    held, size = ([], []), 0
        if size:
            yield from counted()

    counts = docs.select("text").mapInArrow(task, "kind int, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n"))
    path = new_dir(docs.sparkSession, "heavy")
    counts = stored(counts, path)
    total = counts.where("kind = 0 AND token = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = []
    for kind in (0, 1):
        t = counts.where(f"kind = {kind} AND token <> 0").orderBy(F.desc("n"), "token").limit(most).toArrow()
        token, count = t.column("token").to_numpy().view(np.uint64), t.column("n").to_numpy()
        order = np.argsort(token)
        top.append((token[order], count[order]))
    drop_dir(docs.sparkSession, path)
    return shingles.Rarity(*top[0], total), *top[1]


class Orders:
    """The global token orders, as 64-bit keys: light tokens by band and mixed hash, heavy ones after them by count."""

    def __init__(self, token: np.ndarray, count: np.ndarray):
        self.token, self.count = token, np.minimum(count, 2**31 - 1).astype(np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[token & np.uint64((1 << 20) - 1)] = True

    def heavy(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of heavy tokens in s, and their counts."""
        s = s & shingles.LOW
        at = np.flatnonzero(self.maybe[s & np.uint64((1 << 20) - 1)])
        if not len(at):
            return at, np.empty(0, np.uint64)
        k = np.minimum(np.searchsorted(self.token, s[at]), len(self.token) - 1)
        hit = self.token[k] == s[at]
        return at[hit], self.count[k[hit]]

    def prefixes(self, s: np.ndarray, p: int, orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
        """The first p tokens of s under each order, those of the first order sorted by it, and which of them are heavy."""
        at, count = self.heavy(s)
        out = []
        for o in orders:
            key = ((shingles.mix(s, 100 + o) & shingles.LOW) | (s & ~shingles.LOW)) >> np.uint64(1)
            key[at] = (np.uint64(1) << np.uint64(63)) | (count << np.uint64(32)) | (key[at] & np.uint64(2**32 - 1))
            pick = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
            pick = pick[np.lexsort((s[pick], key[pick]))] if o == 0 else pick
            out.append((s[pick], key[pick] >> np.uint64(63) != 0))
        return out


def _lists(values: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(flat.dtype.str.replace("u", "i"))))


def _node(s: np.ndarray) -> int:
    """An id of a non-empty set from a sum and an exclusive or of its mixed tokens, never negative."""
    a = np.bitwise_xor.reduce(shingles.mix(s, 7), keepdims=True)
    b = np.sum(shingles.mix(s, 8), dtype=np.uint64, keepdims=True)
    return int(shingles.mix(a + b * np.uint64(0xC2B2AE3D27D4EB4F), 9)[0] >> np.uint64(1))


def _first_pass(docs: DataFrame, n: int, share: int, known: Broadcast) -> DataFrame:
    """(doc_id, key, row, node, size, light, dense, second, third): each row's set id and size, its first-order prefix by class of token, and 32 bits of the tokens of its other prefixes."""

    @frugal
    def task(batches):
        rarity, *rest = known.value
        orders = Orders(*rest)
        none = (np.empty(0, np.uint64), np.empty(0, bool))
        for b in batches:
            node, size, light, dense, other = [], [], [], [], ([], [])
            for _, s, _ in shingles.sets(b.column("text"), n, rarity):
                size.append(len(s))
                node.append(_node(s) if len(s) else None)
                (t, h), *more = orders.prefixes(s, prefix_size(len(s), share), range(ORDERS)) if len(s) else [none] * ORDERS
                light.append(t[~h])
                dense.append(t[h])
                for held, (t, _) in zip(other, more, strict=True):
                    held.append(np.unique(t.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), b.column("row"), pa.array(node, pa.int64()), pa.array(size, pa.int32()), *map(_lists, (light, dense, *other))], names=["doc_id", "key", "row", "node", "size", "light", "dense", "second", "third"])

    return docs.select("doc_id", "key", "row", "text").mapInArrow(task, "doc_id long, key long, row string, node long, size int, light array<long>, dense array<long>, second array<int>, third array<int>")


def _whole_sets(docs: DataFrame, members: DataFrame, nodes: DataFrame, n: int, known: Broadcast) -> DataFrame:
    """(node, tokens) of the nodes(node), from one text of each. Texts are found by a bitmap of their keys; what it lets through besides goes by its node."""
    keys = members.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key")
    texts = likely(docs, keys, "key", keys.count())

    @frugal
    def task(batches):
        for b in batches:
            rows = [s for _, s, _ in shingles.sets(b.column("text"), n, known.value[0]) if len(s)]
            for i in range(0, len(rows), 500):
                part = rows[i : i + 500]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in part], pa.int64()), _lists(part)], names=["node", "tokens"])

    return texts.select("text").mapInArrow(task, "node long, tokens array<long>").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _filtered(pairs: DataFrame, members: DataFrame, share: int, work: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose prefixes share enough under each order, a written table.

    A link needs `need` shared tokens; all but |x| - need of x's first p tokens are then among the
    first shared ones, and likewise for y. Tokens that coincide in their 32 bits are allowed for.
    """
    pairs = work.put(f"{name}_pairs", pairs)  # they are read three times
    # prefixes of all members would be most of what is shuffled; what the bitmap lets through besides is in no pair
    sig = likely(members, pairs.select(F.explode(F.array("a", "b")).alias("node")), "node", pairs.count())
    sig = sig.select("node", "size", F.concat("light", "dense").alias("first"), "second", "third").dropDuplicates(["node"])
    p = lambda n: f"({n} - ceil({n} * {share} / 100) + 1)"
    left, right = (sig.select(*(F.col(c).alias(f"{c}_{s}" if c != "node" else s) for c in sig.columns)) for s in "ab")
    need = f"ceil({share} * (size_a + size_b) / (100 + {share}))"
    floor = f"greatest(1, least({p('size_a')} - size_a, {p('size_b')} - size_b) + {need})"
    lost = lambda c: f"({p('size_a')} - size({c}_a) + {p('size_b')} - size({c}_b))"
    ok = " AND ".join(f"size(array_intersect({c}_a, {c}_b)) >= greatest(1, {floor} - {lost(c)})" for c in ("first", "second", "third"))
    kept = work.put(name, pairs.join(left, "a").join(right, "b").where(ok).select("a", "b"))
    work.drop(f"{name}_pairs")
    return kept


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(s), F.col("tokens").alias(f"tokens_{s}")) for s in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.where(100 * shared >= share * (F.size("tokens_a") + F.size("tokens_b") - shared)).select("a", "b")


def _sized(share: int):
    return F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * share


def _several(rows: DataFrame, share: int) -> DataFrame:
    """rows(g, node, size, pos, root, pivot) of groups that still hold different components, one group for each set of nodes; n: its nodes.

    Of groups with the same nodes, the one whose token comes first stays. Nodes go whose tokens from pos
    on are too few for the smallest partner that the group may have.
    """
    agg = rows.groupBy("g").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n"), F.sum(F.col("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum("pos").alias("at"), F.min("size").alias("lo"), F.max(F.col("size") - F.col("pos")).alias("left"))
    kept = agg.where("r0 <> r1").groupBy("n", "s", "x").agg(F.min(F.struct("at", "g", "lo", "left")).alias("k")).select("n", "k.g", "k.lo", "k.left")
    near = f"{share} * (size + greatest(lo, ceil(size * {share} / 100))) <= (100 + {share}) * least(size - pos, left)"
    return rows.join(kept, "g").where(near).drop("lo", "left")


def _windows(rows: DataFrame, share: int, work: Scratch) -> DataFrame:
    """Groups cut by size: each node stands in the windows of its band and of the band below, so that a pair whose sizes fit meets in one."""
    band = F.floor(F.log("size") / (math.log(100 / share) * (1 + 1e-6)))
    cut = rows.drop("n").withColumn("b", band).withColumn("g", F.explode(F.array(F.xxhash64("g", "b"), F.xxhash64("g", F.col("b") - 1)))).drop("b")
    cut = work.put("windows_all", _several(cut, share))
    return work.put("windows", _several(cut.drop("n"), share))


def _rooted(rows: DataFrame, roots: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """rows with the root of their node, which is itself if no link is known."""
    known = roots.select(F.col("node").alias(node), F.col("root").alias(root))
    return rows.join(known, node, "left").withColumn(root, F.coalesce(root, node))


def _merged(roots: DataFrame, links: DataFrame, work: Scratch, name: str) -> DataFrame:
    """The roots after more links(a, b) between nodes."""
    tops = _rooted(_rooted(links, roots, "a", "root_a"), roots, "b", "root_b").where("root_a <> root_b")
    upper = components(tops.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), f"{work.path}/{name}_cc")
    up = upper.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = upper.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return work.put(name, old.unionByName(new))


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of a written table of pairs."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _cross(rows: DataFrame, share: int) -> DataFrame:
    """Pairs of nodes of one group whose components differ, whose sizes and tokens left permit a link, and which no star has compared; each pair once, in the first group that both are in."""
    rows = rows.join(rows.groupBy("node").agg(F.expr("transform(array_sort(collect_list(struct(pos, g))), x -> x.g)").alias("gs")), "node")
    left, right = (rows.select("g", F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("size", "pos", "root", "pivot", "gs"))) for s in "ab")
    both = left.join(right, "g").where("a < b AND root_a <> root_b AND pivot_b <> a AND pivot_a <> b").where(_sized(share))
    both = both.where(f"{share} * (size_a + size_b) <= (100 + {share}) * least(size_a - pos_a, size_b - pos_b)")
    return both.where(F.get(F.array_intersect("gs_a", "gs_b"), F.lit(0)) == F.col("g")).select("a", "b")


def _areas(large: DataFrame, work: Scratch, shared: bool = False) -> DataFrame:
    """(area, node, size, pivot): the nodes of large groups that share nodes; pivot: the smallest set of the area, so that no difference to it has more than twice a set's tokens. shared: rows of a group have one pivot, which joins them."""
    if shared:
        ties = large.select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    else:
        hub = large.groupBy("g").agg(F.min("node").alias("b"))
        ties = large.select("g", F.col("node").alias("a")).join(hub, "g").select("a", "b")
    edges = ties.where("a <> b").distinct()
    areas = components(edges, f"{work.path}/areas_cc").select("node", F.col("root").alias("area"))
    areas = areas.join(large.select("node", "size").distinct(), "node")
    return work.put("areas", areas.join(areas.groupBy("area").agg(F.min(F.struct("size", "node")).alias("pivot")), "area"))


def _delta(areas: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(area, node, size, pivot, d, u, far): d are the tokens that differ from the pivot's, far says that they're too many for a link with it.

    u is (100 + share) |d| - (100 - share) size: x and y link if 2 (100 + share) |dx & dy| >= ux + uy.
    """
    own = areas.join(sets, "node")
    mid = areas.select("area", F.col("pivot.node").alias("node")).distinct().join(sets, "node").select("area", F.col("tokens").alias("middle"))
    d = F.concat(F.array_except("tokens", "middle"), F.array_except("middle", "tokens"))
    rows = own.join(mid, "area").select("area", "node", "size", "pivot", d.alias("d"))
    u = (100 + share) * F.size("d") - (100 - share) * F.col("size")
    return rows.withColumn("u", u).withColumn("far", F.col("u") > (100 - share) * F.col("pivot.size"))


def _edits(delta: DataFrame, roots: DataFrame, share: int, work: Scratch, name: str) -> DataFrame:
    """(area, z, i, node, size, root, u, far, n): the prefix of each node's differences by count in the area; n: how many of them several components have."""
    rows = _rooted(delta.drop("pivot"), roots)
    each = rows.select("area", "node", "root", F.explode("d").alias("z"))
    count = each.groupBy("area", "z").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    shared = each.join(count, ["area", "z"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "z"))).alias("d"))
    live = work.put(name, rows.drop("d").join(shared, "node"))
    least = live.groupBy("area").agg(F.min("u").alias("lo"), F.min(F.when(F.col("far"), F.col("u"))).alias("lo_far"))
    need = F.greatest(F.lit(1), F.ceil((F.col("u") + F.when(F.col("far"), F.col("lo")).otherwise(F.col("lo_far"))) / (2 * (100 + share))))
    live = live.join(least, "area").withColumn("need", need).where("size(d) >= need")
    prefix = F.slice("d", F.lit(1), (F.size("d") - F.col("need") + 1).cast("int"))
    return live.select("area", "node", "size", "root", "u", "far", F.size("d").alias("n"), F.posexplode(F.transform(prefix, lambda x: x["z"])).alias("i", "z"))


EDIT = ("node", "size", "root", "u", "far", "n", "i")


def _edit_pairs(edits: DataFrame, share: int, star: bool) -> DataFrame:
    """Pairs (a, b) of different components that share an edit and may link; star: only those with one node of each edit's group, the same whatever the group if it has it."""
    side = lambda s: [F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in EDIT]
    left = edits.select("area", "z", *side("a"))
    if star:
        right = edits.groupBy("area", "z").agg(F.min_by(F.struct(*EDIT), F.struct(F.xxhash64("node"), "node")).alias("q")).select("area", "z", *(F.col(f"q.{c}").alias("b" if c == "node" else f"{c}_b") for c in EDIT))
        both = left.join(right, ["area", "z"])
    else:
        both = left.join(edits.select("area", "z", *side("b")), ["area", "z"]).where("a < b")
    both = both.where("root_a <> root_b AND (far_a OR far_b)").where(_sized(share))
    both = both.where(f"2 * {100 + share} * least(n_a - i_a, n_b - i_b) >= u_a + u_b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, n: int = 5, share: int = 80, heavy: int = 1 << 18, small: int = 32, salts: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs(doc_id, text): texts whose sets of word n-grams have a Jaccard similarity of share/100 or more are linked."""
    return classes(docs.select("doc_id", "text"), n, share, heavy, small, salts).select("doc_id", "n_shingles", "component_id")


def classes(docs: DataFrame, n: int = 5, share: int = 80, heavy: int = 1 << 18, small: int = 32, salts: int = 64) -> DataFrame:
    """near_groups with the columns row, a string of docs(doc_id, text, row) that names rows where doc_id doesn't, and chosen: whether it's the row of its class with the smallest known doc_id, then row (always, for a text without words)."""
    spark = docs.sparkSession
    work = Scratch(spark, "jaccard")
    doc_id = F.col("doc_id").cast("long")
    row = F.col("row") if "row" in docs.columns else F.lit(None).cast("string").alias("row")
    docs = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64("text")).alias("key"), "text", row)
    top = spark.sparkContext.broadcast(heavy_tokens(docs, n, heavy))
    members = work.put("members", _first_pass(docs, n, share, top))
    nodes = members.where("node IS NOT NULL").groupBy("node").agg(F.first("size").alias("size"), F.first("light").alias("light"), F.first("dense").alias("dense"))
    # salt: -1 for a light token, else the part of a heavy token's group in which the node stands
    salt = F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")
    typed = F.array(F.struct(F.lit(-1).alias("salt"), F.lit(0).alias("start"), F.col("light").alias("t")), F.struct(salt.alias("salt"), F.size("light").alias("start"), F.col("dense").alias("t")))
    tokens = nodes.select("node", "size", F.explode(typed).alias("c")).select("node", "size", "c.salt", "c.start", F.posexplode("c.t").alias("at", "token"))
    tokens = tokens.select("node", "size", "salt", (F.col("start") + F.col("at")).alias("pos"), "token")
    w = Window.partitionBy("token", "salt")
    groups = tokens.select("*", F.min(F.struct("node", "size")).over(w).alias("pivot"), F.max("node").over(w).alias("last"))
    groups = work.put("groups", groups.where("salt >= 0 OR pivot.node <> last").select("token", "salt", "node", "size", "pos", "pivot"))
    over = groups.where("salt >= 0 AND node = pivot.node").select("token", "node", "size", F.min(F.struct("node", "size")).over(Window.partitionBy("token")).alias("pivot"))
    star = groups.select("node", "size", "pivot").unionByName(over.select("node", "size", "pivot"))
    star = star.where("node <> pivot.node").select(F.col("node").alias("a"), F.col("pivot.node").alias("b"), F.col("size").alias("size_a"), F.col("pivot.size").alias("size_b")).where(_sized(share)).select("a", "b").distinct()
    rows = groups.select(F.col("token").alias("g"), "node", "size", "pos", F.col("pivot.node").alias("pivot"))
    sift = lambda pairs, name: _filtered(pairs, members, share, work, name)
    out = linked(docs, members, rows, star, n, share, small, top, work, sift)
    top.unpersist()
    return out


def linked(docs: DataFrame, members: DataFrame, rows: DataFrame, star: DataFrame, n: int, share: int, small: int, known: Broadcast, work: Scratch, sift: Callable[[DataFrame, str], DataFrame], placed: bool = True) -> DataFrame:
    """classes of docs(doc_id, key, row, text) whose sets are members(doc_id, key, row, node, size).

    rows(g, node, size, pos, pivot): groups such that any two nodes that link share one; pivot: the node of
    the group that star(a, b) pairs with all others; sift gives those of some pairs that can still link, a
    written table by that name. placed: pos says where in its set the node's token stands, so that windows
    of size leave nodes out; else large groups go to areas at once, by their pivots.
    """
    star = sift(star, "star")
    sets = work.put("sets", _whole_sets(docs, members, _ends(star), n, known))
    links = work.put("links", _verified(star, sets, share))
    roots = components(links, f"{work.path}/roots_cc")

    def with_sets(nodes: DataFrame, name: str) -> DataFrame:
        missing = nodes.join(sets.select("node"), "node", "left_anti")
        return sets if missing.isEmpty() else sets.unionByName(work.put(name, _whole_sets(docs, members, missing, n, known)))

    rows = work.put("open", _several(_rooted(rows, roots), share))
    work.drop("groups", "star")
    few, large, edited = rows.where(F.col("n") <= small), rows.where(F.col("n") > small), None
    if placed and not large.isEmpty():
        cut = _windows(large, share, work)
        few, large = few.unionByName(cut.where(F.col("n") <= small)), cut.where(F.col("n") > small)
    if not large.isEmpty():
        areas = _areas(large, work, shared=not placed)
        sets = with_sets(areas.select("node"), "sets_large")
        delta = work.put("delta", _delta(areas, sets, share))
        near = delta.where("NOT far AND node <> pivot.node").select(F.col("node").alias("a"), F.col("pivot.node").alias("b"))
        dense = sift(_edit_pairs(_edits(delta, roots, share, work, "edits"), share, star=True), "dense")
        roots = _merged(roots, near.unionByName(_verified(dense, sets, share)), work, "roots_large")
        edited = _edit_pairs(_edits(delta, roots, share, work, "rest_edits"), share, star=False)
    rest = _cross(_rooted(few.drop("root"), roots), share)
    rest = (rest if edited is None else rest.unionByName(edited)).distinct()
    rest = sift(rest, "rest")
    sets = with_sets(_ends(rest), "sets_rest")
    roots = _merged(roots, work.put("links_rest", _verified(rest, sets, share)), work, "roots_all")
    named = work.put("named", _rooted(members.select("doc_id", "row", "node", F.col("size").cast("long").alias("n_shingles")), roots))
    work.keep("named")
    for name in ("roots_cc", "areas_cc", "roots_large_cc", "roots_all_cc"):
        work.drop(name)
    ids = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("smallest"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    alone = F.col("root").isNull()
    return named.join(ids, "root", "left").select("doc_id", "row", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"), (alone | F.col("row").eqNullSafe(F.col("first.row"))).alias("chosen"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, string_split_regex(translate(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') AS w
           FROM documents WHERE regexp_matches(text, '[^\\x20\\x09-\\x0D]')),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
     e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
     l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
     r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Classes of all documents by three-word shingles at a similarity of 0.9."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, share=90)
