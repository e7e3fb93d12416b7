"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: ASCII letters lowered, words between ASCII white space, shingles of 4 words (repeats
counted), XXH64 with seed 42 of each; a bit is set if set in over half of the hashes.

Links: equal fingerprints are folded first. The rest is an exact join at `radius` bits over a hierarchy of shared bit patterns.
At its top are patterns of whole blocks of bits: two fingerprints at most
`radius` bits apart agree on at least `b - radius` of `b` blocks, so each choice of that many blocks is one
table of buckets, and `b` grows with the number of fingerprints so that a bucket holds about `per_bucket`. Inside
a bucket fingerprints are sorted by Gray rank, which puts those of equal leading bits together, and put under a tree (`GrayTree`): leaves of `LEAF`
fingerprints, `FAN` nodes under each upper node, every node keeping the pattern (mask and value) that all fingerprints below it
share. Pairs of nodes go down level by level, differences of their patterns adding up; a pair is dropped with all below it once
they exceed the radius, and leaves that are one component already are not compared.

Hot buckets, above `bucket_rows`: their fingerprints are dealt out anew by the next larger `b`, so their rows are copied as often as that
has tables (15, 35 or 70 times for a radius of 4) however large the bucket is. What is still hot when half of all bits agree is ranged by Gray rank over tasks and cut into
runs; the runs' patterns are a table of their own, its pairs are pruned by their differences, and each pair that is left
becomes a task's group of two runs. Buckets return a spanning forest, not
all pairs, which loses no connection.

Components of the forests' union are found by `components`; the id is the least doc_id.

Defined results: null or empty text and text of white space only: fingerprint zero, linked as any
other. Fewer than 4 words: the one shingle is all of them. Equal texts share a component. Null doc_id: kept;
a component's id is the least non-null doc_id (null if there is none). Repeated rows are returned as
often as they occur. Empty table: no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import table, written
from larkspur.llm.components import components

SHINGLE = 4
SEED = 42
STEP = 1 << 15


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    ends = ends[min(SHINGLE, len(words)) - 1 :]
    view, digest, ones = memoryview(flat), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        m = min(STEP, n - at)
        h = np.fromiter((digest(view[s:e], SEED) for s, e in zip(starts[at : at + m].tolist(), ends[at : at + m].tolist(), strict=True)), np.uint64, m)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(m, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, {out} long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class Forest:
    """Union-find over positions; keeps the pairs that joined two trees."""

    def __init__(self, n: int):
        self.up, self.edges = np.arange(n), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        """The root of every position, by halving all paths at once."""
        while not np.array_equal(nxt := self.up[self.up], self.up):
            self.up = nxt
        return self.up

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


LEAF, FAN = 16, 4


class GrayTree:
    """Levels of nodes over runs of fingerprints in Gray order, leaves first: masks of the bits on which all below agree, and those bits."""

    def __init__(self, fps: np.ndarray):
        self.fps, at = fps, np.arange(0, len(fps), LEAF)
        both, some = np.bitwise_and.reduceat(fps, at), np.bitwise_or.reduceat(fps, at)
        self.levels = [(~(both ^ some), both)]
        while len(both) > FAN:
            at = np.arange(0, len(both), FAN)
            both, some = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(some, at)
            self.levels.append((~(both ^ some), both))

    def patterns(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask, value = self.levels[min(level, len(self.levels) - 1)]
        return mask[nodes], value[nodes]

    def below(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """FAN children of each node, and which of them there are; above the top each node is its own only child."""
        if level >= len(self.levels):
            return np.repeat(nodes, FAN), np.tile(np.arange(FAN) == 0, len(nodes))
        kids = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return kids, kids < len(self.levels[level - 1][0])


def leaf_pairs(a: GrayTree, b: GrayTree, radius: int, pruned: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may hold pairs at most `radius` bits apart (for a tree and itself each pair once), nearest patterns first.

    pruned: gets the number of pairs of nodes dropped at each level above the leaves."""
    level = max(len(a.levels), len(b.levels)) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[-1][0])), np.arange(len(b.levels[-1][0])), indexing="ij"))
    seen, differ = np.zeros(len(i), np.uint64), np.zeros(len(i), np.int64)
    while True:
        if a is b:
            i, j, seen, differ = (x[i <= j] for x in (i, j, seen, differ))
        (ma, va), (mb, vb) = a.patterns(level, i), b.patterns(level, j)
        both = ma & mb
        # differences above are counted already: only the bits that are new at this level add to them
        differ = differ + np.bitwise_count((va ^ vb) & both & ~seen)
        near = differ <= radius
        if pruned is not None and level:
            pruned.append(int((~near).sum()))
        i, j, seen, differ = i[near], j[near], both[near], differ[near]
        if not level:
            order = np.argsort(differ, kind="stable")
            return i[order], j[order]
        (ka, ina), (kb, inb) = a.below(level, i), b.below(level, j)
        n = len(i)
        there = (ina.reshape(n, FAN, 1) & inb.reshape(n, 1, FAN)).ravel()
        i = np.broadcast_to(ka.reshape(n, FAN, 1), (n, FAN, FAN)).ravel()[there]
        j = np.broadcast_to(kb.reshape(n, 1, FAN), (n, FAN, FAN)).ravel()[there]
        seen, differ = np.repeat(seen, FAN * FAN)[there], np.repeat(differ, FAN * FAN)[there]
        level -= 1


def link(fps: np.ndarray, radius: int, cut: int | None = None, pruned: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the graph of fingerprints (distinct, in Gray order) at most `radius` bits apart.
    With `cut`, only pairs across that position are compared; each side is then linked by a task of its own."""
    n = len(fps)
    if n < 2 or cut in (0, n):
        return []
    forest = Forest(n)
    a = GrayTree(fps[:cut])
    b = a if cut is None else GrayTree(fps[cut:])
    left, right = leaf_pairs(a, b, radius, pruned)
    split = n if cut is None else cut
    place = lambda leaves, first, end: np.minimum(first + leaves[:, None] * LEAF + np.arange(LEAF), end - 1)
    # the last place of a leaf that isn't full stands for those it lacks: it is compared again, to no effect
    starts = lambda tree: np.arange(0, len(tree.fps), LEAF)
    for lo in range(0, len(left), 256):
        li, ri = left[lo : lo + 256], right[lo : lo + 256]
        roots = forest.roots()
        if lo:
            low, high = (f.reduceat(roots[:split], starts(a)) for f in (np.minimum, np.maximum))
            low_b, high_b = (low, high) if a is b else (f.reduceat(roots[split:], starts(b)) for f in (np.minimum, np.maximum))
            apart = (low[li] != high[li]) | (low_b[ri] != high_b[ri]) | (low[li] != low_b[ri])
            li, ri = li[apart], ri[apart]
        x, y = place(li, 0, split), place(ri, 0 if a is b else split, n)
        at, p, q = np.nonzero(np.bitwise_count(fps[x][:, :, None] ^ fps[y][:, None, :]) <= radius)
        x, y = x[at, p], y[at, q]
        rx, ry = roots[x], roots[y]
        new = np.flatnonzero(rx != ry)
        # of the pairs that join the same two trees one is enough
        _, first = np.unique(np.minimum(rx[new], ry[new]) * n + np.maximum(rx[new], ry[new]), return_index=True)
        for k in new[first].tolist():
            forest.join(int(x[k]), int(y[k]))
    return forest.edges


def block_masks(b: int, radius: int) -> list[int]:
    """Masks of the bits that two near fingerprints share in at least one table: of b near-equal blocks, every choice of b - radius."""
    edges = [64 * i // b for i in range(b + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(blocks, b - radius)]


def blocks_for(n: int, radius: int, per_bucket: int = 1024) -> range:
    """The numbers of blocks to deal fingerprints out by, and what is hot there again by the next, up to half of all bits."""
    if not 0 <= radius <= 28:
        raise ValueError("radius is too large")
    most = 2 * radius if radius > 2 else radius + 3
    first = next((b for b in range(radius + 1, most) if n <= per_bucket * 2 ** min(m.bit_count() for m in block_masks(b, radius))), most)
    return range(first, most + 1)


def keyed_by(distinct: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, t, k): each fingerprint's bucket in every table."""
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    return distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("t", "k"))


def near_links(distinct: DataFrame, radius: int = 4, bucket_rows: int = 20_000) -> DataFrame:
    """distinct (fp long): edges (a, b) that connect what is connected at `radius` bits."""
    out = None
    levels = blocks_for(distinct.count(), radius)
    for b in levels:
        keyed = keyed_by(distinct, block_masks(b, radius))
        # hot buckets are few: they are found by an aggregation with map-side combine
        hot = written(keyed.groupBy("t", "k").count().filter(F.col("count") > bucket_rows).select("t", "k"), "hot-buckets")
        if not hot.take(1):
            links = _linked(keyed, radius)
            return links if out is None else out.unionAll(links)
        links = _linked(keyed.join(hot, ["t", "k"], "left_anti"), radius)
        out = links if out is None else out.unionAll(links)
        kept = keyed.join(hot, ["t", "k"], "left_semi")
        if b != levels[-1]:
            distinct = written(kept.select("fp").distinct(), "hot-fingerprints")
    return out.unionAll(_linked_runs(kept, radius, bucket_rows))


def _linked(keyed: DataFrame, radius: int) -> DataFrame:
    """Buckets in order of their key: rows of a task are sorted (and spilled) by Spark, and a bucket's rows, at most bucket_rows, are held at a time."""
    dealt = keyed.select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k")

    def run(batches):
        t0 = k0 = None
        held: list[np.ndarray] = []

        def flush():
            fps = np.concatenate(held)
            fps = fps[np.argsort(gray_rank(fps), kind="stable")]
            e = link(fps, radius)
            return fps[[i for i, _ in e]], fps[[j for _, j in e]]

        for batch in batches:
            t, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            a, b = [], []
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(t)]):
                if lo == hi:
                    continue
                if held and (t[lo], k[lo]) != (t0, k0):
                    if len(held) > 1 or len(held[0]) > 1:
                        x, y = flush()
                        a.append(x), b.append(y)
                    held = []
                t0, k0 = t[lo], k[lo]
                held.append(fp[lo:hi])
            yield _pairs(a, b)
        if held and sum(map(len, held)) > 1:
            yield _pairs(*[[x] for x in flush()])

    return dealt.mapInArrow(run, "a long, b long")


def _pairs(a, b) -> pa.RecordBatch:
    cat = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
    return pa.record_batch([pa.array(cat(a)), pa.array(cat(b))], names=["a", "b"])


def gray_column(fp: Column) -> Column:
    """gray_rank as a column, with the first bit turned so that signed numbers are in its order."""
    for n in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, n))
    return fp.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def node_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (t, k, run, both, some): pairs (t, k, i, j) of runs, i <= j, whose patterns differ in at most `radius` bits."""
    side = lambda n: nodes.select("t", "k", F.col("run").alias(n), F.bitwise_not(F.col("both").bitwiseXOR(F.col("some"))).alias(f"mask_{n}"), F.col("both").alias(f"value_{n}"))
    differ = F.bit_count(F.col("value_i").bitwiseXOR(F.col("value_j")).bitwiseAND(F.col("mask_i")).bitwiseAND(F.col("mask_j")))
    return side("i").join(side("j"), ["t", "k"]).filter((F.col("i") <= F.col("j")) & (differ <= radius)).select("t", "k", "i", "j")


def _linked_runs(keyed: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """keyed (t, k, fp) of hot buckets: ranged by Gray rank, cut into runs, and each pair of runs whose patterns are near is a task's group."""
    n, run_rows = keyed.count(), max(1, bucket_rows // 2)
    rank = gray_column(F.col("fp"))
    ranged = keyed.select("t", "k", "fp", rank.alias("rank")).repartitionByRange(max(1, -(-n // bucket_rows)), "t", "k", "rank").sortWithinPartitions("t", "k", "rank")

    def cut(batches):
        first = TaskContext.get().partitionId() << 32
        run, rows, of = first - 1, run_rows, None
        for batch in batches:
            t, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            runs = np.empty(len(t), np.int64)
            for lo, hi in itertools.pairwise([0, *(np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1).tolist(), len(t)]):
                while lo < hi:
                    if rows >= run_rows or of != (t[lo], k[lo]):
                        run, rows, of = run + 1, 0, (t[lo], k[lo])
                    end = min(hi, lo + run_rows - rows)
                    runs[lo:end], rows, lo = run, rows + end - lo, end
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array(runs)], names=["t", "k", "fp", "run"])

    rows = written(ranged.mapInArrow(cut, "t int, k long, fp long, run long"), "runs")
    nodes = written(rows.groupBy("t", "k", "run").agg(F.bit_and("fp").alias("both"), F.bit_or("fp").alias("some")), "nodes")
    pairs = written(node_pairs(nodes, radius), "node-pairs")
    own = rows.withColumnRenamed("run", "i").join(pairs, ["t", "k", "i"]).select("t", "k", "i", "j", "fp", F.lit(0).alias("side"))
    other = rows.withColumnRenamed("run", "j").join(pairs.filter("i < j"), ["t", "k", "j"]).select("t", "k", "i", "j", "fp", F.lit(1).alias("side"))

    def linked(group: pa.Table) -> pa.Table:
        fp, side = group.column("fp").to_numpy().view(np.uint64), group.column("side").to_numpy()
        order = np.lexsort((gray_rank(fp), side))
        fp, n = fp[order], int((side == 0).sum())
        e = link(fp, radius, None if n == len(fp) else n)
        return pa.Table.from_batches([_pairs([fp[[i for i, _ in e]]], [fp[[j for _, j in e]]])])

    return own.unionAll(other).groupBy("t", "k", "i", "j").applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, bucket_rows: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text)."""
    rows = written(fingerprints(docs), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(distinct.select("fp"), radius, bucket_rows))
    # fingerprint -> component's root -> least doc_id of the component
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
