"""Near-duplicate documents: SimHash fingerprints joined exactly by vantage-point trees.

Fingerprints are 64 bits over 3-word shingles. Equal ones are one node. A tree of vantage points,
built on a bounded sample, deals nodes to shards by Hamming distance: at each vantage point nodes
within its radius go inside, others outside. For nodes x inside and y outside that link, the triangle
inequality puts x within ``bits`` of the radius, so such x go to both branches and every linked pair
meets in some shard. Inside a shard the same tree in numpy splits on, down to leaves that are compared
in full. A shard gives each node of a linked group one edge to the group's smallest node, never its
pairs; connected components then spread over all edges by alternating star contractions.

Defined results: a null or empty text, or one without a word, has fingerprint zero and links as any
other. Repeated rows each get a row. A null id is never a component's id unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

SHINGLE = 3
SEED = 42
#: Bits in which linked fingerprints may differ.
BITS = 2
#: Nodes to a shard as dealt, most shards, and sampled nodes to each shard: bounds of the tree kept on the driver.
SHARD_NODES, MAX_SHARDS, SAMPLED = 1024, 1 << 16, 16
#: Nodes that a leaf compares in full.
LEAF = 512


def fingerprint(text: str | None) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64 hashes, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, n = xxhash.xxh64_digest, 0
    totals = np.zeros(64, np.int64)
    shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(SHINGLE)), strict=False))
    while part := b"".join([digest(s, SEED) for s in islice(shingles, 50_000)]):
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        totals += bits.sum(axis=0, dtype=np.int32)
        n += len(bits)
    return int.from_bytes(np.packbits(totals * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def hex_of(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class VantageTree:
    """A binary tree over 64-bit fingerprints; leaves are numbered from 0 in order of their making."""

    def __init__(self, sample: np.ndarray, leaves: int, bits: int = BITS, seed: int = 5):
        self.bits, self.leaves = bits, 0
        rng = np.random.default_rng(seed)

        def grow(points: np.ndarray, wanted: int):
            if wanted > 1 and len(points) > 1:
                for v in rng.choice(points, min(4, len(points)), replace=False):
                    d = np.bitwise_count(points ^ v)
                    radius = int(np.median(d))
                    inside = d <= radius
                    if inside.any() and not inside.all():
                        return int(v), radius, grow(points[inside], wanted // 2), grow(points[~inside], wanted - wanted // 2)
            self.leaves += 1
            return self.leaves - 1

        self.root = grow(np.asarray(sample, np.uint64), leaves)

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(leaf, indices)``; a point whose link may lie across a radius has more than one leaf."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            v, radius, inner, outer = node
            d = np.bitwise_count(points[at] ^ np.uint64(v))
            todo += [(inner, at[d <= radius]), (outer, at[d > radius - self.bits])]


def _link_leaf(points: np.ndarray, at: np.ndarray, union, bits: int) -> None:
    """Joins all linked points of a leaf by spreading from one to its neighbours; memory is linear."""
    left = at
    while len(left) > 1:
        front, left = left[:1], left[1:]
        seed = int(front[0])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for p in points[front]:
                near |= np.bitwise_count(points[left] ^ p) <= bits
            front, left = left[near], left[~near]
            for k in front.tolist():
                union(seed, k)


def link_shard(points: np.ndarray, bits: int = BITS, leaf: int = LEAF) -> np.ndarray:
    """For each point the smallest index of its linked group, exactly."""
    parent = list(range(len(points)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def union(a: int, b: int) -> None:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    rng = np.random.default_rng(11)
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) > leaf:
            v = points[at[rng.integers(len(at))]]
            d = np.bitwise_count(points[at] ^ v)
            radius = int(np.median(d))
            inner, outer = at[d <= radius], at[d > radius - bits]
            if max(len(inner), len(outer)) <= 0.9 * len(at):
                todo += [inner, outer]
                continue
        if len(at) <= 2 * leaf:  # most points have no neighbour: leave those out at once
            x = points[at]
            near = (np.bitwise_count(x[:, None] ^ x[None, :]) <= bits).sum(axis=1) > 1
            at = at[near]
        _link_leaf(points, at, union, bits)
    return np.array([find(k) for k in range(len(points))], np.int64)


def edges(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """``u, v`` with u > v: each fingerprint of a linked group of a shard, and the group's smallest; ``nodes`` has distinct ``fp``.

    Beyond ``MAX_SHARDS`` times ``SHARD_NODES`` nodes shards grow instead of their number: at 10^10 nodes
    one has about a million fingerprints of eight bytes.
    """
    spark = nodes.sparkSession
    count = nodes.count()
    shards = 1
    while shards < MAX_SHARDS and shards * SHARD_NODES < count:
        shards *= 2
    shards = max(shards, 64)
    sample = nodes.orderBy(F.xxhash64("fp"), "fp").limit(shards * SAMPLED).select("fp").toPandas()["fp"].to_numpy(np.int64, copy=True)
    tree = spark.sparkContext.broadcast(VantageTree(sample.view(np.uint64), shards, bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for shard, at in tree.value.route(fps.view(np.uint64)):
                yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(at), shard, np.int32)), "fp": pa.array(fps[at])})

    def link(group: pa.Table) -> pa.Table:
        fps = np.sort(group.column("fp").to_numpy())
        root = link_shard(fps.view(np.uint64), bits)
        moved = root != np.arange(len(fps))
        return pa.table({"u": pa.array(fps[moved]), "v": pa.array(fps[root[moved]])})

    dealt = nodes.select("fp").mapInArrow(deal, "shard int, fp long")
    return dealt.groupBy("shard").applyInArrow(link, "u long, v long").distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``u, v``: every node that isn't its component's smallest, and that smallest node (u > v throughout)."""
    now = stash(edges, "edges")
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state or not state[0]:
            return now
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("k"), F.least("u", "w").alias("w")), "star")
        large = stash(both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct(), "large")
        low = stash(large.groupBy("u").agg(F.min("v").alias("w")).withColumnRenamed("u", "k"), "low")
        small = large.join(low, F.col("u") == F.col("k")).filter("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        after = stash(small.unionByName(low.select(F.col("k").alias("u"), F.col("w").alias("v"))).distinct(), "edges")
        discard(now, least, large, low)
        now = after
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def components(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, fp, root, component_id`` of each document; root is the component's smallest fingerprint."""
    prints = stash(with_fingerprints(docs), "prints")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = connected(edges(nodes, bits)).select(F.col("u").alias("k"), F.col("v").alias("root"))
    rooted = stash(nodes.join(roots, F.col("fp") == F.col("k"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    firsts = stash(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "r"), "firsts")
    known = stash(rooted.join(firsts, F.col("root") == F.col("r")).select(F.col("fp").alias("k"), "root", "component_id"), "known")
    return prints.join(known, F.col("fp") == F.col("k")).select("doc_id", "fp", "root", "component_id")
