"""Near-duplicate documents: SimHash and vantage-point trees, then the exact Jaccard similarity of 5-word shingles.

Documents with one set of shingles are one node, with a SimHash fingerprint of that set. Candidates come
from two sides, and a candidate pair links only if the sets themselves have a similarity of 0.8 or more:

* Fingerprints within ``simhash.BITS`` bits, by the vantage-point trees of ``simhash``. Sets with a
  similarity of 0.8 differ in ten of 64 bits on average and in up to twenty, a distance at which no
  branch of such a tree can be pruned (unrelated fingerprints differ in 32, give or take 4).
* So farther pairs come from minimum hashes: a node's least hashes in ``BANDS`` bands of ``ROWS`` give
  keys, and two sets with a similarity of 0.8 share a key but for about 3 cases in a million.

A first round holds each node against the smallest node that it shares a fingerprint's group or a key
with, so that a large group of near copies becomes one component after one pair a node. The second round
takes the pairs that are in different components even then. Of keys of at most ``BUCKET`` nodes these
become rows. Larger keys are compared in tasks, which return no more links than join the components:
they are dealt into parts of about ``PART_NODES`` nodes, and each part is compared in itself. The third round
takes the keys of several parts that hold different components even then, and compares each part with each
other one, so no pair that shares a key goes uncompared. Only sets of such keys are copied, once for each part
of the key; what the tasks return never grows with the square of a group.

Defined results: texts without a word (null, empty, white space) are copies of each other; fewer than
five words are one shingle. Of each group one row stays, with all its columns: of the rows with the
smallest id (rows without one come last), one of those with the smallest set number. Rows that repeat
an id but differ in text are told apart by their sets. An empty table gives an empty table. The input
may have columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, stash, unused

SHINGLE, SEED = 5, 42
#: Pairs link from a Jaccard similarity of LEAST[0] / LEAST[1].
LEAST = (4, 5)
BANDS, ROWS = 24, 4
#: Nodes of a key up to which all its pairs that are still apart become rows; those of larger keys are compared in tasks.
BUCKET = 64
#: Nodes and shingles of one part of a large key (a task holds one or two), and shingles that are counted at once.
PART_NODES, PART_SHINGLES, COLUMNS = 512, 1_000_000, 4096
#: Rows that a Python worker returns at once.
SLICE = 512

_RNG = np.random.default_rng(7)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, BANDS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The XXH64 hashes of the text's shingles, each once, in order."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(islice(words, k, None) for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64))


def node_of(found: np.ndarray) -> int:
    """One number for a set of shingles."""
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes(), SEED), np.uint64).view(np.int64))


def fingerprint_of(found: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed long."""
    totals = np.zeros(64, np.int64)
    for k in range(0, len(found), 50_000):
        totals += np.unpackbits(found[k : k + 50_000].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(totals * 2 > len(found)).view(np.int64)[0])


def keys_of(found: np.ndarray) -> np.ndarray:
    """A key for each band; none of an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 512):
        np.minimum(least, (found[k : k + 512, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return ((least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            yield batch.slice(k, SLICE)
    pa.default_memory_pool().release_unused()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _prints(docs: DataFrame) -> DataFrame:
    """``doc_id, node, n, fp, keys`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "node": pa.array([node_of(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                "fp": pa.array([fingerprint_of(s) for s in sets], pa.int64()), "keys": pa.array([keys_of(s) for s in sets], pa.list_(pa.int64())),
            })

    return _texts(docs).mapInArrow(run, "doc_id long, node long, n long, fp long, keys array<long>")


def _named(docs: DataFrame, column: str) -> DataFrame:
    """Adds each row's node."""
    tagged = docs.withColumn(column, F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            nodes = pa.array([node_of(shingles(t.as_py())) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], nodes], names=batch.schema.names)

    return tagged.mapInArrow(run, tagged.schema)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, found``: the sets of the nodes in ``wanted`` (``node, first_id``: one of its documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"node": pa.array([node_of(s) for s in sets], pa.int64()), "found": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    rows = _texts(docs)
    chosen = rows.join(wanted.select(F.col("first_id").alias("doc_id")), "doc_id", "left_semi").unionByName(rows.filter("doc_id is null"))
    found = chosen.select("text").mapInArrow(run, "node long, found array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``u, v`` whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("found").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("found").alias("a")), "u")
    shared = both.select("u", "v", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("both"))
    return shared.filter(F.col("both") * LEAST[1] >= (F.col("n") - F.col("both")) * LEAST[0]).select("u", "v")


def _fits(a: str, b: str) -> F.Column:
    return F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]


def _near_prints(nodes: DataFrame) -> DataFrame:
    """``u, v``: each node, and the least node of the group of fingerprints that its own is in."""
    prints = stash(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fps")
    roots = simhash.connected(simhash.edges(prints)).select(F.col("u").alias("f"), F.col("v").alias("r"))
    grouped = stash(nodes.select("node", "fp").join(roots, F.col("fp") == F.col("f"), "left").select("node", F.coalesce("r", "fp").alias("g")), "groups")
    least = grouped.groupBy("g").agg(F.min("node").alias("v")).withColumnRenamed("g", "h")
    return grouped.join(least, F.col("g") == F.col("h")).filter("v < node").select(F.col("node").alias("u"), "v")


def _roots(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """``u, v``: every node that isn't its component's smallest, and that smallest node."""
    nodes = stash(prints.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    rows = stash(nodes.select("node", "n", F.explode("keys").alias("key")), "keys")
    shared = rows.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("node", "n")).alias("hub")).filter("c > 1")
    shared = shared.select(F.col("key").alias("k"), "c", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    members = stash(rows.join(shared, F.col("key") == F.col("k")).drop("k"), "members")
    discard(rows)
    near = stash(_near_prints(nodes), "near")
    wanted = members.select("node").unionByName(near.select(F.col("u").alias("node"))).unionByName(near.select(F.col("v").alias("node"))).distinct()
    sets = stash(_sets(docs, nodes.select("node", "first_id").join(wanted, "node", "left_semi")), "sets")
    to_hub = members.filter((F.col("hub") < F.col("node")) & _fits("n", "hub_n")).groupBy(F.col("node").alias("u")).agg(F.min("hub").alias("v"))
    links = stash(_verified(stash(to_hub.unionByName(near).distinct(), "to-hub"), sets), "links")
    so_far = simhash.connected(links)
    small = F.col("c") <= BUCKET
    open_ = stash(_apart(members, so_far), "open")
    other = open_.filter(small).select("key", F.col("node").alias("v"), F.col("n").alias("v_n"), F.col("root").alias("v_root"))
    inside = open_.filter(small).withColumnRenamed("node", "u").join(other, "key").filter((F.col("u") > F.col("v")) & (F.col("root") != F.col("v_root")) & _fits("n", "v_n")).select("u", "v")
    pairs = stash(inside.distinct(), "pairs")
    dealt = stash(_dealt(open_.filter(~small)), "dealt")
    within = _compared(dealt.select("key", F.col("part").alias("lo"), F.col("part").alias("hi"), "node", "root"), sets)
    last = stash(links.unionByName(_verified(pairs, sets)).unionByName(within).distinct(), "last")
    joined = simhash.connected(last)
    apart = stash(_apart(dealt.filter("parts > 1").drop("root"), joined), "apart")
    found = joined if apart.isEmpty() else simhash.connected(last.unionByName(_compared(_two_parts(apart), sets)).distinct())
    discard(nodes, members, near, sets, links, so_far, open_, pairs, dealt, last, apart)
    return found


def _dealt(members: DataFrame) -> DataFrame:
    """``key, parts, part, node, root``: parts of about ``PART_NODES`` nodes and ``PART_SHINGLES`` shingles."""
    total = members.groupBy("key").agg(F.count("*").alias("many"), F.sum("n").alias("weight"))
    parts = total.select("key", F.ceil(F.greatest(F.col("many") / PART_NODES, F.col("weight") / PART_SHINGLES)).alias("parts"))
    return members.join(parts, "key").select("key", "parts", F.pmod(F.xxhash64("node", "key"), F.col("parts")).alias("part"), "node", "root")


def _apart(members: DataFrame, so_far: DataFrame) -> DataFrame:
    """``members`` with their roots, of the keys that hold several roots."""
    now = _rooted(members, so_far, "node", "root")
    split = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    return now.join(split, "key", "left_semi")


def _two_parts(dealt: DataFrame) -> DataFrame:
    """``key, lo, hi, node, root``: each node once for each other part of its key."""
    facing = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("other <> part")
    return facing.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "root")


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v``: links that join what is linked among the nodes of each ``key, lo, hi``, compared in one task."""
    return rows.join(sets, "node").select("key", "lo", "hi", "node", "root", "found").groupBy("key", "lo", "hi").applyInArrow(_joined, "u long, v long")


def _joined(group: pa.Table) -> pa.Table:
    group = group.combine_chunks().sort_by("node")
    nodes, roots, found = (group.column(c).combine_chunks() for c in ("node", "root", "found"))
    u, v = joining(nodes.to_numpy(), roots.to_numpy(), found.values.to_numpy(), found.value_lengths().to_numpy())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def joining(nodes: np.ndarray, roots: np.ndarray, shingle: np.ndarray, sizes: np.ndarray) -> tuple[list[int], list[int]]:
    """Links between nodes of different roots, as few as join all that are linked; the sets stand one after the other in ``shingle``."""
    k = len(nodes)
    kinds, at, many = np.unique(shingle, return_inverse=True, return_counts=True)
    common = many > 1
    column = (np.cumsum(common) - 1)[at]
    row = np.repeat(np.arange(k), sizes)[common[at]]
    column = column[common[at]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((k, k), np.float32)
    for low in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        block = np.zeros((k, COLUMNS), np.float32)
        block[row[a:b], column[a:b] - low] = 1
        both += block @ block.T
    linked = both.astype(np.int64) * sum(LEAST) >= (sizes[:, None] + sizes[None, :]) * LEAST[0]
    linked &= roots[:, None] != roots[None, :]
    parent = {int(r): int(r) for r in roots}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    u, v = [], []
    for i, j in np.argwhere(np.tril(linked)).tolist():
        x, y = find(int(roots[i])), find(int(roots[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            u.append(int(nodes[i]))
            v.append(int(nodes[j]))
    return u, v


def _rooted(df: DataFrame, so_far: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the root of the node in ``column``."""
    return df.join(so_far.select(F.col("u").alias("__u"), F.col("v").alias("__v")), F.col(column) == F.col("__u"), "left").withColumn(name, F.coalesce("__v", column)).drop("__u", "__v")


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, node, root`` of each document; documents with one root are one group."""
    prints = stash(_prints(docs), "prints")
    roots = _roots(docs, prints).select(F.col("u").alias("k"), F.col("v").alias("root"))
    return prints.join(roots, F.col("node") == F.col("k"), "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, with all its columns."""
    found = stash(components(docs), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "node")
    stay = stash(found.groupBy("root").agg(F.min(rank).alias("w")).select("w.doc_id", "w.node"), "stay")
    # an id that stands for one row only is enough to find it; rows of other ids, and without one, are told apart by node
    single = found.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows = 1 and doc_id is not null").select("doc_id")
    own_id, node = unused(docs, "own_id"), unused(docs, "node")
    tagged = docs.withColumn(own_id, F.col("doc_id").cast("long"))
    plain = stay.join(single, "doc_id", "left_semi").select(F.col("doc_id").alias(own_id))
    kept = tagged.join(plain, own_id, "left_semi").select(docs.columns)
    several = stash(stay.join(single, "doc_id", "left_anti"), "several")
    repeated = tagged.join(several.filter("doc_id is not null").select(F.col("doc_id").alias(own_id)), own_id, "left_semi").unionByName(tagged.filter(F.col(own_id).isNull()))
    name, whose = unused(docs, "name"), unused(docs, "whose")
    wanted = several.select(F.col("node").alias(name), F.col("doc_id").alias(whose))
    same = (F.col(node) == F.col(name)) & F.col(own_id).eqNullSafe(F.col(whose))
    return kept.unionByName(_named(repeated, node).join(wanted, same, "left_semi").dropDuplicates([own_id, node]).select(docs.columns))
