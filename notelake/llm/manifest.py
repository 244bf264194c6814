"""Merkle dataset manifest: a tree for each language over its rows, one tree over those, and a witness for every row.

A leaf is the SHA-256 of a row's fields, each written as its byte count, a colon and its value, or ``-`` if
null. Of nodes in order, every eight consecutive ones (the last run: what is left) become the digest of their
concatenation, until one remains. Nodes are appended one by one; a run that is complete closes its subtree, and
each leaf below gets the run's other nodes appended to its witness, which so grows from the leaf upwards.

Rows get their places by a range partitioning: places within partitions, and counts of partitions. Blocks of
4096 aligned places are appended to in tasks of their own. The roots of blocks are then appended as leaves of
the next tier, in aligned blocks again, until a language has one root. So no task sees more than a block, and
the trees of languages with few and with most rows are built alike. The languages' roots are the leaves of the
last tree.

Defined results: null fields are ``-``, an empty text is ``0:``; a null language stands first, null ids stand
first in their language, rows with equal ids are in order of their leaves, and repeated rows are leaves each. The
only row of a language is its root. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stash

ARITY = 8
#: Levels of a block, whose 4096 nodes one task appends.
LEVELS = 4
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a table of offsets or paths up to which it is sent to all tasks (a path has some kilobytes at most).
SMALL = 10_000

PATH = "array<struct<left:string,right:string>>"


def digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Appender:
    """Appends nodes to a tree of a known number of levels; ``witness[k]`` holds what is left and right of node k's path so far, level by level."""

    def __init__(self, levels: int):
        self.levels, self.root = levels, None
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(levels)]
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, node: str) -> None:
        k = len(self.witness)
        self.witness.append([])
        self._put(0, (node, k, k + 1))

    def _put(self, level: int, node: tuple[str, int, int]) -> None:
        if level == self.levels:
            self.root = node[0]
            return
        run = self.open[level]
        run.append(node)
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [n for n, _, _ in run]
        for k, (_, first, end) in enumerate(run):
            beside = ("".join(nodes[:k]), "".join(nodes[k + 1 :]))
            for leaf in range(first, end):
                self.witness[leaf].append(beside)
        self._put(level + 1, (digest(nodes), run[0][1], run[-1][2]))

    def finish(self) -> str:
        """Closes what is open, from below; the root."""
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return self.root


def appended(nodes: Sequence[str], total: int, levels: int) -> Appender:
    """The tree over an aligned block of a row of ``total`` nodes: of one block up to one root, of several all its ``levels``."""
    tree = Appender(min(levels, levels_of(total)))
    for node in nodes:
        tree.append(node)
    tree.finish()
    return tree


def leaf(fields: Sequence[Column]) -> Column:
    """The leaf of a row: SHA-256 of its fields with their byte counts."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(path: Column | str, node: Column | str) -> Column:
    """The root that a leaf and its path give."""
    start = F.col(node) if isinstance(node, str) else node
    return F.aggregate(path, start, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof(path: Column | str) -> Column:
    """SHA-256 of a path's nodes, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a text column ``key``), written, with ``pos`` in the order within the key and ``total`` rows of it."""
    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            for key in batch.column("key").to_pylist():
                n = n + 1 if key == last else 0
                last = key
                local.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())], names=[*batch.schema.names, "part", "local"])

    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    placed = stash(dealt.mapInArrow(run, f"{schema}, part int, local long"), "manifest-rows")
    # a row for each key of each partition
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    of_key = Window.partitionBy("key")
    offsets = stash(counts.select("key", "part", F.coalesce(F.sum("n").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(of_key).alias("total")), "manifest-offsets")
    found = placed.join(_sent(offsets), ["key", "part"]).select(*rows.columns, (F.col("before") + F.col("local")).alias("pos"), "total")
    found._sources = (placed, offsets)
    return found


def _sent(table: DataFrame) -> DataFrame:
    """``table`` (written), broadcast if it has few rows; else the join shuffles by keys that none is hot in."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def _tier(nodes: DataFrame, levels: int) -> DataFrame:
    """``key, pos, above, path, total``, written, of ``key, pos, node, total``: each node's path within its block, and the block's root in ``above``."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("pos")
        tree = appended(rows.column("node").to_pylist(), rows.column("total")[0].as_py(), levels)
        paths = [[{"left": a, "right": b} for a, b in w] for w in tree.witness]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"key": rows.column("key"), "pos": rows.column("pos"), "above": pa.array([tree.root] * len(paths), pa.string()), "path": pa.array(paths, kind), "total": rows.column("total")})

    blocks = nodes.groupBy("key", (F.col("pos") / ARITY**levels).cast("long").alias("block"))
    return stash(blocks.applyInArrow(run, f"key string, pos long, above string, path {PATH}, total long"), "manifest-tier")


def _climb(nodes: DataFrame, levels: int) -> DataFrame:
    """``key, pos, path, root`` of ``key, pos, node, total``: paths up to the one root of each key, tier by tier."""
    size = ARITY**levels
    tiers = [_tier(nodes, levels)]
    while tiers[-1].filter(F.col("total") > size).limit(1).count():
        one = tiers[-1].filter(F.col("pos") % size == 0)
        tiers.append(_tier(one.select("key", (F.col("pos") / size).cast("long").alias("pos"), F.col("above").alias("node"), F.ceil(F.col("total") / size).alias("total")), levels))
    paths = tiers[-1].select("key", "pos", "path", F.col("above").alias("root"))
    for tier in reversed(tiers[:-1]):
        upper = paths.select("key", F.col("pos").alias("__block"), F.col("path").alias("__more"), "root")
        paths = tier.withColumn("__block", (F.col("pos") / size).cast("long")).join(upper, ["key", "__block"]).select("key", "pos", F.concat("path", "__more").alias("path"), "root")
    out = stash(paths, "manifest-paths")
    discard(*tiers)
    return out


def _blocks(rows: DataFrame, carried: list[str], levels: int) -> DataFrame:
    """``key, block, total, node, rows``, written: aligned blocks of rows and their roots."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("pos")
        tree = appended(rows.column("leaf").to_pylist(), rows.column("total")[0].as_py(), levels)
        packed = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in carried], names=carried)
        first = rows.slice(0, 1)
        return pa.table({
            "key": first.column("key"), "block": pa.array([first.column("pos")[0].as_py() // ARITY**levels], pa.int64()), "total": first.column("total"), "node": pa.array([tree.root], pa.string()),
            "rows": pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), packed),
        })

    kinds = dict(rows.dtypes)
    fields = ", ".join(f"{c}: {kinds[c]}" for c in carried)
    return stash(rows.groupBy("key", (F.col("pos") / ARITY**levels).cast("long").alias("block")).applyInArrow(run, f"key string, block long, total long, node string, rows array<struct<{fields}>>"), "manifest-blocks")


def witnesses(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``leaves`` (``doc_id, lang, leaf`` and more) with ``subroot``, ``root`` and ``path``: what is left and right of each row's way to the root."""
    carried = [c for c in leaves.columns if c != "lang"]
    # languages in bytewise order, null before all; the salt parts rows that are repeated very often
    keyed = stash(leaves.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("key"), *carried, F.rand(13).alias("salt")), "manifest-leaves")
    numbered = _numbered(keyed, ["doc_id", "leaf", "salt"])
    blocks = _blocks(numbered.drop("salt"), carried, levels)
    discard(keyed, *numbered._sources)
    of_lang = _climb(blocks.select("key", F.col("block").alias("pos"), "node", F.ceil(F.col("total") / ARITY**levels).alias("total")), levels)
    subroots = of_lang.filter("pos = 0").select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("root").alias("node"))
    places = _numbered(subroots, ["of"])
    top = _climb(places.select("key", "pos", "node", "total"), levels)
    ways = places.select("of", "pos", F.col("node").alias("subroot")).join(top.select("pos", F.col("path").alias("__more"), F.col("root")), "pos").select(F.col("of").alias("key"), "subroot", "__more", "root")
    above = stash(of_lang.drop("root").join(_sent(stash(ways, "manifest-ways")), "key").select("key", F.col("pos").alias("block"), "subroot", "root", F.concat("path", "__more").alias("above")), "manifest-above")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                block = {c: batch.column(c)[n] for c in ("total", "rows", "subroot", "root", "above")}
                rows = block["rows"].values
                tree = appended(rows.field("leaf").to_pylist(), block["total"].as_py(), levels)
                more = [(s["left"], s["right"]) for s in block["above"].as_py()]
                left, right, ends = [], [], [0]
                for w in tree.witness:
                    for a, b in (*w, *more):
                        left.append(a)
                        right.append(b)
                    ends.append(len(left))
                sides = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
                repeated = [pa.array([block[c].as_py()] * len(rows), pa.string()) for c in ("subroot", "root")]
                yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in carried), *repeated, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sides)], names=[*carried, "subroot", "root", "path"])

    kinds = dict(leaves.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in carried) + f", subroot string, root string, path {PATH}"
    return blocks.join(_sent(above), ["key", "block"]).select("total", "rows", "subroot", "root", "above").mapInArrow(run, schema)


def fields_of(docs: DataFrame) -> list[Column]:
    return [F.col(c) for c in FIELDS]


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, path`` of every row: its entry in the manifest, which ``verify`` needs and nothing else."""
    return witnesses(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(fields_of(docs)).alias("leaf")))


def verify(entries: DataFrame, docs: DataFrame, root: str) -> DataFrame:
    """``doc_id, verified``: whether a row of ``docs`` as it is now leads to ``root`` along its path in ``entries``; ids are unique."""
    now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), leaf(fields_of(docs)).alias("now"))
    return now.join(entries.select("doc_id", "path"), "doc_id", "left").select("doc_id", F.coalesce(fold("path", "now") == root, F.lit(False)).alias("verified"))


def with_tampered(docs: DataFrame, changed: Column, text: Column, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, other``: ``other`` is the leaf of the row with ``text`` where it was ``changed``, else the leaf."""
    own = fields_of(docs)
    other = leaf([*own[:-1], text])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(own).alias("leaf"), F.when(changed, other).alias("changed"))
    return witnesses(rows, levels).withColumn("other", F.coalesce("changed", "leaf")).drop("changed")

