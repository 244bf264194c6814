"""Exact top-k search: columnar branch-and-bound over integer inner products.

Candidates lie in blocks of columns (a row for each dimension). A query adds up products dimension block
by dimension block, its heaviest dimensions first, and after each block compacts the candidates to those
that could still reach its k-th best so far if what is left of both vectors pointed the same way
(Cauchy-Schwarz on the remaining mass). What survives all blocks has its exact score. The k-th best
starts from a bounded sample of all vectors that each query is scored against once, and only rises.

Candidates and queries meet in a grid: a cell of it has one lane of candidates and one group of queries,
both of bounded size; the numbers of lanes and groups grow with the rows. Blocks hold vectors of like
length, and groups hold queries of like need: the length that a candidate must have to reach the k-th best
so far. A block goes to the groups whose least need its longest vector meets, and within a cell the longest
blocks come first. (Vectors of one length, as normalised ones are, all go everywhere.)

Components are floor(scale * x), x as double. Scores are added in double precision where every sum
is below 2^53, and in 64-bit integers otherwise (they must fit).

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows
without an id. Vectors meet those of their own length only. Ties go to the smaller id. Rows that
repeat an id are candidates each, but none is a candidate for its own id; as a query such an id has
the least of its vectors. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stash

#: Vectors in a block of candidates, of queries; dimensions that are added up between two tests.
CANDIDATES, QUERIES, DIMENSIONS = 2048, 512, 8
#: Candidates of a lane and queries of a group, as dealt; lanes that are made at least if there are blocks enough.
LANE, GROUP, LANES = 1 << 16, 1 << 11, 48
#: Vectors that every query is scored against first.
SEEDS = 4096


def _cells(rows: list, dim: int) -> tuple[np.ndarray, bool]:
    """A row for each dimension; 32-bit integers where they are enough."""
    cells = np.ascontiguousarray(np.array(rows, np.int64).reshape(len(rows), dim).T)
    narrow = not cells.size or -(2**31) <= cells.min() and cells.max() < 2**31
    return (cells.astype(np.int32), True) if narrow else (cells, False)


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """``part, dim, n, ids, narrow, cells, longest, least``: up to ``size`` vectors with one length and ``part``, as they follow each other, dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list, list, list]] = {}
        part = 0

        def close(dim: int) -> pa.RecordBatch:
            ids, rows, least = open_.pop(dim)
            cells, narrow = _cells(rows, dim)
            of = {"part": ([part], pa.int64()), "dim": ([dim], pa.int32()), "n": ([len(ids)], pa.int32()), "ids": ([np.array(ids, np.int64).tobytes()], pa.binary()), "narrow": ([narrow], pa.bool_()), "cells": ([cells.tobytes()], pa.binary())}
            of |= {"longest": ([float(_lengths(cells).max(initial=0))], pa.float64()), "least": ([np.array(least, float).tobytes()], pa.binary())}
            return pa.RecordBatch.from_pydict({name: pa.array(x, kind) for name, (x, kind) in of.items()})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "vec_id", "least")]
            for at, vec_id, reached, v in zip(*columns, batch.column("v"), strict=True):
                if at != part:
                    yield from [close(dim) for dim in list(open_)]
                    part = at
                values = v.values.to_numpy(zero_copy_only=False)
                ids, rows, least = open_.setdefault(len(values), ([], [], []))
                ids.append(vec_id)
                rows.append(values)
                least.append(reached)
                if len(ids) == size:
                    yield close(len(values))
        for dim in list(open_):
            yield close(dim)

    return vectors.select("part", "vec_id", "v", "least").mapInArrow(run, "part long, dim int, n int, ids binary, narrow boolean, cells binary, longest double, least binary")


def _lengths(cells: np.ndarray) -> np.ndarray:
    real = cells.astype(float)
    return np.sqrt(np.einsum("ij,ij->j", real, real))


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cells of a block."""
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["cells"], np.int32 if row["narrow"] else np.int64).reshape(row["dim"], len(ids)).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Search:
    """Best candidates so far for a block of queries; ``tested[j]`` counts the candidates that dimension block j was added for."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.cells, self.k = ids, cells, k
        #: Scores that the k-th best reaches at least.
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.order = np.argsort(-np.abs(cells), axis=0, kind="stable")
        ordered = np.take_along_axis(cells, self.order, axis=0).astype(float) ** 2
        self.ends = list(range(DIMENSIONS, len(cells), DIMENSIONS)) + [len(cells)]
        self.length = _lengths(cells)
        #: Length of what is left of each query behind each end.
        self.left = np.array([np.sqrt(ordered[e:].sum(axis=0)) for e in self.ends]).reshape(len(self.ends), len(ids))
        self.tested = np.zeros(len(self.ends), np.int64)

    def exact_kind(self, cells: np.ndarray) -> type:
        most = float(np.abs(self.cells).max(initial=0)) * float(np.abs(cells).max(initial=0)) * len(cells)
        return np.float64 if most < 2**53 else np.int64

    def add(self, ids: np.ndarray, cells: np.ndarray) -> None:
        kind = self.exact_kind(cells)
        ours, theirs = self.cells.astype(kind), cells.astype(kind)
        real = cells.astype(float)
        mass = np.einsum("ij,ij->j", real, real)
        lengths = np.sqrt(mass) * (1 + 1e-9)
        shortest, longest = lengths.min(initial=np.inf), lengths.max(initial=0)
        for k in range(len(self.ids)):
            order, least, own = self.order[:, k], self.least[k], self.length[k]
            if longest * own + 1 < least:
                continue
            alive = np.flatnonzero(ids != self.ids[k])
            if shortest * own + 1 < least:
                alive = alive[lengths[alive] * own + 1 >= least]
            whole = len(alive) == len(ids)
            total, rest, all_mass = np.zeros(len(alive), kind), mass[alive], mass[alive]
            begin = 0
            for j, end in enumerate(self.ends):
                rows = order[begin:end]
                part = theirs[rows] if whole else theirs[rows[:, None], alive]
                self.tested[j] += len(alive)
                total = total + ours[rows, k] @ part
                begin = end
                if end == len(cells):
                    break
                part = part.astype(float, copy=False)
                rest = rest - np.einsum("ij,ij->j", part, part)
                # what rounding may have taken away is added again
                reach = total + self.left[j, k] * np.sqrt(np.maximum(rest, 0) + 1e-9 * all_mass) * (1 + 1e-9) + 1
                stay = reach >= least
                if not stay.all():
                    alive, total, rest, all_mass, whole = alive[stay], total[stay], rest[stay], all_mass[stay], False
                    if not len(alive):
                        break
            ok = total >= least
            if len(alive) and ok.any():
                old_ids, old = self.found[k]
                self.found[k] = got = _best(np.concatenate([old_ids, ids[alive[ok]]]), np.concatenate([old, total[ok].astype(np.int64)]), self.k)
                if len(got[0]) == self.k:
                    self.least[k] = max(self.least[k], got[1][-1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(self.ids, [len(i) for i, _ in self.found]), np.concatenate([i for i, _ in self.found]), np.concatenate([s for _, s in self.found])


def seeded(ids: np.ndarray, cells: np.ndarray, seeds: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """For each query the k-th best score among the sample, its own id left out; minus infinity if the sample is too small."""
    least = np.full(len(ids), -np.inf)
    if len(cells) not in seeds:
        return least
    seed_ids, seed_cells = seeds[len(cells)]
    kind = Search(ids[:0], cells[:, :0], k).exact_kind(seed_cells) if not len(ids) else Search(ids, cells, k).exact_kind(seed_cells)
    scores = cells.T.astype(kind) @ seed_cells.astype(kind)
    for q in range(len(ids)):
        own = scores[q, seed_ids != ids[q]]
        if len(own) >= k:
            least[q] = np.partition(own, len(own) - k)[len(own) - k]
    return least


def with_need(asked: DataFrame, seeds: Broadcast, k: int) -> DataFrame:
    """Queries with ``least``, what the k-th best score reaches at least by the sample, and ``need``, the length that a candidate must have to reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("vec_id").to_numpy(), [v.values.to_numpy(zero_copy_only=False) for v in batch.column("v")]
            dims, least, need = np.array([len(r) for r in rows]), np.full(len(rows), -np.inf), np.zeros(len(rows))
            for dim in np.unique(dims):
                for at in np.array_split(np.flatnonzero(dims == dim), -(-np.count_nonzero(dims == dim) // QUERIES)):
                    cells, _ = _cells([rows[n] for n in at], dim)
                    least[at] = seeded(ids[at], cells.astype(np.int64), seeds.value, k)
                    need[at] = np.divide(least[at], _lengths(cells), out=np.zeros(len(at)), where=least[at] > 0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(least), pa.array(need)], ["vec_id", "v", "least", "need"])

    return asked.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<bigint>, least double, need double")


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates with the highest inner products for each query."""
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    whole = usable.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    size = whole.agg(F.count("*").alias("all"), F.count_if(is_query).alias("asked")).first()
    lanes = max(-(-size["all"] // LANE), min(-(-size["all"] // CANDIDATES), LANES), 1)
    groups = max(-(-size["asked"] // GROUP), 1)
    # a sample of bounded size, a few rows of each length that occurs in it
    sample: dict[int, tuple[list, list]] = {}
    for r in whole.orderBy(F.xxhash64("vec_id", F.lit("seed")), "vec_id", "v").limit(SEEDS).collect():
        ids, rows = sample.setdefault(len(r["v"]), ([], []))
        ids.append(r["vec_id"])
        rows.append(r["v"])
    seeds = spark.sparkContext.broadcast({dim: (np.array(ids, np.int64), _cells(rows, dim)[0]) for dim, (ids, rows) in sample.items()})
    asked = stash(with_need(whole.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), seeds, k), "queries")
    # a number for each group: its members need at least that length
    share = [n / groups for n in range(1, groups)]
    cuts = sorted(asked.agg(F.percentile_approx("need", share, 100 * groups).alias("cuts")).first()["cuts"] or []) if share else []
    needs = spark.sparkContext.broadcast(np.array([0.0, *cuts]))

    def group_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need, mark = batch.column("need").to_numpy(), batch.column("mark").to_numpy()
            low, high = (np.searchsorted(needs.value[1:], need, side) for side in ("left", "right"))
            # queries of one need may be so many that several groups begin with it
            yield batch.set_column(batch.schema.get_field_index("part"), "part", pa.array(low + mark % (high - low + 1), pa.int64()))

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.searchsorted(needs.value, batch.column("longest").to_numpy() * (1 + 1e-9), "right")
            yield batch.set_column(batch.schema.get_field_index("part"), "part", pa.array(n, pa.int64()))

    long = "part long, vec_id long, v array<bigint>, least double, need double, mark long"
    marked = asked.select(F.lit(0).cast("long").alias("part"), "vec_id", "v", "least", "need", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)).alias("mark"))
    ours = blocks(marked.mapInArrow(group_of, long).repartition("part").sortWithinPartitions("part"), QUERIES)
    ours = ours.select("dim", "n", "ids", "narrow", "cells", "least", F.col("part").alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))
    by_length = whole.select(F.lit(0).cast("long").alias("part"), "vec_id", "v", F.lit(0.0).alias("least")).sortWithinPartitions(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).desc())
    theirs = blocks(by_length, CANDIDATES)
    theirs = theirs.mapInArrow(copies, theirs.schema).filter("part > 0").select("dim", "n", "ids", "narrow", "cells", "longest", F.pmod(F.xxhash64("ids", "cells"), F.lit(lanes)).alias("lane"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("part") - 1)).alias("group"))

    def cell(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        longest_first = np.argsort(-candidates.column("longest").to_numpy(), kind="stable")
        for query in queries.to_pylist():
            ids, cells = unpack(query)
            now = Search(ids, cells, k, np.frombuffer(query["least"], float))
            for n in longest_first:
                now.add(*unpack(candidates.slice(n, 1).to_pylist()[0]))
            out.append(now.rows())
        columns = [np.concatenate([x[j] for x in out]) if out else np.zeros(0, np.int64) for j in range(3)]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    key = ["lane", "group", "dim"]
    found = theirs.groupBy(*key).cogroup(ours.groupBy(*key)).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
