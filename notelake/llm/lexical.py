"""Ranked lexical search over bit-sliced Bloom signatures.

Documents lie in blocks of about one size. A document's signature has, for each of its terms and for each power
of two that the term's count reaches, three bits; a block stores signatures bit by bit, so a bit of all its
documents is a bitmap. The bitmaps of a term's bits, ANDed, mark every document that holds the term (that often)
and a few others. Each mark is worth the term's weight times the most that such a count can score at the
document's length; the sum over marks is an upper bound of the score. From the highest bound down, documents are
scored exactly, from their stored counts, until no bound reaches the item's tenth score so far: what is left is
provably excluded.

``index`` reads all texts once and writes blocks and document frequencies; ``search`` reads only these. Items go
in groups of a bounded number of terms, each a pass over the blocks.

Defined results: null and empty texts and texts without a term are no documents of the index, and items without
a term that occurs have no rows. Repeated rows are documents each. Rows without an id count in all statistics and
are ranked behind equal scores, with a null ``doc_id``. Items that share an id have the terms of all of them; items
without an id have no rows. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stash
from .licenses import words

#: Bits of a term, and bits of a signature for each key that it has at most (so about 1 % of marks are wrong).
HASHES, BITS_PER_KEY = 3, 12
#: Bits of a block's bitmaps, most documents in a block, and bytes of stored terms after which it is closed.
BLOCK_BITS, BLOCK_DOCS, BLOCK_BYTES = 1 << 22, 4096, 1 << 22
#: Signatures for at most 2**CLASS keys are the smallest; terms that a task counts before it passes them on.
CLASS, FLUSH = 6, 200_000
#: Terms of a group of items (one item may have more), and marks that are added up at once.
GROUP_TERMS, CELLS = 100_000, 1 << 22
#: Distinct terms asked for up to which they are sent to all tasks that read document frequencies.
SMALL = 200_000

_STEP = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Hashes(dict):
    """Hashes of terms; forgets all of them when it has many."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= FLUSH:
            self.clear()
        self[term] = h = xxhash.xxh64_intdigest(term)
        return h


def shift(level: int) -> np.uint64:
    """What a term's hash is moved by for a power of two."""
    return np.uint64(level * _STEP % 2**64)


def keys_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A key for each term and each power of two up to its count."""
    out, level, left = [hashes], 1, np.flatnonzero(counts >= 2)
    while len(left):
        out.append(hashes[left] + shift(level))
        level += 1
        left = left[counts[left] >= 1 << level]
    return np.concatenate(out)


def bits_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """A row for each key: the numbers of its bits."""
    mixed = keys * _MIX
    mixed ^= mixed >> np.uint64(32)
    low, step = mixed & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def gain(count, m):
    """What a term's count gives at a document's ``m``, before its weight."""
    return 1_000_000_000 * count // (1000 * count + 8 * m)


class Block:
    """Documents whose signatures have one size."""

    def __init__(self, size: int):
        self.bits = BITS_PER_KEY << size
        self.room = max(8, min(BLOCK_DOCS, BLOCK_BITS // self.bits // 8 * 8))
        self.cells = np.zeros((self.bits, self.room // 8), np.uint8)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[bytes] = []
        self.counts: list[bytes] = []
        self.bytes = self.most = 0

    def add(self, doc_id: int | None, n: int, found: Counter, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Whether the block is full now."""
        j = len(self.ids)
        self.cells[np.unique(bits_of(keys, self.bits)), j >> 3] |= np.uint8(128 >> (j & 7))
        terms = b" ".join(found)
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.terms.append(terms)
        self.counts.append(counts.astype("<u4").tobytes())
        self.bytes += len(terms) + 4 * len(counts)
        self.most = max(self.most, int(counts.max()))
        return len(self.ids) == self.room or self.bytes >= BLOCK_BYTES

    def row(self) -> dict:
        width = -(-len(self.ids) // 8)
        return {
            "ids": self.ids, "lengths": self.lengths, "bits": self.bits, "most": self.most, "slices": np.ascontiguousarray(self.cells[:, :width]).tobytes(),
            "terms": self.terms, "counts": self.counts, "docs": len(self.ids), "words": sum(self.lengths), "term": None, "df": None,
        }


_ROW = "ids array<long>, lengths array<long>, bits int, most int, slices binary, terms array<binary>, counts array<binary>, docs long, words long, term binary, df long"
_ARROW = pa.schema([
    ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("bits", pa.int32()), ("most", pa.int32()), ("slices", pa.binary()), ("terms", pa.list_(pa.binary())),
    ("counts", pa.list_(pa.binary())), ("docs", pa.int64()), ("words", pa.int64()), ("term", pa.binary()), ("df", pa.int64()),
])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents, and terms with how many of the task's documents hold them."""
    known, seen, open_ = Hashes(), Counter(), {}

    def passed_on() -> pa.RecordBatch:
        none = pa.nulls(len(seen))
        columns = {f.name: none.cast(f.type) for f in _ARROW}
        columns |= {"term": pa.array(list(seen), pa.binary()), "df": pa.array(list(seen.values()), pa.int64())}
        seen.clear()
        return pa.RecordBatch.from_pydict(columns, schema=_ARROW)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            own = words(text.as_py())
            if not own:
                continue
            found = Counter(own)
            seen.update(found.keys())
            counts = np.fromiter(found.values(), np.int64, len(found))
            keys = keys_of(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)), counts)
            size = max(CLASS, (len(keys) - 1).bit_length())
            if size not in open_:
                open_[size] = Block(size)
            if open_[size].add(doc_id, len(own), found, keys, counts):
                yield pa.RecordBatch.from_pylist([open_.pop(size).row()], schema=_ARROW)
            if len(seen) >= FLUSH:
                yield passed_on()
    for block in open_.values():
        yield pa.RecordBatch.from_pylist([block.row()], schema=_ARROW)
    yield passed_on()


@dataclass
class Index:
    """``table``: blocks (``term`` is null), and terms with their document frequencies in parts."""

    table: DataFrame
    documents: int
    length: int

    @property
    def blocks(self) -> DataFrame:
        return self.table.filter("term is null").drop("term", "df")

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """``term, df`` of the ``terms`` (distinct, in a written table) that occur."""
        few = terms.limit(SMALL + 1).count() <= SMALL
        rows = self.table.filter("term is not null").select("term", "df")
        return rows.join(F.broadcast(terms) if few else terms, "term").groupBy("term").agg(F.sum("df").alias("df"))

    def discard(self) -> None:
        discard(self.table)


def index(docs: DataFrame) -> Index:
    """An index of the whole texts of ``docs`` (``doc_id, text``)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = stash(rows.mapInArrow(_indexed, _ROW), "lexical-index")
    size = table.filter("term is null").agg(F.sum("docs").alias("n"), F.sum("words").alias("l")).first()
    return Index(table, size["n"] or 0, size["l"] or 0)


def _terms(items: DataFrame) -> DataFrame:
    """``item_id, term``, written: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id"), batch.column("text"), strict=True):
                own = sorted(set(words(text.as_py())))
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([item.as_py()] * len(own), pa.int64()), "term": pa.array(own, pa.binary())})

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null")
    return stash(rows.mapInArrow(run, "item_id long, term binary").distinct(), "lexical-terms")


class Query:
    """A group of items: pairs of item and term in order of items, and weights."""

    def __init__(self, rows: list[tuple[int, bytes, int]], documents: int, length: int, k: int):
        rows = sorted(rows)
        self.documents, self.length, self.k = documents, length, k
        self.items = sorted({i for i, _, _ in rows})
        self.terms = sorted({t for _, t, _ in rows})
        number = {t: n for n, t in enumerate(self.terms)}
        self.pairs = np.array([number[t] for _, t, _ in rows], np.int64)
        self.weights = np.array([w for _, _, w in rows], np.int64)
        of_item = np.array([i for i, _, _ in rows])
        self.starts = np.searchsorted(of_item, self.items)
        self.ends = np.searchsorted(of_item, self.items, side="right")
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in self.terms], np.uint64)

    def marks(self, block: dict) -> tuple[list[np.ndarray], np.ndarray]:
        """Bitmaps of all terms for each power of two, of which each holds those after it, and what a count below the next is worth more."""
        cells = np.frombuffer(block["slices"], np.uint8).reshape(block["bits"], -1)
        lengths = np.array(block["lengths"], np.int64)
        m = 10 + 90 * lengths * self.documents // self.length
        bitmaps, worth, before = [], [], np.zeros(len(lengths), np.int64)
        for level in range(max(1, block["most"].bit_length())):
            rows = bits_of(self.hashes + shift(level), block["bits"])
            here = np.bitwise_and.reduce(cells[rows], axis=1)
            if bitmaps:
                here &= bitmaps[-1]
            now = gain(np.minimum(lengths, (2 << level) - 1), m)
            bitmaps.append(here)
            worth.append(now - before)
            before = now
            if not here.any():
                break
        return bitmaps, np.array(worth)

    def bounds(self, bitmaps: list[np.ndarray], worth: np.ndarray, first: int, last: int) -> np.ndarray:
        """Upper bounds of the items from ``first`` to before ``last`` (rows) for all documents."""
        n = worth.shape[1]
        pairs, weights = self.pairs[self.starts[first] : self.ends[last - 1]], self.weights[self.starts[first] : self.ends[last - 1]]
        starts = self.starts[first:last] - self.starts[first]
        total = np.zeros((last - first, n), np.int64)
        for bitmap, more in zip(bitmaps, worth, strict=True):
            there = np.flatnonzero(bitmap.any(axis=1)[pairs])
            if not len(there):
                continue
            marked = np.unpackbits(bitmap[pairs[there]], axis=1, count=n) * weights[there, None]
            owner = np.searchsorted(starts, there, side="right") - 1
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[heads]] += np.add.reduceat(marked, heads, axis=0) * more
        return total


class Ranking:
    """The best documents of each item of a group so far; ``scored`` counts exact scores, ``bounded`` documents with a bound."""

    def __init__(self, query: Query):
        self.query = query
        self.best: list[list[tuple[int, tuple[bool, int], int | None]]] = [[] for _ in query.items]
        self.scored = self.bounded = 0

    def add(self, block: dict) -> None:
        q = self.query
        bitmaps, worth = q.marks(block)
        lengths, counts, ms = block["lengths"], {}, {}

        def exact(j: int, item: int) -> int:
            if j not in counts:
                counts[j] = dict(zip(block["terms"][j].split(b" "), np.frombuffer(block["counts"][j], "<u4").tolist(), strict=True))
                ms[j] = 10 + 90 * lengths[j] * q.documents // q.length
            self.scored += 1
            own, m, total = counts[j], ms[j], 0
            for n in range(q.starts[item], q.ends[item]):
                if tf := own.get(q.terms[q.pairs[n]]):
                    total += int(q.weights[n]) * gain(tf, m)
            return total

        first = 0
        while first < len(q.items):
            last = first + 1
            while last < len(q.items) and (q.ends[last] - q.starts[first]) * len(lengths) <= CELLS:
                last += 1
            bounds = q.bounds(bitmaps, worth, first, last)
            for item, line in enumerate(bounds, first):
                best = self.best[item]
                full = len(best) == q.k
                able = np.flatnonzero(line >= (max(1, best[-1][0]) if full else 1))
                self.bounded += int(np.count_nonzero(line))
                for j in able[np.argsort(-line[able], kind="stable")].tolist():
                    if len(best) == q.k and line[j] < best[-1][0]:
                        break
                    if score := exact(j, item):
                        doc_id = block["ids"][j]
                        best.append((score, (doc_id is None, doc_id or 0), doc_id))
                        best.sort(key=lambda x: (-x[0], x[1]))
                        del best[q.k :]
            first = last

    def rows(self) -> list[tuple[int, int | None, int]]:
        return [(item, doc_id, score) for item, best in zip(self.query.items, self.best, strict=True) for score, _, doc_id in best]


def search(found: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of the index for each item (``item_id, text``)."""
    spark: SparkSession = items.sparkSession
    terms = _terms(items)
    distinct = stash(terms.select("term").distinct(), "lexical-asked")
    if not found.documents:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    weight = F.floor(1000 * F.log(F.lit(2.0 * found.documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    # terms that every document holds weigh nothing
    weighted = stash(terms.join(found.frequencies(distinct).select("term", weight.alias("w")), "term").filter("w > 0"), "lexical-weights")
    discard(terms, distinct)
    groups = max(1, math.ceil(weighted.count() / GROUP_TERMS))
    parts = []
    for group in range(groups):
        rows = weighted.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).select("item_id", "term", "w").toArrow()  # about GROUP_TERMS rows
        query = Query(list(zip(rows.column("item_id").to_pylist(), rows.column("term").to_pylist(), rows.column("w").to_pylist(), strict=True)), found.documents, found.length, k)
        shared = spark.sparkContext.broadcast(query)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ranking = Ranking(shared.value)
            for batch in batches:
                for n in range(batch.num_rows):
                    ranking.add(batch.slice(n, 1).to_pylist()[0])
            best = ranking.rows()
            yield pa.RecordBatch.from_pydict({name: pa.array([r[c] for r in best], pa.int64()) for c, name in enumerate(("item_id", "doc_id", "score"))})

        parts.append(stash(found.blocks.mapInArrow(run, "item_id long, doc_id long, score long"), "lexical-found"))
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
