"""Best-fit packing of token sequences by exact-complement hashing.

Documents are tokenised and cut into pieces of at most ``CAPACITY`` tokens. Only the number of pieces
of each length matters for a plan, and there are at most ``CAPACITY`` lengths, so the plan is made from
that table: for the longest pieces left, an index of single, pair and triple sums of the lengths still
available gives a combination that fills the gap exactly, and it is used as often as the counts allow;
where there is none, the longest piece that fits goes in (best fit) and the smaller gap is tried again.
Pieces of one length are interchangeable: each gets a rank among them, and the plan says which
sequence and offset that rank has.

Defined results: null and empty texts have only the end token. Repeated rows are packed each.
Null ids are packed too. An empty table gives an empty result. The tokenizer's own tokens (its end-of-text string)
within a text become their ids, as the tokenizer gives them, and part the text.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .units import Ids, UnitTable, expand, filled, gathered

CAPACITY = 1024
END_ID = 2
#: Units that begin a match whatever stands before them, and that nothing after them joins.
FOLLOWS = r"\A[ \n][^ \n\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_TABLES: dict[str, UnitTable] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def unit_table(path: str) -> UnitTable:
    """This worker's table of known units for the tokenizer in ``path``."""
    if path not in _TABLES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError(f"{path} has added tokens that take more than their string")
        tokenizer.encode_special_tokens = True  # texts come without them

        size = np.zeros(tokenizer.get_vocab_size(), np.int64)  # bytes of each token: a character of its name for each
        for name, k in tokenizer.get_vocab().items():
            size[k] = len(name)
        batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)  # without offsets, which aren't needed

        def encode(new: pa.StringArray) -> Ids:
            # words with the space or line feed before them are encoded as one text: its ids are dealt out by their bytes
            follows = pc.match_substring_regex(new, FOLLOWS).to_numpy(zero_copy_only=False)
            words = new.filter(pa.array(follows)).to_pylist()
            together = ["".join(words[at : at + 1024]) for at in range(0, len(words), 1024)]
            one = np.array([i for e in batch(together, add_special_tokens=False) for i in e.ids], np.uint32)
            ends = np.cumsum(pc.binary_length(new.filter(pa.array(follows))).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = np.concatenate([[0], np.searchsorted(np.cumsum(size[one]), ends, side="left") + 1]) if len(words) else np.zeros(1, np.int64)
            if len(words) and (at[-1] != len(one) or not np.array_equal(np.cumsum(size[one])[at[1:] - 1], ends)):
                raise ValueError(f"tokens of {path} don't end where words do")
            rest = [e.ids for e in batch(new.filter(pa.array(~follows)).to_pylist(), add_special_tokens=False)]
            lengths = np.zeros(len(new), np.int32)
            lengths[follows], lengths[~follows] = np.diff(at), [len(x) for x in rest]
            ids = np.concatenate([one, np.array([i for x in rest for i in x], np.uint32)])
            place = np.concatenate([at[:-1], len(one) + np.cumsum([0, *map(len, rest)])[:-1]])
            order = np.empty(len(new), np.int64)
            order[np.concatenate([np.flatnonzero(follows), np.flatnonzero(~follows)])] = place
            return expand(ids, order, lengths), lengths

        _TABLES[path] = UnitTable(encode, {t.content: k for k, t in added.items()})
    return _TABLES[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` of every piece of every document."""
    path = path or default_vocabulary()

    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unit_table(path)
        last = np.array([END_ID], "<u4")
        for batch in gathered(batches, "text"):
            doc_ids = batch.column("doc_id")
            for first, ids, ends in known.groups(filled(batch.column("text"))):
                # every document's end token goes behind its ids
                ids = np.insert(ids.astype("<u4", copy=False), ends, last)
                ends = ends + np.arange(1, len(ends) + 1)
                sizes = np.diff(ends, prepend=0)
                many = -(-sizes // capacity)
                piece = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                head = np.repeat((sizes - 1) % capacity + 1, many)
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                at = np.repeat(ends - sizes, many) + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [doc_ids.take(pa.array(np.repeat(np.arange(first, first + len(sizes)), many))), *(pa.array(x, kind) for x, kind in zip((piece, start, length, crc), list(kinds.values())[1:], strict=True))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[*kinds, *(["ids"] if with_ids else [])])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _exact(count: np.ndarray, gap: int, most: int = 3) -> tuple[int, ...]:
    """One to ``most`` (three at most) available lengths that sum to ``gap``, the longest first; empty if there are none."""
    if gap <= 0:
        return ()
    if count[gap] > 0:
        return (gap,)
    if most == 1:
        return ()
    there = count > 0

    def pair(total: int, most: int) -> tuple[int, ...]:
        """Lengths a >= b, a at most ``most``, with a + b = total."""
        low, high = (total + 1) // 2, min(most, total - 1)
        if low > high:
            return ()
        a = np.arange(high, low - 1, -1)
        ok = there[a] & there[total - a] & ((a * 2 != total) | (count[a] > 1))
        return (int(a[ok.argmax()]), int(total - a[ok.argmax()])) if ok.any() else ()

    if (found := pair(gap, gap - 1)) or most == 2:
        return found
    for a in np.flatnonzero(there[: gap - 1])[::-1].tolist():
        if 3 * a < gap:
            break
        count[a] -= 1
        found = pair(gap - a, a)
        found = found if all(count[x] >= found.count(x) for x in found) else ()
        count[a] += 1
        if found:
            return (a, *found)
    return ()


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths of a sequence, how many such sequences)`` that use up all of ``lengths``.

    Triples spend short pieces early, which suits some tables and not others: of the plans with
    triples, with pairs and with single complements only, that with the fewest sequences is taken.
    """
    return min((_plan(lengths, capacity, most) for most in (3, 2, 1)), key=lambda p: sum(times for _, times in p))


def _plan(lengths: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    count = np.zeros(capacity + 1, np.int64)
    for k, n in lengths.items():
        count[k] = n
    out: list[tuple[tuple[int, ...], int]] = []
    for longest in range(capacity, 0, -1):
        while count[longest]:
            items, left = [longest], capacity - longest
            count[longest] -= 1
            while left:
                if found := _exact(count, left, most):
                    items += found
                    for x in found:
                        count[x] -= 1
                    break
                fits = np.flatnonzero(count[: left + 1])
                if not len(fits):
                    break
                best = int(fits[-1])
                many = int(min(count[best], left // best))
                many = many if best * 2 > left or best < 16 else 1
                items += [best] * many
                count[best] -= many
                left -= best * many
            uses = {x: items.count(x) for x in set(items)}
            more = min(int(count[x]) // n for x, n in uses.items())
            for x, n in uses.items():
                count[x] -= n * more
            out.append((tuple(items), 1 + more))
    return out


class Placement:
    """Where the piece of a length with a rank goes; sorted arrays that ``look`` searches."""

    def __init__(self, chosen: list[tuple[tuple[int, ...], int]]):
        rows, used, sequence = [], {}, 0
        for items, times in chosen:
            offset = 0
            for x in items:
                rows.append((x, used.get(x, 0), sequence, offset))
                used[x] = used.get(x, 0) + times
                offset += x
            sequence += times
        rows.sort()
        at = np.array(rows, np.int64).reshape(-1, 4)
        self.sequences = sequence
        self.key, self.rank, self.sequence, self.offset = (at[:, 0] << 44) + at[:, 1], at[:, 1], at[:, 2], at[:, 3]

    def look(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length << 44) + rank, side="right") - 1
        return self.sequence[k] + rank - self.rank[k], self.offset[k]


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, choose: Callable = plan) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, start, length, ids_crc32``, a written table, as it is read four times.

    Full pieces are sequences of their own, with negative numbers, and need neither plan nor shuffle.
    """
    spark = cut_pieces.sparkSession
    # the numbers depend on the files' order only, so that a task that is run again gives the same ones
    full = cut_pieces.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    parts = cut_pieces.filter(F.col("length") < capacity)
    found = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    # at most `capacity` rows came back
    placed = spark.sparkContext.broadcast(Placement(choose(found, capacity)))
    salts = max(256, sum(found.values()) // 5000)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = parts.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    joined = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).select(*cut_pieces.columns, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = placed.value.look(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema.fields)
    return joined.mapInArrow(run, f"{schema}, sequence_id long, offset long").unionByName(full)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs all documents."""
    return pack(stash(pieces(docs, path, capacity, with_ids), "pieces"), capacity)
