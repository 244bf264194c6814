"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each match of the split pattern is encoded separately. A tree over its bytes holds at each leaf the
rank of the pair that starts there, and at each node the smallest (rank, position): the root is the
leftmost pair of least rank. A merge changes three leaves - the pair that starts at the new token, the
pair that its left neighbour starts, and the swallowed one - so it costs three walks to the root, and
a match of n bytes takes O(n log n) however long it is. Many short matches are merged at once, a numpy
row for each; long ones one by one.

Defined results: null and empty texts have no ids. Repeated rows are encoded each. Ids that aren't in
the vocabulary can't be decoded and raise KeyError.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import Ids, UnitTable, filled, gathered

_NONE = np.int64(1) << 40
#: Bytes up to which matches are merged together.
SHORT = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.known = UnitTable(self._encode_units)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``_NONE`` where it can't merge or b is negative."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((b >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], _NONE)

    def merge_many(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most ``width`` bytes (a power of two), a row of each array for each word."""
        n = len(words)
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        column = np.arange(width)
        live = column < size[:, None]
        token = np.where(live, self.byte_ids[raw], -1)
        after = np.where(column + 1 < size[:, None], column + 1, width)
        before = np.broadcast_to(column - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE * width, np.int64)
        tree[:, width : 2 * width - 1] = self._rank(token[:, :-1], token[:, 1:]) * width + column[:-1]
        tree[:, width:][tree[:, width:] >= _NONE * width] = _NONE * width
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = np.where(rank < _NONE, rank * width + at, _NONE * width)
            while node[0] > 1:  # all nodes are on one level
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.arange(n)
        while len(rows := rows[tree[rows, 1] < _NONE * width]):
            best = tree[rows, 1]
            at, rank = best % width, best // width
            gone = after[rows, at]
            token[rows, at], live[rows, gone] = rank, False
            follow = after[rows, gone]
            after[rows, at] = follow
            has = follow < width
            before[rows[has], follow[has]] = at[has]
            put(rows, gone, np.full(len(rows), _NONE))
            put(rows, at, self._rank(rank, np.where(has, token[rows, np.minimum(follow, width - 1)], -1)))
            left = before[rows, at]
            if (has := left >= 0).any():
                put(rows[has], left[has], self._rank(token[rows[has], left[has]], rank[has]))
        flat = token[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_one(self, word: bytes) -> bytes:
        """Ids of one long word."""
        n, pairs, none = len(word), self.pairs, int(_NONE)
        width = 1 << (n - 1).bit_length()
        token = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        leaf = [pairs.get((a << 20) | b, none) for a, b in zip(token, token[1:], strict=False)]
        tree = [(none, 0)] * width + [(r, k) for k, r in enumerate(leaf)] + [(none, 0)] * (width - n + 1)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(at: int, rank: int) -> None:
            node = at + width
            tree[node] = (rank, at)
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1][0] < none:
            rank, at = tree[1]
            gone = after[at]
            token[at], token[gone] = rank, -1
            follow = after[at] = after[gone]
            put(gone, none)
            if follow >= 0:
                before[follow] = at
            put(at, pairs.get((rank << 20) | token[follow], none) if follow >= 0 else none)
            if (left := before[at]) >= 0:
                put(left, pairs.get((token[left] << 20) | rank, none))
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(w) > SHORT:
                out[k] = self.merge_one(w)
            else:
                groups.setdefault(1 << (len(w) - 1).bit_length(), []).append(k)
        for width, members in groups.items():
            for at in range(0, len(members), 1 << 14):
                part = members[at : at + (1 << 14)]
                for k, ids in zip(part, self.merge_many([words[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _encode_units(self, new: pa.StringArray) -> Ids:
        split = [self.pattern.findall(u) for u in new.to_pylist()]
        words = list({w for parts in split for w in parts})
        found = dict(zip(words, self.merge([w.encode() for w in words]), strict=True))
        own = [b"".join([found[w] for w in parts]) for parts in split]
        return np.frombuffer(b"".join(own), "<u4"), np.array([len(x) // 4 for x in own], np.int32)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for _, ids in self.encoded(pa.array(texts, pa.string()))]

    def encoded(self, texts: pa.Array) -> Iterator[tuple[int, bytes]]:
        """Number and ids of each text, in order."""
        for first, ids, ends in self.known.groups(filled(texts)):
            raw = ids.astype("<u4", copy=False).tobytes()
            for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                yield first + k, raw[4 * a : 4 * b]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec for a rank file; it keeps what it has encoded, within a bound."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


#: Column name: SQL type, Arrow type, and its value from the ids and the codec.
Derived = dict[str, tuple[str, pa.DataType, Callable[[bytes, Codec], object]]]
IDS: Derived = {"ids": ("array<int>", pa.list_(pa.int32()), lambda ids, _: np.frombuffer(ids, "<u4").astype(np.int32))}


def encode(docs: DataFrame, derive: Derived = IDS, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id`` and what ``derive`` makes of the ids of each whole text: the ids themselves, unless told otherwise."""
    path, pattern = path or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in gathered(batches, "text"):
            rows: list[list] = [[] for _ in derive]
            for _, ids in own.encoded(batch.column("text")):
                for values, (_, _, make) in zip(rows, derive.values(), strict=True):
                    values.append(make(ids, own))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, kind) for v, (k, (_, kind, _)) in zip(rows, derive.items(), strict=True)})

    schema = "doc_id long, " + ", ".join(f"{k} {sql}" for k, (sql, _, _) in derive.items())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, bytes`` from ``doc_id, ids``."""
    path, pattern = path or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            found = [own.decode(np.array(ids.as_py() or [], "<u4").tobytes()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bytes": pa.array(found, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
