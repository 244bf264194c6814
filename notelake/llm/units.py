"""Texts as units that byte-level BPE tokenizers treat independently, for lookup in a table of known units.

The split pattern of these tokenizers lets no match reach across white space, but for one space before
a word; so a run of other characters with that space, and the white space before it, are encoded alike
wherever they stand. Texts repeat such units far more than they invent new ones. Splitting, the list of
distinct units and the lookup work on Arrow columns; only units that are new reach the tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as Unicode defines it (Python's \s has four control characters more).
_OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0  -     　"
_RUNS = re.compile(f"[ \n{_OTHER_SPACE}]+|[^ \n{_OTHER_SPACE}]+")
_OTHER = re.compile(f"[{_OTHER_SPACE}]")
#: Parts units in plain texts; a text that holds it is no plain text.
_MARK = "\x00"
#: Texts that aren't words parted by single spaces or line feeds.
_UNEVEN = rf"[ \n]{{2}}|\A[ \n]|[ \n]\z|[{_OTHER_SPACE}\x00]"
#: A comma or full stop after a plain letter is a match of its own.
_STOPPED = r"[a-z][,.]\z"

#: Ids of units one after the other, and how many each has.
Ids = tuple[np.ndarray, np.ndarray]


def runs(text: str) -> list[str]:
    """Units of any text, whose concatenation it is; of more than one white-space character, the last stands alone."""
    out: list[str] = []
    found = _RUNS.findall(text)
    spaced = False
    for k, run in enumerate(found):
        if run[0] in " \n" or _OTHER.match(run):
            last = k + 1 == len(found)
            spaced = not last and run[-1] == " "
            body = run if last or len(run) == 1 and not spaced else run[:-1]
            if body:
                out.append(body)
            if not last and not spaced and len(run) > 1:
                out.append(run[-1])
        else:
            out.append(" " + run if spaced else run)
            spaced = False
    return out


def split(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All units of the texts, one after the other, and how many each text has; texts aren't null."""
    uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
    even = texts.filter(pa.array(~uneven)) if uneven.any() else texts
    parts = pc.split_pattern(pc.replace_substring(pc.replace_substring(even, " ", _MARK + " "), "\n", _MARK + "\n"), _MARK)
    flat, counts = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    if not uneven.any():
        return flat, counts
    # the others one by one; back in order, a stretch of each kind at a time
    others = [runs(t) for t in texts.filter(pa.array(uneven)).to_pylist()]
    joined = pa.array([u for own in others for u in own], pa.string())
    total = np.zeros(len(texts), np.int64)
    total[~uneven], total[uneven] = counts, [len(own) for own in others]
    turns = np.flatnonzero(np.diff(uneven)) + 1
    stretches, at = [], [0, 0]
    for a, b in zip([0, *turns], [*turns, len(texts)], strict=True):
        kind, n = int(uneven[a]), int(total[a:b].sum())
        stretches.append((joined if kind else flat).slice(at[kind], n))
        at[kind] += n
    return pa.concat_arrays(stretches), total


def expand(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    shift = (starts - (ends - lengths)).astype(np.int32 if len(ids) < 1 << 31 and (not len(ends) or ends[-1] < 1 << 31) else np.int64)
    at = np.repeat(shift, lengths)
    at += np.arange(len(at), dtype=at.dtype)
    return ids[at]


class UnitTable:
    """Ids of units that were met before, within a bound; ``encode`` gives those of new ones."""

    #: Bytes of text whose units are looked up together.
    TOGETHER = 8_000_000
    #: Bytes of a unit that is kept at most, kept units and kept ids at most: the bounds of the table.
    LONGEST, MOST_UNITS, MOST_IDS = 48, 600_000, 4_000_000

    def __init__(self, encode: Callable[[pa.StringArray], Ids], specials: dict[str, int] | None = None):
        #: ``specials``: strings that are tokens of their own wherever they stand; texts end and begin anew at them.
        self.encode, self.specials = encode, specials or {}
        self.forget()
        self.marks = [encode(pa.array([m], pa.string()))[0] for m in ",."]

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def groups(self, texts: pa.StringArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of texts: the number of the first, their ids, and where each text's ids end."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + self.TOGETHER, side="right")))
            yield at, *self._together(texts.slice(at, end - at))
            at = end

    def _together(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        if not any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.specials):
            return self._plain(texts)
        pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        parted = [pattern.split(t) for t in texts.to_pylist()]  # texts between specials, and these
        ids, ends = self._plain(pa.array([x for p in parted for x in p[::2]], pa.string()))
        last = np.cumsum([len(p) // 2 + 1 for p in parted]) - 1
        inner = np.ones(len(ends), bool)
        inner[last] = False  # behind the others stands a special
        found = np.array([self.specials[x] for p in parted for x in p[1::2]], ids.dtype)
        return np.insert(ids, ends[inner], found), (ends + np.cumsum(inner))[last]

    def _plain(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = split(texts)
        coded = flat.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids, lengths = self._look(coded.dictionary)
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        own = lengths[at]
        ends = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])[np.cumsum(counts, dtype=np.int64)]
        return expand(ids, starts[at], own), ends

    def _look(self, words: pa.StringArray) -> Ids:
        """Ids of distinct units: those that end in a comma or full stop are looked up without it."""
        stopped = pc.match_substring_regex(words, _STOPPED).to_numpy(zero_copy_only=False)
        last = np.zeros(len(words), np.int8)
        bare = words
        if stopped.any():
            last[stopped] = np.where(pc.ends_with(words.filter(pa.array(stopped)), ",").to_numpy(zero_copy_only=False), 1, 2)
            bare = pc.if_else(pa.array(stopped), pc.utf8_slice_codeunits(words, 0, -1), words)
        coded = bare.dictionary_encode()
        ids, lengths = self._bare(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        starts = (np.cumsum(lengths, dtype=np.int64) - lengths)[at]
        own = lengths[at]
        if not stopped.any():
            return expand(ids, starts, own), own
        # a unit's ids and then its mark's: two runs each, the second of which may be empty
        marks = np.array([0, *map(len, self.marks)])
        where = len(ids) + np.array([0, 0, marks[1]])
        runs_at = np.column_stack([starts, where[last]]).ravel()
        runs_of = np.column_stack([own, marks[last]]).ravel()
        return expand(np.concatenate([ids, *self.marks]), runs_at, runs_of), (own + marks[last]).astype(np.int32)

    def _bare(self, words: pa.StringArray) -> Ids:
        found = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(found))
        ids, lengths = self.encode(new) if len(new) else (np.zeros(0, np.uint32), np.zeros(0, np.int32))
        at = found.to_numpy(zero_copy_only=False)
        missing = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
        place = np.where(missing, 0, at).astype(np.int64)
        place[missing] = len(self.lengths) + np.arange(len(new))
        all_lengths = np.concatenate([self.lengths, lengths])
        starts = np.cumsum(all_lengths, dtype=np.int64) - all_lengths
        out = expand(np.concatenate([self.ids, ids]), starts[place], all_lengths[place]), all_lengths[place]
        self._keep(new, ids, lengths)
        return out

    def _keep(self, new: pa.StringArray, ids: np.ndarray, lengths: np.ndarray) -> None:
        if not len(new):
            return
        short = pc.binary_length(new).to_numpy(zero_copy_only=False) <= self.LONGEST
        if not short.all():
            starts = np.cumsum(lengths, dtype=np.int64) - lengths
            ids, lengths, new = expand(ids, starts[short], lengths[short]), lengths[short], new.filter(pa.array(short))
        if len(self.known) + len(new) > self.MOST_UNITS or len(self.ids) + len(ids) > self.MOST_IDS:
            # the units met first are the commonest, as a rule: half of the table stays
            half = len(self.known) // 2
            self.known = pa.concat_arrays([self.known.slice(0, half)])
            self.lengths = self.lengths[:half].copy()
            self.ids = self.ids[: int(self.lengths.sum())].copy()
        room = min(len(new), max(0, self.MOST_UNITS - len(self.known)), int(np.searchsorted(np.cumsum(lengths), self.MOST_IDS - len(self.ids), side="right")))
        self.known = pa.concat_arrays([self.known, new.slice(0, room)])
        self.lengths = np.concatenate([self.lengths, lengths[:room]]).astype(np.int32)
        self.ids = np.concatenate([self.ids, ids[: int(lengths[:room].sum())]]).astype(np.uint32)


def gathered(batches: Iterator[pa.RecordBatch], column: str, least: int = UnitTable.TOGETHER) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: small ones are joined until their texts have ``least`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= least:
            yield _joined(held)
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield _joined(held)
    pa.default_memory_pool().release_unused()


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def filled(texts: pa.Array) -> pa.StringArray:
    """Null texts as empty ones."""
    return pc.fill_null(texts.cast(pa.string()), "")
