"""License scans: fuzzy search for short notices.

A text is a sequence of words: A-Z lower-cased, ASCII characters that are no letters or digits part
words. Notices are searched in the words joined by single spaces. A notice with at most k edits is cut
into k + 1 seeds; by the pigeonhole principle one of them stands unchanged in every match. All seeds
are found in one pass (Aho-Corasick); around each hit, the regex library's bounded-error matching
verifies the whole notice and counts its edits. Matches are runs of whole words. A base phrase
counts where it stands without an edit.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows are each
scanned; the score is the best match's likeness, 1 - edits / length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose exact places count, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices, as words, that add labels when they match within their edits.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution": "cc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Characters of a notice for each edit that it may have.
CHARS_PER_EDIT = 12

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


class Notice:
    def __init__(self, phrase: str, label: str, base: bool):
        self.phrase, self.label, self.base = phrase, label, base
        self.edits = len(phrase) // CHARS_PER_EDIT
        self.pattern = regex.compile(f"(?b)(?:{regex.escape(phrase, special_only=True, literal_spaces=True)}){{e<={self.edits}}}")
        step = len(phrase) / (self.edits + 1)
        cuts = [round(step * k) for k in range(self.edits + 2)]
        self.seeds = [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """``found`` gives ``(notice, start, end, edits)`` in the joined words (one character for each byte)."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES):
        self.notices = [Notice(p, k, True) for p, k in base.items()] + [Notice(p, k, False) for p, k in notices.items()]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(self.notices):
            for offset, seed in notice.seeds:
                seeds.setdefault(seed, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def found(self, joined: str) -> list[tuple[Notice, int, int, int]]:
        out: dict[tuple[int, int], tuple[Notice, int, int, int]] = {}
        for last, (size, uses) in self.automaton.iter(joined):
            for n, offset in uses:
                notice = self.notices[n]
                at, k, size_n = last + 1 - size - offset, notice.edits, len(notice.phrase)
                if at >= 0 and joined.startswith(notice.phrase, at):  # most matches have no edit
                    if (at == 0 or joined[at - 1] == " ") and joined[at + size_n : at + size_n + 1] in ("", " "):
                        out[n, at] = (notice, at, at + size_n, 0)
                        continue
                if k and not any((n, s) in out for s in range(at - k, at + k + 1)):
                    if m := self._verified(notice, joined, at):
                        out[n, m[1]] = m
        return sorted(out.values(), key=lambda x: (x[1], x[2], x[0].phrase))

    @staticmethod
    def _verified(notice: Notice, joined: str, at: int) -> tuple[Notice, int, int, int] | None:
        """The match with the fewest edits of those that start at most k from ``at``, where a seed puts the notice, and end likewise.

        Each run of whole words there is held against the pattern: a search could not see beyond its window.
        """
        k, end = notice.edits, at + len(notice.phrase)
        starts = [s for s in range(max(0, at - k), at + k + 1) if s == 0 or joined[s - 1] == " "]
        ends = [e for e in range(end - k, min(len(joined), end + k) + 1) if joined[e : e + 1] in ("", " ")]
        runs = ((s, e, notice.pattern.fullmatch(joined, s, e)) for s in starts for e in ends if abs(e - s - len(notice.phrase)) <= k)
        return min(((notice, s, e, sum(m.fuzzy_counts)) for s, e, m in runs if m), key=lambda x: (x[3], x[1], x[2]), default=None)


@cache
def scanner(notices: tuple = tuple(NOTICES.items())) -> Scanner:
    """One for each table of notices in a Python worker."""
    return Scanner(notices=dict(notices))


def _words_of(notices: dict[str, str]) -> tuple:
    """Notices as they are matched: words in lower case with a blank between; those without a word are an error."""
    out = {b" ".join(words(phrase)).decode("latin-1"): label for phrase, label in notices.items()}
    if "" in out:
        raise ValueError("a notice needs a word")
    return tuple(out.items())


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def spans(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row for each match: ``doc_id, label, notice, base, first_word, n_words, edits, matched``; ``notices`` are phrases with their labels."""
    asked = _words_of(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan_words = scanner(asked).found
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                joined = b" ".join(words(text.as_py())).decode("latin-1")
                for notice, start, end, edits in scan_words(joined):
                    rows.append((doc_id.as_py(), notice.label, notice.phrase.encode("latin-1").decode("utf-8", "replace"), notice.base, joined.count(" ", 0, start), joined.count(" ", start, end) + 1, edits, joined[start:end].encode("latin-1").decode("utf-8", "replace")))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            names = ("doc_id", "label", "notice", "base", "first_word", "n_words", "edits", "matched")
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))})

    return _source(docs).mapInArrow(run, "doc_id long, label string, notice string, base boolean, first_word long, n_words long, edits int, matched string")


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row for each document with its base places, all labels and a score; ``notices`` are phrases with their labels. An empty table gives no row."""
    asked = _words_of(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan_words = scanner(asked).found
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                own = words(text.as_py())
                joined = b" ".join(own).decode("latin-1")
                found = scan_words(joined)
                exact = [m for m in found if m[0].base and m[3] == 0]
                rows.append((
                    len(own), len(exact),
                    joined.count(" ", 0, exact[0][1]) if exact else None,
                    joined.count(" ", 0, exact[-1][1]) if exact else None,
                    ",".join(sorted({m[0].label for m in exact})), ",".join(sorted({m[0].label for m in found})),
                    max((1 - m[3] / len(m[0].phrase) for m in found), default=0.0),
                ))
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64())
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))})

    return _source(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
