"""Mass edits of note text: entity links, finished todos, frontmatter stamps, journals and templates."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import discard, stash

#: Names, and their characters, up to which an automaton of all of them goes to every task.
MOST_NAMES, MOST_CHARACTERS = 50_000, 2_000_000
#: Words of an entity's name that it meets notes by.
MAX_NAME_WORDS = 6
#: Different first words of names up to which they go to every task as they are, beyond that as a filter.
FEW_FIRST = 100_000
#: Least and most bits (as powers of two) of the filter of names that goes to every task, and of a part of it.
LEAST_BITS, MOST_BITS, PART_BITS = 16, 29, 16

_LINKED = re.compile(r"\[\[.*?\]\]|\[[^\]]*\]\([^)]*\)", re.S)
_EDGE = frozenset(T.UPPER + T.LOWER + "0123456789_-")
_PLAIN = str.maketrans(T.UPPER + "_-", T.LOWER + "  ")
#: ASCII words, and each other character by itself but for separators: the matcher allows an edge beside those.
_WORDS = re.compile(r"[0-9a-z]+|[^0-9a-z ]")
_BRACKETS = frozenset("[]()")


def _plain_name(name: str) -> str:
    """A name's parts as they stand in a text of plain letters and separators."""
    return " ".join(p for p in re.split(r"[ _\-]+", name) if p).translate(_PLAIN)


def name_run(name: str) -> tuple[str, int]:
    """A name's first ``MAX_NAME_WORDS`` words, and how many these are; those before a bracket, as links that are put in bring such."""
    words = _WORDS.findall(name.translate(_PLAIN))[:MAX_NAME_WORDS]
    words = words[: max(next((k for k, word in enumerate(words) if word in _BRACKETS), len(words)), 1)]
    return " ".join(words), len(words)


def _place(run: str, bits: int) -> int:
    return crc32(run.encode("utf-8", "surrogatepass")) >> (32 - bits)


def _bitmap(places: DataFrame, bits: int) -> bytes:
    """A bit for each ``place`` (of ``2 ** bits``), made in parts of ``2 ** PART_BITS``; at most 64 MB."""
    size = 1 << min(bits, PART_BITS)

    def part(key: tuple, rows: pa.Table) -> pa.Table:
        marks = np.zeros(size, np.uint8)
        marks[rows.column("place").to_numpy() % size] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    out = bytearray((1 << bits) // 8)
    for row in places.select("place", F.expr(f"place div {size}").alias("part")).groupBy("part").applyInArrow(part, "part long, bits binary").collect():
        out[row["part"] * size // 8 : (row["part"] + 1) * size // 8] = row["bits"]
    return bytes(out)


def _asked(names: DataFrame) -> DataFrame:
    """``name, run, n`` of different names that have words."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(name, *name_run(name)) for name in batch.column("name").to_pylist()]
            yield pa.RecordBatch.from_pydict({"name": pa.array([x[0] for x in own], pa.string()), "run": pa.array([x[1] for x in own], pa.string()), "n": pa.array([x[2] for x in own], pa.int32())})

    return names.select("name").filter("name is not null").distinct().mapInArrow(runs, "name string, run string, n int").filter("n > 0")


class RunFilter:
    """The runs of words in a text that may be those of a name: by the names' first words (or bits of them), then by bits of their runs."""

    def __init__(self, first: bytes | frozenset[str], whole: bytes, lengths: list[int], brackets: bool = True):
        self.first, self.whole, self.lengths, self.brackets = first, whole, lengths, brackets
        self.exact = isinstance(first, frozenset)
        self.first_bits, self.bits = (len(x).bit_length() + 2 for x in (first, whole))

    def _may_begin(self, word: str) -> bool:
        if self.exact:
            return word in self.first
        at = _place(word, self.first_bits)
        return bool(self.first[at >> 3] >> (at & 7) & 1)

    def runs(self, text: str) -> list[str]:
        # what is linked already stays so, if no name has a bracket; a NUL keeps runs from going over it
        words = _WORDS.findall((text if self.brackets else _LINKED.sub("\0", text)).translate(_PLAIN))
        begins = {word for word in set(words) if self._may_begin(word)}
        out = []
        for k, word in enumerate(words) if begins else ():
            if word in begins:
                for n in self.lengths:
                    if k + n <= len(words):
                        run = " ".join(words[k : k + n])
                        at = _place(run, self.bits)
                        if self.whole[at >> 3] >> (at & 7) & 1:
                            out.append(run)
        return list(dict.fromkeys(out))


def _met(notes: DataFrame, asked: DataFrame) -> DataFrame:
    """``filename, body, runs`` of the notes with a run of words that may be a name's."""
    lengths = sorted(r["n"] for r in asked.select("n").distinct().collect())  # at most MAX_NAME_WORDS
    bits = min(max((asked.count() * 32).bit_length(), LEAST_BITS), MOST_BITS)
    first_bits = min(bits, 22)
    brackets = not asked.filter(F.col("name").rlike(r"[\[\]()]")).isEmpty()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"place": pa.array([_place(x, bits) for x in batch.column("run").to_pylist()], pa.int64())})

    def first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"place": pa.array(sorted({_place(x.split(" ", 1)[0], first_bits) for x in batch.column("run").to_pylist()}), pa.int64())})

    few = [r["word"] for r in asked.select(F.substring_index("run", " ", 1).alias("word")).distinct().limit(FEW_FIRST + 1).collect()]
    first = frozenset(few) if len(few) <= FEW_FIRST else _bitmap(asked.select("run").mapInArrow(first_places, "place long").distinct(), first_bits)
    shared = notes.sparkSession.sparkContext.broadcast((first, _bitmap(asked.select("run").mapInArrow(places, "place long").distinct(), bits), lengths, brackets))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = RunFilter(*shared.value)
        for batch in batches:
            rows = ((f, b, names.runs(b or "")) for f, b in zip(batch.column("filename").to_pylist(), batch.column("body").to_pylist(), strict=True))
            kept = [row for row in rows if row[2]]
            yield pa.RecordBatch.from_pydict({"filename": pa.array([x[0] for x in kept], pa.string()), "body": pa.array([x[1] for x in kept], pa.string()), "runs": pa.array([x[2] for x in kept], pa.list_(pa.string()))})

    return notes.select("filename", "body").mapInArrow(scan, "filename string, body string, runs array<string>")


def candidates(notes: DataFrame, names: DataFrame) -> DataFrame:
    """``filename, names``: the entity names whose first ``MAX_NAME_WORDS`` words stand one after another in a note's text.

    Notes and names meet on runs of words, so no note is held against all names. A filter of the names' runs leaves out
    most others of a note before they are shuffled.
    """
    asked = stash(_asked(names), "asked")
    return _named(_met(notes, asked), asked)


def _named(met: DataFrame, asked: DataFrame) -> DataFrame:
    return met.select("filename", F.explode("runs").alias("run")).join(asked.select("run", "name"), "run").groupBy("filename").agg(F.array_sort(F.collect_set("name")).alias("names"))


def link_text(text: str, names: list[str] | set[str]) -> tuple[str, int]:
    """Text in which each name becomes ``[[name]]`` wherever it isn't linked yet, longest names first; how often."""
    total, plain = 0, text.translate(_PLAIN)
    for name in sorted(set(names), key=lambda n: (-len(n), n)):
        key = _plain_name(name)
        if not key or key not in plain:
            continue
        out, done, at = [], 0, 0
        for linked in [*_LINKED.finditer(text), None]:
            end = linked.start() if linked else len(text)
            begin = at
            # beside a link, and at the ends of a text, a name has an edge
            while (k := plain.find(key, at, end)) >= 0:
                behind = k + len(key)
                if (k == begin or text[k - 1] not in _EDGE) and (behind == end or text[behind] not in _EDGE):
                    out += [text[done:k], f"[[{name}]]"]
                    done = at = behind
                    total += 1
                else:
                    at = k + 1
            at = linked.end() if linked else end
        if out:
            text = "".join([*out, text[done:]])
            plain = text.translate(_PLAIN)
    return text, total


class NameFinder:
    """The names that stand somewhere in a text, whatever the case of ASCII letters and the separators: an Aho-Corasick automaton."""

    def __init__(self, names: list[str]):
        self.automaton = ahocorasick.Automaton()
        same: dict[str, list[str]] = {}
        for name in names:
            if key := _plain_name(name):
                same.setdefault(key, []).append(name)
        for key, own in same.items():
            self.automaton.add_word(key, own)
        if same:
            self.automaton.make_automaton()
        self.empty = not same

    def names(self, text: str) -> set[str]:
        return set() if self.empty else {name for _, own in self.automaton.iter(text.translate(_PLAIN)) for name in own}


def _linked(rows: Iterator[tuple[str, str, list[str] | set[str]]]) -> pa.RecordBatch:
    new = [(filename, *link_text(body, names)) for filename, body, names in rows]
    return pa.RecordBatch.from_pydict({"filename": pa.array([f for f, _, _ in new], pa.string()), "body": pa.array([b for _, b, _ in new], pa.string()), "n_links": pa.array([n for _, _, n in new], pa.int64())})


def link_entities(notes: DataFrame, names: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """``filename, body, n_links`` of the notes that name an entity (``names``: ``name``), with links put in.

    Names within a bound go to all tasks as one automaton, and notes are read where they are. Beyond it, notes and
    names meet on runs of words; notes that may name one are written once.
    """
    distinct = stash(names.select("name").filter("name is not null").distinct(), "names")
    size = distinct.agg(F.count("*").alias("n"), F.sum(F.length("name")).alias("characters")).first()
    if size["n"] <= most and (size["characters"] or 0) <= MOST_CHARACTERS:
        shared = notes.sparkSession.sparkContext.broadcast([r["name"] for r in distinct.collect()])
        discard(distinct)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = NameFinder(shared.value)
            for batch in batches:
                rows = ((f, b or "") for f, b in zip(batch.column("filename").to_pylist(), batch.column("body").to_pylist(), strict=True))
                yield _linked((f, b, found) for f, b in rows if (found := finder.names(b)))

        found = notes.select("filename", "body").mapInArrow(scan, "filename string, body string, n_links long")
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _linked(zip(batch.column("filename").to_pylist(), (b or "" for b in batch.column("body").to_pylist()), batch.column("names").to_pylist(), strict=True))

        asked = stash(_asked(distinct), "asked")
        met = stash(_met(notes, asked), "met")
        found = met.select("filename", "body").join(_named(met, asked), "filename").mapInArrow(run, "filename string, body string, n_links long")
        discard(distinct)
    return found.filter("n_links > 0")


def complete_todos(raw: DataFrame, edits: DataFrame, day: str) -> DataFrame:
    """``filename, content`` of the files in ``edits`` (``filename, line_number``), those lines' open todos done and dated."""
    asked = edits.groupBy("filename").agg(F.collect_set("line_number").alias("__at"))
    done = lambda x: F.concat(F.regexp_replace(x, r"^(\s*)- \[ \]", "$1- [x]"), F.when(x.contains("✅"), "").otherwise(f" ✅ [[{day}]]"))
    edited = F.transform(F.split("content", "\n"), lambda x, n: F.when(F.array_contains("__at", n + 1) & x.rlike(r"^\s*- \[ \]"), done(x)).otherwise(x))
    return raw.join(asked, "filename").select("filename", F.array_join(edited, "\n").alias("content"))


def stamp_updated(content: Column | str, stamp: str) -> Column:
    """``updated:`` set in the frontmatter; text without frontmatter stays."""
    content = F.col(content) if isinstance(content, str) else content
    rows = F.split(content, "\n")
    end = F.array_position(F.transform(F.slice(rows, F.lit(2), F.size(rows)), T.trim), "---").cast("int")  # of the lines after the first
    front = F.slice(rows, F.lit(1), end)
    fresh = F.lit(f"updated: {stamp}")
    put = F.when(F.exists(front, lambda x: x.rlike(r"^updated:")), F.transform(front, lambda x: F.when(x.rlike(r"^updated:"), fresh).otherwise(x))).otherwise(F.concat(front, F.array(fresh)))
    return F.when((F.size(rows) > 1) & (T.trim(F.get(rows, F.lit(0))) == "---") & (end > 0), F.array_join(F.concat(put, F.slice(rows, end + 1, F.size(rows))), "\n")).otherwise(content)


JOURNAL = "## Yournal"


def journal_entry(text: Column, as_todo: Column, day: str, at: Column | None = None) -> Column:
    """A todo with its day, a heading as it is, or a list item; with ``at`` (a timestamp) its time in brackets comes first."""
    stamp = F.lit("") if at is None else F.coalesce(F.concat(F.lit("["), F.date_format(at, "HH:mm"), F.lit("] ")), F.lit(""))
    return F.when(as_todo, F.concat(F.lit("- [ ] "), stamp, text, F.lit(f" due: {day}"))).when(text.startswith("#"), F.concat(stamp, text)).otherwise(F.concat(F.lit("- "), stamp, text))


def journal_append(notes: DataFrame, entries: DataFrame) -> DataFrame:
    """``filename, content`` with each file's entries (``filename, ts, line``) under the journal heading, newest first, each followed by a blank line.

    A line that the text has already isn't put in again. Without the heading it is put at the end.
    """
    single = entries.groupBy("filename", "line").agg(F.max("ts").alias("ts"))
    new = single.groupBy("filename").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "line")), asc=False), lambda x: x["line"]).alias("__new"))
    joined = notes.join(new, "filename").withColumn("content", F.coalesce("content", F.lit("")))
    fresh = F.filter("__new", lambda x: ~F.array_contains(T.lines("content"), x))
    block = F.concat(F.array_join(fresh, "\n\n"), F.lit("\n\n"))
    at = F.instr("content", JOURNAL) + len(JOURNAL)  # behind the heading
    rest = F.regexp_replace(F.expr(f"substring(content, instr(content, '{JOURNAL}') + {len(JOURNAL)})"), r"^\n+", "")
    under = F.concat(F.substring(F.col("content"), F.lit(1), at - 1), F.lit("\n"), block, rest)
    behind = F.concat(F.regexp_replace("content", r"[\s\p{Z}]+$", ""), F.lit(f"\n\n{JOURNAL}\n"), block)
    put = F.when(F.contains(F.col("content"), F.lit(JOURNAL)), under).otherwise(behind)
    return joined.select("filename", F.when(F.size(fresh) > 0, put).otherwise(F.col("content")).alias("content"))


def fill_template(template: Column | str, now: dt.datetime, title: Column | str) -> Column:
    """Date and title placeholders replaced."""
    out = F.col(template) if isinstance(template, str) else template
    day = lambda n: (now.date() + dt.timedelta(days=n)).isoformat()
    fixed = {
        "date": day(0), "today": day(0), "time": now.strftime("%H:%M"), "date_human": now.strftime("%A, %B %d, %Y"), "tomorrow": day(1), "yesterday": day(-1),
        "lastweek": day(-7), "nextweek": day(7), "month": now.strftime("%B"), "year": now.strftime("%Y"),
    }
    for name, value in fixed.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.lit(value))
    return F.replace(out, F.lit("{{title}}"), F.col(title) if isinstance(title, str) else title)
