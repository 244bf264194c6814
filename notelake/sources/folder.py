"""A folder of notes as a stream of versions: each round reads only the files that changed.

An offset is the number of a stored listing. A new listing is walked in order and merged with the last one as it is
written, so neither is held in memory: what is new, has another time or size, or is gone goes to a file of changes,
and a task gets a range of that file. A changed file is opened in its task; a removed one is a tombstone. Listings and
changes that a finished round no longer needs are deleted, so what is left behind is one listing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

VERSION = "filename string, content string, mtime timestamp, deleted boolean"
#: Changes that a task reads.
FILES = 256


class Changes(InputPartition):
    """A range of bytes of a round's file of changes."""

    def __init__(self, number: int, first: int, end: int):
        super().__init__((number, first, end))
        self.number, self.first, self.end = number, first, end


class NoteFolder(DataSource):
    """Options: ``path`` (a folder that the driver and all tasks can reach), ``state`` (a folder for listings), ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return "note_folder"

    def schema(self) -> str:
        return VERSION

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self.options["state"], self.options.get("suffix", ".md"))


def store_of(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FolderReader(DataSourceStreamReader):
    def __init__(self, path: str, state: str, suffix: str):
        self.path, self.state, self.suffix = path.rstrip("/"), state.rstrip("/"), suffix

    _store = staticmethod(store_of)

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        store, home = self._store(self.state)
        store.create_dir(home, recursive=True)
        last = max((n for n, _ in self._kept(store, home, "listing")), default=0)
        return {"round": last + 1 if self._list(store, home, last) else last}

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        store, home = self._store(self.state)
        out = []
        for number in range(start["round"] + 1, end["round"] + 1):
            with store.open_input_stream(f"{home}/marks-{number}") as f:
                marks = json.loads(f.read())
            out += [Changes(number, a, b) for a, b in zip(marks, marks[1:])]
        return out

    def read(self, partition: Changes) -> Iterator[tuple]:
        store, home = self._store(self.state)
        files, root = self._store(self.path)
        with store.open_input_file(f"{home}/changes-{partition.number}") as f:
            f.seek(partition.first)
            lines = f.read(partition.end - partition.first).decode().splitlines()
        for name, mtime, _, deleted in map(json.loads, lines):
            when = datetime.fromtimestamp(mtime / 1e9, timezone.utc) if mtime is not None else None
            if deleted:
                yield name, None, when, True
                continue
            try:
                with files.open_input_stream(f"{root}/{name}") as f:
                    yield name, f.read().decode("utf-8", "replace"), when, False
            except FileNotFoundError:
                continue  # went after the listing: a tombstone of the next round

    def commit(self, end: dict) -> None:
        """What rounds up to ``end`` needed goes; its listing stays, as the next is merged with it."""
        store, home = self._store(self.state)
        for kind in ("changes", "marks", "listing"):
            for number, path in self._kept(store, home, kind):
                if number < end["round"] or kind != "listing" and number == end["round"]:
                    store.delete_file(path)

    @staticmethod
    def _kept(store, home: str, kind: str) -> list[tuple[int, str]]:
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(home, allow_not_found=True))
        return [(int(i.base_name.rpartition("-")[2]), i.path) for i in found if i.base_name.startswith(f"{kind}-") and i.base_name.rpartition("-")[2].isdigit()]

    def _walk(self, files, folder: str, below: str) -> Iterator[tuple[str, int | None, int]]:
        """``name, mtime, size`` of all notes, in order of the parts of their names; one folder at a time is held."""
        from pyarrow import fs

        for info in sorted(files.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.base_name):
            name = f"{below}{info.base_name}"
            if info.type == fs.FileType.Directory:
                yield from self._walk(files, info.path, f"{name}/")
            elif info.base_name.endswith(self.suffix):
                yield name, info.mtime_ns, info.size

    def _list(self, store, home: str, last: int) -> bool:
        """Writes the listing after ``last`` and what it changes; nothing if nothing did."""
        files, root = self._store(self.path)
        number, marks, count, at = last + 1, [0], 0, 0
        order = lambda row: row[0].split("/")
        with store.open_output_stream(f"{home}/new-listing") as listing, store.open_output_stream(f"{home}/changes-{number}") as changes:

            def change(name: str, mtime: int | None, size: int | None, deleted: bool) -> None:
                nonlocal count, at
                line = json.dumps([name, mtime, size, deleted]).encode() + b"\n"
                changes.write(line)
                count, at = count + 1, at + len(line)
                if count % FILES == 0:
                    marks.append(at)

            before = self._listed(store, home, last)
            old = next(before, None)
            for row in self._walk(files, root, ""):
                listing.write(json.dumps(row).encode() + b"\n")
                while old is not None and order(old) < order(row):
                    change(old[0], old[1], None, True)
                    old = next(before, None)
                if old is not None and old[0] == row[0]:
                    if (old[1], old[2]) != (row[1], row[2]):
                        change(*row, False)
                    old = next(before, None)
                else:
                    change(*row, False)
            while old is not None:
                change(old[0], old[1], None, True)
                old = next(before, None)
        if not count:
            store.delete_file(f"{home}/new-listing")
            store.delete_file(f"{home}/changes-{number}")
            return False
        if marks[-1] != at:
            marks.append(at)
        with store.open_output_stream(f"{home}/marks-{number}") as f:
            f.write(json.dumps(marks).encode())
        # the listing comes last: a round counts once it is there
        store.move(f"{home}/new-listing", f"{home}/listing-{number}")
        return True

    @staticmethod
    def _listed(store, home: str, number: int) -> Iterator[tuple]:
        if not number:
            return
        with store.open_input_stream(f"{home}/listing-{number}") as f:
            rest = b""
            while part := f.read(1 << 16):
                *lines, rest = (rest + part).split(b"\n")
                for line in lines:
                    yield tuple(json.loads(line))
