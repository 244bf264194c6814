"""Keeping an index up to date: changed files, keyed replacement, pruning, back-fill and summaries.

Operations on DataFrames give the new state, which the caller writes. A ``KeyedTable`` is a written table that can be
replaced in part: its rows lie in folders by a hash of their key, and a change rewrites the folders of its keys only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.python import signature_holds, trigram_signature
from ..scratch import discard, remove, stash
from .parse import Index, index_from, parse


def changed(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files of ``listing`` (``filename, mtime``) that ``state`` doesn't have with that time."""
    last = state.select("filename", F.col("mtime").alias("__last"), F.lit(True).alias("__known"))
    return listing.join(last, "filename", "left").filter(F.col("__known").isNull() | ~F.col("mtime").eqNullSafe(F.col("__last"))).drop("__last", "__known")


def upsert(table: DataFrame, batch: DataFrame, key: str = "filename") -> DataFrame:
    """All rows of a key in ``table`` are replaced by those in ``batch``."""
    return table.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def orphans(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Filenames of the index whose file is gone."""
    return index.select("filename").distinct().join(listing.select("filename"), "filename", "left_anti")


def prune(table: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows of any table with a filename whose file is still there."""
    return table.join(listing.select("filename").distinct(), "filename", "left_semi")


def refresh_actions(requested: DataFrame, listing: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """``filename, action``: a requested file is updated if it is there, else removed; unreadable ones are errors."""
    here = listing.select("filename").distinct().withColumn("__here", F.lit(True))
    rows = requested.select("filename").distinct().join(here, "filename", "left")
    if unreadable is None:
        return rows.select("filename", F.when(F.col("__here"), "updated").otherwise("removed").alias("action"))
    bad = unreadable.select("filename").distinct().withColumn("__bad", F.lit(True))
    return rows.join(bad, "filename", "left").select("filename", F.when(F.col("__bad"), "error").when(F.col("__here"), "updated").otherwise("removed").alias("action"))


def refresh(table: DataFrame, requested: DataFrame, listing: DataFrame, parsed: DataFrame) -> DataFrame:
    """The table after requested files were replaced by ``parsed`` rows or removed; other files' rows stay."""
    gone = table.join(requested.select("filename").distinct(), "filename", "left_anti")
    return gone.unionByName(parsed.join(requested.select("filename").distinct(), "filename", "left_semi").join(listing.select("filename").distinct(), "filename", "left_semi"))


def summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def clear(table: DataFrame) -> DataFrame:
    return table.limit(0)


def backfill(notes: DataFrame, column: str, name: str, key: str = "filename") -> DataFrame:
    """Junction rows of a column that holds a JSON array of text."""
    return notes.select(key, F.explode(F.from_json(column, "array<string>")).alias(name)).distinct()


# --- written tables --------------------------------------------------------------------------------

#: Folders of a written table; what a change of one key rewrites is one of them.
BUCKETS = 256


@dataclass
class KeyedTable:
    """A table below ``path`` in folders by a hash of ``key``; reads of given keys and changes touch their folders only.

    A change that was broken off is done again: it gives the same rows. A table may be, or become, empty.
    """

    spark: SparkSession
    path: str
    key: str = "filename"
    buckets: int = BUCKETS
    #: Order of rows in a file, by which reads skip parts of it.
    order: str = "filename"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with a task for each folder."""
        return rows.repartitionById(self.buckets, self._bucket())

    def write(self, rows: DataFrame, dealt: bool = False) -> None:
        """Writes the table anew; rows that were ``dealt`` before they were widened aren't shuffled."""
        found = (rows if dealt else self.dealt(rows)).select("*", self._bucket())
        self._sorted(found).write.mode("overwrite").partitionBy("bucket").parquet(self.path)
        # a file without rows, so that the table can be read when it has none
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bucket=-1")

    def _files(self, bucket: int) -> set[str]:
        """Names of the files in a folder, which differ from one write to the next."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
        store = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {x.getPath().getName() for x in store.listStatus(where)} if store.exists(where) else set()

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions("bucket", self.order if self.order in rows.columns else self.key)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def of_keys(self, keys: list[str]) -> DataFrame:
        """The rows of some keys, from their folders."""
        there = {r["bucket"] for r in self.spark.createDataFrame([(k,) for k in keys], f"{self.key} string").select(self._bucket()).collect()}
        return self.spark.read.parquet(self.path).filter(F.col("bucket").isin(sorted(there)) & F.col(self.key).isin(keys)).drop("bucket")

    def among(self, keys: DataFrame, few: int = 1000) -> DataFrame:
        """The rows of given keys: up to ``few`` are looked up in the files, more are joined within the folders that have some."""
        first = [r[0] for r in keys.select(self.key).distinct().limit(few + 1).collect()]
        if len(first) <= few:
            return self.of_keys(first)
        there = sorted(r["bucket"] for r in keys.select(self._bucket()).distinct().collect())  # at most as many as there are folders
        return self.spark.read.parquet(self.path).filter(F.col("bucket").isin(there)).join(keys.select(self.key), self.key, "left_semi").drop("bucket")

    def upsert(self, batch: DataFrame, keys: DataFrame | None = None) -> None:
        """All rows of ``keys`` (or of the batch's keys) are replaced by those of ``batch``; keys without any are removed."""
        asked = stash((batch if keys is None else keys).select(self.key).distinct().select("*", self._bucket()), "keys")
        touched = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # at most as many as there are folders
        if touched:
            by = ["bucket", self.key]
            keys_of = asked.repartition(self.buckets, "bucket")
            # each side is shuffled once, to the folder it is written to; a commit replaces folders when all has been read
            kept = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(touched)).repartition(self.buckets, "bucket").join(keys_of.hint("merge"), by, "left_anti")
            fresh = batch.select("*", self._bucket()).repartition(self.buckets, "bucket").join(keys_of.hint("merge"), by, "left_semi")
            before = {bucket: self._files(bucket) for bucket in touched}
            self._sorted(kept.unionByName(fresh)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            for bucket, files in before.items():
                if files and self._files(bucket) == files:  # no row is left in it, so nothing was written over it
                    remove(self.spark, f"{self.path}/bucket={bucket}")
        discard(asked)

    def drop(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def trigrams(text: Column | str) -> Column:
    """Every three characters that follow each other in a text, letters A-Z in lower case, once each."""
    return F.array_distinct(F.regexp_extract_all(T.ascii_lower(text), F.lit(r"(?s)(?=(...))"), F.lit(1)))


def needle_trigrams(needle: str, like: bool = True) -> list[str]:
    """The trigrams of every text that holds a needle; in a pattern those of its parts between wildcards and escapes."""
    parts = re.split(r"[%_\\]", T.fold_text(needle)) if like else [T.fold_text(needle)]
    return sorted({part[k : k + 3] for part in parts for k in range(len(part) - 2)})


def postings(parsed: DataFrame) -> DataFrame:
    """``filename, gram``: the trigrams of each note's title, body and attributes; line ends in bodies also as single ones, as sections have them."""
    body = F.when(F.col("body").contains("\r\n"), F.concat("body", F.lit("\n"), F.regexp_replace("body", r"\r?\n", "\n"))).otherwise(F.col("body"))
    grams = reduce(F.array_union, [F.coalesce(trigrams(c), F.array().cast("array<string>")) for c in (body, F.col("title"), F.col("header_json"))])
    return parsed.select("filename", F.explode_outer(grams).alias("gram")).filter("gram is not null")


def signed(parsed: DataFrame) -> DataFrame:
    """Adds ``signature``: some bits for the trigrams of each note's title, body and attributes, about as many as these have characters; see ``postings``."""
    body = F.when(F.col("body").contains("\r\n"), F.concat("body", F.lit("\n"), F.regexp_replace("body", r"\r?\n", "\n"))).otherwise(F.col("body"))
    # what lies over a seam between texts adds bits, and takes none
    return parsed.withColumn("signature", trigram_signature()(T.ascii_lower(F.concat_ws("\n", body, "title", "header_json"))))


@dataclass
class Grams:
    """The trigrams of kept notes, a row for each, as they follow from the notes. They aren't written: there are more of them than characters in the texts."""

    table: KeyedTable

    def read(self) -> DataFrame:
        return postings(self.table.read())


class StoredIndex:
    """An index that is kept: its parsed notes in a ``KeyedTable`` below ``folder``, from which all its tables follow without parsing a note again.

    With ``texts`` each note has a signature of its trigrams beside it, by which ``holding`` leaves out notes that can't hold a needle.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, texts: bool = False):
        self.table = KeyedTable(spark, f"{folder.rstrip('/')}/parsed", buckets=buckets)
        self.grams = Grams(self.table) if texts else None

    def write(self, index: Index) -> None:
        # texts go to their folders before they are parsed: what is parsed is several times as wide
        dealt = index.source is not None
        rows = (parse(self.table.dealt(index.source[0].select("filename", "content", "mtime")), index.source[1]) if dealt else index.parsed).drop("header")
        self.table.write(signed(rows) if self.grams else rows, dealt)

    def read(self) -> Index:
        return index_from(self.table.read().drop("signature"))

    def _possible(self, needles: list[str], like: bool) -> DataFrame | None:
        """The kept notes whose signatures have every trigram of the needles; None if these have none."""
        asked = sorted({g for needle in needles for g in needle_trigrams(needle, like)})
        if not asked or self.grams is None:
            return None
        return self.table.read().filter(signature_holds(asked)("signature"))

    def candidates(self, needles: list[str], like: bool = True) -> DataFrame | None:
        """``filename`` of the notes that have every trigram of the needles, and of few others; None if these have none, so that any note may match."""
        found = self._possible(needles, like)
        return None if found is None else found.select("filename")

    def holding(self, *needles: str, like: bool = True, few: int = 1000) -> Index:
        """An index of the notes that can hold all needles (patterns with ``%`` and ``_``, or plain texts): searches that ask for these find in it what they find in all notes.

        Up to ``few`` notes are looked up by their paths; more are told by their signatures as the table is read, so that no text is shuffled.
        """
        found = self._possible(list(needles), like)
        if found is None:
            return self.read()
        first = [r[0] for r in found.select("filename").limit(few + 1).collect()]
        return index_from((self.table.of_keys(first) if len(first) <= few else found).drop("signature"))

    def refresh(self, fresh: Index, removed: DataFrame | None = None) -> None:
        """Notes of ``fresh`` are replaced and those ``removed`` (``filename``) go, with their todos, tags, links, segments and attributes."""
        rows = fresh.parsed.drop("header")
        names = stash(rows.select("filename") if removed is None else rows.select("filename").unionByName(removed.select("filename")), "names")
        self.table.upsert(signed(rows) if "signature" in self.table.read().columns else rows, names)
        discard(names)
