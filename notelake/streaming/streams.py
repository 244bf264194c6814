"""Structured Streaming over note versions and visits, and folders of notes as such streams.

Note versions arrive as rows ``filename, content, mtime, deleted``: a changed file is a new row, a removed one a
tombstone. Spark's file source takes each file once and sees no removal, so a folder whose files are
rewritten is read by a source of its own (``sources.folder``). State by file keeps late older versions out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.maintenance import upsert
from ..sources.folder import VERSION, NoteFolder

#: How late a visit may come before its window is closed.
LATE, WINDOW = "1 hour", "8 hours"


def latest_versions(versions: DataFrame) -> DataFrame:
    """The last version of each file; removed files have none. For a stream, in update or complete mode."""
    last = versions.groupBy("filename").agg(F.max_by(F.struct("content", "mtime", "deleted"), "mtime").alias("v"))
    return last.filter(~F.coalesce("v.deleted", F.lit(False))).select("filename", "v.content", "v.mtime")


def visit_counts(visits: DataFrame, window: str = WINDOW, late: str = LATE) -> DataFrame:
    """Visits by browser in tumbling windows; ``ts`` is a timestamp."""
    return visits.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "browser").agg(F.count("*").alias("n_visits")).select(F.col("w.start").alias("window_start"), "browser", "n_visits")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a table below ``folder``; what has been read once isn't read again."""
    spark = stream.sparkSession
    out = f"{folder}/out"
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(out)
    else:

        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else S.StructType([*stream.schema.fields, S.StructField("__batch", S.IntegerType())])).option("recursiveFileLookup", "true").parquet(out)


def latest_of_updates(updates: DataFrame, key: str) -> DataFrame:
    """What an update-mode table says last about each key."""
    columns = [c for c in updates.columns if c not in (key, "__batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*columns), "__batch").alias("v")).select(key, *[f"v.{c}" for c in columns])


def watch(versions: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """Calls ``refresh(latest versions of a batch, number)`` for each batch: parsing, keyed replacement and pruning go there."""

    def each(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("filename").agg(F.max_by(F.struct("content", "mtime", "deleted"), "mtime").alias("v")).select("filename", "v.*")
        refresh(last, number)

    writer = versions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def apply_versions(table: DataFrame, last: DataFrame, rows: DataFrame) -> DataFrame:
    """A table after a batch: rows of changed files replaced, of removed ones dropped."""
    keep = table.join(last.filter(F.coalesce("deleted", F.lit(False))).select("filename"), "filename", "left_anti")
    return upsert(keep, rows)


def folder_versions(spark: SparkSession, folder: str, home: str) -> DataFrame:
    """The stream of versions (``VERSION``) of the notes below a folder; listings are kept in ``home``."""
    spark.dataSource.register(NoteFolder)
    return spark.readStream.format("note_folder").option("state", f"{home}/listings").load(folder)


def watch_folder(spark: SparkSession, folder: str, refresh: Callable[[DataFrame, int], None], home: str, every: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """Calls ``refresh(versions, number)`` for each round in which something changed below a folder; ``home`` keeps its state.

    Every round lists the folder and opens the files that changed, whatever time they have and in whatever order
    they came. A round that failed is done again, with the same changes.
    """
    return watch(folder_versions(spark, folder, home), refresh, f"{home}/checkpoint", every, once)


def newest_versions(versions: DataFrame, keep: dt.timedelta = dt.timedelta(days=30)) -> DataFrame:
    """A stream of versions without those that come after a newer one of their file; in update mode.

    The state of a file is its last version's time, so late older versions don't replace newer ones in whatever batch
    they come. Of versions with one time, removals come last, then the greater digest counts: any split into batches
    gives the same answer. A removed file's state goes after ``keep``, by a timer, so the state has the files that are
    there and those removed lately; the timer's clock is the time at which batches began, so no version is late for it.
    Times are compared to the microsecond, versions without one come first.
    """
    keep_ms = max(1, int(keep.total_seconds() * 1000))
    ranked = versions.select(
        "filename", "content", "mtime", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce(F.unix_micros("mtime"), F.lit(-(2**63))).alias("at"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"), F.current_timestamp().alias("arrived")
    ).withWatermark("arrived", "0 seconds")

    def newest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, row = (state.get if state.exists else None), None
        for part in parts:
            for r in part.itertuples(index=False):
                now = (int(r.at), bool(r.deleted), r.digest)
                if best is None or now > tuple(best):
                    best, row = now, r
        if row is not None:
            state.update(best)
            yield pd.DataFrame({"filename": [key[0]], "content": [row.content], "mtime": [row.mtime], "deleted": [bool(row.deleted)]})
            if best[1]:
                state.setTimeoutTimestamp(int(row.arrived.timestamp() * 1000) + keep_ms)
        elif best is not None and best[1]:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + keep_ms)

    return ranked.groupBy("filename").applyInPandasWithState(newest, VERSION, "at long, deleted boolean, digest string", "update", GroupStateTimeout.EventTimeTimeout)
