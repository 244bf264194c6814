"""Note files in a folder, and tables of notes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folder import store_of


def read_vault(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``filename, content, mtime`` of every ``.md`` file below ``folder``, and the files that aren't UTF-8.

    Spark's file source leaves out files of no bytes; ``streaming.streams.folder_versions`` has them.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
        .withColumn("filename", _relative(F.col("path"), folder))
        .withColumn("text", F.expr("try_validate_utf8(cast(content as string))"))
    )
    good = files.filter("text is not null").select("filename", F.col("text").alias("content"), F.col("modificationTime").alias("mtime"))
    return good, files.filter("text is null").select("filename", F.col("modificationTime").alias("mtime"), "length")


def _relative(path: Column, folder: str) -> Column:
    root = folder.split("://", 1)[-1] if "://" in folder else folder.removeprefix("file:")
    return F.regexp_replace(path, "^.*?" + _quoted(root.rstrip("/") + "/"), "")


def _quoted(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def list_vault(spark: SparkSession, folder: str) -> DataFrame:
    """``filename, mtime`` without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder).select(_relative(F.col("path"), folder).alias("filename"), F.col("modificationTime").alias("mtime"))


def import_notes(rows: DataFrame, filename: Column, content: Column, mtime: Column) -> DataFrame:
    """Notes from any table."""
    return rows.select(filename.cast("string").alias("filename"), content.cast("string").alias("content"), mtime.cast("timestamp").alias("mtime")).filter(F.col("filename").isNotNull())


def write_vault(notes: DataFrame, folder: str) -> int:
    """Writes each note (``filename, content``) to a file of its own below ``folder``, in tasks; how many.

    ``folder`` is one that all tasks share. A task that is done again writes the same files again. Of rows with one
    name, the greatest content is written; rows without a name are left out, null content is an empty file. A name
    that leads out of the folder is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = store_of(folder.rstrip("/"))
        made = set()
        for batch in batches:
            for name, content in zip(batch.column("filename").to_pylist(), batch.column("content").to_pylist(), strict=True):
                parts = name.split("/")
                if not parts[-1] or any(p in ("", ".", "..") for p in parts):
                    raise ValueError(f"not a name below a folder: {name!r}")
                path = f"{home}/{name}"
                above = path.rpartition("/")[0]
                if above not in made:
                    store.create_dir(above, recursive=True)
                    made.add(above)
                with store.open_output_stream(path) as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    named = notes.filter("filename is not null").groupBy("filename").agg(F.max(F.coalesce("content", F.lit(""))).alias("content"))
    return named.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
