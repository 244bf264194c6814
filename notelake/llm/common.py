"""Helpers that several text operators share: scratch tables, row splits and text access."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, scratch_path, stash

__all__ = ["discard", "id_split", "keep_rows", "labelled_texts", "sample_ids", "scratch_path", "stash", "table", "unused"]


def id_split(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_ids(df: DataFrame, id_column: str, rows: int) -> DataFrame:
    """The ``rows`` ids with the smallest hash: a bounded sample that does not depend on partitioning."""
    return df.orderBy(F.xxhash64(id_column, F.lit("sample")), id_column).limit(rows)


def labelled_texts(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """``doc_id, text, <label>``, written: one text for each row of ``ids``, a sample of bounded size (so it may be broadcast).

    Of rows that share an id, that whose text has the least hash counts, so the result is bounded as ``ids`` are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(ids.select(F.col("doc_id").cast("long").alias("doc_id"), label)), "doc_id")
    one = found.groupBy("doc_id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return stash(one.select("doc_id", "text", label).repartition(32), "sample")


def keep_rows(docs: DataFrame, model, keep) -> DataFrame:
    """Rows of ``docs`` whose text passes ``keep(model, text)``; columns and schema stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([keep(m, t.as_py()) for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
