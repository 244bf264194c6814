"""Cosine similarity of many queries with many vectors, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, and groups of blocks that each block of queries is sent to.
BLOCK, LANES = 4096, 32


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``dim, ids, cells``: unit rows of vectors of one length; vectors of length zero have zero rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list, list]] = {}

        def close(dim: int) -> pa.RecordBatch:
            ids, cells = open_.pop(dim)
            m = np.array(cells, float).reshape(len(ids), dim)
            length = np.sqrt((m * m).sum(axis=1, keepdims=True))
            m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "cells": pa.array([m.tobytes()], pa.binary())})

        for batch in batches:
            for key, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids, cells = open_.setdefault(len(v), ([], []))
                ids.append(key)
                cells.append([np.nan if x is None else x for x in v])
                if len(ids) == size:
                    yield close(len(v))
        for dim in list(open_):
            yield close(dim)

    return rows.mapInArrow(run, "dim int, ids binary, cells binary")


def similar(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` vectors (``id, embedding``) with the highest cosine for each query (``query_id, vector``).

    Vectors without an embedding or with a null component are left out. A vector of another length than the
    query's, or of length zero, has score 0 in a search with one query (``similar_to``); here lengths meet
    only their own. Scores are compared at nine digits, ties go to the smaller id.
    """
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull())
    mine = _blocks(vectors.filter(whole("embedding")).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")), BLOCK).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(LANES).cast("long")))
    asked = _blocks(queries.filter(whole("vector")).select(F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v")), 512)
    asked = asked.select("dim", F.col("ids").alias("query_ids"), F.col("cells").alias("query_cells"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))).alias("lane"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                score = np.round(np.frombuffer(row["query_cells"]).reshape(len(query_ids), -1) @ np.frombuffer(row["cells"]).reshape(len(ids), -1).T, 9)
                for q, line in zip(query_ids.tolist(), score, strict=True):
                    best = np.flatnonzero(line >= np.partition(line, -k)[-k]) if len(line) > k else np.arange(len(line))
                    best = best[np.lexsort((ids[best], -line[best]))[:k]]
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.full(len(best), q)), "id": pa.array(ids[best]), "score": pa.array(line[best])})

    found = mine.join(asked, ["lane", "dim"]).select("ids", "cells", "query_ids", "query_cells").mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
