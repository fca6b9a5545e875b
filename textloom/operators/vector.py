"""Nearest neighbours by cosine (V1)."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import ranked


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(batches, ids, queries, k):
    """Each task's k best rows of every query: score, then smaller id."""
    norm = np.sqrt((queries * queries).sum(1))
    best = [np.zeros(0, [("score", float), ("vec_id", np.int64)]) for _ in ids]
    for batch in batches:
        for at in range(0, batch.num_rows, step := max(1, (1 << 21) // len(ids))):
            part = batch.slice(at, step)
            m = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            vec = part.column("vec_id").to_numpy()
            scores = np.round(queries @ m.T / (norm[:, None] * np.sqrt((m * m).sum(1))), 6)
            for i, s in enumerate(scores):
                keep = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                rows = np.zeros(len(keep), best[i].dtype)
                rows["score"], rows["vec_id"] = s[keep], vec[keep]
                rows = np.concatenate((best[i], rows))
                best[i] = rows[np.lexsort((rows["vec_id"], -rows["score"]))[:k]]
    rows = np.concatenate(best)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in best])), pa.array(np.ascontiguousarray(rows["vec_id"])), pa.array(np.ascontiguousarray(rows["score"]))], names=["query_id", "vec_id", "score"])


def knn(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of (vec_id, embedding) to each stated query (query_id, query).

    Queries travel in blocks of about ``block``, whatever their number, and a task sends its k best rows of a query.

    Vectors of one length; those with nulls, NaN or infinity, without an id or without a length (all 0) take no part.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    as_doubles = lambda df, i, x: df.select(F.col(i).cast("long").alias(i), F.col(x).cast("array<double>").alias("v")).filter(F.col(i).isNotNull() & (dot(F.col("v"), F.col("v")) > 0) & (dot(F.col("v"), F.col("v")) < float("inf")))
    candidates, asked = as_doubles(vectors, "vec_id", "embedding"), as_doubles(queries, "query_id", "query")
    parts = max(1, -(-asked.count() // block))
    out = spark.createDataFrame([], schema)
    for p in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).collect()
        if rows:
            ids, q = np.array([r["query_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], float)
            out = out.unionByName(candidates.mapInArrow(partial(_best, ids=ids, queries=q, k=k), schema))
    return ranked(out, "query_id", [F.desc("score"), F.asc("vec_id")], k)
