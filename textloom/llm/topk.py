"""Exact top-k search by refining score histograms.

Every candidate is scored against every query of a block.  Pass by pass, each task
counts its scores in equal bins of the interval that holds a query's kth score;
the counts add up over the cluster, and the bin with the kth score is the next
interval.  A task leaves out bins below its own kth score, which can't hold the
global one.  When intervals are one score wide, rows with the kth score or more
remain, each task keeps its best k of them (score, then smaller id), and a last
ranking of those picks the result.  So nothing but bounded counts and at most k
rows a query and task are ever moved, and any number of equal vectors is safe.

Queries travel in blocks of ``block`` vectors, collected one block at a time.

Defined cases: null vectors, and vectors with null or non-finite components or
without an id, take no part; vectors of different lengths score over the shorter
one; repeated rows of a vec_id are candidates each (a query skips all rows with its
id) and one query; scores that could pass 2**63 fail the job; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stash, table

BINS = 512


def vectors(df: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, v): whole-number vectors that take part."""
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values, offs = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offs, n = offs - offs[0], len(column)
    size = np.diff(offs)
    if n and (size == width).all():
        return values.reshape(n, width)
    out = np.zeros((n, width), dtype=np.int64)
    for i in range(n):
        out[i, : min(width, size[i])] = values[offs[i] : offs[i] + min(width, size[i])]
    return out


def _scores(batches, ids, queries):
    """(candidate ids, scores by query and candidate, own) in blocks of bounded size."""
    width = queries.shape[1]
    top = float(np.abs(queries.astype(float)).max(initial=0))
    step = max(1, (1 << 22) // max(1, len(ids)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            m = _matrix(part.column("v"), width)
            # Products add up exactly in doubles below 2**53; larger ones take the slow way.
            most = width * top * float(np.abs(m.astype(float)).max(initial=0))
            if most >= 1 << 63:
                raise ValueError("components are too large: a score could pass 2**63")
            small = most < 1 << 53
            s = (queries.astype(float) @ m.T.astype(float)).astype(np.int64) if small else queries @ m.T
            vec = part.column("vec_id").to_numpy()
            yield vec, s, vec[None, :] == ids[:, None]


def _count(batches, ids, queries, low, wide, k):
    """Histogram rows (query, bin, n) of the intervals, from each task's own kth score up."""
    n = np.zeros((len(ids), BINS), dtype=np.int64)
    for _, s, own in _scores(batches, ids, queries):
        b = (s - low[:, None]) // wide[:, None]
        np.clip(b, -1, BINS - 1, out=b)
        b[own] = -1
        q, c = np.nonzero(b >= 0)
        n += np.bincount(q * BINS + b[q, c], minlength=n.size).reshape(n.shape)
    above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
    q, b = np.nonzero((n > 0) & (above < k))
    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(b.astype(np.int32)), pa.array(n[q, b])], names=["query_id", "bin", "n"])


def _range(batches, ids, queries):
    low, high = None, None
    for _, s, _own in _scores(batches, ids, queries):
        low = s.min(1) if low is None else np.minimum(low, s.min(1))
        high = s.max(1) if high is None else np.maximum(high, s.max(1))
    if low is not None:
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low), pa.array(high)], names=["query_id", "low", "high"])


def _keep(batches, ids, queries, least, k):
    best = [np.zeros((0, 2), dtype=np.int64) for _ in ids]
    for vec, s, own in _scores(batches, ids, queries):
        q, c = np.nonzero((s >= least[:, None]) & ~own)
        cut = np.searchsorted(q, np.arange(len(ids) + 1))
        for i in np.unique(q):
            rows = np.concatenate((best[i], np.stack((s[i, c[cut[i] : cut[i + 1]]], vec[c[cut[i] : cut[i + 1]]]), 1)))
            best[i] = rows[np.lexsort((rows[:, 1], -rows[:, 0]))[:k]]
    q = np.repeat(ids, [len(x) for x in best])
    rows = np.concatenate(best) if best else np.zeros((0, 2), dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.ascontiguousarray(rows[:, 1])), pa.array(np.ascontiguousarray(rows[:, 0]))], names=["query_id", "vec_id", "score"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates; inputs: (vec_id, v)."""
    spark = candidates.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    out = []
    queries = stash(queries.dropDuplicates(["vec_id"]), "queries")
    blocks = max(1, -(-queries.count() // block))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    for i in range(blocks):
        rows = queries.filter(part == i).collect()
        if not rows:
            continue
        ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        width = max(len(r["v"]) for r in rows)
        q = np.zeros((len(rows), width), dtype=np.int64)
        for j, r in enumerate(rows):
            q[j, : len(r["v"])] = r["v"]
        at = {v: j for j, v in enumerate(ids.tolist())}
        ranges = candidates.mapInArrow(partial(_range, ids=ids, queries=q), "query_id long, low long, high long").groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        if not ranges:
            continue
        low, high, need = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.full(len(ids), k)
        for r in ranges:
            low[at[r["query_id"]]], high[at[r["query_id"]]] = r["low"], r["high"]
        # Bins below an interval count as none, bins above as the last; need: scores still wanted from the interval.
        wide = np.maximum(1, -(-(high - low + 1) // BINS))
        while True:
            got = candidates.mapInArrow(partial(_count, ids=ids, queries=q, low=low, wide=wide, k=k), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n")).collect()
            n = np.zeros((len(ids), BINS), dtype=np.int64)
            for r in got:
                n[at[r["query_id"]], r["bin"]] = r["n"]
            reach = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] >= need[:, None]
            b = np.where(reach.any(1), BINS - 1 - np.argmax(reach[:, ::-1], axis=1), 0)
            low, done = low + b * wide, wide == 1
            if done.all():
                break
            # The bin is cut again; what lies above it falls into the last bin and is counted there again.
            wide = np.where(done, 1, np.maximum(1, -(-wide // (BINS - 1))))
        kept = candidates.mapInArrow(partial(_keep, ids=ids, queries=q, least=low, k=k), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        out.append(kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    result = out[0] if out else spark.createDataFrame([], schema)
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.filter("vec_id % 100 = 0"))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
