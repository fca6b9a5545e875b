"""Substring dedup: words covered by a window that a smaller document also has.

Every window of ``width`` consecutive words has a Rabin-Karp hash.  Windows are
counted in Spark, but not one row each: consecutive windows that share a winnowing
anchor (the least ``ANCHOR``-gram hash among those inside the window) travel as one
run, under the anchor and the sums of their hashes (128 bits, as those of windows).  Equal windows have equal
anchors, so

* a run whose anchor occurs in one document only holds no repeated window;
* if all runs of an anchor are equal, the least document of the run has all of
  its windows first, and the other runs are repeats as a whole;
* the windows of the remaining runs (edges of repeated passages) are counted one
  by one: least doc_id for each window hash.

Repeated windows of a document merge into maximal intervals of words, which go.
No group is ever gathered: hot windows meet in partial aggregates, whose results are
written, so that joins on anchors and windows read plain exchanges, which adaptive
execution splits where a key is hot.

Defined cases: null or empty texts have no words (n_words 0, SHA-256 of nothing);
texts shorter than a window keep all words; rows with a null doc_id keep all and
repeat nothing; repeated rows of one doc_id don't repeat each other; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Words, blocks, sliding_min
from .shared import lean, stash, table

ANCHOR = 24
_PARTS = "array<struct<first:int,n:int,edge:boolean>>"


def _runs(data, offs, width):
    """(document, first word, windows, anchor, sums of hashes) of each run of a block."""
    w = Words(data, offs)
    at = np.flatnonzero(w.within(width))
    if not len(at):
        return None
    k = min(ANCHOR, width)
    grams, _ = w.grams(k, salt=77)
    anchor = sliding_min(grams, width - k + 1)[at]
    doc = w.doc_of()[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    sums = [np.add.reduceat(w.grams(width, salt)[0][at], first) for salt in (0, 1)]
    return doc[first], at[first] - w.offs[doc[first]], np.diff(np.append(first, len(at))), anchor[first], *sums


def _scan(batches, width):
    for rows, data, offs in blocks(batches):
        runs = _runs(data, offs, width)
        if runs is None:
            continue
        doc, first, n, anchor, a, b = runs
        ids, keys = rows.column("doc_id").take(pa.array(doc)), rows.column("key").take(pa.array(doc))
        yield pa.RecordBatch.from_arrays([ids, keys, pa.array(anchor.view(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "key", "anchor", "a", "b", "first", "n"])


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _settle(batches):
    """Documents without edge runs are finished; the others keep their text."""
    for batch in batches:
        out = [[] for _ in range(6)]
        parts = batch.column("parts").to_pylist()
        for i, (text, part) in enumerate(zip(batch.column("text").to_pylist(), parts)):
            edges = [(p["first"], p["n"]) for p in part or () if p["edge"]]
            sure = [(p["first"], p["n"]) for p in part or () if not p["edge"]]
            words = (text or "").encode().split()
            for col, x in zip(out, (len(words), None, None, text if part else None, [{"first": a, "n": n} for a, n in sorted(set(sure))], [{"first": a, "n": n} for a, n in sorted(set(edges))])):
                col.append(x)
            if not part:
                out[1][-1], out[2][-1] = 0, _digest(words)
        spans = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], spans), pa.array(out[5], spans)], names=["doc_id", "key", "n_words", "n_removed", "kept_sha256", "text", "sure", "edges"])


def _windows(batches, width):
    """A row for each window of the edge runs."""
    for rows, data, offs in blocks(batches):
        w = Words(data, offs)
        a, b = w.grams(width, 0)[0], w.grams(width, 1)[0]
        edges = rows.column("edges").to_pylist()
        doc = np.repeat(np.arange(len(edges)), [sum(e["n"] for e in x) for x in edges])
        at = [np.arange(e["first"], e["first"] + e["n"]) for x in edges for e in x]
        if not at:
            continue
        at = np.concatenate(at)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(doc)), rows.column("key").take(pa.array(doc)), pa.array(a[at + w.offs[doc]].view(np.int64)), pa.array(b[at + w.offs[doc]].view(np.int64)), pa.array(at.astype(np.int32))], names=["doc_id", "key", "window", "twin", "at"])


def _cut(batches, width):
    for batch in batches:
        removed, sha, spans = [], [], []
        for text, sure, more in zip(batch.column("text").to_pylist(), batch.column("sure").to_pylist(), batch.column("more").to_pylist()):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for a, n in [(p["first"], p["n"]) for p in sure] + [(a, 1) for a in more or ()]:
                gone[a] += 1
                gone[a + n + width - 1] -= 1
            keep = np.cumsum(gone[:-1]) == 0
            kept = [x for x, k in zip(words, keep) if k]
            edge = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype(np.int8)))
            removed.append(len(words) - len(kept))
            sha.append(_digest(kept))
            spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])])
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, kind)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])


def dedup_substrings(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed intervals of words (first and last)."""
    lean(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("key"))
    known = docs.filter("doc_id is not null and text is not null")
    runs = known.mapInArrow(partial(_scan, width=width), "doc_id long, key long, anchor long, a long, b long, first int, n int")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("a", "b") for f in (F.min, F.max)]
    shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), *ends).filter("least < most")
    shared = stash(shared.select("anchor", "least", F.expr("min_a <> max_a or min_b <> max_b").alias("edge")), "anchors")
    parts = runs.join(shared.hint("merge"), "anchor").filter("edge or doc_id > least").groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "n", "edge")).alias("parts"))
    settled = stash(
        docs.join(parts, ["doc_id", "key"], "left").select("doc_id", "key", "text", F.col("parts").cast(_PARTS).alias("parts")).mapInArrow(
            _settle, "doc_id long, key long, n_words long, n_removed long, kept_sha256 string, text string, sure array<struct<first:int,n:int>>, edges array<struct<first:int,n:int>>"
        ),
        "substrings",
    )
    done = settled.filter("kept_sha256 is not null").select("doc_id", "n_words", "n_removed", "kept_sha256", F.array().cast("array<struct<first:long,last:long>>").alias("removed"))
    open_ = settled.filter("kept_sha256 is null")
    windows = open_.filter("size(edges) > 0").select("doc_id", "key", "text", "edges").mapInArrow(partial(_windows, width=width), "doc_id long, key long, window long, twin long, at int")
    least = windows.groupBy("window", "twin").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("window", "twin", "least")
    more = windows.join(stash(least, "windows").hint("merge"), ["window", "twin"]).filter("doc_id > least").groupBy("doc_id", "key").agg(F.collect_list("at").alias("more"))
    cut = (
        open_.join(more, ["doc_id", "key"], "left")
        .select("doc_id", "n_words", "text", "sure", "more")
        .mapInArrow(partial(_cut, width=width), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:long,last:long>>")
    )
    return done.unionByName(cut)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("removed")


SQL = """
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), p as (
  select doc_id, unnest(range(1, len(w) - 48)) as i, w from d where len(w) >= 50
), g as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') as s from p
), r as (
  select distinct a.doc_id, a.i from (select doc_id, i, min(doc_id) over (partition by s) as least from g) a where a.least < a.doc_id
), k as (
  select d.doc_id, len(w) as n, list_filter(range(1, len(w) + 1), lambda j: not coalesce(list_bool_or(list_transform(x.s, lambda i: j >= i and j <= i + 49)), false)) as keep, w
  from d left join (select doc_id, list(i) as s from r group by 1) x using (doc_id)
)
select doc_id, n::bigint as n_words, (n - len(keep))::bigint as n_removed,
       sha256(array_to_string(list_transform(keep, lambda j: w[j]), ' ')) as kept_sha256
from k
"""
