"""Packing of token sequences by non-negative least squares over length combinations.

Each document is tokenised (its ids, then id 0).  Whole windows are cut off first;
what remains of each document is shorter than a window.  The histogram of these
lengths (fewer bins than a window has tokens) goes to the driver, which enumerates
all combinations of up to three lengths that fill a window (fewer than a twelfth of the
square of the window), solves how often each repeats by non-negative least squares
(multiplicative updates), rounds to whole numbers that the histogram has, and packs
the residual counts greedily, longest first with the longest that still fit.
Sequences are then joined back by rank within a length.  Ranks come from two
steps, a count for each (bucket, length) and a row number inside it, so one length
that a third of all documents share is spread over all buckets.

Defined cases: a null or empty text is the single id 0; texts of any length are
tokenised whole; repeated rows and null doc_ids are packed like others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from bisect import bisect_right
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernel import blocks, process_cache
from .shared import lean, stash, table

MEMO = 400_000


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, exactly those of the vocabulary file.

    A space before a character that isn't white space always begins a pre-token, so
    a text is cut there and pieces are remembered (up to MEMO of them).
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path.replace(".json", ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.whole = path, None
        self.memo: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        ids = array("I", self.fast.encode_ordinary(piece))
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        if "<|endoftext|>" in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        memo, (head, *pieces) = self.memo, text.split(" ")
        out = list(map(memo.get, pieces))
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    p = pieces[i]
                    if not p or p[0].isspace():  # more white space follows: not a place to cut
                        return self._ids(text)
                    out[i] = memo.get(p) or self._ids(" " + p)
                    if len(memo) < MEMO and len(p) <= 64:
                        memo[p] = out[i]
        return self._ids(head) + b"".join(out)


def _tokenise(batches, path, window):
    cache = process_cache()
    encoder = cache.get(path) or cache.setdefault(path, Encoder(path))
    step = 4 * window
    for rows, data, offs in blocks(batches):
        raw, cuts = data.tobytes(), offs.tolist()
        n, crcs = [], []
        for a, b in zip(cuts, cuts[1:]):
            ids = encoder.encode(raw[a:b].decode()) + b"\0\0\0\0"
            n.append(len(ids) // 4)
            crcs.append([zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)])
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])


def combinations(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """All combinations of up to three of the lengths that fill a window."""
    have, out = set(lengths), []
    for a in lengths:
        if window - a in have and a >= window - a:
            out.append((a, window - a))
    return out + [(a, b, window - a - b) for a in lengths for b in lengths if b <= a and window - a - b <= b and window - a - b in have]


def solve(counts: dict[int, int], window: int, rounds: int = 120) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, repeats)] that use up the histogram exactly."""
    lengths = sorted((x for x, n in counts.items() if n > 0), reverse=True)
    left = {x: counts[x] for x in lengths}
    plan: list[tuple[tuple[int, ...], int]] = []
    combos = combinations(lengths, window)
    if combos:
        row = {x: i for i, x in enumerate(lengths)}
        target = np.array([counts[x] for x in lengths], dtype=float)
        at = np.array([[row[x] for x in (c + (c[0],))[:3]] for c in combos])
        use = np.array([[1.0, 1.0, float(len(c) == 3)] for c in combos])
        x = np.full(len(combos), target.sum() / (2.5 * len(combos)))
        for _ in range(rounds):  # minimise |A x - target|, x >= 0
            made = np.bincount(at.ravel(), (use * x[:, None]).ravel(), len(lengths))
            x *= (use * target[at]).sum(1) / np.maximum((use * made[at]).sum(1), 1e-9)
        for c, n in sorted(zip(combos, np.floor(x + 0.5).astype(np.int64).tolist()), key=lambda p: -p[1]):
            need = {v: c.count(v) for v in c}
            n = min([n, *(left[v] // m for v, m in need.items())])
            if n > 0:
                plan.append((c, n))
                for v, m in need.items():
                    left[v] -= n * m
    rest = sorted(v for v, n in left.items() if n)
    while rest:  # greedy: the longest, then always the longest that fits
        room, chosen = window, []
        while room and rest:
            i = bisect_right(rest, room) - 1
            while i >= 0 and left[rest[i]] <= chosen.count(rest[i]):
                i -= 1
            if i < 0:
                break
            chosen.append(rest[i])
            room -= rest[i]
        n = min(left[v] // chosen.count(v) for v in set(chosen))
        plan.append((tuple(chosen), n))
        for v in chosen:
            left[v] -= n
        rest = [v for v in rest if left[v]]
    return plan


def _ranges(plan):
    """For each length: ranks from, first sequence, offset; and the number of sequences."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for combo, n in plan:
        offset = 0
        for v in combo:
            out.setdefault(v, []).append((used.get(v, 0), sequence, offset))
            used[v] = used.get(v, 0) + n
            offset += v
        sequence += n
    return out, sequence


def _place(batches, ranges):
    starts = {v: [r[0] for r in x] for v, x in ranges.items()}
    for batch in batches:
        seq, off = [], []
        for v, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
            first, sequence, offset = ranges[v][bisect_right(starts[v], rank) - 1]
            seq.append(sequence + rank - first)
            off.append(offset)
        cols = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, window: int = 1024, bucket_rows: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece."""
    lean(docs)
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_tokenise, path=path, window=window), "doc_id long, doc_tokens long, crcs array<long>")
    # Buckets of rows as they were written: stored, so ranks are the same whenever they are read.
    uid = F.monotonically_increasing_id()
    tokens = stash(tokens.withColumn("uid", uid), "tokens").withColumn("bucket", F.floor(F.col("uid") / bucket_rows))
    tail = F.col("doc_tokens") % window
    parts = tokens.groupBy("bucket").agg(F.sum(F.floor(F.col("doc_tokens") / window)).alias("n"))
    ends = tokens.filter(tail > 0).select("doc_id", "uid", "bucket", "doc_tokens", tail.alias("length"), (F.col("doc_tokens") - tail).alias("start"), F.element_at("crcs", -1).alias("ids_crc32"))
    by_length = ends.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in by_length.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges, sequences = _ranges(solve(counts, window))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = by_length.select("length", "bucket", before(Window.partitionBy("length").orderBy("bucket")).alias("first"))
    ranked = ends.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid")) - 1).join(first, ["length", "bucket"])
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("own") + F.col("first")).alias("rank")).mapInArrow(
        partial(_place, ranges=ranges), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    # Whole windows: a sequence each, numbered after the others by bucket, document and place.
    whole = tokens.filter(F.col("doc_tokens") >= window)
    own = whole.groupBy("bucket", "uid").agg(F.sum(F.floor(F.col("doc_tokens") / window)).alias("n"))
    inside = own.select("uid", "bucket", before(Window.partitionBy("bucket").orderBy("uid")).alias("inside"))
    group = F.floor(F.col("bucket") / 4096)
    groups = parts.groupBy(group.alias("group")).agg(F.sum("n").alias("n"))
    over_groups = groups.select("group", before(Window.partitionBy(F.lit(0)).orderBy("group")).alias("outer"))
    buckets = parts.withColumn("group", group).select("group", "bucket", before(Window.partitionBy("group").orderBy("bucket")).alias("middle")).join(over_groups, "group")
    full = (
        whole.join(inside, ["uid", "bucket"])
        .join(buckets, "bucket")
        .select("doc_id", "doc_tokens", (F.col("inside") + F.col("middle") + F.col("outer") + sequences).alias("first"), F.posexplode(F.slice("crcs", F.lit(1), F.floor(F.col("doc_tokens") / window).cast("int"))).alias("i", "ids_crc32"))
        .select("doc_id", (F.col("i") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    return placed.unionByName(full)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
