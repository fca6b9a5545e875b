"""Quality classifier: a factorisation machine.

Features are hashed words (log counts, scaled to unit length), structure statistics
of the text, and the metadata n_chars.  Pairwise interactions have rank ``RANK``
and are scored in linear time: half of (sum v x)^2 - sum v^2 x^2.  Training uses at
most ``sample`` labelled rows, those with the least hash of doc_id, outside the
held-out fold crc32(doc_id) mod 5 = 0; labels, lang, source and doc_id are no inputs.

Defined cases: null and empty texts are scored from their statistics; a null n_chars
counts as the length of the text; labels that are null are ignored; a doc_id with
several labels trains with each, repeated labels once, a doc_id with several texts
with the one of the least hash; without labelled rows of both kinds the score is
the share of label 1 (0.5 without any); rows with a null doc_id are scored and not
held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Words, blocks
from .shared import lean, table

BUCKETS, RANK = 1 << 14, 8
_CLASSES = [np.isin(np.arange(256), list(c)) for c in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#$%&*@^~", b"|<>{}[]\\/_=", b".,;:", b"\n\r", b" \t", bytes(range(128, 256)))]
_STATS = len(_CLASSES) + 9
WIDTH = BUCKETS + _STATS


def features(data, offs, n_chars):
    """(ids, values, bounds): sparse rows of a block of documents."""
    w = Words(data, offs, lower=True)
    size = np.diff(offs)
    stats = np.zeros((len(size), _STATS), dtype=np.float64)
    for i, c in enumerate(_CLASSES):
        sums = np.append(0, np.cumsum(c[data]))
        stats[:, i] = (sums[offs[1:]] - sums[offs[:-1]]) / np.maximum(1, size)
    lead = np.append(0, np.cumsum(data & 0xC0 != 0x80))
    chars = lead[offs[1:]] - lead[offs[:-1]]
    last = data[w.ends - 1] if len(data) else data
    odd = np.append(0, np.cumsum(_CLASSES[2][last] | _CLASSES[3][last])) if len(w.hash) else np.zeros(1)
    n = w.counts
    k = len(_CLASSES)
    grams, ok = w.grams(4)
    ids, values, bounds = [], [], [0]
    bucket = (w.hash % np.uint64(BUCKETS)).astype(np.int64)
    for d in range(len(size)):
        a, b = w.offs[d], w.offs[d + 1]
        own, count = np.unique(bucket[a:b], return_counts=True)
        x = np.log1p(count)
        x = x / max(1e-9, float(np.sqrt((x * x).sum())))
        m = n[d]
        stats[d, k : k + 8] = (
            (odd[b] - odd[a]) / max(1, m),
            min(2.0, chars[d] / max(1, m) / 10),
            min(1.0, np.log1p(m) / 12),
            len(own) / max(1, m),
            len(np.unique(grams[a:b][ok[a:b]])) / max(1, m - 3) if m > 3 else 1.0,
            float(m < 5),
            float(m < 30),
            1.0,
        )
        stats[d, k + 8] = min(1.0, np.log1p(max(0, n_chars[d] if n_chars[d] is not None else chars[d])) / 14)
        ids += [own, np.arange(BUCKETS, WIDTH)]
        values += [x, stats[d]]
        bounds.append(bounds[-1] + len(own) + _STATS)
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(values) if values else np.zeros(0), np.array(bounds)


def raw_scores(ids, values, bounds, model):
    """Scores of sparse rows, in time linear in their entries."""
    bias, w, v = model
    start = bounds[:-1]
    linear = np.add.reduceat(w[ids] * values, start)
    vx = v[ids] * values[:, None]
    pairs = (np.add.reduceat(vx, start, axis=0) ** 2 - np.add.reduceat(vx * vx, start, axis=0)).sum(axis=1) / 2
    return bias + linear + pairs


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows, labels, epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 1e-4):
    """Adam on the log loss of sparse rows [(ids, values)]."""
    rng = np.random.default_rng(3)
    share = float(np.mean(labels)) if len(labels) else 0.5
    bias = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
    w, v = np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, RANK))
    if not len(labels) or share in (0.0, 1.0):
        return bias, w, v * 0
    labels = np.asarray(labels, dtype=float)
    p = [np.array([bias]), w, v]
    m, s, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            ids, values = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
            bounds = np.append(0, np.cumsum([len(rows[i][0]) for i in pick]))
            vx = p[2][ids] * values[:, None]
            sums = np.add.reduceat(vx, bounds[:-1], axis=0)
            z = p[0][0] + np.add.reduceat(p[1][ids] * values, bounds[:-1]) + (sums**2 - np.add.reduceat(vx * vx, bounds[:-1], axis=0)).sum(1) / 2
            g = (_sigmoid(z) - labels[pick]) / len(pick)
            ge = np.repeat(g, np.diff(bounds))
            grad_w = np.bincount(ids, ge * values, WIDTH)
            one = ge[:, None] * values[:, None] * (np.repeat(sums, np.diff(bounds), axis=0) - vx)
            grad_v = np.stack([np.bincount(ids, one[:, f], WIDTH) for f in range(RANK)], 1)
            t += 1
            for i, grad in enumerate((np.array([g.sum()]), grad_w + decay * p[1], grad_v + decay * p[2])):
                m[i] = 0.9 * m[i] + 0.1 * grad
                s[i] = 0.999 * s[i] + 0.001 * grad * grad
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return float(p[0][0]), p[1], p[2]


def _extract(batches):
    for rows, data, offs in blocks(batches):
        ids, values, bounds = features(data, offs, rows.column("n_chars").to_pylist())
        at = pa.array(bounds.astype(np.int32))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(values.astype(np.float32)))], names=["doc_id", "label", "ids", "values"])


def _score(batches, model):
    for rows, data, offs in blocks(batches):
        out = _sigmoid(raw_scores(*features(data, offs, rows.column("n_chars").to_pylist()), model.value))
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rows.schema.names), pa.array(out, pa.float64())], names=[*rows.schema.names, "score"])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000):
    """A model from at most ``sample`` labelled rows outside the held-out fold."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out()).distinct()
    # Labels of documents that are here, by hash; at most ``sample`` rows, hence broadcast.
    there = own.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    picked = F.broadcast(there.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars")).join(picked, "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), "n_chars")).alias("r")).select("doc_id", "label", "r.text", "r.n_chars")
    got = one.mapInArrow(_extract, "doc_id long, label int, ids array<int>, values array<float>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"]))
    return fit([(np.array(r["ids"], dtype=np.int64), np.array(r["values"], dtype=float)) for r in got], [r["label"] for r in got])


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), threshold: float = 0.3, sample: int = 4000) -> DataFrame:
    """doc_id, the columns ``keep``, held_out, score and predicted."""
    lean(docs)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"), *(c for c in keep if c not in ("doc_id", "text", "n_chars")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double"
    scored = rows.mapInArrow(partial(_score, model=model), schema)
    return scored.select(*dict.fromkeys(("doc_id", *keep)), held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
