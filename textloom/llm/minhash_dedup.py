"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

One scan gives each document its number of distinct word shingles, a 128-bit hash
of that set, ``BANDS * ROWS`` minima, of which ``BITS`` low bits are kept and packed
into longs, and a hash of each band of full minima.  Then

* documents with equal sets form a class; one row of each class goes on;
* a band value that two classes share makes a bucket.  Its least member is its
  centre, and members pair with centres, never with each other;
* the packed signatures give each pair an estimate of its similarity: XOR, fold,
  bit count, corrected for chance collisions of ``BITS``-bit values.  Pairs far
  below the threshold (``MARGIN``, about six standard deviations) go;
* each class is compared on whole sets with the centre that looks nearest, which
  gives a forest of confirmed links;
* where a bucket still holds several trees, a prefix filter on the rarest shingles
  of whole sets finds every pair across trees that can reach the threshold, so no
  link of a bucket is lost and no group is paired with itself.  These pairs are
  estimated and confirmed likewise, and trees joined by links are merged.

At similarity 0.8 or more, a pair shares none of 32 bands of 4 minima with a
probability under 5e-8.

Defined cases: null and empty texts, and texts without words, have no shingles and
link with nothing; fewer words than a shingle give one shingle, the whole text;
rows sharing a doc_id are one node; rows with a null doc_id link with nothing; of
centres that look equally near, the greater counts; texts of any length are hashed
whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .kernel import Words, blocks, mix
from .shared import lean, stash, table

BANDS, ROWS, BITS, MARGIN = 32, 4, 4, 0.2
_N = BANDS * ROWS
_SLICE = 1 << 16
_rng = np.random.default_rng(9)
_XOR = _rng.integers(0, 1 << 32, _N, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.integers(0, 1 << 32, _N, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _sets(data, offs, n):
    """(sorted distinct shingle hashes, offsets by document) of a block."""
    w = Words(data, offs, lower=True)
    hashes, ok = w.grams(n)
    for k in range(1, n):  # a short text is one shingle
        docs = np.flatnonzero(w.counts == k)
        if len(docs):
            hashes[w.offs[docs]] = w.grams(k)[0][w.offs[docs]]
            ok[w.offs[docs]] = True
    doc, hashes = w.doc_of()[ok], hashes[ok]
    bounds = np.searchsorted(doc, np.arange(len(offs)))
    hashes = hashes.copy()
    for a, b in zip(bounds[:-1], bounds[1:]):
        hashes[a:b].sort()
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[first], np.searchsorted(doc[first], np.arange(len(offs)))


def _sketch(batches, n):
    weights = (np.uint64(1) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)))[None, None, :]
    for rows, data, offs in blocks(batches):
        hashes, bounds = _sets(data, offs, n)
        size = np.diff(bounds)
        full = np.flatnonzero(size)
        starts = bounds[:-1][full]
        d = len(full)
        minima = np.empty((d, _N), dtype=np.uint32)
        a, b = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        if d:
            low = (hashes >> np.uint64(20)).astype(np.uint32)
            for i in range(_N):
                minima[:, i] = np.minimum.reduceat((low ^ _XOR[i]) * _MUL[i], starts)
            a[full] = np.add.reduceat(mix(hashes, 1), starts)
            b[full] = np.add.reduceat(mix(hashes, 2), starts)
            for i in np.flatnonzero(size == 1):  # very many texts are that short: their class is that of their words themselves
                words = data[offs[i] : offs[i + 1]].tobytes().lower().split()
                b[i] = int.from_bytes(hashlib.blake2b(b" ".join(words[:n] if len(words) > n else words), digest_size=8).digest(), "little")
        kept = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64)
        packed = (kept.reshape(d, -1, 64 // BITS) * weights).sum(axis=2, dtype=np.uint64)
        wide = minima.astype(np.uint64).reshape(d, BANDS, ROWS)
        band = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for r in range(ROWS):
            band = mix(band + wide[:, :, r], 31 + r)
        longs = lambda m: _lists(m, full, len(size))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), longs(band), longs(packed)], names=["doc_id", "n_shingles", "a", "b", "bands", "bits"])


def _lists(m: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The rows of m as lists at the places ``at``, elsewhere empty lists."""
    size = np.zeros(n + 1, dtype=np.int32)
    size[at + 1] = m.shape[1] if m.ndim > 1 else 0
    return pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(np.ascontiguousarray(m).reshape(-1).view(np.int64)))


def _full(batches, n):
    for rows, data, offs in blocks(batches):
        hashes, bounds = _sets(data, offs, n)
        raw = hashes.tobytes()
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["node", "hashes"])


def _confirm(batches, percent):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x_set"), batch.column("y_set")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))


def estimate(x, y):
    """Similarity of two packed signatures, corrected for chance collisions."""
    ones = int("1" * (64 // BITS), 2) if BITS == 1 else sum(1 << i for i in range(0, 64, BITS))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    differ = F.lit(0)
    for i in range(_N * BITS // 64):
        v = x[i].bitwiseXOR(y[i])
        folded = v
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(v, s))
        differ = differ + F.bit_count(folded.bitwiseAND(F.lit(ones)))
    chance = 0.5**BITS
    return (1 - differ / _N - chance) / (1 - chance)


class _Pairs:
    """Estimates and confirms candidate pairs (x > y)."""

    def __init__(self, docs, bits, n, percent):
        self.docs, self.bits, self.n, self.percent = docs, bits, n, percent

    def likely(self, pairs):
        """The distinct pairs whose estimate isn't far below the threshold."""
        x = self.bits.select(F.col("node").alias("x"), F.col("bits").alias("x_bits"))
        y = self.bits.select(F.col("node").alias("y"), F.col("bits").alias("y_bits"))
        near = pairs.distinct().join(x.hint("merge"), "x").join(y.hint("merge"), "y").select("x", "y", estimate(F.col("x_bits"), F.col("y_bits")).alias("near"))
        return near.filter(F.col("near") >= self.percent / 100 - MARGIN)

    def sets(self, nodes):
        """(node, hashes) of the nodes' texts; joins by merging at every size, as neither side has a bound."""
        texts = self.docs.select(F.col("doc_id").alias("node"), "text").join(nodes.distinct().hint("merge"), "node", "left_semi")
        return stash(texts.select(F.col("node").alias("doc_id"), "text").mapInArrow(partial(_full, n=self.n), "node long, hashes binary").filter("length(hashes) > 0"), "sets")

    def confirmed(self, pairs, sets):
        x = sets.select(F.col("node").alias("x"), F.col("hashes").alias("x_set"))
        y = sets.select(F.col("node").alias("y"), F.col("hashes").alias("y_set"))
        return pairs.select("x", "y").join(x.hint("merge"), "x").join(y.hint("merge"), "y").mapInArrow(partial(_confirm, percent=self.percent), "x long, y long").distinct()


def _roots(parents):
    """(node, component) of a forest of (x, y), y the parent of x, by pointer jumping."""
    while True:
        up = parents.select(F.col("x").alias("y"), F.col("y").alias("z"))
        jumped = stash(parents.join(up, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")), "parents")
        if jumped.filter("moved").isEmpty():
            return jumped.select(F.col("x").alias("node"), F.col("y").alias("component"))
        parents = jumped.select("x", "y")


def _tokens(batches):
    """The tokens of each set, in parts of ``_SLICE`` at most."""
    for batch in batches:
        for node, raw in zip(batch.column("node").to_pylist(), batch.column("hashes")):
            tokens = np.frombuffer(raw.as_buffer(), np.int64)
            for at in range(0, len(tokens), _SLICE):
                part = tokens[at : at + _SLICE]
                yield np.full(len(part), node, np.int64), part


def _token_rows(batches):
    nodes, tokens, n = [], [], 0
    for node, part in _tokens(batches):
        nodes.append(node)
        tokens.append(part)
        n += len(part)
        if n >= _SLICE:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(tokens))], names=["node", "token"])
            nodes, tokens, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(tokens))], names=["node", "token"])


def _prefix_pairs(named, sets, percent):
    """Pairs of nodes in different components that can reach the threshold.

    Shingles are ordered by frequency among these nodes, rarest first.  Sets as
    similar as the threshold share a shingle among the first |set| - ceil(t |set|) + 1
    of either, so nodes whose rare shingles are their own pair with nothing, and
    shingles inside one component pair nothing.  From the first shingle that a pair
    shares on, both sets must have as many left as the threshold needs in common.
    """
    tokens = sets.mapInArrow(_token_rows, "node long, token long")
    # Written, so that joins by token read plain exchanges: those are split where a token is hot, aggregates aren't.
    counts = stash(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    ordered = tokens.join(counts.hint("merge"), "token", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "token"))).alias("order"))
    size = F.size("order")
    prefix = F.transform(F.slice("order", F.lit(1), size - F.ceil(size * percent / 100).cast("int") + 1), lambda t, i: F.struct(t["n"].alias("n"), t["token"].alias("token"), (size - i).alias("rest")))
    rare = ordered.join(named.hint("merge"), "node").select("node", "component", size.alias("size"), F.explode(F.filter(prefix, lambda t: t["n"] > 1)).alias("t"))
    rare = stash(rare.select("node", "component", "size", "t.token", "t.rest"), "prefixes")
    met = rare.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("token")
    rare = stash(rare.join(stash(met, "met").hint("merge"), "token"), "met")
    p, q = (rare.select("token", F.col("node").alias(c), *(F.col(k).alias(f"{c}_{k}") for k in ("component", "size", "rest"))) for c in "xy")
    enough = (100 + percent) * F.least("x_rest", "y_rest") >= percent * (F.col("x_size") + F.col("y_size"))
    return p.join(q.hint("merge"), "token").filter((F.col("x") > F.col("y")) & (F.col("x_component") != F.col("y_component")) & enough).select("x", "y")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs.

    Documents are linked if 100 * |common shingles| >= percent * |all shingles|;
    component_id is the least doc_id that links reach.
    """
    lean(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stash(docs.mapInArrow(partial(_sketch, n=n), "doc_id long, n_shingles long, a long, b long, bands array<long>, bits array<long>"), "sketch")
    known = sketch.filter("n_shingles > 0 and doc_id is not null")
    least = stash(known.groupBy("a", "b").agg(F.min("doc_id").alias("node")), "classes")
    heads = known.join(least.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    members = heads.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre < last").select("bucket", "centre")
    buckets = stash(members.join(shared.hint("merge"), "bucket"), "buckets")
    bits = stash(heads.select(F.col("doc_id").alias("node"), "bits").join(buckets.select("node").distinct().hint("merge"), "node", "left_semi"), "bits")
    pairs = _Pairs(docs, bits, n, percent)
    # Each member with the centre that looks nearest: a forest, as centres are smaller.
    stars = pairs.likely(buckets.filter("node > centre").select(F.col("node").alias("x"), F.col("centre").alias("y")))
    best = stash(stars.groupBy("x").agg(F.max_by("y", F.struct("near", "y")).alias("y")), "best")
    sets = pairs.sets(buckets.select("node"))
    roots = _roots(stash(pairs.confirmed(best, sets).groupBy("x").agg(F.min("y").alias("y")), "forest"))
    # Nodes of buckets that still hold several components: exact candidates, then the same confirmation.
    own = F.coalesce("component", "node").alias("component")
    named = buckets.select("bucket", "node").join(roots.hint("merge"), "node", "left").select("bucket", "node", own)
    split = named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("bucket")
    mixed = stash(named.join(split.hint("merge"), "bucket").select("node", "component").distinct(), "mixed")
    left = stash(pairs.likely(_prefix_pairs(mixed, sets.join(mixed.select("node").hint("merge"), "node", "left_semi"), percent)), "left")
    more = pairs.confirmed(left, sets)
    at = lambda c: mixed.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")).hint("merge")
    joined = components(more.join(at("x"), "x").join(at("y"), "y").select(F.col("x_in").alias("a"), F.col("y_in").alias("b")))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("top"))
    first = least.join(roots.hint("merge"), "node", "left").select("a", "b", own)
    named = first.join(joined.hint("merge"), "component", "left").select("a", "b", F.coalesce("top", "component").alias("component_id"))
    ids = known.select("doc_id", "n_shingles", "a", "b").join(named.hint("merge"), ["a", "b"]).select("doc_id", "n_shingles", "component_id")
    alone = sketch.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return ids.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w
), e as (select doc_id, unnest(s) as g from s),
c as (select a.doc_id as x, b.doc_id as y, count(*) as n from e a join e b on a.g = b.g and a.doc_id > b.doc_id group by 1, 2),
l as (select x, y from c join s a on a.doc_id = x join s b on b.doc_id = y where 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
b as (select x, y from l union all select y, x from l),
r as (select doc_id as node, doc_id as other from documents union select r.node, b.y from r join b on b.x = r.other),
m as (select node, min(other) as component_id from r group by 1)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join m on node = doc_id
"""
