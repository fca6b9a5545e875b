"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

A text is a sequence of lower-cased words.  The CGK embedding walks over it: every
step writes down the word it stands on, and a random bit that depends on the step
and the word says whether it moves to the next one.  Where two texts are alike their
walks agree, and after an edit they fall in step again, so edit distance becomes
Hamming distance.  A repetition is a walk of its own and samples ``m`` of its first
steps; the words there are the key.  Walks start at every word of every document and
at every word of every item; equal keys make the item-sized stretch of the document
a candidate, ``edits`` * words wider at both ends.  Candidates are verified by the
exact edit distance (words) of the item to the best window inside.

Before anything is scanned, ``build`` plants copies of its items inside other words,
with as many edits as are accepted (substitutions, deletions and insertions alike),
and adds repetitions until ``target`` of them are candidates through keys of their
own item at their own place; it fails if ``MOST`` repetitions don't reach it.

Items travel in blocks of ``block``, collected one block at a time; every block is
matched in one scan without any shuffle, and a hot passage costs what its rows cost.

Defined cases: null and empty texts match nothing; items with fewer than
``least_words`` words are too short to tell and match nothing; items with a null id
or text match nothing; rows with a null doc_id are searched like others; several texts
of an item_id are items each; repeated rows give repeated results; of equally near
windows the one that ends first counts; texts of any length are scanned whole; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import ALNUM_WORDS, Words, blocks, mix
from .shared import lean, table

MOST, TRIALS = 40, 400
_MAP = 1 << 23
#: Steps walked and steps sampled, for items from so many words on.
CLASSES = ((40, 8, 4), (10, 6, 3), (0, 4, 2))


def steps_of(words: int) -> tuple[int, int]:
    return next((s, m) for least, s, m in CLASSES if words >= least)


def sampled(steps: int, m: int, r: int) -> list[int]:
    """The steps whose words make repetition r's key: the first and m - 1 others."""
    return [0, *sorted(random.Random(f"{steps}.{m}.{r}").sample(range(1, steps), m - 1))]


def embed(words: np.ndarray, end: np.ndarray, steps: int, picked: list[int], r: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, usable) of the walk from each word; usable keys hold as many places of the text as steps."""
    at = np.arange(len(words))
    key = np.full(len(words), r + 1, dtype=np.uint64)
    ok = np.ones(len(words), dtype=bool)
    last = np.full(len(words), -1)
    for step in range(picked[-1] + 1):
        inside = at < end
        word = words[np.minimum(at, len(words) - 1)]
        if step in picked:
            ok &= inside & (at > last)
            last = at
            key = mix(key ^ word)
        # The bit is a hash of word, step and repetition.
        bit = ((word ^ np.uint64(((step + 1) * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) & (1 << 64) - 1)) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(63)
        at = at + bit.astype(np.int64)
    return key, ok


def _hashes(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    offs = np.append(0, np.cumsum([len(t) for t in raw])).astype(np.int64)
    return Words(np.frombuffer(b"".join(raw), np.uint8), offs, ALNUM_WORDS, lower=True)


def edited(rng: random.Random, words: list, n: int, new) -> list:
    """The words after n random substitutions, deletions and insertions."""
    out = list(words)
    for _ in range(n):
        i, how = rng.randrange(len(out)), rng.randrange(3)
        out[i : i + (how < 2)] = [] if how == 1 else [new()]
    return out


def _keys(words: list[np.ndarray], steps: int, m: int, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys in order, items, places) of repetition r."""
    end = np.repeat(np.cumsum([len(w) for w in words]), [len(w) for w in words])
    own = np.repeat(np.arange(len(words)), [len(w) for w in words])
    place = np.concatenate([np.arange(len(w)) for w in words])
    key, ok = embed(np.concatenate(words), end, steps, sampled(steps, m, r), r)
    key, own, place = key[ok], own[ok], place[ok]
    order = np.argsort(key, kind="stable")
    return key[order], own[order], place[order]


def _caught(trials, keys, steps, m, r) -> list[bool]:
    """Whether a key of its own item, at its own place, meets each trial (item, words, begin, edits)."""
    known, own, place = keys
    out = []
    for item, words, begin, k in trials:
        key, ok = embed(words, np.full(len(words), len(words)), steps, sampled(steps, m, r), r)
        lo, hi = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
        out.append(any(own[j] == item and abs(p - place[j] - begin) <= k for p in np.flatnonzero(ok & (lo < hi)).tolist() for j in range(lo[p], hi[p])))
    return out


def build(texts: list[str], edits: float, least_words: int, target: float = 0.99) -> dict:
    """The index of a block of items: their words, and by class the repetitions with their keys."""
    w = _hashes(texts)
    words = [w.hash[a:b] for a, b in zip(w.offs, w.offs[1:])]
    groups: dict[tuple[int, int], list[int]] = {}
    for i, x in enumerate(words):
        if len(x) >= max(1, least_words):
            groups.setdefault(steps_of(len(x)), []).append(i)
    out = []
    for (steps, m), ids in sorted(groups.items()):
        rng = random.Random(17)
        new = lambda: np.uint64(rng.getrandbits(64))
        trials = []
        for j in range(TRIALS):
            item = j % len(ids) if len(ids) <= TRIALS else rng.randrange(len(ids))
            x = list(words[ids[item]])
            k = int(edits * len(x))
            copy = edited(rng, x, k, new)
            before = [new() for _ in range(rng.randrange(len(x) + 1))]
            trials.append((item, np.array(before + copy + [new() for _ in range(len(x))], np.uint64), len(before), k))
        short = [x for x in ids if len(words[x]) < m]
        own = [words[i] for i in ids]
        missed, reps = trials, []
        for r in range(MOST):
            keys = _keys(own, steps, m, r)
            reps.append((r, keys[0], np.array(ids, np.int64)[keys[1]], keys[2]))
            missed = [t for t, hit in zip(missed, _caught(missed, keys, steps, m, r)) if not hit]
            if len(missed) <= (1 - target) * len(trials):
                break
        if short or len(missed) > (1 - target) * len(trials):
            raise ValueError(f"{len(reps)} repetitions find {1 - len(missed) / len(trials):.3f} of copies with {edits} edits a word, not {target}; items of {min(len(x) for x in own)} to {max(len(x) for x in own)} words")
        out.append((steps, m, reps))
    return {"words": words, "classes": out}


def nearest(item: list[int], text: list[int]) -> int:
    """Edit distance of the item to the nearest stretch of the text (bit-parallel, Myers)."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    same: dict[int, int] = {}
    for i, x in enumerate(item):
        same[x] = same.get(x, 0) | 1 << i
    up, down, d = full, 0, n
    best = d
    for x in text:
        eq = same.get(x, 0)
        flat = (((eq & up) + up) ^ up) | eq
        more = down | (~(flat | up) & full)
        less = up & flat
        d += bool(more & top) - bool(less & top)
        if d < best:
            best = d
        eq |= down
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (~(eq | more) & full), more & eq
    return best


def distance(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """(edit distance, first, last) of the item to the nearest stretch of the text."""
    n, m = len(item), len(text)
    row, begin = [0] * (m + 1), list(range(m + 1))
    for i in range(1, n + 1):
        prev, origin = row, begin
        row, begin = [i] + [0] * m, [0] * (m + 1)
        for j in range(1, m + 1):
            d, o = prev[j - 1] + (item[i - 1] != text[j - 1]), origin[j - 1]
            if prev[j] + 1 < d:
                d, o = prev[j] + 1, origin[j]
            if row[j - 1] + 1 < d:
                d, o = row[j - 1] + 1, begin[j - 1]
            row[j], begin[j] = d, o
    last = min(range(m + 1), key=lambda j: (row[j], j))
    return row[last], begin[last], last


class _Matcher:
    """Finds a block of items in blocks of documents."""

    def __init__(self, index: dict, edits: float):
        self.index = index
        self.lists = [x.tolist() for x in index["words"]]
        self.sets = [set(x) for x in self.lists]
        self.most = [int(edits * len(x)) for x in self.lists]
        self.maps = []
        for _, _, reps in index["classes"]:
            self.maps.append([])
            for _, keys, _, _ in reps:
                self.maps[-1].append(np.zeros(_MAP, bool))
                self.maps[-1][-1][keys & np.uint64(_MAP - 1)] = True

    def candidates(self, w: Words) -> dict[tuple[int, int], set[int]]:
        """Where items may begin: {(document, item): words of the block}."""
        found: dict[tuple[int, int], set[int]] = {}
        doc, end = w.doc_of(), np.repeat(w.offs[1:], w.counts)
        for (steps, m, reps), maps in zip(self.index["classes"], self.maps):
            for (r, keys, ids, places), known in zip(reps, maps):
                got, ok = embed(w.hash, end, steps, sampled(steps, m, r), r)
                at = np.flatnonzero(known[got & np.uint64(_MAP - 1)] & ok)
                lo, hi = np.searchsorted(keys, got[at], "left"), np.searchsorted(keys, got[at], "right")
                hit = lo < hi
                for p, d, a, b in zip(at[hit].tolist(), doc[at[hit]].tolist(), lo[hit].tolist(), hi[hit].tolist()):
                    for i, place in zip(ids[a:b].tolist(), places[a:b].tolist()):
                        found.setdefault((d, i), set()).add(p - place)
        return found

    def match(self, data, offs) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, first, last) in order."""
        w = Words(data, offs, ALNUM_WORDS, lower=True)
        out = []
        for (d, i), starts in self.candidates(w).items():
            x, k, low, high = self.lists[i], self.most[i], int(w.offs[d]), int(w.offs[d + 1])
            stretches: list[list[int]] = []
            for p in sorted(starts):
                a, b = max(low, p - k), min(high, p + len(x) + k)
                # An edit takes away one of the item's words at most.
                if len(self.sets[i].intersection(w.hash[a:b].tolist())) < len(self.sets[i]) - k:
                    continue
                if stretches and a <= stretches[-1][1]:
                    stretches[-1][1] = b
                else:
                    stretches.append([a, b])
            best = None
            for a, b in stretches:
                text = w.hash[a:b].tolist()
                if nearest(x, text) <= (k if best is None else best[0] - 1):
                    got = distance(x, text)
                    best = (got[0], a - low + got[1], a - low + got[2])
            if best is not None:
                out.append((d, i, *best))
        return sorted(out)


def _leaks(batches, index, edits):
    matcher = _Matcher(index.value, edits)
    ids = np.array(index.value["ids"], np.int64)
    for rows, data, offs in blocks(batches):
        cols = np.array(matcher.match(data, offs), np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(cols[:, 0])), pa.array(ids[cols[:, 1]]), *(pa.array(np.ascontiguousarray(cols[:, c])) for c in (2, 3, 4))], names=["doc_id", "item_id", "edits", "first_word", "last_word"])


def _clean(batches, index, edits):
    matcher = _Matcher(index.value, edits)
    for rows, data, offs in blocks(batches):
        keep = np.ones(rows.num_rows, dtype=bool)
        keep[[m[0] for m in matcher.match(data, offs)]] = False
        yield rows.filter(pa.array(keep))


def _indexes(docs: DataFrame, items: DataFrame, edits: float, least_words: int, block: int):
    """Broadcast indexes of blocks of ``block`` items each, about."""
    if not 0 <= edits < 1:
        raise ValueError(f"edits must be a share of 0 to below 1, not {edits}")
    spark = lean(docs)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").dropDuplicates(["item_id", "text"])
    parts = max(1, -(-items.count() // block))
    for p in range(parts):
        got = sorted((r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect())
        if got:
            yield spark.sparkContext.broadcast(build([t for _, t in got], edits, least_words) | {"ids": [i for i, _ in got]})


def find_leaks(docs: DataFrame, items: DataFrame, edits: float = 0.25, least_words: int = 5, block: int = 5000) -> DataFrame:
    """(doc_id, item_id, edits, first_word, last_word): each item in each document, where it is nearest.

    An item is in a document if some window is within ``edits`` * its words of it; 0 <= edits < 1.
    """
    schema = "doc_id long, item_id long, edits long, first_word long, last_word long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in _indexes(docs, items, edits, least_words, block):
        df = rows.mapInArrow(partial(_leaks, index=index, edits=edits), schema)
        out = df if out is None else out.unionByName(df)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, edits: float = 0.25, least_words: int = 5, block: int = 5000) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found; nothing is shuffled."""
    for index in _indexes(docs, items, edits, least_words, block):
        docs = docs.mapInArrow(partial(_clean, index=index, edits=edits), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
