"""Vectorised text primitives over Arrow string buffers.

Everything here works on whole blocks of documents at once: a block is a slice of
an Arrow batch with at most ``BLOCK_BYTES`` of text (one longer document makes a
block of its own, so no text is ever cut).  A word's hash chains its bytes, eight at
a time, through a bijection that isn't linear (words of over ``LONG`` bytes take
BLAKE2b).  Long runs of words have Rabin-Karp hashes modulo the prime 2**31 - 1, two
lanes a hash, from prefix sums; short ones are chained.  No modulus is a power of two,
for which strings like Thue-Morse's collide whatever the base.

Nulls count as empty texts.  Hashes depend on the constants below only, hence are
equal on every executor and in every run.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
LONG, CHAINED = 64, 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What is kept of eight bytes loaded when only so many belong to the word.
_PART = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_P = np.uint64((1 << 31) - 1)
_LANES = [int(x) for x in np.random.default_rng(20240607).integers(1 << 20, int(_P), 4)]

#: Bytes of words: all but ASCII white space; and letters, digits and non-ASCII.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.ones(256, dtype=bool)
ALNUM_WORDS[:0x80] = False
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x41:0x5B] = True


def process_cache() -> dict:
    """Values that stay in this process from task to task; code arrives anew with each task, so globals don't."""
    name = "_textloom_process"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].values = {}
    return sys.modules[name].values


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    x = (x & _P) + (x >> np.uint64(31))
    return x - _P * (x >= _P)


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a lane's base and of its inverse modulo 2**31 - 1."""
    cache = process_cache()
    have = cache.get(("powers", lane))
    if have is None or len(have[0]) < n:
        size, out = max(n, 1 << 16), []
        for base in (_LANES[lane], pow(_LANES[lane], -1, int(_P))):
            a = np.ones(1, dtype=np.uint64)
            while len(a) < size:
                a = np.concatenate((a, _mod(a * np.uint64(pow(base, len(a), int(_P))))))
            out.append(a[:size])
        if size > BLOCK_BYTES:  # a giant document's tables don't stay
            return out[0][:n], out[1][:n]
        have = cache[("powers", lane)] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    if not len(column) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def blocks(batches, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of slices with at most ``limit`` bytes, or one row."""
    for batch in batches:
        data, offs = buffers(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes."""
    size = ends - starts
    out = mix(size.astype(np.uint64), 0x5DEECE66D)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero(size <= LONG)
    at, left = starts[live], size[live]
    while len(live):
        out[live] = mix(out[live] ^ (eight[at] & _PART[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """The words of a block: byte ranges, hashes, and each document's range of words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, classes: np.ndarray = SPACE_WORDS, lower: bool = False):
        n = len(data)
        inside = classes[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True  # a document's end also ends its word
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offs = np.searchsorted(self.starts, offs)  # n docs + 1
        self.hash = word_hashes(_LOWER[data] if lower else data, self.starts, self.ends)
        self.counts = np.diff(self.offs)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in its document."""
        return np.arange(len(self.hash)) + k <= np.repeat(self.offs[1:], self.counts)

    def grams(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether all k lie in its document.

        Hashes of even and odd salts come from different lanes: two of them make 128 bits.
        """
        n = len(self.hash)
        out = np.zeros(n, dtype=np.uint64)
        m = n - k + 1
        if m > 0 and k <= CHAINED:
            h = np.full(m, (salt * 0x9E3779B97F4A7C15 + k) & (1 << 64) - 1, dtype=np.uint64)
            for i in range(k):
                h = mix(h ^ self.hash[i : i + m], salt & 1)
            out[:m] = h
        elif m > 0:
            for lane, word in ((0, self.hash >> np.uint64(33)), (1, self.hash & _P)):
                up, down = powers(2 * (salt & 1) + lane, n)
                sums = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(_mod(_mod(word) * up), out=sums[1:])
                out[:m] = (out[:m] << np.uint64(32)) | _mod(_mod(sums[k:] - sums[:m]) * down[:m])
            out[:m] = mix(out[:m], (salt * 0x9E3779B97F4A7C15 + k) & (1 << 64) - 1)
        return out, self.within(k)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of a[i : i + w] for every i with w elements, by doubling."""
    if len(a) < w:
        return a[:0]
    span, m = 1, a
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
