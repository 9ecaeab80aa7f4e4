"""Vectorised word and shingle hashing over Arrow string arrays.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased, every other byte is kept.  A word is
hashed by blocks of eight bytes: each block is mixed with its number, the mixed blocks are summed, and the sum is mixed
with the length.  No arithmetic relation between blocks survives the mixing, so repetitive words do not meet.  Nothing
here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are hashed in runs of about this many bytes, so that a batch's arrays stay small.
CHUNK_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The little-endian number of the eight bytes from each byte on; past the end come zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges ``start`` to ``end``, each read once; another ``seed`` gives an independent hash."""
    if not len(start):
        return np.zeros(0, U64)
    salt = U64(seed * 0xD1342543DE82EF95 % 2**64)
    size = end - start
    blocks = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(blocks) - blocks
    number = np.arange(first[-1] + blocks[-1]) - np.repeat(first, blocks)
    left = np.repeat(size, blocks) - 8 * number
    value = eight_bytes(data)[np.repeat(start, blocks) + 8 * number]
    short = np.flatnonzero(left < 8)
    value[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
    value = mix(value ^ mix(number.astype(U64) + U64(1) + salt))
    return mix(np.add.reduceat(value, first) + size.astype(U64) * U64(0x9E3779B97F4A7C15) + salt)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive words, by joining hashes of 1, 2, 4, ... words; entry i is of the words from i on."""
    out, done, power, size = None, 0, words, 1
    while True:
        if k & size:
            out = power if out is None else _joined(out, power, done)
            done += size
        if size * 2 > k:
            return mix(out[: max(0, len(words) - k + 1)])
        power, size = _joined(power, power, size), size * 2


def _joined(left: np.ndarray, right: np.ndarray, by: int) -> np.ndarray:
    n = min(len(left), len(right) - by)
    if n <= 0:
        return np.zeros(0, U64)
    out = left[:n] * U64(0x9E3779B97F4A7C15) + right[by : by + n] * U64(0xC2B2AE3D27D4EB4F)
    out ^= out >> U64(29)
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= out >> U64(32)
    return out


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each word, and the n + 1 word offsets of the texts."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, end = solid.copy(), solid
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    tail = np.ones(len(data), bool)
    tail[:-1] = ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end & tail) + 1
    return hash_ranges(_LOWER[data], starts, ends), starts, ends, np.searchsorted(starts, offsets)


_STEPS = mix(np.arange(1, 4097, dtype=U64)) | U64(1)


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles and the offsets of the texts; a text of 1 to k - 1 words has one, its whole sequence."""
    n = len(bounds) - 1
    count = np.diff(bounds)
    have = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(have)])
    if not len(words):
        return np.zeros(0, U64), out_bounds
    padded = np.concatenate([words, np.zeros(k, U64)])
    rolled = np.zeros(len(words), U64)
    for i in range(k):
        rolled += padded[i : i + len(words)] * _STEPS[i]
    full = count >= k
    keep = np.ones(len(words), bool)
    last = bounds[1:][full]
    for i in range(1, k):
        keep[last - i] = False
    for t in np.flatnonzero((count > 0) & ~full):
        a, b = bounds[t], bounds[t + 1]
        keep[a + 1 : b] = False
        rolled[a] = (words[a:b] * _STEPS[: b - a]).sum(dtype=U64) + U64(b - a)
    assert n == 0 or keep.sum() == out_bounds[-1]
    return mix(rolled[keep]), out_bounds


def minima(hashes: np.ndarray, bounds: np.ndarray, n_hashes: int) -> np.ndarray:
    """MinHash values (texts x n_hashes, uint32) under fixed multiply-add permutations; texts without shingles get the largest value."""
    n = len(bounds) - 1
    out = np.full((n, n_hashes), 0xFFFFFFFF, np.uint32)
    have = np.flatnonzero(np.diff(bounds) > 0)
    if not len(have):
        return out
    seeds = mix(np.arange(1, 2 * n_hashes + 1, dtype=U64) * U64(0x632BE59BD9B4E019))
    value = (hashes >> U64(32)).astype(np.uint32)
    other = (hashes & U64(0xFFFFFFFF)).astype(np.uint32)
    at = bounds[:-1][have]
    for k in range(n_hashes):
        a, b = np.uint32(int(seeds[2 * k]) & 0xFFFFFFFF | 1), np.uint32(int(seeds[2 * k + 1]) & 0xFFFFFFFF | 1)
        out[have, k] = np.minimum.reduceat(value * a + other * b, at)
    return out


def distinct_per_text(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and their offsets."""
    parts = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
