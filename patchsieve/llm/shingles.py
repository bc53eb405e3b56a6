"""Distinct word shingles of whole texts as sorted 64-bit hashes, for whole Arrow batches at once.

Words are the runs outside the bytes 0x20 and 0x09 to 0x0D, with A-Z lower-cased. A word's hash is a
polynomial over random byte values, read off a running sum over the batch; a shingle's hash mixes
its words' hashes with their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

from patchsieve.llm.common import slices, strings, utf8

_U = np.uint64
_RANDOM = np.random.default_rng(20_240_917)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_PLACES = _RANDOM.integers(1, 2**63, 64, dtype=np.int64).astype(_U) * _U(2) + _U(1)
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, _U)
    down = np.full(n, pow(_BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts and how many each text has."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(bounds) - 1, np.int64)
    solid = ~_SPACE[raw]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(1 << max(10, (n - 1).bit_length()))
    run = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[raw] * up[:n], out=run[1:])
    h = mix((run[e] - run[s]) * down[s] + (e - s).astype(_U))
    return h, np.diff(np.searchsorted(s, bounds))


def words_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words per row) for runs of rows of about CHUNK bytes.

    A longer text is cut at white space, so that memory stays bounded by its words.
    """
    raw, at = utf8(strings(texts))
    for i, j in slices(np.diff(at), CHUNK):
        lo, hi = at[i], at[j]
        if hi - lo <= 2 * CHUNK or j - i > 1:
            yield i, *_word_hashes(raw[lo:hi], at[i:j + 1] - lo)
            continue
        parts = []
        while lo < hi:
            stop = min(lo + CHUNK, hi)
            while stop < hi:
                spaces = np.flatnonzero(_SPACE[raw[stop:stop + CHUNK]])
                if len(spaces):
                    stop += spaces[0]
                    break
                stop = min(stop + CHUNK, hi)
            parts.append(_word_hashes(raw[lo:stop], np.array([0, stop - lo]))[0])
            lo = stop
        h = np.concatenate(parts)
        yield i, h, np.array([len(h)])


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[list[np.ndarray]]:
    """For runs of rows, the sorted distinct shingle hashes of each row.

    Fewer than `k` words give their whole sequence as one shingle, no words the empty set.
    """
    for _, h, counts in words_of(texts):
        ends = np.cumsum(counts)
        total = max(len(h) - k + 1, 0)
        wide = np.zeros(total, _U)
        for j in range(k):
            wide += h[j:j + total] * _PLACES[j]
        wide = mix(wide)
        out = []
        for end, count in zip(ends.tolist(), counts.tolist()):
            begin = end - count
            if count >= k:
                out.append(np.unique(wide[begin:end - k + 1]))
            elif count:
                few = (h[begin:end] * _PLACES[:count]).sum(dtype=_U) + _U(count)
                out.append(mix(np.array([few], _U)))
            else:
                out.append(np.zeros(0, _U))
        yield out


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    low, high = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8")
    return int(low), int(high)
