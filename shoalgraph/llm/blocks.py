"""Vectorised work on whole texts: Arrow batches in, numpy arrays over their UTF-8 bytes out.

Nothing here loops over words. A chunk is a run of texts of about ``LIMIT`` bytes (one longer text is
a chunk of its own), so memory is bounded by the longest text, not by the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT = 1 << 20


def tidy() -> None:
    """Gives freed memory back to the system, so that a worker that waits for its next task holds none of the last one's."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def tidied(f):
    """A generator function that tidies up after itself."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        try:
            yield from f(*args, **kwargs)
        finally:
            tidy()

    return run


try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: freed memory stays with the worker
    _libc = None
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    if len(_powers[0]) < n:
        size = max(n, LIMIT + 1)
        for k, base in enumerate((BASE, _inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Prefix:
    """Hashes of any substrings of a buffer, each in constant time."""

    def __init__(self, buf: np.ndarray):
        p, self.inverse = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_values[buf] * p[: len(buf)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:-k]) * self.inverse[:n])


def chunks(texts: pa.Array, limit: int = LIMIT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for each chunk; null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_space = np.zeros(256, bool)
_space[[0x20, 9, 10, 11, 12, 13]] = True


#: Bytes between words of letters and digits; every byte beyond ASCII is part of a word.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def words(buf: np.ndarray, offsets: np.ndarray, between: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space, or what ``between`` marks), and how many words lie before each text."""
    out = between[buf]
    begins = ~out
    begins[1:] &= out[:-1]
    edges = offsets[:-1]
    edges = edges[edges < len(buf)]
    begins[edges] = ~out[edges]
    ends = ~out
    ends[:-1] &= out[1:]
    last = offsets[1:] - 1
    last = last[(offsets[1:] > offsets[:-1])]
    ends[last] = ~out[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


_odd = (np.arange(1, 65, dtype=np.uint64) * BASE) | np.uint64(1)


def shingles(h: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words (one run of all words where a text has fewer), and each run's text."""
    counts = np.diff(before)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    text = np.repeat(np.arange(len(counts)), per)
    first = np.repeat(before[:-1], per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    out = np.zeros(len(first), np.uint64)
    size = np.minimum(counts, k)[text]
    for i in range(k):
        there = size > i
        if there.all():
            out += h[first + i] * _odd[i]
        else:
            out[there] += h[first[there] + i] * _odd[i]
    return mixed(out + size.astype(np.uint64)), text


def replicas(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by text and key: (key, text, how many times it occurs there)."""
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return k[at], t[at], np.diff(np.append(at, len(k)))
