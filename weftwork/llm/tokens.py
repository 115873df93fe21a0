"""Vectorised words, hashes and shingles over the bytes of an Arrow string column.

Words are runs of bytes other than 0x20 and 0x09-0x0D; UTF-8 never uses these bytes inside a longer character, so bytes
and code points give the same words. Everything works on whole texts, half a megabyte of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 500_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_MULT = U(0x9E3779B97F4A7C15)
_POS = _rng.integers(1, 2**63, 8, dtype=np.uint64) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(n: int, of: np.uint64 = _MULT) -> np.ndarray:
    """The first n powers of a multiplier; the table grows when a longer run comes."""
    known = _powers.get(int(of))
    if known is None or len(known) < n:
        known = np.full(max(n, 1024), of, dtype=np.uint64)
        known[0] = U(1)
        known = np.multiply.accumulate(known)
        if n <= _BLOCK:  # what a single very long text needs isn't kept for the life of the worker
            _powers[int(of)] = known
    return known[:n]


def run_hashes(data: np.ndarray, starts: np.ndarray, inside: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Hash of each run that begins at starts[i] and reaches to the next start; bytes not `inside` don't count. Another
    `table` of values for the bytes gives an independent hash. Works on about a megabyte of whole runs at a time."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _BLOCK)))
        lo, hi = int(starts[i]), int(starts[j]) if j < len(starts) else len(data)
        own = starts[i:j] - lo
        begin = np.zeros(hi - lo, np.int64)
        begin[own] = own
        place = np.arange(hi - lo) - np.maximum.accumulate(begin)
        terms = table[data[lo:hi]] * powers(int(place.max()) + 1)[place]
        terms[~inside[lo:hi]] = U(0)
        out[i:j] = mix(np.add.reduceat(terms, own))
        i = j
    return out


class Chunk(NamedTuple):
    """Some rows of a batch: `rows` are their places in it, `at` the first byte of each text and the end of the last."""

    rows: np.ndarray
    data: np.ndarray
    at: np.ndarray


class Words(NamedTuple):
    """Words of a chunk in order: first byte, hash, and the text (0, 1, ... in the chunk) that each belongs to."""

    starts: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each text: the place of its first word; one more entry at the end


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into runs of whole texts of about `most` bytes; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield Chunk(np.arange(i, j), raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def words(c: Chunk, lower: bool) -> Words:
    """The words of every text of a chunk; with `lower`, A-Z count as a-z."""
    docs = len(c.rows)
    if not len(c.data):
        z = np.zeros(0, np.int64)
        return Words(z, np.zeros(0, np.uint64), z, np.zeros(docs + 1, np.int64))
    data = _LOWER[c.data] if lower else c.data
    space = _SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[c.at] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | begins[:-1]))
    first = np.searchsorted(starts, c.at)
    doc = np.repeat(np.arange(docs), np.diff(first))
    return Words(starts, run_hashes(data, starts, ~space), doc, first)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a text, and the place of each run's first word."""
    n = len(w.hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[: n - size + 1] == w.doc[size - 1 :])
    total = np.zeros(len(at), np.uint64)
    for t in range(size):
        total += w.hashes[at + t] * _POS[t]
    return mix(total), at


def shingle_sets(c: Chunk, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) for each text: lower-cased runs of `size` words; with fewer words
    the whole sequence is the only shingle; without words the set is empty."""
    w = words(c, lower=True)
    hashes, at = windows(w, size)
    cut = np.searchsorted(at, w.first)
    for k, row in enumerate(c.rows):
        own = hashes[cut[k] : cut[k + 1]]
        if not len(own) and (few := w.hashes[w.first[k] : w.first[k + 1]]).size:
            own = mix((few * _POS[: len(few)]).sum(keepdims=True, dtype=np.uint64) + U(len(few) * int(_MULT) & 0xFFFFFFFFFFFFFFFF))
        yield int(row), np.unique(own)
