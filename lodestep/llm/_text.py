"""Vectorised byte, word and shingle hashing over slices of Arrow string columns.

Everything works on UTF-8 bytes of a few hundred kilobytes at a time, so memory stays bounded whatever
the batch or the length of a document. Hashes are deterministic across processes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=U)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_MUL = U(0x9E3779B97F4A7C15)
_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = U(0xD1342543DE82EF95)
_POW: dict[str, np.ndarray] = {}

#: Word bytes of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _powers(kind: str, base: U, n: int) -> np.ndarray:
    have = _POW.get(kind)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 20), base, U)
        full[0] = 1
        have = _POW[kind] = np.multiply.accumulate(full)
    return have[:n]


def powers(n: int) -> np.ndarray:
    """Powers of the polynomial's odd base modulo 2**64."""
    return _powers("up", _MUL, n)


def inverse_powers(n: int) -> np.ndarray:
    return _powers("down", _INV, n)


class Slice(NamedTuple):
    """A run of texts: row range in the batch, their bytes, and each text's byte offsets in them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 19) -> Iterator[Slice]:
    """Cuts a string column into runs of about ``most`` bytes; a longer text is a run of its own. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class Words(NamedTuple):
    """Words of a slice: hashes, byte starts and ends, and each text's offsets into them."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def words(part: Slice, inside: np.ndarray) -> Words:
    """Maximal runs of the bytes that ``inside`` marks, never across texts, hashed with A-Z as a-z."""
    data, n = part.data, len(part.data)
    cut = part.offsets[:-1]
    cut = cut[cut < n]
    ends_at = part.offsets[1:]
    ends_at = ends_at[ends_at > 0] - 1
    in_word = inside[data]
    begins, finishes = in_word.copy(), in_word.copy()
    begins[1:] &= ~in_word[:-1]
    begins[cut] = in_word[cut]
    finishes[:-1] &= ~in_word[1:]
    finishes[ends_at] = in_word[ends_at]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * powers(n), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse_powers(n)[starts] + (ends - starts).astype(U))
    return Words(hashes, starts, ends, np.searchsorted(starts, part.offsets))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``size``-word shingles, and each text's offsets into them; a shorter text that has words is one shingle."""
    h, offsets = found.hashes, found.offsets
    counts = np.diff(offsets)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    rows = np.repeat(np.arange(len(counts)), made)
    first = offsets[:-1][rows] + np.arange(at[-1]) - at[:-1][rows]
    length = np.minimum(counts, size)[rows]
    out = length.astype(U) * U(0xA0761D6478BD642F)
    for k in range(size):
        use = length > k
        out = out * _STEP + np.where(use, h[np.minimum(first + k, max(len(h) - 1, 0))] if len(h) else U(0), U(0))
    return mix(out), at


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run's hashes sorted and without repeats, and the offsets of the runs."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = hashes.copy()
    for i in range(len(offsets) - 1):
        out[offsets[i] : offsets[i + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
