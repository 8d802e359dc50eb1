"""Word spans and hashes of whole batches of texts, as numpy arrays.

A batch of an Arrow string column is one byte buffer with offsets.  Words are
maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; in UTF-8 these separators
never occur inside a longer character, so working on bytes equals working on
characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once, so that work arrays stay at some tens of MB.
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.Philox(20250101))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
FOLDED_VALUE = BYTE_VALUE.copy()
FOLDED_VALUE[65:91] = BYTE_VALUE[97:123]
_STEP = int(_rng.integers(2**40, 2**62)) * 2 + 1
_STEP_INVERSE = pow(_STEP, -1, 2**64)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverse_powers = np.ones(1, dtype=np.uint64)


def _grown(have: np.ndarray, base: int, n: int) -> np.ndarray:
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 2**64))])
    return have


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    global _powers, _inverse_powers
    _powers = _grown(_powers, _STEP, n)
    _inverse_powers = _grown(_inverse_powers, _STEP_INVERSE, n)
    return _powers[:n], _inverse_powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def slices(
    column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of slices of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds, cut at row bounds, and the rows' offsets into them."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cuts = offsets[(offsets > 0) & (offsets < n)]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[cuts] = inside[cuts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the rows' offsets into them."""
    return spans(~SEPARATOR[data], offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal spans wherever they stand."""
    forward, back = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * forward[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive entries that begin at each place (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * U64(pow(0x9E3779B97F4A7C15, 2 * j + 1, 2**64))
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles of A-Z-folded words, one after another, and the rows' offsets.

    A row with fewer than k words, but at least one, has its whole sequence as
    its only shingle.  Repeats within a row are kept.
    """
    starts, ends, at = words(data, offsets)
    each = span_hashes(data, starts, ends, FOLDED_VALUE)
    count = np.diff(at)
    out_count = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(out_count)])
    out = np.zeros(out_at[-1], dtype=np.uint64)
    long = runs(each, k)
    full = np.flatnonzero(count >= k)
    if len(full):
        sizes = out_count[full]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(out_at[full], sizes) + within] = long[np.repeat(at[full], sizes) + within]
    for row in np.flatnonzero((count > 0) & (count < k)):
        whole = U64(0)
        for j, h in enumerate(each[at[row] : at[row + 1]]):
            whole = U64((int(whole) + int(h) * pow(0xC2B2AE3D27D4EB4F, 2 * j + 1, 2**64)) % 2**64)
        out[out_at[row]] = mix(np.array([whole + U64(count[row])], dtype=np.uint64))[0]
    return out, out_at
