"""Vectorised text kernels over Arrow string columns: words, 64-bit word hashes, shingles.

Everything works on the raw UTF-8 buffer of a slice of documents; no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one vectorised step holds; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_LANES = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
_powers: dict[int, np.ndarray] = {}


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 65536)
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = known
    return known[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.string()), np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most size bytes each, or one document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words [^\\x20\\x09-\\x0D]+, and n + 1 word offsets of the documents."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    own, before, after = inside[1:-1], inside[:-2], inside[2:]
    first, last = own & ~before, own & ~after
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = own[cut]
    last[cut - 1] = own[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets).astype(np.int64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words, equal exactly for equal byte strings but for chance (2 ** -64 a pair)."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    terms = _BYTE[_LOWER[data] if lower else data]
    terms *= _power(_BASE, len(data))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(terms, out=total[1:])
    return splitmix((total[end] - total[start]) * _power(_INVERSE, len(data))[start])


def windows(hashes: np.ndarray, word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words and n + 1 offsets; 0 < words < k gives one window of the whole."""
    count = np.diff(word_offsets)
    n = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(out_offsets[-1], dtype=np.uint64)
    if len(hashes) >= k:
        full = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
        for j in range(k):
            full += hashes[j : j + len(full)] * _LANES[j]
        take = np.ones(len(full), dtype=bool)
        for j in range(1, k):  # a window that begins in the last k - 1 words of a document crosses its end
            at = word_offsets[1:] - j
            at = at[(at >= 0) & (at < len(full))]
            take[at] = False
        starts = np.flatnonzero(take)
        doc = np.searchsorted(word_offsets, starts, "right") - 1
        ok = count[doc] >= k
        starts, doc = starts[ok], doc[ok]
        out[out_offsets[doc] + starts - word_offsets[doc]] = splitmix(full[starts])
    for d in np.flatnonzero((count > 0) & (count < k)):
        w = hashes[word_offsets[d] : word_offsets[d + 1]]
        out[out_offsets[d]] = splitmix((w * _LANES[: len(w)]).sum(keepdims=True) + np.array([len(w)], np.uint64) * _LANES[63])[0]
    return out, out_offsets


def crc32_of_ids(ids: pa.Array | np.ndarray) -> np.ndarray:
    """crc32 of the decimal text of each id, as Spark's crc32(cast(id as string)) gives it."""
    import zlib

    return np.fromiter((zlib.crc32(str(int(x)).encode()) for x in ids), dtype=np.int64, count=len(ids))


def spans(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each [offsets[i], offsets[i + 1]), 0 where that is empty; values may have columns."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=np.result_type(values.dtype, np.int64) if values.dtype == bool else values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=out.dtype)
    return out


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each position below offsets[-1], the index of the span that holds it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 data, and the offsets in code points; ill-formed bytes become U+FFFD."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begins = np.empty(len(data) + 1, dtype=np.int64)
    begins[0] = 0
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    if begins[-1] == len(chars):
        return chars, begins[offsets]
    each = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for a, b in zip(offsets[:-1], offsets[1:])]
    return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
