"""Words and their hashes, found for whole Arrow batches at once.

Everything works on UTF-8 bytes. A separator table of 256 booleans says which
bytes end a word; bytes of multi-byte characters are never separators. Word
hashes are 64 bits and depend on the word's bytes alone, so they agree between
tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Separators of ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators when punctuation ends a word as well.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_K1, _K2, _K3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S29, _S32 = np.uint64(29), np.uint64(32)
#: Words longer than this are hashed one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all its bits."""
    x = (x ^ (x >> _S32)) * _K1
    x = (x ^ (x >> _S29)) * _K2
    return x ^ (x >> _S32)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more at the end). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of ``rows`` rows at most with about ``most`` bytes of text each; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(lengths):
        return
    total = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < len(lengths):
        before = total[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(total, before + most, "right"))), at + rows)
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``, and the index of its text."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    length = ends - starts
    out = mix(length.astype(np.uint64) + _K3)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    out = mix(out ^ (eight[starts] & _MASK[np.minimum(length, 8)]))
    at, rest = 8, np.flatnonzero(length > 8)
    while len(rest) and at < _LONG:
        left = length[rest] - at
        out[rest] = mix(out[rest] ^ (eight[starts[rest] + at] & _MASK[np.minimum(left, 8)]))
        at, rest = at + 8, rest[left > 8]
    for i in rest:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def word_hashes(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more at the end)."""
    data, offsets = buffers(texts)
    if lower:
        data = LOWER[data]
    starts, ends, doc = spans(data, offsets, separators)
    bounds = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(doc, minlength=len(offsets) - 1), out=bounds[1:])
    return hashes(data, starts, ends), bounds
