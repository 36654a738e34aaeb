"""Array helpers for texts inside tasks: runs of characters as words, and 64-bit hashes of spans, some hundred KB of text at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken at once; a longer text is taken alone.
CHUNK = 1 << 19
SEED = 0x9E3779B97F4A7C15
_MUL = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in ``column``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            total, begin = 0, i
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def released() -> None:
    """Give what this process has freed back to the system: a Python worker stays after its tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps it otherwise
        trim(0)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and the n + 1 offsets of the texts in them; a null is empty."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends and per-text counts (as n + 1 offsets) of the maximal runs of True that don't leave a text."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if n else inside
    begins = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.concatenate((inside[1:], [False])) if n else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[begin:end] for each span; equal spans have equal hashes wherever they are."""
    n = len(codes)
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK)
        _powers[:] = [np.concatenate(([np.uint64(1)], np.full(size, f))).cumprod(dtype=np.uint64) for f in (_MUL, _INV)]
    values = _BYTE[codes] if codes.dtype == np.uint8 else mixed(codes.astype(np.uint64) + np.uint64(SEED))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(values * _powers[0][:n], dtype=np.uint64)))
    return mixed((sums[ends] - sums[begins]) * _powers[1][begins] + (ends - begins).astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive hashes."""
    out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width if len(out) else 0):
        out = mixed(out * _MUL + hashes[k : k + len(out)])
    return out


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def spaced_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the n + 1 offsets of the texts among them."""
    data, offsets = utf8(texts)
    data = ascii_lower(data) if lower else data
    begins, ends, counts = runs(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)
    return span_hashes(data, begins, ends), counts
