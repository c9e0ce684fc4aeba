"""Vectorised text work inside Arrow tasks: whole UTF-8 columns as numpy bytes.

Rows are handled in slices of bounded text size, so a task's memory follows
the slice (or its longest single text), never the partition.  Null text reads
as the empty text.  Words are maximal runs of bytes outside a separator table;
every separator is ASCII, so byte runs and character runs are the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes per slice; the numpy work holds some tens of bytes per text byte.
SLICE_BYTES = 1 << 20

_WS = np.ones(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words that end at ASCII white space.
SPACED = _WS
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
#: Bytes of words made of ASCII letters, digits and any non-ASCII character.
ALNUM = _ALNUM
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_B1 = 0x9E3779B97F4A7C15
_B2 = 0xC2B2AE3D27D4EB4F
_M64 = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: What a Python worker keeps between tasks (encoders); tasks that do not use it let it go.
HELD: dict[str, object] = {}


def _give_back() -> None:
    """Return freed memory to the system (where the C library can): a worker lives on after its task."""
    import ctypes
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(data bytes, offsets) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(off, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES, holds: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``max_bytes`` of text (one row at least).  ``holds``: the task uses what the worker holds."""
    if not holds and HELD:
        import gc
        HELD.clear()
        gc.collect()
    data, off = utf8_column(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield batch.slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j
    _give_back()


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, first word index per document with the total last)."""
    if data.size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = table[data]
    edge = np.zeros(data.size + 1, dtype=bool)
    edge[off] = True
    first = w & edge[:-1]
    first[0] = w[0]
    first[1:] |= w[1:] & ~w[:-1]
    last = w & edge[1:]
    last[-1] = w[-1]
    last[:-1] |= w[:-1] & ~w[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inv = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inv):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 1 << 21:
            _POWERS[base] = have
    return have


def poly_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _B1) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of values[start:end] for every range, from one prefix sum."""
    if starts.size == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that the high bits of hashes are uniform."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(poly_hash(data, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(_B2))


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words inside a document and the word index where each starts."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    base = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    at = base + np.arange(total)
    return mix(poly_hash(hashes, at, at + width, _B2)), at


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as fixed-width differences: one width byte, the first value, then the gaps."""
    if values.size == 0:
        return b""
    gaps = np.diff(values)
    top = int(gaps.max()) if gaps.size else 0
    width = max(1, (top.bit_length() + 7) // 8)
    return bytes([width]) + values[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(body) + 1, 8), np.uint8)
    out[1:, :width] = body
    out[0] = np.frombuffer(blob, np.uint8, 8, 1)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def int_column(column, null: int) -> np.ndarray:
    """An integer column as int64 with ``null`` in place of nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)
