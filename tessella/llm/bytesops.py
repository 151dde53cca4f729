"""Vectorised work on the UTF-8 bytes of whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of rows of about this many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(batch: pa.RecordBatch, text: str = "text", run_bytes: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows: (rows, bytes, offsets)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(size, dtype=np.int64) // run_bytes
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows = batch.slice(a, b - a)
        yield rows, *text_bytes(rows.column(text))


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a mask or of counts over each text."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, 1 << 16)
        _powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, _BASE))), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64))))), dtype=np.uint64)
    return _powers, _inverse


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums modulo 2**64; span_hash() takes any span's hash from them."""
    power, _ = _tables(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of bytes start..end, wherever they stand."""
    _, inverse = _tables(len(prefix))
    return (prefix[end] - prefix[start]) * inverse[start]


def span_hash_all(prefix: np.ndarray, width: int) -> np.ndarray:
    """span_hash() of every span of the width."""
    n = len(prefix) - width
    _, inverse = _tables(len(prefix))
    return (prefix[width:] - prefix[:n]) * inverse[:n]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the words: runs without ASCII white space. None crosses two texts."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1
