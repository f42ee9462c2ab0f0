"""Arrow string columns as numpy code-point arrays and back, without a call per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows end to end, row offsets into them); nulls are empty rows."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    marks = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    first, last = int(marks[0]), int(marks[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
    return points, leads[marks - first]


def encode(points: np.ndarray, offsets: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """The inverse of decode: an Arrow large_string array; rows where ``nulls`` is true become null."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(width)))[offsets]
    valid = None
    if nulls is not None and nulls.any():
        valid = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [valid, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)])


def parts(batch: pa.RecordBatch, column: int = -1, most: int = 1 << 20):
    """Slices of a record batch whose strings in ``column`` hold at most ``most`` bytes (one longer row stands alone)."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.columns[column]), 0)).astype(np.int64)
    bucket = np.cumsum(sizes) // most
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [batch.num_rows]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield batch.slice(a, b - a)
