"""Word and n-gram arithmetic on the byte buffers of Arrow string columns.

The functions work on one chunk of rows at a time, so that memory is bounded by the chunk
(or by the longest single row), and on whole arrays, so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        step = np.full(max(n, CHUNK_BYTES + 1), _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        step[0] = 1
        _POWERS[kind] = np.multiply.accumulate(step)
    return _POWERS[kind][:n]


class Chunk:
    """Some consecutive rows: ``first`` row number, their bytes, and the offsets of the rows in them."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column cut into runs of rows of at most ``limit`` bytes, or of one longer row.  Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        last = min(last, n)
        yield Chunk(row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


class Words:
    """The words of a chunk: ``[^\\x20\\x09-\\x0D]+``, never across rows."""

    def __init__(self, chunk: Chunk, lower: bool = True):
        data, offsets = chunk.data, chunk.offsets
        self.chunk = chunk
        self.data = LOWER[data] if lower else data
        blank = SPACE[data]
        before = np.empty(len(data), dtype=bool)
        after = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = after[-1] = True
            before[1:], after[:-1] = blank[:-1], blank[1:]
            full = offsets[1:] > offsets[:-1]
            before[offsets[:-1][full]] = True
            after[offsets[1:][full] - 1] = True
        self.starts = np.flatnonzero(~blank & before)
        self.ends = np.flatnonzero(~blank & after) + 1
        #: words of row i are bounds[i] .. bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.rows = np.repeat(np.arange(chunk.rows), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def windows(self, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words in a row, and the number of each run's first word."""
        n = len(values) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.rows[:n] == self.rows[size - 1 :])
        return run_hashes(values, at, size), at


def run_hashes(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of values[i : i + size] for each i in ``at``; order matters."""
    out = np.full(len(at), size, dtype=np.uint64) * _GOLDEN
    for k in range(size):
        out = mix(out * np.uint64(_BASE) + values[at + k])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of data[start:end], from prefix sums of a polynomial over the whole buffer."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[data] * _powers("up", n), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers("down", n + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _GOLDEN)


def hash_text(value: str | bytes | None) -> int:
    """A stable unsigned 64-bit hash of one short text."""
    raw = b"" if value is None else value.encode() if isinstance(value, str) else value
    h = 0xCBF29CE484222325
    for b in raw:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([h], dtype=np.uint64))[0])


def batch(fields: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, type=schema.field(k).type) for k, v in fields.items()], schema=schema
    )


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(values, type=kind))


def prefix_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for 64-bit values; order and length matter."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(values) * _powers("up", n), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers("down", n + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _GOLDEN)


def first_in_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Marks each value's first occurrence within its row.  ``rows`` ascends."""
    new = np.zeros(len(values), dtype=bool)
    _, at = np.unique(values + mix(rows.astype(np.uint64) + np.uint64(1)), return_index=True)
    new[at] = True
    return new
