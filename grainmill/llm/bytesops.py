"""Text columns as byte arrays: splitting, word spans and hashes in numpy, without a Python object per word.

All functions work on one buffer of bytes and an array of row offsets (`n + 1` values, the first 0). Null texts are
empty rows. A word is a run of bytes other than ASCII white space; A-Z are folded to lower case where asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

CHUNK_BYTES = 2_000_000
SMALL_BYTES = 500_000  # for operators that hold many arrays of a chunk's bytes or words at once

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown and kept up to a chunk's length."""
    have = _POWERS.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    out = np.ones(max(n, 1 << 16), np.uint64)
    filled = 1
    with np.errstate(over="ignore"):
        while filled < len(out):
            step = min(filled, len(out) - filled)
            out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 2**64))
            filled += step
    if len(out) <= 4 * CHUNK_BYTES:
        _POWERS[base] = out
    return out[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], (off - off[0]).astype(np.int64)


def chunked(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold at most `limit` bytes, or one row where that row alone holds more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < len(ends):
            stop = max(int(np.searchsorted(ends, base + limit, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def joined(texts: Sequence[bytes], limit: int = CHUNK_BYTES // 4) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First position, bytes and offsets of runs of texts of at most `limit` bytes, or of one longer text."""
    start = 0
    while start < len(texts):
        stop, size = start + 1, len(texts[start])
        while stop < len(texts) and size + len(texts[stop]) <= limit:
            size += len(texts[stop])
            stop += 1
        yield start, *buffers(pa.array(texts[start:stop], pa.binary()))
        start = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where `inside` holds; no run crosses a row boundary."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    rows = off[:-1]
    first[rows[rows < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    rows = off[1:]
    last[rows[rows > 0] - 1] = True
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spans(~SPACE[data], off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, by differences of one running sum."""
    n = len(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * _powers(_BASE, n), out=running[1:])
        return mix((running[end] - running[start]) * _powers(_INVERSE, n)[start] + (end - start).astype(np.uint64))


def owners(start: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row of each span, given the spans' starts in order."""
    return np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and the offsets of each row's words."""
    low = LOWER[data]
    start, end = word_spans(low, off)
    return span_hashes(low, start, end), np.searchsorted(start, off)


def with_values(
    df: DataFrame,
    text_col: str,
    name: str,
    kind: T.DataType,
    values: Callable[[np.ndarray, np.ndarray], np.ndarray],
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """`df` with `name`, the values of a function of the texts' bytes and offsets, by chunks of at most `limit` bytes."""
    columns = df.columns
    kept = [i for i, c in enumerate(columns) if c != name]
    place = columns.index(text_col)

    def run(batches):
        for batch in chunked(batches, text_col, limit):
            found = pa.array(values(*buffers(batch.column(place).cast(pa.string()))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [found], names=[columns[i] for i in kept] + [name]
            )

    return df.mapInArrow(run, df.select(*[columns[i] for i in kept]).schema.add(name, kind))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` bears it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def others(df: DataFrame, replaced: Sequence[str]) -> list[str]:
    """Columns of `df` that bear none of the names, in any case."""
    gone = {c.lower() for c in replaced}
    return [c for c in df.columns if c.lower() not in gone]
