"""Vectorised helpers on Arrow string batches, shared by the text operators.

A batch's texts lie in one byte buffer; words are found and hashed with numpy
over the whole buffer, so Python runs per document, never per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

U64 = np.uint64
#: Rows of a text table that a task gets at a time.
ROWS_PER_BATCH = 1000
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_SEED = U64(0x9E3779B97F4A7C15)
#: Bytes 0x09-0x0D and 0x20.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: ASCII letters, digits and all non-ASCII bytes.
WORD = np.zeros(256, bool)
WORD[128:] = WORD[48:58] = WORD[65:91] = WORD[97:123] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * _M1
    x = x ^ (x >> U64(33))
    x = x * _M2
    return x ^ (x >> U64(33))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to send tasks few rows at a time, as a row may be a long text.

    Every operator that sends texts to Python calls this, so that none depends
    on what ran before; a smaller figure that the session has is kept.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= ROWS_PER_BATCH:
        conf.set(key, str(ROWS_PER_BATCH))
    return df


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` of text each (one row at least), so that memory is bounded by the longest text."""
    col = batch.column(column)
    lengths = np.asarray(pa.compute.binary_length(col).fill_null(0))
    at = 0
    total = np.concatenate([[0], np.cumsum(lengths)])
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most_bytes, "right")) - 1)
        yield at, end
        at = end


def parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into :func:`slices`."""
    for batch in batches:
        for a, b in slices(batch, column):
            yield batch.slice(a, b - a)


def running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place."""
    return np.concatenate([[0], np.cumsum(flags)])


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its row offsets; null counts as empty."""
    col = col.fill_null("") if col.null_count else col
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of true bytes, runs cut at row bounds; and each row's first run."""
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside.copy()
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside.copy()
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(inside))]
    before[bounds] = False
    after[bounds - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, eight bytes at a time over all runs at once."""
    lengths = ends - starts
    out = mix(lengths.astype(U64) + _SEED)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded.tobytes(), 0, (1,))
    live, k = np.arange(len(starts)), 0
    while len(live):
        left = lengths[live] - 8 * k
        part = lanes[starts[live] + 8 * k] & _MASKS[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ part) * _M1 + _SEED)
        live = live[left > 8]
        k += 1
    return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each ``width`` successive hashes; callers drop those that cross a row's end."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = mix(hashes[:n] + U64(width))
    for j in range(1, width):
        out = mix(out * _M2 + hashes[j : j + n])
    return out


def whole(hashes: np.ndarray) -> int:
    """One hash for a whole short sequence, apart from those of :func:`windows`."""
    out = mix(np.array([len(hashes)], U64) ^ _SEED)
    for h in hashes:
        out = mix(out * _M2 + h)
    return out[0]
