"""Fixed-size summaries gathered from all tasks: counters, bit sets, and exact membership by a chain of bit sets.

Parts meet block by block over many tasks, and only the finished summary, whose
size is bounded by a parameter, reaches the driver and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import text_kernel as K
from tradeloom.session import discard, durable

BLOCKS = 128
BLOCK_SCHEMA = "block int, cells binary"
#: Bits of a set for each key, and of the smallest set.
BITS_A_KEY = 16
LEAST_BITS = 1 << 13
#: Keys whose set (16 MB at 16 bits a key) may be broadcast; callers with more join instead.
MOST_KEYS = 1 << 23
#: A chain ends with an exact list once this many keys are left.
LAST_KEYS = 1 << 16
_STEP = 0x9E3779B97F4A7C15
_ARROW = pa.schema([("block", pa.int32()), ("cells", pa.binary())])


def as_blocks(cells: np.ndarray) -> pa.RecordBatch:
    parts = np.split(cells, BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=_ARROW)


def gather(parts: DataFrame, cells: int, kind: str) -> np.ndarray:
    """Add up the counters of all tasks, block by block; returns an array of ``cells`` values."""
    size = cells // BLOCKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
                got = np.frombuffer(raw.as_buffer(), kind)
                mine = held.setdefault(block, np.zeros(size, kind))
                mine += got
        for block, mine in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mine.tobytes()], pa.binary())], schema=_ARROW)

    out = np.zeros(cells, kind)
    for row in parts.repartition("block").mapInArrow(add, BLOCK_SCHEMA).collect():  # as large as the summary
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(bytes(row.cells), kind)
    return out


def bits_for(keys: int) -> int:
    """A power of two of at least ``BITS_A_KEY`` bits a key."""
    return max(LEAST_BITS, 1 << (BITS_A_KEY * keys - 1).bit_length())


def _set_blocks(bits: int) -> int:
    return max(1, bits >> 21)


def bit_places(keys: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    """Two places of each 64-bit key in a set of ``bits`` (a power of two), both in the block that the key's leading bits name.

    The places come from the high bits of the whole key finalised with the
    salt, so keys that meet at one salt meet at another by chance only.
    """
    blocks = _set_blocks(bits)
    inside = bits // blocks
    base = (keys >> np.uint64(48)) % np.uint64(blocks) * np.uint64(inside)
    mixed = K.mix(keys + np.uint64((salt + 1) * _STEP % (1 << 64)))
    width = np.uint64(inside.bit_length() - 1)
    return base + np.stack([mixed >> (np.uint64(64) - width), (mixed >> (np.uint64(64) - width - width)) & np.uint64(inside - 1)])


def bit_set(df: DataFrame, column: str, bits: int, salt: int = 0) -> np.ndarray:
    """Bits of the hashes in ``column`` (long): a bounded filter that lets every member pass.

    The keys themselves are shuffled by block, so the work follows their number
    and not the number of tasks that hold them.
    """
    blocks = _set_blocks(bits)
    size = bits // blocks

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = np.asarray(batch.column(0)).view(np.uint64)
            at = bit_places(keys, bits, salt)
            of = (at[0] // np.uint64(size)).astype(np.int64)
            for k in np.unique(of):
                held.setdefault(int(k), np.zeros(size, bool))[(at[:, of == k] % np.uint64(size)).ravel()] = True
        for k, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], schema=_ARROW)

    keys = df.select(F.col(column).cast("long").alias("h")).where("h IS NOT NULL")
    keys = keys.repartition(blocks, F.shiftrightunsigned("h", 48) % blocks) if blocks > 1 else keys.coalesce(1)
    out = np.zeros(bits // 8, np.uint8)
    for row in keys.mapInArrow(fill, BLOCK_SCHEMA).collect():  # as large as the set
        out[row.block * (size // 8) : (row.block + 1) * (size // 8)] = np.frombuffer(bytes(row.cells), np.uint8)
    return out


def in_bit_set(packed: np.ndarray, keys: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    at = bit_places(keys, bits, salt)
    return np.logical_and.reduce((packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)


@dataclass
class Members:
    """Which keys of a known universe are members, exactly, from a few bit sets and a list.

    The first set holds the members, the second the other keys of the universe
    that pass the first, the third the members that pass the second, and so on.
    The last ones are a sorted list, which no other key passes. A key is decided
    by the first set it fails. Keys outside the universe get no promise.
    """

    levels: list[np.ndarray] = field(default_factory=list)
    last: np.ndarray | None = None  # keys that pass all levels and belong to the side that is next

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        alive = np.arange(len(keys))
        for k, packed in enumerate(self.levels):
            stays = in_bit_set(packed, keys[alive], 8 * len(packed), k)
            out[alive[~stays]] = k % 2 == 1
            alive = alive[stays]
        if self.last is not None and len(self.last):
            at = np.minimum(np.searchsorted(self.last, keys[alive]), len(self.last) - 1)
            out[alive] = (self.last[at] == keys[alive]) == (len(self.levels) % 2 == 0)
        else:
            out[alive] = len(self.levels) % 2 == 1
        return out


def _passing(df: DataFrame, packed: np.ndarray, salt: int) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("h")).view(np.uint64)
            yield batch.filter(pa.array(in_bit_set(held.value, keys, 8 * len(held.value), salt)))

    return df.mapInArrow(run, "h long")


def members(inside: DataFrame, outside: DataFrame) -> Members:
    """Membership in ``inside(h)`` for keys of ``inside`` and ``outside(h)``, which share no key and hold no null.

    Both are read once or twice; give durable tables. Each set lets about one
    other key in seventy pass, so a few sets bring any number of keys down to
    the list. The whole takes some two bytes for each key of ``inside``.
    """
    out, mine, others, made = Members(), inside, outside, []
    while (n := mine.count()) > LAST_KEYS:
        salt = len(out.levels)
        out.levels.append(bit_set(mine, "h", bits_for(n), salt))
        mine, others = durable(_passing(others, out.levels[-1], salt)), mine
        made.append(mine)
    out.last = np.sort(np.array([r.h for r in mine.select("h").collect()], np.int64).view(np.uint64))  # at most LAST_KEYS
    for used in made:
        discard(used)
    return out


def member_column(spark: SparkSession, found: Members):
    """A column function: whether a hash (long) is a member; only the hashes leave the JVM."""
    held = spark.sparkContext.broadcast(found)

    @F.arrow_udf("boolean")
    def holds(keys: pa.Array) -> pa.Array:
        return pa.array(held.value.holds(np.asarray(keys.fill_null(0)).view(np.uint64)))

    return holds
