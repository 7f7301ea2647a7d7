"""Near duplicates by SimHash: fingerprints that differ in few bits, found by deletion-variant signatures.

Of ``h`` of each shingle, a fingerprint's bit is 1 if set in over half. Two
fingerprints link if at most ``distance`` bits differ. Cut into ``distance // 2
+ 1`` segments, two such fingerprints differ by one bit at most in one of them.
So the index holds, for each segment and each of its bits, the segment with
that bit as a wildcard: two segments that differ by one bit agree in one of
these variants, equal ones in all. An equality join on them finds the pairs and
counting the bits verifies each.

Copies and near copies don't multiply the work: documents of one fingerprint
are one class; in each variant's list every class is first held against the
least and the greatest fingerprint of the list, and what links shares a
component; then only pairs of different components are left to find. Lists of
over ``MANY`` are cut again: the rest of two linked fingerprints, in ``distance +
1`` pieces, agrees in one, so these pieces join the key, and only classes
outside such a list's largest component meet the others. Nothing is capped, and
no list meets in one task.

Null and empty texts have no shingles and the fingerprint zero, linked like any
other. A text of fewer words than a shingle is one shingle. Rows that repeat an
id, and rows with a null id, are documents like any other; a null id names no
component unless nobody else in it has an id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import text_kernel as K
from tradeloom.operators.components import connected_components
from tradeloom.session import discard, durable, read

BITS = 64
SEED = 42
#: Classes of a list beyond which it is cut again.
MANY = 64
#: Shingles hashed at a time.
_AT_ONCE = 1 << 14
_LOWER = bytes(K.LOWER)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of a text, unsigned."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes split at 0x09-0x0D and 0x20
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _AT_ONCE):
        pairs = zip(starts[at : at + _AT_ONCE].tolist(), ends[at : at + _AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in pairs], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of each row; ``fp`` is the fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    texts = K.small_batches(documents).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """First bit and length of each segment: so few that two fingerprints within ``distance`` differ by one bit at most in one."""
    m = distance // 2 + 1
    ends = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _piece(fp: Column, places: list[int]) -> Column:
    """The named bits of ``fp``, other bits 0."""
    return fp.bitwiseAND(F.lit(_signed(sum(1 << p for p in places))))


def variants(classes: DataFrame, distance: int) -> DataFrame:
    """A row for each fingerprint and one-wildcard variant: all columns, ``variant`` (the wildcard's place) and ``rest`` (the segment's other bits)."""
    every = []
    for first, length in segments(distance):
        places = range(first, first + length)
        every += [F.struct(F.lit(p).alias("variant"), _piece(F.col("fp"), [q for q in places if q != p]).alias("rest")) for p in places]
    return classes.select("*", F.explode(F.array(*every)).alias("v")).select(*classes.columns, "v.variant", "v.rest")


def _cut_again(rows: DataFrame, distance: int) -> DataFrame:
    """A row for each piece of the bits outside the variant's segment, numbered in ``cut``, its bits in ``cut_bits``."""
    choice: Column | None = None
    for first, length in segments(distance):
        others = [p for p in range(BITS) if not first <= p < first + length]
        n = len(others)
        parts = [others[n * k // (distance + 1) : n * (k + 1) // (distance + 1)] for k in range(distance + 1)]
        pieces = F.array(*[F.struct(F.lit(k).alias("cut"), _piece(F.col("fp"), p).alias("cut_bits")) for k, p in enumerate(parts)])
        mine = F.col("variant").between(first, first + length - 1)
        choice = F.when(mine, pieces) if choice is None else choice.when(mine, pieces)
    return rows.select("*", F.explode(choice).alias("c")).select(*rows.columns, "c.cut", "c.cut_bits")


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def _large(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is sorted and never broadcast: Spark sizes exploded rows as if there were one for each row they come from."""
    return rows.hint("merge")


def _same(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in keys])


def _across(one: DataFrame, two: DataFrame, keys: list[str], distance: int, *also: Column) -> DataFrame:
    """``(p, q)``: verified pairs of different components that share ``keys``."""
    x = one.select(*keys, F.col("fp").alias("p"), F.col("component").alias("of_p")).alias("x")
    y = two.select(*keys, F.col("fp").alias("q"), F.col("component").alias("of_q")).alias("y")
    wanted = [F.col("of_p") != F.col("of_q"), _near("p", "q", distance), *also]
    return _large(x).join(_large(y), reduce(Column.__and__, wanted, _same(keys))).select("p", "q")


def links(classes: DataFrame, distance: int = 4, many: int = MANY) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs ``(a, b)`` of linked fingerprints of ``classes(fp)`` that connect all that is linked, and the tables made on the way.

    Joins put out verified pairs only, so chance meetings in a list cost a
    comparison and no row.
    """
    key = ["variant", "rest"]
    pair = lambda p, q: (F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    sizes = durable(variants(classes.select("fp"), distance).groupBy(*key).agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1"))
    x, y = variants(classes.select("fp"), distance).alias("x"), sizes.alias("y")
    to_end = [(F.col("fp") != F.col(end)) & _near("fp", end, distance) for end in ("low", "high")]
    met = durable(_large(x).join(y, _same(key) & (to_end[0] | to_end[1])).select("fp", "low", "high").distinct())
    first = durable(reduce(DataFrame.unionByName, [met.where(near).select(*pair("fp", end)) for near, end in zip(to_end, ("low", "high"), strict=True)]).distinct())
    label = durable(connected_components(first, "a", "b"))
    named = durable(classes.select("fp").join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")))

    crowded = durable(sizes.where(F.col("n") > many).select(*key))
    every, wide = variants(named, distance), not crowded.isEmpty()
    short = _large(every).join(crowded, key, "left_anti") if wide else every
    found = [_across(short, short, key, distance, F.col("p") < F.col("q")).select(*pair("p", "q"))]
    made = [sizes, met, first, label, named, crowded]
    if wide:
        cut = [*key, "cut", "cut_bits"]
        pieces = durable(_cut_again(_large(every).join(crowded, key), distance))
        largest = pieces.groupBy(*cut, "component").agg(F.count("*").alias("n")).groupBy(*cut).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
        largest = durable(largest.where(F.col("all") > F.col("top.n")).select(*cut, F.col("top.component").alias("largest")))
        live = durable(_large(pieces).join(largest, cut))
        found.append(_across(live.where(F.col("component") != F.col("largest")), live, cut, distance).select(*pair("p", "q")))
        made += [pieces, largest, live]
    second = durable(reduce(DataFrame.unionByName, found).distinct())
    return first.unionByName(second), [*made, second]


def near_duplicates(documents: DataFrame, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """``(doc_id, fingerprint, component_id, n_copies)``, one row for each row of ``documents``.

    ``fingerprint`` has 16 hex digits, ``component_id`` is the smallest id
    reachable by links, ``n_copies`` the number of rows with this fingerprint.
    """
    docs = durable(fingerprints(documents, width, id_col, text_col))
    classes = durable(docs.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n_copies")))
    pairs, made = links(classes, distance, many)
    groups = durable(connected_components(pairs, "a", "b").withColumnRenamed("node", "fp").join(classes.select("fp", "first"), "fp"))
    lowest = durable(groups.groupBy("component").agg(F.min("first").alias("lowest")))
    reached = groups.join(lowest, "component").select("fp", "lowest")
    names = durable(classes.join(reached, "fp", "left").select("fp", "n_copies", F.coalesce("lowest", "first").alias("component_id")))
    out = docs.join(names, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "id").alias("component_id"), "n_copies")
    out = durable(out)
    for used in (docs, classes, *made, groups, lowest, names):
        discard(used)
    return out


def op13_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over 4-word shingles and its group at 4 differing bits."""
    return near_duplicates(read(spark, sf_dir, "documents"), 4, 4)
