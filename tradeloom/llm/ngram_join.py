"""Exact n-gram Jaccard join by T-occurrence search (DivideSkip), giving groups of linked documents.

Two documents link when ``100 * |A n B| >= percent * |A u B|`` over their sets
of distinct word n-grams. A document of ``n`` n-grams shares at least
``T = ceil(percent * n / 100)`` with any partner, so it must be found T times in
the inverted lists of its n-grams. As in DivideSkip these lists are divided by
their length: the ``L`` longest are long, the ``n - L`` others short, and a
partner stands in ``T - L`` short lists at least (``short_hits`` says how L
follows from T). The short lists are merged by Spark's sort by n-gram, which
does a heap's work over many machines; hits of a pair are counted, and pairs
with too few are dropped. The long lists are never merged: each candidate that
remains is probed in them by binary search, in the sorted n-grams of the
candidate's own set, which hold a gram just if its list holds the candidate.

Copies and near copies don't multiply the work:

* documents with equal sets form a class, and only classes are compared;
* in each short list every member is first compared with one leader, the
  member with the fewest rarer n-grams before the shared one; what links with
  its leader shares a component;
* then only pairs of different components are left to count; the place of their
  first shared n-gram in both sets bounds the overlap still possible, and so do
  parities of the whole sets, bit by bit: each bit that differs stands for an
  n-gram that one set lacks.

List lengths come from a fixed-size count sketch over all documents. Any order
gives the same result, so the sketch's errors cost time only. N-grams and whole
sets are compared by 64-bit hashes.

Null and empty texts have no n-grams and link with nothing. A text of fewer
words than the n-gram has its whole sequence as the one n-gram. Repeated rows
are documents like any other, and so are rows with a null id: they link others,
but never name a group unless nobody else in it has an id. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import sketches
from tradeloom.llm import text_kernel as K
from tradeloom.operators.components import connected_components
from tradeloom.session import discard, durable, read

#: Hits in short lists that a pair needs.
SHORT_HITS = 2
#: Cells of the count sketch.
SKETCH_CELLS = 1 << 19
#: The parities of a set: whether it has an odd number of n-grams in each of 1024 bins, as sixteen longs.
_PARITY = [f"parity{k}" for k in range(16)]
#: One list in so many is searched first.
FIRST_LISTS = 4
#: Classes that a task remembers having sent.
_HELD_CLASSES = 1 << 15
_SHIFT = np.uint64(64 - 19)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    data, offsets = K.buffer_of(texts)
    data = K.LOWER[data]
    starts, ends, first = K.spans(~K.SPACE[data], offsets)
    words = K.hash_runs(data, starts, ends)
    grams = K.windows(words, width)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield np.array([K.whole(words[a:b])], K.U64)
        else:
            yield np.zeros(0, K.U64)


def _class_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parities(grams: np.ndarray) -> np.ndarray:
    bins = np.bincount((grams >> np.uint64(54)).astype(np.int64), minlength=64 * len(_PARITY))
    return np.packbits((bins & 1).astype(bool), bitorder="little").view(np.int64)


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def short_hits(least: int) -> int:
    """``T - L``: in how many short lists a partner stands at least, for ``T = least``.

    More hits rule more chance pairs out, but need as many more entries of each
    document, of which the last stand in longer lists.
    """
    return min(least, SHORT_HITS)


def _scan(texts: DataFrame, width: int) -> DataFrame:
    """One row for each document (its class, set size and key) and blocks of the count sketch."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), *[(c, pa.int64()) for c in _PARITY], ("block", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, some = np.zeros(SKETCH_CELLS, np.int64), [], 0
        for part in K.parts(batches, "text"):
            cls, n, odd = [], [], []
            for grams in shingle_sets(part.column("text"), width):
                cls.append(_class_of(grams))
                n.append(len(grams))
                odd.append(_parities(grams))
                held.append(grams >> _SHIFT)
                some += len(grams)
            if some > 1 << 18:
                counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=SKETCH_CELLS)
                held, some = [], 0
            none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            parities = [pa.array(c, pa.int64()) for c in (np.stack(odd, 1) if odd else [[]] * len(_PARITY))]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), *parities, *none], schema=schema)
        if held:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=SKETCH_CELLS)
        if counts.any():
            blocks, k = sketches.as_blocks(counts.astype(np.uint32)), sketches.BLOCKS
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64())] * (4 + len(_PARITY)) + blocks.columns, schema=schema)

    return texts.mapInArrow(run, f"id long, key long, cls long, n long, {', '.join(f'{c} long' for c in _PARITY)}, block int, cells binary")


def _short_lists(texts: DataFrame, width: int, percent: int, levels) -> DataFrame:
    """``(gram, cls, n, pos)``: the entries of each class in its short lists; a task sends a class once or a few times."""
    schema = pa.schema([("gram", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = levels.value, set()
        for part in K.parts(batches, "text"):
            out = []
            for grams in shingle_sets(part.column("text"), width):
                n = len(grams)
                if not n or (cls := _class_of(grams)) in seen:
                    continue
                if len(seen) >= _HELD_CLASSES:  # classes sent again cost only time
                    seen.clear()
                seen.add(cls)
                least = int(_least(n, percent))
                keep = n - least + short_hits(least)
                place = (rank[grams >> _SHIFT].astype(K.U64) << K.U64(58)) | (grams >> K.U64(6))
                short = np.argsort(place, kind="stable")[:keep]
                out.append((grams[short].view(np.int64), np.full(keep, cls), np.full(keep, n, np.int32), np.arange(keep, dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)

    return texts.select("text").mapInArrow(run, "gram long, cls long, n int, pos int")


def _bit_map(grams: np.ndarray) -> bytes:
    """A set as bits, two to four for each n-gram."""
    size = max(64, 1 << int(2 * len(grams) - 1).bit_length())
    flags = np.zeros(size, bool)
    flags[grams & K.U64(size - 1)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _sets_of(texts: DataFrame, wanted: DataFrame, width: int, encode=np.ndarray.tobytes) -> DataFrame:
    """``(cls, grams)`` of the documents in ``wanted(key, cls)``, encoded: a filter sized by their number first (a join beyond its bound), then an exact join."""
    texts, n = texts.select("key", "text"), wanted.count()
    if n > sketches.MOST_KEYS:
        texts, n = texts.join(wanted.select("key").distinct(), "key", "left_semi"), 0
    bits = texts.sparkSession.sparkContext.broadcast(sketches.bit_set(wanted, "key", sketches.bits_for(n)) if n else None)
    schema = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            keep = np.ones(len(keys), bool) if bits.value is None else sketches.in_bit_set(bits.value, keys.view(np.uint64), 8 * len(bits.value))
            keep = [i for i, k in zip(np.flatnonzero(keep), keys[keep].tolist(), strict=True) if k not in sent and not sent.add(k)]
            if len(sent) >= _HELD_CLASSES:  # rows that repeat id and text, sent again, cost only time
                sent.clear()
            for part in K.parts([batch.take(pa.array(keep, pa.int64()))], "text"):
                sets = list(shingle_sets(part.column("text"), width))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([_class_of(g) for g in sets], pa.int64()), pa.array([encode(g) for g in sets], pa.binary())], schema=schema)

    found = texts.mapInArrow(run, "key long, cls long, grams binary")
    return found.join(wanted, ["key", "cls"]).select("cls", "grams").dropDuplicates(["cls"])


def _pair_filter(pairs: DataFrame, sets: DataFrame, holds) -> DataFrame:
    """The pairs ``(a, b)`` for which ``holds(encoded a, encoded b)``; both joins can split a hot class."""
    left = sets.select(F.col("cls").alias("a"), F.col("grams").alias("of_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("grams").alias("of_b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [holds(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _linked(percent: int):
    """Probe one set's n-grams in the lists that hold the other, by binary search in the other's n-grams."""

    def holds(x, y) -> bool:
        x, y = np.frombuffer(x, K.U64), np.frombuffer(y, K.U64)
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    return holds


def _sized_map(grams: np.ndarray) -> bytes:
    return np.array([len(grams)], "<u8").tobytes() + _bit_map(grams)


def _may_link(percent: int):
    """Whether the bits leave room for the overlap: each bit of one set alone stands for an n-gram the other lacks."""

    def holds(x, y) -> bool:
        n, m = int(np.frombuffer(x, "<u8", 1)[0]), int(np.frombuffer(y, "<u8", 1)[0])
        x, y = np.frombuffer(x, np.uint8, offset=8), np.frombuffer(y, np.uint8, offset=8)
        size = min(len(x), len(y))
        x, y = (np.bitwise_or.reduce(v.reshape(-1, size)) if len(v) > size else v for v in (x, y))
        both = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
        return 100 * both >= percent * (n + m - both)

    return holds


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs that link, and the tables made on the way.

    Pairs first meet as bit maps, a twentieth of the sets' size, which rule
    most of them out; whole sets are built and moved only for the others.
    """
    made: list[DataFrame] = []
    for encode, holds in ((_sized_map, _may_link(percent)), (np.ndarray.tobytes, _linked(percent))):
        if pairs.isEmpty():
            break
        wanted = durable(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct().join(classes.select("cls", "id", "key"), "cls"))
        pairs = durable(_pair_filter(pairs, _sets_of(texts, wanted, width, encode), holds))
        made += [wanted, pairs]
    return pairs, made[:-1]


def _hits(percent: int, n: str) -> Column:
    """``short_hits`` of a set of ``n``."""
    return F.least(F.ceil(F.col(n).cast("long") * percent / F.lit(100) - 1e-9), F.lit(SHORT_HITS))


def _room(percent: int, n: str, pos: str, m: str, at: str, hits: Column | None = None) -> Column:
    """Whether sets of ``n`` and ``m`` that meet at places ``pos`` and ``at`` can still reach the overlap their sizes ask for.

    The place is that of their first shared n-gram, or of one of the first ``hits``.
    """
    n, pos, m, at = (F.col(c).cast("long") for c in (n, pos, m, at))
    least = F.ceil((n + m) * percent / F.lit(100 + percent) - 1e-9)
    return F.least(n - pos, m - at) >= (least if hits is None else least - hits + 1)


def _parity_room(percent: int, x: str, y: str) -> Column:
    """Whether the parities of two sets leave room for the overlap: their sets differ in as many n-grams at least as parities do."""
    n, m = (F.col(f"{side}.n").cast("long") for side in (x, y))
    least = F.ceil((n + m) * percent / F.lit(100 + percent) - 1e-9)
    differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in _PARITY), F.lit(0))
    return differ <= n + m - 2 * least


def _met(lists: DataFrame, label: DataFrame, classes: DataFrame, tried: DataFrame, percent: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Entries of lists with several components, and the pairs ``(a, b)`` of different ones that may link and aren't in ``tried``.

    Of the ``whole`` lists these are all such pairs; a part of the lists gives
    those that it shows to be likely.
    """
    marked = lists.join(label.withColumnRenamed("node", "cls"), "cls", "left").select("gram", "cls", "n", "pos", F.coalesce("component", "cls").alias("component"))
    open_lists = marked.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram")
    marked = durable(marked.join(open_lists, "gram", "left_semi").join(classes.select("cls", *_PARITY), "cls"))
    x, y = marked.alias("x"), marked.alias("y")
    asked = F.least(_hits(percent, "x.n"), _hits(percent, "y.n"))
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.component") != F.col("y.component")) & _room(percent, "x.n", "x.pos", "y.n", "y.pos", asked) & _parity_room(percent, "x", "y"))
    across = met.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(F.count("*").alias("hits"), *[F.min(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in ("n", "pos")])
    enough = F.least(_hits(percent, "x_n"), _hits(percent, "y_n")) if whole else F.lit(1)
    across = across.where(F.col("hits") >= enough).where(_room(percent, "x_n", "x_pos", "y_n", "y_pos"))
    return marked, durable(across.select("a", "b").join(tried, ["a", "b"], "left_anti"))


def linked_documents(documents: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id)`` for each row of ``documents``.

    ``class_id`` is the smallest id with the same set, ``component_id`` the
    smallest id reachable by links.
    """
    spark: SparkSession = documents.sparkSession
    texts = K.small_batches(documents).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("id", "text"))
    scanned = durable(_scan(texts, width))
    counts = sketches.gather(scanned.where("block is not null").select("block", "cells"), SKETCH_CELLS, "u4")
    levels = spark.sparkContext.broadcast(np.floor(np.log2(counts.astype(np.float64) + 1)).astype(np.uint8))
    docs = scanned.where("block is null").select("id", "key", "cls", "n", *_PARITY)
    classes = durable(docs.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.min("key").alias("key"), *[F.min(c).alias(c) for c in _PARITY]))  # a table, so that joins with it can split a hot class

    lists = _short_lists(texts, width, percent, levels).repartition("gram")  # one shuffle serves the counts and the lists
    leaders = lists.groupBy("gram").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.min(F.struct("pos", "cls", "n")).alias("leader")).where("low < high").select("gram", "leader")
    shared = durable(lists.join(leaders, "gram").select("gram", "cls", "n", "pos", "leader").distinct())

    to_leader = shared.where("cls <> leader.cls").where(_room(percent, "n", "pos", "leader.n", "leader.pos")).select(F.least("cls", "leader.cls").alias("a"), F.greatest("cls", "leader.cls").alias("b")).distinct()
    tried = durable(to_leader)
    first, sets_used = _links(tried, classes, texts, width, percent)
    links = first
    label = durable(connected_components(links, "a", "b"))

    # what links in every fourth list shares a component and is not met again in the search of all lists
    made = [tried, label]
    for lists_of, whole in ((shared.where(F.pmod("gram", F.lit(FIRST_LISTS)) == 0), False), (shared, True)):
        marked, across = _met(lists_of, label, classes, tried, percent, whole)
        more, more_sets = _links(across, classes, texts, width, percent)
        links, tried = links.unionByName(more), tried.unionByName(across)
        label = durable(connected_components(links, "a", "b"))
        made += [marked, across, more, *more_sets, label]

    named = durable(docs.select("id", "cls", "n").join(classes.select("cls", F.col("id").alias("class_id")), "cls", "left"))
    # the component of a class, then the smallest document id of the component
    groups = durable(label.withColumnRenamed("node", "cls").join(classes.select("cls", "id"), "cls"))
    lowest = groups.groupBy("component").agg(F.min("id").alias("component_id"))
    groups_named = groups.join(lowest, "component").select("cls", "component_id")
    out = named.join(groups_named, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "class_id", "id").alias("component_id")
    )
    out = durable(out)
    for used in (scanned, classes, shared, first, *sets_used, *made, named, groups):
        discard(used)
    return out


def one_per_group(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` without those whose component has a smaller id; rows keep all their columns.

    An id that repeats stays with all its rows if one of them is the first of
    its component. Rows without an id stay.
    """
    linked = linked_documents(documents, width, percent)
    first = durable(linked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).alias("first")))
    out = without_ids(documents, first.where("NOT first"))
    for used in (linked, first):
        discard(used)
    return out


def without_ids(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """``documents`` whose id is not in ``gone(doc_id)``.

    No row moves while the ids that go are ``sketches.MOST_KEYS`` at most, as bit
    sets decide exactly for every id that occurs; beyond that the table is joined.
    """
    spark = documents.sparkSession
    number = F.col("doc_id").cast("long")
    hashed = F.xxhash64(number).alias("h")
    listed = durable(gone.where("doc_id IS NOT NULL").select(hashed).distinct())
    if listed.count() > sketches.MOST_KEYS:
        return documents.join(listed, F.xxhash64(documents["doc_id"].cast("long")) == listed["h"], "left_anti")
    others = durable(documents.where("doc_id IS NOT NULL").select(hashed).distinct().join(listed, "h", "left_anti"))
    is_gone = sketches.member_column(spark, sketches.members(listed, others))
    for used in (listed, others):
        discard(used)
    return documents.where(number.isNull() | ~is_gone(F.xxhash64(number)))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group at 85 % Jaccard over 4-word shingles."""
    return linked_documents(read(spark, sf_dir, "documents"), 4, 85)
