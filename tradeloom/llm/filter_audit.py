"""How filters interact: what each removes, in every order of applying them.

Each document becomes a mask of the filters it fails, and each part of the
corpus (a source, say) its counts by mask. A Gray-code walk then passes through
all subsets of the filters, one switched on or off at a step: it keeps for each
mask the number of active filters that it fails, and the running survivors, and
stores these for every subset. What a filter removes after others in any order
is the difference of two stored states, so the documents are read once however
many orders are asked for.

A document repeats another if its text is that of a row with a smaller id, in
any part, whatever becomes of that row. Texts are compared by SHA-256, and null
text is empty text.

Rows are counted as they stand: rows that repeat an id count each, and don't
repeat each other. A null id is never smaller than another nor larger. A null
part is the empty string. A document is good or toxic if any row of its labels
says so; without a label or an id it is neither. Extra columns are ignored. Without
documents there are no parts and no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.session import discard, durable, read

Filter = Callable[[Column], Column]
REPEATS = "E"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def too_short(least: int) -> Filter:
    """Fewer than ``least`` words."""
    return lambda text: F.size(_words(text)) < least


def too_repetitive(percent: int) -> Filter:
    """Distinct words are fewer than ``percent`` of the words."""
    return lambda text: 100 * F.size(F.array_distinct(_words(text))) < percent * F.size(_words(text))


def too_loud(percent: int) -> Filter:
    """Capitals A-Z are more than ``percent`` of the characters."""
    return lambda text: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > percent * F.length(text)


def holds_any(pattern: str) -> Filter:
    return lambda text: text.rlike(pattern)


#: The filters of the registered query, by letter; ``REPEATS`` is the fifth.
FILTERS: dict[str, Filter] = {"A": too_short(50), "B": too_repetitive(65), "C": too_loud(5), "D": holds_any("[#$%&*|]")}


def failures(documents: DataFrame, labels: DataFrame, filters: dict[str, Filter] = FILTERS, part_col: str = "source") -> DataFrame:
    """``(part, mask, n, good, toxic)``: the rows of each part by the filters that they fail.

    Bit k of ``mask`` is the k-th filter, the bit after the last says that the
    text repeats. Texts are read once; ids, flags and digests move. Both joins
    are between plain tables, so that a text with very many copies is split.
    """
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(f(text), 1 << k).otherwise(0) for k, f in enumerate(filters.values())]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    marks = documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    marks = durable(marks)
    several = durable(marks.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    said = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).cast("long").alias(f"is_{c}")
    known = durable(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(said("quality"), said("toxic")))
    repeats = F.when(F.col("id") > F.col("first"), 1 << len(filters)).otherwise(0)
    every = marks.join(several, "digest", "left").join(known, "id", "left")
    counted = every.groupBy("part", (F.col("mask") + repeats).alias("mask")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"is_{c}"), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    counted = durable(counted)
    for used in (marks, several, known):
        discard(used)
    return counted


def gray_states(cells: np.ndarray) -> np.ndarray:
    """The survivors of every subset of filters, ``(parts, subsets, figures)``, from ``cells (parts, masks, figures)``.

    One filter is switched at a step, by the reflected Gray code. ``active``
    counts for each mask the active filters it fails; a mask's rows leave when
    its count becomes one and come back when it becomes none again.
    """
    size = cells.shape[1]
    masks = np.arange(size)
    active = np.zeros(size, np.int64)
    alive = cells.sum(1)
    out = np.zeros_like(cells)
    out[:, 0] = alive
    subset = 0
    for step in range(1, size):
        bit = (step & -step).bit_length() - 1
        hit = (masks >> bit & 1).astype(bool)
        subset ^= 1 << bit
        if subset >> bit & 1:
            alive = alive - cells[:, hit & (active == 0)].sum(1)
            active[hit] += 1
        else:
            active[hit] -= 1
            alive = alive + cells[:, hit & (active == 0)].sum(1)
        out[:, subset] = alive
    return out


def by_order(states: np.ndarray, cells: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Figures of each ``(part, order, step)`` as differences of stored states; orders as :func:`itertools.permutations` gives them."""
    orders = np.array(list(permutations(range(filters))))
    after = np.cumsum(1 << orders, axis=1)
    lost = states[:, after - (1 << orders)] - states[:, after]
    masks = np.arange(1 << filters)
    fails = np.stack([cells[:, (masks >> k & 1).astype(bool), 0].sum(1) for k in range(filters)], 1)
    alone = np.stack([cells[:, 1 << k, 0] for k in range(filters)], 1)
    removed = lost[..., 0]
    shapley = np.stack([removed[:, orders == k].sum(1) for k in range(filters)], 1)
    return {
        "kept": states[:, after, 0], "removed": removed, "redundant": fails[:, orders] - removed, "unique_fails": alone[:, orders],
        "good_lost": lost[..., 1], "toxic_lost": lost[..., 2], "shapley": shapley[:, orders],
    }


_FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` for every order of ``letters``.

    ``counted`` is the result of :func:`failures`. A part brings one row of at
    most ``2 ** len(letters)`` counts to one task.
    """
    k = len(letters)
    names = ["".join(o) for o in permutations(letters)]
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in _FIGURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells = np.zeros((1, 1 << k, 3), np.int64)
                for c in row["cells"]:
                    cells[0, c["mask"]] = c["n"], c["good"], c["toxic"]
                figures = by_order(gray_states(cells), cells, k)
                lead = [pa.array([row["part"]] * (len(names) * k)), pa.array(np.repeat(names, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(names)))]
                yield pa.RecordBatch.from_arrays([*lead, *[pa.array(figures[c].ravel()) for c in _FIGURES]], schema=schema)

    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _FIGURES))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in all 120 orders."""
    counted = failures(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), read(spark, sf_dir, "labels"))
    return interactions(counted, "".join(FILTERS) + REPEATS)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS e
  FROM w
),
k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN k USING (doc_id) GROUP BY ALL
),
letters AS (SELECT unnest(range(5)) AS x),
orders AS (
  SELECT [o1.x, o2.x, o3.x, o4.x, o5.x] AS o FROM letters o1, letters o2, letters o3, letters o4, letters o5
  WHERE len(list_distinct([o1.x, o2.x, o3.x, o4.x, o5.x])) = 5
),
steps AS (
  SELECT list_reduce(list_transform(o, lambda v: substr('ABCDE', v::INT + 1, 1)), lambda p, q: p || q) AS filter_order, s.step, (1 << o[s.step]::INT) AS own,
    list_sum(list_transform(o[:s.step], lambda v: 1 << v::INT))::INT AS after
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
),
figures AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (WHERE mask & after = 0) AS kept,
    sum(n) FILTER (WHERE mask & own <> 0 AND mask & (after - own) = 0) AS removed,
    sum(n) FILTER (WHERE mask & own <> 0 AND mask & (after - own) <> 0) AS redundant,
    sum(n) FILTER (WHERE mask = own) AS unique_fails,
    sum(good) FILTER (WHERE mask & own <> 0 AND mask & (after - own) = 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & (after - own) = 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM figures
"""
