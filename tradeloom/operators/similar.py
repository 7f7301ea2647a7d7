"""The best sets of each query by shared elements.

Blocks of the catalog meet pieces of the queries, both of bounded size, and a
task puts out ``pool`` sets a query at most, so no pair of sets is ever a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tradeloom.session import discard, durable

#: Scores have six decimals; a bound lies below all scores that round to it.
_HALF_STEP = 1e-6
#: Scores as whole numbers: halves go up, as in SQL.
_STEPS = 1e6
#: Sets of a block, and queries of a piece, that meet in one task.
SETS = 1 << 15
ASKING = 1 << 16


def _positions(sets: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``(key, size, els, el, n, pos)``: the elements of each set from the rarest on, ``pos`` from 1, those that ``counts`` has.

    ``size`` counts all elements of the set, ``els`` are those in ``counts``.
    """
    rows = sets.select(key, F.size("els").alias("size"), F.explode("els").alias("el")).join(counts, "el")
    listed = rows.groupBy(key, "size").agg(F.array_sort(F.collect_list(F.struct("n", "el"))).alias("l"))
    return listed.select(key, "size", F.transform("l", lambda x: x.el).alias("els"), F.posexplode("l").alias("at", "x")).select(key, "size", "els", "x.el", "x.n", (F.col("at") + 1).alias("pos"))


def _scored(pairs: DataFrame, pool: int) -> DataFrame:
    shared = F.size(F.array_intersect("q_els", "c_els"))
    x = pairs.select("query_id", "code", F.round(shared / (F.col("nq") + F.col("nc") - shared), 6).alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "code")
    return x.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= pool)


def candidates(queries: DataFrame, catalog: DataFrame, pool: int) -> tuple[DataFrame, DataFrame]:
    """The distinct pairs that may be among the ``pool`` nearest, with both sets, and the queries' bounds; durable tables.

    A way by joins for sets that share few elements; :func:`nearest_sets` takes any.

    First each query meets only the lists of its rarest elements, as many as
    hold ``2 * pool`` entries together. Its ``pool``-th best score among these
    is a bound: what is to enter the pool reaches it. Two sets whose similarity
    reaches a bound ``t`` share one of the ``n - ceil(t n) + 1`` rarest elements
    of either set of ``n``, and their sizes differ by the factor ``t`` at most;
    only such pairs are met then. A query whose first lists don't fill its
    pool has the bound 0 and meets every set that shares an element.
    """
    wanted = queries.select(F.explode("els").alias("el")).distinct()
    entries = catalog.select("code", F.explode("els").alias("el"))
    counts = durable(entries.join(wanted, "el", "left_semi").groupBy("el").agg(F.count("*").alias("n")))
    q = durable(_positions(queries, "query_id", counts))
    c = durable(_positions(catalog, "code", counts))
    left = q.select("query_id", F.col("size").alias("nq"), F.size("els").alias("mq"), F.col("els").alias("q_els"), "el", "n", F.col("pos").alias("q_pos"))
    right = c.select("code", F.col("size").alias("nc"), F.size("els").alias("mc"), F.col("els").alias("c_els"), "el", F.col("pos").alias("c_pos"))
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("q_pos").rowsBetween(Window.unboundedPreceding, -1))
    rare = left.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 2 * pool)
    first = rare.join(right, "el").select("query_id", "code", "nq", "nc", "q_els", "c_els").dropDuplicates(["query_id", "code"])
    worst = _scored(first, pool).where(F.col("rk") == pool).select("query_id", (F.col("score") - _HALF_STEP).alias("bound"))
    bounds = durable(queries.select("query_id").join(worst, "query_id", "left").na.fill(0.0, ["bound"]))
    t = F.col("bound")
    # elements outside the other side are no part of an overlap: they shorten the list, not the overlap asked for
    reach = lambda listed, size: F.col(listed) - F.greatest(F.lit(1), F.ceil(F.col(size) * t)).cast("int") + 1
    mine = left.join(bounds, "query_id").where(F.col("q_pos") <= reach("mq", "nq"))
    sized = (F.col("nc") >= F.col("nq") * t) & (F.col("nc") * t <= F.col("nq"))
    pairs = durable(mine.join(right, "el").where((F.col("c_pos") <= reach("mc", "nc")) & sized).select("query_id", "code", "nq", "nc", "q_els", "c_els").dropDuplicates(["query_id", "code"]))
    for used in (counts, q, c):
        discard(used)
    return pairs, bounds


class _Lists:
    """The sets of a block by their elements; sets in order of their codes."""

    def __init__(self, table: pa.Table, weighted: bool):
        table = table.take(pc.sort_indices(table.column("code")))
        self.codes, els = table.column("code").combine_chunks(), table.column("els").combine_chunks()
        self.sizes, named = els.value_lengths().to_numpy(zero_copy_only=False), els.flatten().dictionary_encode()
        self.words, ids = named.dictionary, named.indices.to_numpy()
        order = np.argsort(ids, kind="stable")
        self.holders = np.repeat(np.arange(len(self.codes), dtype=np.int32), self.sizes)[order]
        self.starts = np.searchsorted(ids[order], np.arange(len(self.words) + 1))
        self.weights = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)[order] if weighted else None

    def scores(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets that have one of ``words``, and their scores in steps: sums of weights, or Jaccard similarities to a set of ``size``."""
        lists = [slice(self.starts[w], self.starts[w + 1]) for w in words]
        holders = np.concatenate([self.holders[x] for x in lists])
        shared = np.bincount(holders, minlength=len(self.codes))
        found = np.flatnonzero(shared)
        if self.weights is None:
            n = shared[found]
            score = n / (size + self.sizes[found] - n)
        else:
            score = np.bincount(holders, np.concatenate([self.weights[x] for x in lists]), len(self.codes))[found]
        return found, np.floor(score * _STEPS + 0.5).astype(np.int64)


def _best_of_block(asked: pa.Table, sets: pa.Table, pool: int, weighted: bool, schema: pa.Schema) -> pa.Table:
    """``(query_id, code, steps)``: the ``pool`` best sets of each query in a block, those that reach the query's bound (``least``, ``last``)."""
    at, of, steps = [], [], []
    if asked.num_rows and sets.num_rows:
        block = _Lists(sets, weighted)
        els = asked.column("els").combine_chunks()
        sizes = els.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = pc.index_in(els.flatten(), value_set=block.words).fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        least = asked.column("least").fill_null(np.iinfo(np.int64).min if weighted else 1).to_numpy()  # similar sets score above 0
        named = pa.chunked_array([block.codes, *asked.column("last").chunks])
        rank = pc.rank(named, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
        places = np.searchsorted(rank[: len(block.codes)], rank[len(block.codes) :], "right")  # sets that a tie at the bound lets in
        for q in range(len(sizes)):
            own = words[ends[q] - sizes[q] : ends[q]]
            own = own[own >= 0]
            if not len(own):
                continue
            found, score = block.scores(own, sizes[q])
            keep = (score > least[q]) | ((score == least[q]) & (found < places[q]))
            found, score = found[keep], score[keep]
            if len(found) > pool:
                best = np.argpartition(found - score * len(block.codes), pool - 1)[:pool]
                found, score = found[best], score[best]
            at.append(np.full(len(found), q))
            of.append(found)
            steps.append(score)
    if not at:
        return schema.empty_table()
    ids, codes = asked.column("query_id").combine_chunks().take(pa.array(np.concatenate(at))), block.codes.take(pa.array(np.concatenate(of)))
    return pa.table([ids, codes, pa.array(np.concatenate(steps), pa.int64())], schema=schema)


def _best(queries: DataFrame, catalog: DataFrame, pool: int, weighted: bool) -> DataFrame:
    """``(query_id, code, score, rk)`` of ``queries(query_id, els)`` and ``catalog(code, els[, weights])``, a durable table.

    Where the catalog has many blocks, a query first meets the root of their
    number; its ``pool``-th set there is a bound that the other blocks hold
    against. So rows put out grow with the root, not the number, of blocks.
    """
    queries, catalog = queries.where("query_id IS NOT NULL"), catalog.where("code IS NOT NULL")
    blocks, pieces = (max(1, math.ceil(df.count() / n)) for df, n in ((catalog, SETS), (queries, ASKING)))
    types = dict(queries.dtypes) | dict(catalog.dtypes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sets = catalog.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")).withColumn("piece", every(pieces))
    asked = queries.withColumn("piece", F.pmod(F.xxhash64("query_id"), F.lit(pieces)).cast("int"))
    best = Window.partitionBy("query_id").orderBy(F.desc("steps"), "code")

    def met(asked: DataFrame, n: int) -> DataFrame:
        """The best sets of the first ``n`` blocks, each query's in order."""
        one = asked.withColumn("block", every(n)).groupBy("block", "piece")
        other = sets.where(F.col("block") < n).groupBy("block", "piece")
        schema = f"query_id {types['query_id']}, code {types['code']}, steps bigint"
        arrow = to_arrow_schema(StructType.fromDDL(schema))
        found = one.cogroup(other).applyInArrow(lambda a, s: _best_of_block(a, s, pool, weighted, arrow), schema)
        return found.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= pool)

    free = asked.withColumns({"least": F.lit(None).cast("long"), "last": F.lit(None).cast(types["code"])})
    first = math.isqrt(blocks - 1) + 1
    if blocks > 4:
        bounds = durable(met(free, first).where(F.col("rk") == pool).select("query_id", F.col("steps").alias("least"), F.col("code").alias("last")))
        free = asked.join(bounds, "query_id", "left")
    found = durable(met(free, blocks).select("query_id", "code", (F.col("steps") / _STEPS).alias("score"), "rk"))
    if blocks > 4:
        discard(bounds)
    return found


def nearest_sets(queries: DataFrame, catalog: DataFrame, pool: int) -> DataFrame:
    """``(query_id, code, score, rk)``: the ``pool`` sets of greatest Jaccard similarity to each query, ties by code.

    ``queries(query_id, els)`` and ``catalog(code, els)`` hold arrays of
    distinct elements, one row a key. Sets that share nothing don't appear, nor
    do null keys. The result is that of all pairs.
    """
    return _best(queries.select("query_id", "els"), catalog.select("code", "els"), pool, False)


def heaviest_sets(queries: DataFrame, catalog: DataFrame, pool: int) -> DataFrame:
    """``(query_id, code, score, rk)``: the ``pool`` sets of ``catalog(code, els, weights)`` whose shared elements weigh most, ties by code.

    An element's weight stands at its place in ``weights``. Otherwise as :func:`nearest_sets`.
    """
    return _best(queries.select("query_id", "els"), catalog.select("code", "els", "weights"), pool, True)


def classes(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(code, content)`` of one content as a class that the least code stands for: members and classes.

    Members are ``(code, class, place, n)``, the ``most`` smallest codes of each
    class with their places from 1 and their number; classes are ``(code,
    content)``. Codes must be distinct.
    """
    w = Window.partitionBy("content").orderBy("code")
    first = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    every = Window.partitionBy("content")
    held = durable(first.select("code", F.min("code").over(every).alias("class"), "place", F.count("*").over(every).alias("n"), "content"))
    return held.drop("content"), held.where("place = 1").select("code", "content")


def by_member(hits: DataFrame, members: DataFrame, pool: int) -> DataFrame:
    """The ``pool`` best codes of each query, ties by code, from the ``pool`` best classes (ties by the least codes).

    A class that stands behind so many has so many codes before its own. Of a
    class so many of its smallest codes are taken as the better classes leave.
    """
    sized = hits.select("query_id", F.col("code").alias("class"), "score").join(members.where("place = 1").select("class", "n"), "class")
    tied = Window.partitionBy("query_id", "score")
    until = Window.partitionBy("query_id").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    left = sized.withColumn("room", pool - (F.sum("n").over(until) - F.sum("n").over(tied))).where("room > 0")
    pairs = left.drop("n").join(members.drop("n"), "class").where("place <= room")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "code")
    return pairs.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= pool).select("query_id", "code", "score", "rk")


def filled(hits: DataFrame, queries: DataFrame, catalog: DataFrame, pool: int) -> DataFrame:
    """``hits`` where each query has ``pool`` rows: the smallest codes of the catalog that it didn't hit follow with score 0.

    A query lacks less than ``pool`` rows and hits less than ``pool`` codes, so
    the ``2 * pool`` smallest codes are enough for all of them.
    """
    short = queries.select("query_id").distinct().join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").na.fill(0, ["n"]).where(F.col("n") < pool)
    least = catalog.select("code").where("code IS NOT NULL").distinct().orderBy("code").limit(2 * pool)
    more = short.join(F.broadcast(least), F.lit(True)).join(hits.select("query_id", "code"), ["query_id", "code"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("code")
    more = more.withColumn("rk", F.col("n").cast("int") + F.row_number().over(w)).where(F.col("rk") <= pool)
    return hits.unionByName(more.select("query_id", "code", F.lit(0.0).alias("score"), "rk"))
