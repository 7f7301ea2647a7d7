"""Nearest vectors of a batch of queries: exactly, block by block, or through an index of lists with its recall measured."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tradeloom.session import discard, durable

#: Queries of a block, which every task of the catalog gets.
BLOCK = 1024
#: Vectors that the lists of an index are fitted on.
SAMPLE = 20_000
#: Vectors of a list, and queries that look into it, which meet in one task.
PIECE = 4096
ASKING = 2048
#: Scores have six decimals; what lies below another by more than this doesn't round to it.
_HALF_STEP = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an array column at length 1; null, empty and zero vectors are rows of nan."""
    if not pa.types.is_list(column.type):
        column = column.cast(pa.list_(pa.float64()))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dim = int(sizes.max(initial=0))
    whole = (sizes == dim) & (dim > 0)
    values = column.flatten().to_numpy(zero_copy_only=False)[np.repeat(whole, sizes)]
    out = np.full((len(column), dim), np.nan)
    out[whole] = values.reshape(-1, dim) if dim else 0
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.full_like(out, np.nan), where=norm > 0)


def _plain(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column of arrays of one length."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cut(scored: DataFrame, pool: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "code")
    return scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= pool)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


class _Best:
    """The ``pool`` best codes of each of so many queries; ties by code."""

    def __init__(self, queries: int, pool: int):
        self.pool, self.least = pool, np.full(queries, -np.inf)
        self.at, self.scores, self.codes = np.zeros(0, np.int64), np.zeros(0), None
        self.last = np.zeros(queries, np.int64)  # where the last of a full pool stands

    def add(self, sims: np.ndarray, codes: np.ndarray) -> None:
        """Take in ``sims`` (queries x codes), of which those that are nan don't count."""
        sims = np.where(np.isnan(sims), -np.inf, sims)
        floor = self.least - _HALF_STEP
        new = np.flatnonzero(np.isinf(self.least))
        if len(new) and sims.shape[1] > self.pool:
            place = sims.shape[1] - self.pool
            floor[new] = np.partition(sims[new], place, axis=1)[:, place] - _HALF_STEP
        at, col = np.nonzero((sims >= floor[:, None]) & (sims > -np.inf))
        scores, named = np.round(sims[at, col], 6), codes[col]
        if self.codes is not None:
            tied = np.flatnonzero(scores <= self.least[at])
            behind = tied[(scores[tied] < self.least[at[tied]]) | (named[tied] > self.codes[self.last[at[tied]]])]
            at, scores, named = np.delete(at, behind), np.delete(scores, behind), np.delete(named, behind)
            at, scores, named = np.concatenate([self.at, at]), np.concatenate([self.scores, scores]), np.concatenate([self.codes, named])
        order = np.lexsort((named, -scores, at))
        at, scores, named = at[order], scores[order], named[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.pool
        self.at, self.scores, self.codes = at[kept], scores[kept], named[kept]
        last = np.flatnonzero(place[kept] == self.pool - 1)
        self.least[self.at[last]], self.last[self.at[last]] = self.scores[last], last


def exact(queries: DataFrame, catalog: DataFrame, pool: int = 50, block: int = BLOCK) -> DataFrame:
    """``(query_id, code, score, rk)``: the ``pool`` nearest of ``catalog(code, vec)`` for ``queries(query_id, vec)`` by cosine, rounded to 6 digits.

    Queries go block by block, so what the tasks of the catalog get is bounded;
    a task keeps the best of each query and sends no more than these. Missing
    and zero vectors, and those of another length, have no neighbours.
    """
    spark = queries.sparkSession
    asked = durable(queries.select("query_id", "vec").withColumn("_at", F.monotonically_increasing_id()))
    base = durable(catalog.select("code", "vec").repartition(spark.sparkContext.defaultParallelism, "code"))
    kinds = dict(asked.dtypes)["query_id"], dict(base.dtypes)["code"]
    id_type = to_arrow_type(asked.schema["query_id"].dataType)
    found: list[DataFrame] = []
    for rows in _blocks(asked, block):
        ids, mine = [r.query_id for r in rows], spark.sparkContext.broadcast(_matrix(pa.array([r.vec for r in rows])))

        def run(batches: Iterator[pa.RecordBatch], ids=ids, mine=mine) -> Iterator[pa.RecordBatch]:
            best, code_type = _Best(len(ids), pool), None
            for batch in batches:
                theirs, code_type = _matrix(batch.column("vec")), batch.column("code").type
                if theirs.shape[1] == mine.value.shape[1]:
                    best.add(mine.value @ theirs.T, np.array(batch.column("code").to_pylist()))
            if len(best.at):
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in best.at], id_type), pa.array(best.codes.tolist(), code_type), pa.array(best.scores)], names=["query_id", "code", "score"])

        found.append(base.mapInArrow(run, f"query_id {kinds[0]}, code {kinds[1]}, score double"))
    if not found:
        return _cut(asked.select("query_id").limit(0).crossJoin(base.select("code").limit(0)).withColumn("score", F.lit(0.0)), pool)
    parts = [durable(_cut(part, pool)) for part in found]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    discard(asked)
    discard(base)
    return out


def _blocks(asked: DataFrame, block: int) -> Iterator[list]:
    """Bounded blocks of rows, fetched partition by partition."""
    rows: list = []
    for r in asked.drop("_at").toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            yield rows
            rows = []
    if rows:
        yield rows


def fit_lists(catalog: DataFrame, lists: int, rounds: int = 12, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centres of ``lists`` lists, by spherical k-means on at most ``sample`` vectors, chosen by a hash of their code."""
    rows = catalog.where("vec IS NOT NULL").orderBy(F.xxhash64("code"), "code").limit(sample).select("vec").collect()  # bounded by ``sample``
    x = _matrix(pa.array([r.vec for r in rows], pa.list_(pa.float64())))
    x = x[~np.isnan(x).any(1)]
    centres = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _assigned(rows: DataFrame, key: str, centres: np.ndarray, probes: int) -> DataFrame:
    """``(key, vec, list, nth)``: the ``probes`` nearest lists of each vector, nearest first from 0; vectors at length 1."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            if x.shape[1] != held.value.shape[1]:
                continue
            fine = np.flatnonzero(~np.isnan(x).any(1))
            near = np.argsort(-(x[fine] @ held.value.T), axis=1, kind="stable")[:, :probes]
            at = np.repeat(fine, near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), _lists(x[at]), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(near.shape[1], dtype=np.int32), len(fine)))], names=[key, "vec", "list", "nth"])

    return rows.select(key, "vec").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, vec array<double>, list int, nth int")


def _probes_for(index: DataFrame, queries: DataFrame, catalog: DataFrame, pool: int, centres: np.ndarray, least: float) -> int:
    """The fewest lists in which ``least`` of the true neighbours of at most ``BLOCK`` queries stand."""
    some = durable(queries.where("vec IS NOT NULL").orderBy(F.xxhash64("query_id"), "query_id").limit(BLOCK))
    asked = _assigned(some, "query_id", centres, len(centres)).select("query_id", "list", "nth")
    true = exact(some, catalog, pool).select("query_id", "code").join(index.select("code", "list"), "code").join(asked, ["query_id", "list"])
    counts = true.groupBy("nth").agg(F.count("*").alias("n")).orderBy("nth").collect()  # a row for each list
    wanted, met = least * sum(r.n for r in counts), 0
    for r in counts:
        met += r.n
        if met >= wanted:
            return r.nth + 1
    return len(centres)


def by_lists(queries: DataFrame, catalog: DataFrame, pool: int = 50, lists: int = 64, probes: int | None = None, sample: int = SAMPLE, least: float = 0.9) -> DataFrame:
    """As :func:`exact`, through an index of lists: every vector of the catalog is in one, a query looks into ``probes`` of them.

    Only the centres are fitted on a sample; they are ``lists`` vectors, which
    every task gets. Without ``probes`` their number follows from the recall
    ``least``, measured against the exact neighbours of a block of queries.
    A list's vectors and the queries that look into it meet piece by piece; of
    a piece each query sends its best.
    """
    centres = fit_lists(catalog, lists, sample=sample)
    index = durable(_assigned(catalog, "code", centres, 1))
    probes = probes or _probes_for(index, queries, catalog, pool, centres, least)
    asked = durable(_assigned(queries, "query_id", centres, probes).withColumnRenamed("vec", "q").drop("nth"))
    count = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    parts = durable(count(index, PIECE, "pieces").join(count(asked, ASKING, "turns"), "list"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    theirs = index.drop("nth").join(parts, "list").select("list", one("code", "pieces").alias("piece"), every("turns").alias("turn"), "code", "vec")
    mine = asked.join(parts, "list").select("list", every("pieces").alias("piece"), one("query_id", "turns").alias("turn"), "query_id", "q")
    kinds = dict(asked.dtypes)["query_id"], dict(index.dtypes)["code"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, codes = left.column("query_id").combine_chunks(), right.column("code").combine_chunks()
        best = _Best(len(ids), pool)
        if len(ids) and len(codes):
            best.add(_plain(left.column("q")) @ _plain(right.column("vec")).T, np.array(codes.to_pylist()))
        named = [] if best.codes is None else best.codes.tolist()
        return pa.table({"query_id": ids.take(pa.array(best.at)), "code": pa.array(named, codes.type), "score": pa.array(best.scores)})

    keys = "list", "piece", "turn"
    met = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(meet, f"query_id {kinds[0]}, code {kinds[1]}, score double")
    out = durable(_cut(met, pool))
    for used in (index, asked, parts):
        discard(used)
    return out


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``recall``: the share of the true neighbours that were found."""
    both = truth.select("query_id", "code").join(found.select("query_id", "code").withColumn("hit", F.lit(1)), ["query_id", "code"], "left")
    return both.agg((F.count("hit") / F.count("*")).alias("recall"))
