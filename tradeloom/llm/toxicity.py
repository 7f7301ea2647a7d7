"""Non-negative positive-unlabelled learning of toxicity: a linear classifier in numpy over hashed words.

Only confirmed toxic texts count as labelled. All other text is unlabelled, as
much of it is toxic too, and the risk on it is corrected by the class prior p:
``p R(P, +) + max(0, R(U, -) - p R(P, -))`` with the sigmoid loss. When the
bracket turns negative the step goes up that part instead, which keeps a
flexible model from fitting the unlabelled rows away.

Features are the words of a text (runs of ASCII letters, digits and non-ASCII
bytes, A-Z lower-cased) and their first six and seven bytes, each counted
once a text. Those kept are at most ``MOST_FEATURES``, far more usual in toxic
texts than in all texts outside fold 0, which are all counted for it. The
numpy fit takes at most ``most_positive`` and ``most_unlabelled`` rows, none of
fold 0; the prior is the share of toxic rows among the labelled ones outside
fold 0. Features equally telling are taken in the order of their hashes.

Scoring takes whole texts. Null and empty texts have no features and get the
score of the bias; without toxic labels every text gets a low constant score.
Repeated rows are scored each, extra columns ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import labelled
from tradeloom.llm import text_kernel as K
from tradeloom.session import discard, durable, read

MOST_POSITIVE = 3000
MOST_UNLABELLED = 6000
MOST_FEATURES = 512
THRESHOLD = 0.5
_PREFIXES = (6, 7)
_WORD = ~K.SPACE
_WORD[:128] = False
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True


def features_of(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(row, feature)`` pairs, each once; ``wanted`` (sorted) keeps only those features."""
    data, offsets = K.buffer_of(texts)
    data = K.LOWER[data]
    starts, ends, first = K.spans(_WORD[data], offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    parts = [(row, K.hash_runs(data, starts, ends))]
    for size in _PREFIXES:
        long = ends - starts > size
        parts.append((row[long], K.mix(K.hash_runs(data, starts[long], starts[long] + size) + K.U64(size))))
    rows, found = (np.concatenate(x) for x in zip(*parts, strict=True))
    if wanted is not None:
        at = np.minimum(np.searchsorted(wanted, found), max(0, len(wanted) - 1))
        keep = wanted[at] == found if len(wanted) else np.zeros(len(found), bool)
        rows, found = rows[keep], at[keep]
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[new], found[new]


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        rows, found = features_of(texts, self.features)
        np.add.at(total, rows, self.weights[found])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def non_negative_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk estimate."""
    x = np.hstack([np.vstack([positive, unlabelled]), np.ones((len(positive) + len(unlabelled), 1), np.float32)]).astype(np.float32)
    n = len(positive)
    w = np.zeros(x.shape[1], np.float32)
    w[-1] = -2
    keep = np.ones_like(w)
    keep[-1] = 0
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = s * (1 - s)
        slope[:n] /= max(1, n)
        slope[n:] /= max(1, len(x) - n)
        if s[n:].mean() - prior * s[:n].mean() >= 0:
            slope[:n] *= -2 * prior
        else:
            slope[:n] *= prior
            slope[n:] *= -1
        grad = x.T @ slope + ridge * keep * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1].astype(float), float(w[-1])


def _usage(texts: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """``feature, n``: how many rows of ``texts`` have it, of those in ``wanted`` if given; under a null feature the rows."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, None if shared.value is None else np.zeros(len(shared.value), np.int64)
        for batch in batches:
            rows += batch.num_rows
            for a, b in K.slices(batch, "text"):
                _, found = features_of(batch.column("text").slice(a, b - a), shared.value)
                if total is not None:
                    total += np.bincount(found, minlength=len(total))
                    continue
                names, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], names=["feature", "n"])
        names = [None] if total is None else [*shared.value.view(np.int64), None]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([*(() if total is None else total), rows], pa.int64())], names=["feature", "n"])

    return texts.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> ToxicityModel:
    """Learn from the toxic rows of ``labels(doc_id, toxic)`` outside fold 0 and from unlabelled texts."""
    rows = labelled.learnable(labels, "toxic")
    known = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    nothing = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -3.0)
    if not known.get(1):
        return nothing
    prior = known[1] / sum(known.values())
    ids = documents.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").where(labelled.fold("id") != 0).distinct()
    positive = labelled.sample(rows.where("y = 1").select("id"), most_positive).withColumn("toxic", F.lit(1))
    others = labelled.sample(ids, most_unlabelled, 1).withColumn("toxic", F.lit(0))
    texts = K.small_batches(documents).select(F.col("doc_id").cast("long").alias("id"), "text")
    picked = texts.join(F.broadcast(positive.unionByName(others)), "id")  # its bound: the two limits
    held = durable(labelled.one_text(picked, "toxic").select("toxic", "text"))

    sizes = {r.toxic: r.n for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not (n_p and n_u):
        return nothing
    usual = _usage(held.where("toxic = 1")).where("n >= 3 AND feature IS NOT NULL").collect()  # of the bounded sample
    told = np.sort(np.array([r.feature for r in usual], np.int64).view(np.uint64))
    everywhere = {r.feature: r.n for r in _usage(texts.where("id is not null").where(labelled.fold("id") != 0), told).collect()}
    n_all = everywhere.get(None, 0)
    ranked = []
    for r in usual:
        u = everywhere.get(r.feature, 0)
        a, b = r.n / n_p, u / n_all
        z = (a - b) / math.sqrt((r.n + 1) / n_p**2 + (u + 1) / n_all**2)
        if z >= 2.5 and a >= 1.5 * b:
            ranked.append((-z, r.feature))
    features = np.sort(np.array([f for _, f in sorted(ranked)[:MOST_FEATURES]], np.int64).view(np.uint64))
    if not len(features):
        return nothing
    shared = documents.sparkSession.sparkContext.broadcast(features)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = features_of(batch.column("text"), shared.value)
            cuts = np.searchsorted(at, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists], names=["toxic", "found"])

    x = {0: [], 1: []}
    for r in held.mapInArrow(rows_of, "toxic int, found array<int>").collect():
        line = np.zeros(len(features), np.float32)
        line[r.found] = 1
        x[r.toxic].append(line)
    discard(held)
    weights, bias = non_negative_fit(np.array(x[1]), np.array(x[0]), prior)
    return ToxicityModel(features, weights, bias)


def score_documents(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``documents(doc_id, text)``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch, "text"):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(part.column("text")))], schema=schema)

    scored = K.small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    documents = read(spark, sf_dir, "documents")
    scored = score_documents(documents, fit(documents, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (labelled.fold() == 0).alias("held_out"), "score", "predicted")
