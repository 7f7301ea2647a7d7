"""Compression classifier: two zstandard dictionaries, one of good and one of bad text, and a calibrated score.

Texts are compressed block by block with either dictionary. The difference of
the compressed sizes over their sum says which dictionary's text it resembles;
the size per byte, as a whole and of the most repetitive block, says how much
it repeats itself. A logistic curve over these and the length, fitted on
labelled rows that are in neither dictionary, turns them into the probability
of a good text.

Fitting takes at most ``most_rows`` labelled rows of each class, half for the
dictionaries (three blocks of each text at most), half for the curve; rows of
fold 0 are never used. Scoring takes whole texts. Null and empty texts get the
score of zero bytes. Without rows of both classes every score is the share of
good ones (0.5 without labels). Repeated rows are scored each, extra columns
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import labelled
from tradeloom.llm import text_kernel as K
from tradeloom.session import discard, durable, read

#: Labelled rows of each class that a fit takes at most.
MOST_ROWS = 3000
BLOCK_BYTES = 4096
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
THRESHOLD = 0.3


def _blocks(raw: bytes, size: int) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)] or [b""]


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself serves
        return b"".join(samples)[-DICTIONARY_BYTES:]


class _Sizes:
    """Compressed sizes with one dictionary."""

    def __init__(self, raw: bytes):
        import zstandard

        held = zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None
        if held is not None:
            held.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def __call__(self, blocks: list[bytes]) -> list[int]:
        return [len(self.compress(b)) for b in blocks]


@dataclass
class QualityModel:
    good: bytes = b""
    bad: bytes = b""
    prior: float = 0.5
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    _held: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_held": None}  # compressors stay in their process

    def features(self, raw: bytes) -> list[float]:
        if self._held is None:
            self._held = (_Sizes(self.good), _Sizes(self.bad))
        blocks = _blocks(raw, BLOCK_BYTES)
        good, bad = self._held[0](blocks), self._held[1](blocks)
        g, b = sum(good), sum(bad)
        least = min(min(x, y) / max(1, len(z)) for x, y, z in zip(good, bad, blocks, strict=True))
        return [(b - g) / (b + g), math.log(min((b + g) / (2 * max(1, len(raw))), 1.5) + 0.02), math.log(min(least, 1.5) + 0.02), math.log(len(raw) + 20)]

    @staticmethod
    def _terms(x: np.ndarray) -> np.ndarray:
        return np.hstack([x] + [x[:, [i]] * x[:, [j]] for i in range(x.shape[1]) for j in range(i, x.shape[1])])

    def fit_curve(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Ridge logistic regression by Newton's method."""
        terms = self._terms(x)
        self.centre, self.scale = terms.mean(0), terms.std(0) + 1e-9
        a = np.hstack([(terms - self.centre) / self.scale, np.ones((len(x), 1))])
        w, ridge = np.zeros(a.shape[1]), 0.05 * np.eye(a.shape[1])
        ridge[-1, -1] = 1e-6
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        a = np.hstack([(self._terms(x) - self.centre) / self.scale, np.ones((len(x), 1))])
        return 1 / (1 + np.exp(-np.clip(a @ self.weights, -30, 30)))


def _features_of(texts: DataFrame, model: QualityModel) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("rank", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.features((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], schema=schema)

    return K.small_batches(texts).select("rank", "y", "text").mapInArrow(run, "rank long, y int, x array<double>")


def fit(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> QualityModel:
    """Learn from ``labels(doc_id, quality)`` outside fold 0 and the texts of ``documents(doc_id, text)``."""
    rows = labelled.learnable(labels, "quality")
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = QualityModel(prior=counts.get(1, 0) / sum(counts.values()) if counts else 0.5)
    if not (counts.get(0) and counts.get(1)):
        return model
    picked = labelled.sample(rows.where("y = 0"), most_rows).unionByName(labelled.sample(rows.where("y = 1"), most_rows))
    picked = picked.withColumn("rank", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)))  # half for the dictionaries, half for the curve
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null")
    held = durable(labelled.one_text(texts.join(F.broadcast(picked), "id"), "y", "rank"))  # the bound on its rows is the limit above
    schema = pa.schema([("y", pa.int32()), ("block", pa.binary())])

    def some_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, out = [], []
            for label, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                blocks = _blocks(text.encode(), BLOCK_BYTES // 2)
                for b in blocks if len(blocks) <= 3 else (blocks[0], blocks[len(blocks) // 2], blocks[-1]):
                    y.append(label)
                    out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(out, pa.binary())], schema=schema)

    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for r in held.where("rank = 0").orderBy(F.xxhash64("id"), "id").select("y", "text").mapInArrow(some_blocks, "y int, block binary").toLocalIterator():
        samples[r.y].append(bytes(r.block))
    if samples[0] and samples[1]:
        model.good, model.bad = _dictionary(samples[1]), _dictionary(samples[0])
        got = _features_of(held.where("rank = 1"), model).collect()
        y = np.array([r.y for r in got], float)
        if 0 < y.sum() < len(y):
            share = {k: counts[k] / max(1, (y == k).sum()) for k in (0, 1)}
            weight = np.where(y == 1, share[1], share[0])
            model.fit_curve(np.array([r.x for r in got]), y, weight * len(y) / weight.sum())
    discard(held)
    return model


def score_documents(documents: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with ``score`` (probability of good text) and ``predicted``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = [shared.value.features((t.as_py() or "").encode()) for t in texts]
        return pa.array(shared.value.score(np.array(x)) if x else [], pa.float64())

    return K.small_batches(documents).withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that the classifier doesn't reject."""
    columns = documents.columns
    scored = score_documents(documents.withColumn("__text", F.col("text")).select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(columns)], F.col("__text").alias("text")), fit(documents, labels), threshold)
    return scored.where("predicted = 1").select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)])


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    documents = read(spark, sf_dir, "documents")
    model = fit(documents, read(spark, sf_dir, "labels"))
    scored = score_documents(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (labelled.fold() == 0).alias("held_out"), "score", "predicted")
