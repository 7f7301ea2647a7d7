"""Target-distribution importance resampling: documents drawn by how much their words resemble a target's.

A pre-tokeniser of the tokenizers library, an untrained split by a pattern over
A-Z lower-cased text, gives the words and their offsets. Windows over these
pairs are the features: all runs of 1 to ``most_words`` words, joined by one
space, repeats counted. CRC-32 puts them into buckets. The bucket counts of all
documents and of the whole target give each bucket's gain, the logarithm of the
smoothed ratio of its shares, in whole thousandths; a document's weight is the
sum over its features. Gumbel noise from its id makes the highest scores a draw
without replacement in proportion to exp(weight / 1000).

A text is pre-tokenised once: its bucket counts are kept in a table for the sum
that follows. The driver holds two counts for each bucket, the number of which
is a parameter. Ranks come from range partitions and their sizes.

Null and empty texts have no features, weight 0 and are never drawn unless
``least_words`` is 0. Rows that repeat an id are drawn each, with the same noise;
ties in score go to the smaller id, then in any order. A null id has the noise
of the empty string and stands last in a tie. Very long texts are split between
words into pieces, windows reaching across. Extra columns are ignored. Without
documents the result is empty; without a target all gains follow from its
smoothing alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from tradeloom.llm import text_kernel as K
from tradeloom.operators.ordered import in_order
from tradeloom.session import discard, durable, read

#: Fixed value: what a word is, after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_WORD = frozenset(map(chr, chain(range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80))))
_LOWER = bytes(K.LOWER)
#: Characters pre-tokenised at a time.
PIECE = 1 << 18


def _pieces(text: str) -> Iterator[str]:
    """``text`` cut outside words; a piece is longer than ``PIECE`` only where a word is."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and text[end] not in _NO_WORD:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def features(text: str | None, split: pre_tokenizers.PreTokenizer, most_words: int = 1) -> tuple[Counter, int]:
    """Each feature and its count, and the number of words."""
    found: Counter = Counter()
    tail: list[tuple[str, tuple[int, int]]] = []
    n = 0
    for piece in _pieces((text or "").encode().translate(_LOWER).decode()):
        pairs = split.pre_tokenize_str(piece)
        n += len(pairs)
        found.update([w for w, _ in pairs])
        if most_words > 1:
            both = tail + pairs
            for width in range(2, most_words + 1):  # only windows that end in this piece are new
                for end in range(max(width, len(tail) + 1), len(both) + 1):
                    found[_joined(piece, both[end - width : end], end - width >= len(tail))] += 1
            tail = both[1 - most_words :]
    return found, n


def _joined(piece: str, window: list[tuple[str, tuple[int, int]]], inside: bool) -> str:
    """A window's words joined by one space: a slice of the piece where its offsets say that nothing else lies between."""
    if inside:
        a, b = window[0][1][0], window[-1][1][1]
        if b - a == sum(len(w) + 1 for w, _ in window) - 1 and all(piece[e] == " " for _, (_, e) in window[:-1]):
            return piece[a:b]
    return " ".join([w for w, _ in window])


def splitter() -> pre_tokenizers.PreTokenizer:
    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def histograms(texts: DataFrame, most_words: int = 1, buckets: int = 10_000) -> DataFrame:
    """``(id, n_words, n_features, cells, times, bucket, n)`` of ``texts(id, text)``.

    A row for each text with its buckets and counts as packed integers, and
    rows ``(bucket, n)`` with what a task has added up, as many as there are
    buckets at most.
    """
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("cells", pa.binary()), ("times", pa.binary()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, total, crc = splitter(), np.zeros(buckets, np.int64), zlib.crc32
        for part in K.parts(batches, "text"):
            words, sizes, cells, times = [], [], [], []
            for text in part.column("text"):
                found, n = features(text.as_py(), split, most_words)
                at = np.fromiter((crc(f.encode()) % buckets for f in found), np.int64, len(found))
                count = np.fromiter(found.values(), np.int64, len(found))
                mine, place = np.unique(at, return_inverse=True)
                count = np.bincount(place, count, len(mine)).astype("<u4")
                total[mine] += count
                words.append(n)
                sizes.append(int(count.sum(dtype=np.int64)))
                cells.append(mine.astype("<u4").tobytes())
                times.append(count.tobytes())
            columns = [part.column("id"), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cells, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(words), pa.int32()), pa.nulls(len(words), pa.int64())], schema=schema)
        some = np.flatnonzero(total)
        if len(some):
            none = [pa.nulls(len(some), f.type) for f in list(schema)[:5]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(some.astype(np.int32)), pa.array(total[some])], schema=schema)

    return texts.mapInArrow(run, "id long, n_words long, n_features long, cells binary, times binary, bucket int, n long")


def bucket_counts(counted: DataFrame, buckets: int) -> np.ndarray:
    """The sums of the bucket rows of :func:`histograms`, one figure a bucket."""
    out = np.zeros(buckets, np.int64)
    for r in counted.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's ``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))`` over the ``B`` buckets."""
    of, to = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log(float((t + 1) * of) / float((s + 1) * to))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(gain)  # a figure for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("cells"), batch.column("times"), strict=True)
            sums = [int((held.value[np.frombuffer(c.as_buffer(), "<u4")] * np.frombuffer(t.as_buffer(), "<u4")).sum()) for c, t in pairs]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "n_words", "n_features")], pa.array(sums, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def resample(
    documents: DataFrame, target: DataFrame, most_words: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of each row; ``rank`` is null for documents that aren't drawn.

    ``percent`` of the documents with ``least_words`` words or more are drawn.
    """
    texts = K.small_batches(documents).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = durable(histograms(texts, most_words, buckets))
    aim = histograms(target.select(F.lit(0).cast("long").alias("id"), F.col(target_text).alias("text")), most_words, buckets)
    gain = gains(bucket_counts(counted, buckets), bucket_counts(aim, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    scored = durable(_weighed(counted.where("bucket IS NULL"), gain).withColumn("score", F.col("weight") + noise))
    drawn = in_order(scored.where(F.col("n_words") >= least_words), F.desc("score"), F.asc_nulls_last("id"))
    most = percent * drawn.total // 100
    ranked = drawn.placed("rank").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    every = ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    discard(counted)
    return every.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the words of the benchmark."""
    return resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


#: CRC-32 is a table of 256 remainders, made by rule, and a fold over the bytes of each distinct word.
SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)
  )
),
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
bw AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
),
dw AS (SELECT doc_id, unnest(words) AS word FROM w),
counted AS (SELECT doc_id, word, count(*) AS n FROM dw GROUP BY ALL),
vocabulary AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM counted UNION SELECT word FROM bw)),
hashed AS (
  SELECT word, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INT + 1, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM vocabulary, crc_table
),
s AS (SELECT bucket, sum(n) AS s FROM counted JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
g AS (
  SELECT b.bucket, floor(1000 * ln(
    ((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
weights AS (SELECT doc_id, sum(n * gain) AS weight FROM counted JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN weights USING (doc_id)
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
