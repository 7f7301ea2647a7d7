"""Token counts of sections by offset mapping: a text is encoded once, and its tokens are attributed to its sections.

A byte-level vocabulary keeps every byte, so the running sum of its tokens'
byte lengths gives each token's span. Spans are joined with the sections'
intervals, both in order, by binary search. A token that crosses a boundary
goes to the section that holds most of its bytes, the earlier one if two hold
as many; bytes between sections (the line feed that ends a line) count as part
of the section before them. So every token is counted once, and the counts of
a document's sections add up to its tokens.

Sections of a document are its lines, cut at line feeds. Null and empty texts
have one empty section. Repeated rows are counted each; extra columns are
ignored. A document is handled by itself, its memory bounded by its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import text_kernel as K
from tradeloom.llm import token_ids
from tradeloom.session import read


def line_starts(raw: np.ndarray) -> np.ndarray:
    """Byte offsets at which lines begin; a final line feed ends the last line."""
    starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(raw) else starts


def attribute(ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The section of each token. ``ends``: the tokens' byte ends; ``starts``: the sections' byte starts, from 0."""
    begins = np.concatenate([[0], ends[:-1]])
    low = np.searchsorted(starts, begins, "right") - 1
    high = np.searchsorted(starts, ends - 1, "right") - 1
    out = low.copy()
    bounds = np.append(starts, np.iinfo(np.int64).max)
    for t in np.flatnonzero(high > low):  # the few that cross a boundary
        sections = np.arange(low[t], high[t] + 1)
        shares = np.minimum(ends[t], bounds[sections + 1]) - np.maximum(begins[t], bounds[sections])
        out[t] = sections[int(np.argmax(shares))]
    return out


def section_tokens(documents: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", bounds_col: str | None = None) -> DataFrame:
    """One row for each section: ``doc_id, section, start, end, n_tokens, n_crossing, doc_tokens``.

    ``start`` and ``end`` are code points. ``bounds_col`` names an array of the
    code points where sections start (the first being 0) in place of lines.
    """
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or token_ids.vocabulary_path()
        coder = token_ids.encoder(path)
        for batch in batches:
            for a, b in K.slices(batch, "text"):
                part = batch.slice(a, b - a)
                texts = part.column("text").fill_null("").to_pylist()
                given = part.column("bounds").to_pylist() if bounds_col else [None] * len(texts)
                columns: list[list[np.ndarray]] = [[] for _ in names]
                for doc, text, cuts, ids in zip(part.column("id").to_pylist(), texts, given, coder.encode(texts), strict=True):
                    raw = np.frombuffer(text.encode(), np.uint8)
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
                    starts = line_starts(raw) if cuts is None else np.searchsorted(points, np.array(sorted({0, *(c for c in cuts if c is not None and 0 <= c <= points[-1])})), "left")
                    ends = np.cumsum(coder.lengths[np.frombuffer(ids, "<u4")])
                    of = attribute(ends, starts) if len(ends) else np.zeros(0, np.int64)
                    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    crossing = of[np.searchsorted(starts, begins, "right") < np.searchsorted(starts, ends - 1, "right")] if len(ends) else of
                    n = len(starts)
                    till = np.append(starts[1:], len(raw))
                    for held, values in zip(
                        columns,
                        (np.full(n, doc), np.arange(n), points[starts], points[till], np.bincount(of, minlength=n), np.bincount(crossing, minlength=n), np.full(n, len(ends))),
                        strict=True,
                    ):
                        held.append(values)
                if columns[0]:
                    arrays = [pa.array([None if v is None else int(v) for x in columns[0] for v in x], pa.int64())] + [pa.array(np.concatenate(c).astype(np.int64)) for c in columns[1:]]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    extra = [F.col(bounds_col).alias("bounds")] if bounds_col else []
    return K.small_batches(documents).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *extra).mapInArrow(run, ", ".join(f"`{c}` long" for c in names))


def op9_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(read(spark, sf_dir, "documents"))
