"""Sum-of-squares online packing of tokenised documents into windows of fixed length.

Each task packs the documents of its input split as they come. A document of
``length`` tokens or more first gives whole windows; its rest goes to the fill
level, or to a new window, that makes the sum of the squared numbers of
partially filled windows over all levels least. The numbers stand in an array
with one entry for each level. With equal sums the fullest window wins.

When a task ends, or ``most_open`` windows are open, the fullest open windows
are topped up with cuts from the emptiest. What is left of a task at its end
is laid out in windows whose fill is a power of two, which need no padding. So
no token of padding remains, documents under ``length`` are seldom cut, and
nothing is shuffled: a task's work and memory don't depend on other tasks, and
a lost one is run again with the same result, as window ids come from the
split's number and order.

Null and empty texts have the end id alone. Repeated rows are packed each;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import text_kernel as K
from tradeloom.llm import token_ids
from tradeloom.session import read

#: Windows of a task in one number range.
_TASK_BITS = 33
MOST_OPEN = 2048


class Piece:
    """Tokens ``start .. start + length`` of a document, with their ids."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, start: int, ids: memoryview, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> Piece:
        """Keep the first ``at`` tokens, return the others."""
        rest = Piece(self.doc, self.start + at, self.ids[4 * at :], self.total)
        self.ids = self.ids[: 4 * at]
        return rest


class SumOfSquaresPacker:
    """Packs pieces into windows; ``closed`` gets each finished window."""

    def __init__(self, length: int, most_open: int = MOST_OPEN):
        self.length, self.most_open = length, most_open
        self.levels = np.zeros(length + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(length)]
        self.n_open = 0
        self.closed: list[list[Piece]] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        view, total = memoryview(ids), len(ids) // 4
        whole = total - total % self.length
        for at in range(0, whole, self.length):
            self.closed.append([Piece(doc, at, view[4 * at : 4 * (at + self.length)], total)])
        if total > whole:
            self._place(Piece(doc, whole, memoryview(bytes(view[4 * whole :])), total))
            if self.n_open > self.most_open:
                self._merge(False)

    def _place(self, piece: Piece) -> None:
        size = len(piece)
        came = 2 * self.levels[size:] + 1  # at each level a window could reach
        came[-1] = 0  # a full window is no longer partial
        left = 1 - 2 * self.levels[: self.length - size + 1]
        left[0] = 0  # a new window
        change = came + left
        change[1:][self.levels[1 : len(change)] == 0] = np.iinfo(np.int64).max
        level = int(len(change) - 1 - np.argmin(change[::-1]))
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        self._keep(window, level + size)

    def _keep(self, window: list[Piece], fill: int) -> None:
        if fill == self.length:
            self.closed.append(window)
        elif fill:
            self.open[fill].append(window)
            self.levels[fill] += 1
            self.n_open += 1

    def _merge(self, final: bool) -> None:
        """Top up the fullest open windows with cuts from the emptiest."""
        todo = [(fill, w) for fill in range(self.length - 1, 0, -1) for w in self.open[fill]]
        for stack in self.open:
            stack.clear()
        self.levels[:] = 0
        self.n_open = 0
        low, high = len(todo) - 1, 0
        fills, held = [f for f, _ in todo], [w for _, w in todo]
        while high < low:
            need = self.length - fills[high]
            if not need:
                self.closed.append(held[high])
                high += 1
                continue
            piece = held[low].pop()
            if len(piece) > need:
                rest = piece.cut(len(piece) - need)
                held[low].append(piece)
                piece = rest
            held[high].append(piece)
            fills[high] += len(piece)
            fills[low] -= len(piece)
            if not fills[low]:
                low -= 1
        if high == low:
            if not final:
                self._keep(held[high], fills[high])
            else:
                self._powers(held[high], fills[high])

    def _powers(self, pieces: list[Piece], fill: int) -> None:
        """Lay the last window out in windows whose fills are powers of two."""
        if fill == self.length:
            self.closed.append(pieces)
            return
        pieces = pieces[::-1]
        for bit in range(fill.bit_length() - 1, -1, -1):
            need = fill & (1 << bit)
            window = []
            while need:
                piece = pieces.pop()
                if len(piece) > need:
                    pieces.append(piece.cut(need))
                window.append(piece)
                need -= len(piece)
            if window:
                self.closed.append(window)

    def finish(self) -> None:
        self._merge(True)


def pack_documents(
    documents: DataFrame, length: int = 1024, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, most_open: int = MOST_OPEN
) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``.

    ``tokenizer`` is the path of a tokenizer file on the executors; the public byte-level vocabulary if None.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(c, pa.int64()) for c in names] + [("ids", pa.list_(pa.int64()))] * keep_ids)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = token_ids.encoder(tokenizer or token_ids.vocabulary_path())
        packer = SumOfSquaresPacker(length, most_open)
        number = TaskContext.get().partitionId() << _TASK_BITS

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows: list[tuple] = []
            for window in packer.closed:
                at = 0
                for p in window:
                    rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, number, at, *([np.frombuffer(p.ids, "<u4")] if keep_ids else [])))
                    at += len(p)
                number += 1
            packer.closed.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for a, b in K.slices(batch, "text"):
                part = batch.slice(a, b - a)
                for doc, ids in zip(part.column("id").to_pylist(), coder.encode(part.column("text").fill_null("").to_pylist()), strict=True):
                    packer.add(doc, ids + end)
                yield from flush()
        packer.finish()
        yield from flush()

    out = ", ".join(f"{c} long" for c in names) + (", ids array<long>" if keep_ids else "")
    return K.small_batches(documents).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of 1024 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"), 1024)
