"""Personal data by patterns, and information-theoretic sanitisation of the terms that give it away.

Patterns find e-mail addresses, IP numbers, payment cards and phone numbers in
whole texts. Their values are the protected entities. A term's disclosure of
an entity is its pointwise mutual information over the entity's information,
``PMI(t; e) / IC(e)``, from counts over all documents: 1 means that the term
occurs only with the entity. A term is a quasi-identifier if it stands within
``REACH`` words of an entity in ``least_texts`` different texts or more,
discloses it by ``THRESHOLD`` or more, and more than half of the texts with the
term name the entity. So a rare name beside a single phone number is one, and a
word that other texts use as well isn't. All counts are of different texts:
copies neither add evidence nor take it away. Each occurrence of such a term
becomes a span of kind ``term``, which sanitisation generalises.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased; terms have no digit and four characters at least, and words inside
a pattern's match are neither terms nor counted by ``REACH``. Words and texts
are compared by 64-bit hashes. Ties play no part: every term over the
thresholds counts.

Offsets are code points, ends exclusive. Null and empty texts have no spans;
rows with a null id are rows like any other. Repeated rows are scanned each;
extra columns, whatever their names, are kept by :func:`sanitise` and ignored by
:func:`find_spans`. Without documents there are no terms.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import sketches
from tradeloom.llm import text_kernel as K
from tradeloom.session import discard, durable, read

KINDS = ("email", "ip", "card", "phone", "term")
REACH = 8
LEAST_TEXTS = 1
THRESHOLD = 0.9
LEAST_CHARACTERS = 4
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = str.maketrans("", "", " ().+-")
#: Distinct words that a task counts before it sends their counts on.
_HELD_WORDS = 1 << 19


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the patterns' matches in order of start, then kind.

    For each kind matches are leftmost and don't overlap; those that fail the
    kind's test are dropped. An address is sought by its @, so that long runs
    of letters cost linear time.
    """
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, m.end(), "email"))
                free = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].translate(_NOT_DIGIT)
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(m[0].translate(_NOT_DIGIT)) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _value(text: str, kind: str) -> str:
    return text.lower() if kind in ("email", "ip") else text.translate(_NOT_DIGIT)


class _Words:
    """The words of a string array: code points of start and end, hash, whether they can be terms, and each row's first word."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = K.buffer_of(texts)
        self.starts, self.ends, self.first = K.spans(K.WORD[self.data], offsets)
        points, digits = K.running((self.data & 0xC0) != 0x80), K.running((self.data >= 48) & (self.data <= 57))
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        base = points[offsets[:-1]][self.row]
        self.start, self.end = points[self.starts] - base, points[self.ends] - base
        self.usable = (self.end - self.start >= LEAST_CHARACTERS) & (digits[self.starts] == digits[self.ends])
        self.hashes = K.hash_runs(K.LOWER[self.data], self.starts, self.ends)

    def text(self, k: int) -> str:
        return K.LOWER[self.data[self.starts[k] : self.ends[k]]].tobytes().decode()


def _outside(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """Which words overlap no span."""
    free = np.ones(len(start), bool)
    for a, b, _ in spans:
        free[np.searchsorted(end, a, "right") : np.searchsorted(start, b, "left")] = False
    return free


def _evidence(texts: DataFrame) -> DataFrame:
    """``(entity, term, h, doc)`` of ``texts(text, doc)``: the terms near an entity and their hashes.

    A row without a term says that the text names the entity.
    """
    schema = pa.schema([("entity", pa.int64()), ("term", pa.string()), ("h", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.parts(batches, "text"):
            named = [base_spans(t or "") for t in part.column("text").to_pylist()]
            keep = [i for i, s in enumerate(named) if s]
            if not keep:
                continue
            part = part.take(pa.array(keep))
            w, rows = _Words(part.column("text")), []
            for k, doc in enumerate(part.column("doc").to_pylist()):
                a, b, spans = w.first[k], w.first[k + 1], named[keep[k]]
                text = part.column("text")[k].as_py()
                free = np.flatnonzero(_outside(w.start[a:b], w.end[a:b], spans)) + a
                near: dict[int, set[int]] = {}
                for start, end, kind in spans:
                    found = near.setdefault(_hash(f"{kind} {_value(text[start:end], kind)}"), set())
                    left, right = np.searchsorted(w.end[free], start, "right"), np.searchsorted(w.start[free], end, "left")
                    found.update(i for i in (*free[max(0, left - REACH) : left], *free[right : right + REACH]) if w.usable[i])
                for entity, found in near.items():
                    rows.append((entity, None, None, doc))
                    rows += [(entity, w.text(i), h, doc) for h, i in {int(w.hashes[i].view(np.int64)): i for i in sorted(found)}.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts.select("text", "doc").mapInArrow(run, "entity long, term string, h long, doc long")


def _word_counts(texts: DataFrame, copied: np.ndarray) -> DataFrame:
    """``(h, n_term)``: in how many different texts of ``texts(text, doc)`` each word stands.

    Tasks add up the words of texts that have no copy; those of texts that may
    have one, by the bit set ``copied``, are sent with the text's hash, so that
    each text counts once.
    """
    held = texts.sparkSession.sparkContext.broadcast(copied)

    def emit(h: np.ndarray, n: np.ndarray, doc: np.ndarray | None = None) -> pa.RecordBatch:
        docs = pa.nulls(len(h), pa.int64()) if doc is None else pa.array(doc)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), docs, pa.array(n)], names=["h", "doc", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        for part in K.parts(batches, "text"):
            docs = np.asarray(part.column("doc"))
            once = np.zeros(len(docs), bool)
            once[np.unique(docs, return_index=True)[1]] = True
            w = _Words(part.column("text"))
            use = w.usable & once[w.row]
            rows, hashes = w.row[use], w.hashes[use]
            order = np.lexsort((hashes, rows))
            rows, hashes = rows[order], hashes[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
            rows, hashes = rows[new], hashes[new]
            copy = sketches.in_bit_set(held.value, docs.view(np.uint64), 8 * len(held.value))[rows]
            if copy.any():
                yield emit(hashes[copy], np.ones(copy.sum(), np.int64), docs[rows[copy]])
            waiting.append(hashes[~copy])
            size += len(waiting[-1])
            if size > _HELD_WORDS:
                words, counts = _added(words, counts, waiting)
                waiting, size = [], 0
                if len(words) > _HELD_WORDS:
                    yield emit(words, counts)
                    words, counts = words[:0], counts[:0]
        words, counts = _added(words, counts, waiting)
        if len(words):
            yield emit(words, counts)

    said = texts.select("text", "doc").mapInArrow(run, "h long, doc long, n long")
    once = said.groupBy("h", "doc").agg(F.when(F.col("doc").isNull(), F.sum("n")).otherwise(1).alias("n"))
    return once.groupBy("h").agg(F.sum("n").alias("n_term"))


def _added(words: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, place = np.unique(np.concatenate([words, *more]), return_inverse=True)
    return every, np.bincount(place, np.concatenate([counts, *[np.ones(len(m), np.int64) for m in more]]), len(every)).astype(np.int64)


def study(documents: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, least_texts: int = LEAST_TEXTS) -> tuple[DataFrame, DataFrame]:
    """``(term, h, entity, disclosure)`` of the terms at or over the threshold, and ``(h, n_term)`` of all words.

    Both are durable tables, from counts over all different texts.
    """
    texts = K.small_batches(documents).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("doc")).where("text <> ''")
    seen = durable(_evidence(texts).distinct())
    different = durable(texts.groupBy("doc").agg(F.count("*").alias("copies")))
    total, copies = different.agg(F.count("*"), F.coalesce(F.sum((F.col("copies") > 1).cast("long")), F.lit(0))).first()
    copied = sketches.bit_set(different.where("copies > 1"), "doc", sketches.bits_for(copies))
    words = durable(_word_counts(texts, copied))
    pairs = seen.where("h IS NOT NULL").groupBy("entity", "h").agg(F.min("term").alias("term"), F.count("*").alias("both")).where(F.col("both") >= least_texts)
    entities = seen.where("h IS NULL").groupBy("entity").agg(F.count("*").alias("n_entity"))
    scored = pairs.join(entities, "entity").join(words, "h").where(2 * F.col("both") > F.col("n_term"))
    p_entity, p_term, p_both = (F.col(c) / F.lit(float(total)) for c in ("n_entity", "n_term", "both"))
    ratio = F.log(p_both / (p_entity * p_term)) / F.greatest(-F.log(p_entity), F.lit(1e-9))
    terms = durable(scored.withColumn("disclosure", ratio).where(F.col("disclosure") >= threshold).select("term", "h", "entity", "disclosure"))
    discard(seen)
    discard(different)
    return terms, words


def disclosing_terms(documents: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """``(term, h, entity, disclosure)`` for the terms at or over the threshold; ``h`` is the word's hash."""
    terms, words = study(documents, text_col, threshold, least_texts)
    discard(words)
    return terms


def _membership(terms: DataFrame, words: DataFrame) -> sketches.Members:
    """Exact membership in ``terms`` among ``words``, by bit sets."""
    listed = durable(terms.select("h").distinct())
    others = words.select("h").join(listed, "h", "left_anti")
    found = sketches.members(listed, others)
    discard(listed)
    return found


def _spans_of(texts: pa.Array, listed: sketches.Members) -> list[list[tuple[int, int, str]]]:
    found = [base_spans(t or "") for t in texts.to_pylist()]
    if listed.levels or len(listed.last):
        w = _Words(texts)
        use = np.flatnonzero(w.usable)
        hits = use[listed.holds(w.hashes[use])]
        for k in np.unique(w.row[hits]):
            mine = hits[w.row[hits] == k]
            mine = mine[_outside(w.start[mine], w.end[mine], found[k])]
            found[k] = sorted([*found[k], *((int(w.start[i]), int(w.end[i]), "term") for i in mine)], key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def find_spans(documents: DataFrame, terms: DataFrame, words: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` with ``spans array<struct<start, end, kind>>``; ``terms`` and ``words`` as from :func:`study`.

    ``words(h)`` are all words of ``documents``, found by a pass of their own if
    None. They make the look-up of terms exact without moving a text.
    """
    texts = K.small_batches(documents).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if words is None:
        words = _word_counts(texts.select("text", F.xxhash64("text").alias("doc")).where("text <> ''"), np.zeros(sketches.LEAST_BITS // 8, np.uint8))
    listed = texts.sparkSession.sparkContext.broadcast(_membership(terms, words))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.parts(batches, "text"):
            out = [[{"start": s, "end": e, "kind": k} for s, e, k in spans] for spans in _spans_of(part.column("text"), listed.value)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, spans array<struct<start: long, end: long, kind: string>>")


def _redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def sanitise(documents: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """``documents`` with personal data replaced by its kind, ``[EMAIL]`` and so on, and disclosing terms by ``[TERM]``.

    The rows and columns stay; a column ``n_chars`` is set to the new length.
    Overlapping spans are replaced as one, under the first span's kind.
    """
    terms, words = study(documents, text_col, threshold, least_texts)
    listed = documents.sparkSession.sparkContext.broadcast(_membership(terms, words))
    discard(terms)
    discard(words)
    at = documents.columns.index(text_col)
    length = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.parts(batches, text_col):
            column = part.column(at)
            clean = pa.array([_redacted(t, s) for t, s in zip(column.to_pylist(), _spans_of(column, listed.value), strict=True)], column.type)
            columns = list(part.columns)
            columns[at] = clean
            if length is not None:
                columns[length] = pa.compute.utf8_length(clean).cast(columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return K.small_batches(documents).mapInArrow(run, documents.schema)


def op3_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document, with counts and a digest of the patterns' spans."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    terms, words = study(documents)
    found = find_spans(documents, terms, words)
    discard(terms)
    discard(words)
    part = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS[:4]]
    base = F.array_join(F.transform(F.filter("spans", lambda s: s.kind != "term"), part), ",")
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", part), ",").alias("spans"))
