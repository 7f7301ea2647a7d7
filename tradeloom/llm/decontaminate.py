"""Benchmark decontamination by template canonicalisation.

A text's tokens are runs of ASCII letters, digits and non-ASCII bytes, A-Z
lower-cased. Numbers, names (capitalised inside a sentence) and units after a
number become typed placeholders. Windows of ``WIDTH`` such tokens with enough
literal ones are hashed and joined with those of the benchmark; an item's other
windows are hashed with their own values and so are met word for word only.

A window that very many items hold (a preamble, a form of question) is evidence
for none of them. Items whose whole templates are equal are of one form. A
template that over ``COMMON`` forms hold is hashed with its values instead;
values that over ``COMMON`` forms hold are left out, also of the number of the
item's windows. Only items that would keep no window keep them all. Items of one
text are sought once.

Where a text and an item meet at one alignment, a window counts if its values
are the item's own or if none of its slots clashes. A number or unit clashes if
its value of the item stands for several of the text and the other way round;
either one alone happens by chance. A name clashes if the item's name does not
stand for this one in most of its places. If most places of the names that the
item repeats clash, the frame has unrelated slots, and only windows with the
item's own values count.

An item taints a document if at one alignment the windows that count are
``MIN_WINDOWS`` at least or ``MIN_SHARE`` of the item's, or if those with enough
literals are that share of the item's with enough. An item of fewer tokens than
a window is one window of its own length.

Windows of documents first pass a filter, sized by their number, made from the benchmark's
hashes, then the exact hash join, so neither table is broadcast; as a hash is
held by few forms, a document meets few. Null and empty texts and items have no
windows. Rows that repeat a document id count as one
document; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.llm import ngram_join, sketches
from tradeloom.llm import text_kernel as K
from tradeloom.session import discard, durable, read

WIDTH = 8
MIN_LITERALS = 4
MIN_SHARE = 0.3
MIN_WINDOWS = 10
COMMON = 8
#: Unit words that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg t oz lb lbs gram grams kilogram kilograms tonne tonnes pound pounds ounce ounces ml cl l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v a j kj cal kcal "
    "c f k degree degrees percent pct eur usd gbp dollar dollars euro euros cent cents kb mb gb tb bytes bits mph kmh kph"
).split()
NUMBER, NAME, UNIT = 1, 2, 3
_TOKEN = ~K.SPACE
_TOKEN[:128] = False
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, ord("."), ord("!"), ord("?"), ord(":"), ord("|"), ord('"')]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = K.buffer_of(pa.array(words))
    return K.hash_runs(data, offsets[:-1], offsets[1:])


_UNIT_HASHES = np.sort(_hash_words(UNITS))
_PLACEHOLDERS = _hash_words(["", "<number>", "<name>", "<unit>"])


def _count(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, slot kind (0: literal) and value hash of each token, and each row's first token."""
    data, offsets = K.buffer_of(texts)
    starts, ends, first = K.spans(_TOKEN[data], offsets)
    values = K.hash_runs(K.LOWER[data], starts, ends)
    digits, capitals, stops = _count((data >= 48) & (data <= 57)), _count((data >= 65) & (data <= 90)), _count(_STOP[data])
    kinds = np.zeros(len(starts), np.int8)
    if len(starts):
        begins = np.zeros(len(starts), bool)
        begins[first[:-1][first[:-1] < first[1:]]] = True
        opens = begins.copy()
        opens[1:] |= stops[starts[1:]] > stops[ends[:-1]]
        number = digits[ends] - digits[starts] == ends - starts
        title = (data[starts] >= 65) & (data[starts] <= 90) & (capitals[ends] - capitals[starts] == 1) & (ends - starts > 1)
        after = np.concatenate([[False], number[:-1]]) & ~begins
        at = np.minimum(np.searchsorted(_UNIT_HASHES, values), len(_UNIT_HASHES) - 1)
        kinds[title & ~opens] = NAME
        kinds[after & (_UNIT_HASHES[at] == values)] = UNIT
        kinds[number] = NUMBER
    return np.where(kinds > 0, _PLACEHOLDERS[kinds], values), kinds, values, first


_WINDOW = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("hash", pa.int64()), ("exact", pa.bool_()), ("places", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int8())), ("values", pa.list_(pa.int64()))])
_WINDOW_SQL = "id long, pos int, hash long, exact boolean, places array<int>, kinds array<tinyint>, values array<long>"
_EXACT = np.uint64(0xA5A5A5A5A5A5A5A5)


def _windows(rows: DataFrame, widths: list[int], bits=None) -> DataFrame:
    """The windows of each text of ``rows(id, text)``; with ``bits`` those that pass the filter, without it a benchmark's.

    A benchmark item has windows of the full width, or one of its own length;
    each gives its values (``exact``) and, unless it is short of literals, its
    template, of which :func:`_telling` chooses. A text has both for each window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch, "text"):
                part = batch.slice(a, b - a)
                frame, kinds, values, first = templates(part.column("text"))
                ids = part.column("id")
                slots = _count(kinds > 0)
                sizes = np.diff(first)
                for width in widths:
                    n = max(0, len(frame) - width + 1)
                    rows_of = np.repeat(np.arange(len(sizes)), sizes)[:n]
                    inside = np.arange(n) + width <= first[1:][rows_of]
                    if bits is None and width < WIDTH:
                        inside &= sizes[rows_of] == width
                    literal = width - (slots[width : width + n] - slots[:n]) >= min(MIN_LITERALS, width)
                    for exact in (False, True):
                        hashes = K.mix(K.windows(values, width) ^ _EXACT) if exact else K.windows(frame, width)
                        keep = inside.copy() if exact else inside & literal
                        if bits is not None:
                            keep[keep] = sketches.in_bit_set(bits.value, hashes[keep], 8 * len(bits.value))
                        at, row = np.flatnonzero(keep), rows_of[keep]
                        if not len(at):
                            continue
                        spots = [np.flatnonzero(kinds[i : i + width]) + i for i in at]
                        columns = [
                            ids.take(pa.array(row)),
                            pa.array((at - first[row]).astype(np.int32)),
                            pa.array(hashes[at].view(np.int64)),
                            pa.array(np.full(len(at), exact)),
                            pa.array([(s - f).astype(np.int32) for s, f in zip(spots, first[row], strict=True)], pa.list_(pa.int32())),
                            pa.array([kinds[s] for s in spots], pa.list_(pa.int8())),
                            pa.array([values[s].view(np.int64) for s in spots], pa.list_(pa.int64())),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, schema=_WINDOW)

    return rows.mapInArrow(run, _WINDOW_SQL)


def _forms(items: DataFrame) -> DataFrame:
    """``(id, form)``: a hash of each item's whole template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame, _, _, first = templates(batch.column("text"))
            forms = np.array([K.whole(frame[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(forms.view(np.int64))], names=["id", "form"])

    return items.mapInArrow(run, "id long, form long")


def _telling(windows: DataFrame, forms: DataFrame) -> DataFrame:
    """One row for each window of an item that tells its form from others: by its template, else by its values, else none."""
    held = windows.join(forms, "id").groupBy("hash", "exact").agg(F.countDistinct("form").alias("forms"))
    rows = durable(windows.join(held, ["hash", "exact"]).withColumn("telling", F.col("forms") <= COMMON))
    one = Window.partitionBy("id", "pos")
    by_template = F.max(~F.col("exact") & F.col("telling")).over(one)
    chosen = rows.withColumn("by_template", by_template).where(F.col("exact") != F.col("by_template"))
    some = F.max("telling").over(Window.partitionBy("id"))
    return chosen.withColumn("some", some).where("telling OR NOT some").drop("forms", "telling", "by_template", "some")


def _short_widths(items: DataFrame) -> list[int]:
    """Token counts of the items that are shorter than a window; at most ``WIDTH - 1`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(templates(batch.column("text"))[3])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(sizes[(sizes > 0) & (sizes < WIDTH)]).astype(np.int32))], names=["n"])

    return [r.n for r in items.mapInArrow(run, "n int").distinct().collect()]


def tainted(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_share: float = MIN_SHARE, min_windows: int = MIN_WINDOWS
) -> DataFrame:
    """``(doc_id, item_id, n_matched, n_windows, coverage, n_slots, same_values)`` for each pair of a document and an item it holds.

    ``n_windows`` are the item's; ``coverage`` is the greater share, of these or of those with enough literals.
    ``n_slots`` counts the item's slots met; ``same_values`` says that all have the item's own values.
    """
    spark = documents.sparkSession
    every = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"), F.sha2(F.col(item_text).cast("binary"), 256).alias("digest")).where("text IS NOT NULL")
    first = durable(every.groupBy("digest").agg(F.min(F.coalesce("item_id", F.lit(0))).alias("id"), F.min("text").alias("text")))
    items = first.select("id", "text")
    same_text = every.select("item_id", "digest").join(first.select("digest", "id"), "digest").select("id", "item_id").distinct()
    texts = K.small_batches(documents).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    widths = [WIDTH, *_short_widths(items)]
    wanted = durable(_telling(_windows(items, widths), _forms(items)))
    of_template = lambda c: F.countDistinct(F.when(~F.col("exact"), F.col(c)))
    totals = wanted.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("pos").alias("n_windows"), of_template("pos").alias("windows"))
    bits = spark.sparkContext.broadcast(sketches.bit_set(wanted, "hash", sketches.bits_for(wanted.count())))
    d = _windows(texts, widths, bits).select(F.col("id").alias("doc_id"), F.col("pos").alias("d_pos"), "hash", "exact", F.col("values").alias("d_values"))
    i = wanted.select(F.col("id").alias("item_id"), F.col("pos").alias("i_pos"), "hash", "exact", "places", "kinds", F.col("values").alias("i_values"))
    hits = d.join(i, ["hash", "exact"]).withColumn("shift", F.col("d_pos") - F.col("i_pos"))
    hits = durable(hits.withColumn("d_values", F.when(F.col("exact"), F.col("i_values")).otherwise(F.col("d_values"))).distinct())
    keys = ["doc_id", "item_id", "shift"]
    slot = hits.select(*keys, F.explode(F.arrays_zip("places", "kinds", "i_values", "d_values")).alias("s")).select(*keys, "s.*").distinct()
    pair = slot.groupBy(*keys, "kinds", "i_values", "d_values").agg(F.count("*").alias("n"))
    by_item = pair.groupBy(*keys, "kinds", "i_values").agg(F.sum("n").alias("n_item"), F.count("*").alias("stands_for"))
    by_text = pair.groupBy(*keys, "kinds", "d_values").agg(F.count("*").alias("stood_for"))
    name, clash = F.col("kinds") == NAME, F.col("clash")
    pair = pair.join(by_item, [*keys, "kinds", "i_values"]).join(by_text, [*keys, "kinds", "d_values"])
    pair = pair.withColumn("clash", F.when(name, 2 * F.col("n") <= F.col("n_item")).otherwise((F.col("stands_for") > 1) & (F.col("stood_for") > 1)))
    places = lambda which: F.coalesce(F.sum(F.when(name & (F.col("n_item") > 1) & which, F.col("n"))), F.lit(0))
    judged = pair.groupBy(*keys).agg(
        F.count("*").alias("n_slots"), F.min((F.col("i_values") == F.col("d_values")).cast("int")).alias("same"),
        F.collect_set(F.when(clash, F.struct("kinds", "i_values", "d_values"))).alias("clashes"), (places(clash) > places(~clash)).alias("unrelated"),
    )
    slots = F.transform(F.arrays_zip("kinds", "i_values", "d_values"), lambda s: F.struct(s.kinds.alias("kinds"), s.i_values.alias("i_values"), s.d_values.alias("d_values")))
    counts = F.col("n_slots").isNull() | (F.col("i_values") == F.col("d_values")) | (~F.col("unrelated") & ~F.arrays_overlap(slots, "clashes"))
    met = hits.join(judged, keys, "left").where(counts)
    met = met.groupBy(*keys).agg(F.countDistinct("i_pos").alias("n_matched"), of_template("i_pos").alias("n_template"), F.first("n_slots").alias("n_slots"), F.first("same").alias("same")).join(totals, "item_id")
    share = F.greatest(F.col("n_matched") / F.col("n_windows"), F.when(F.col("windows") > 0, F.col("n_template") / F.col("windows")))
    met = met.withColumn("share", share).where((F.col("n_matched") >= min_windows) | (F.col("share") >= min_share))
    best = met.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_matched", "share", "n_windows", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("same", F.lit(1)).alias("same"))).alias("b")
    )
    best = best.withColumnRenamed("item_id", "id").join(same_text, "id")
    return best.select(
        F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "b.n_matched", "b.n_windows", F.round("b.share", 4).alias("coverage"),
        "b.n_slots", (F.col("b.same") == 1).alias("same_values"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` without those that hold a benchmark item; rows without an id stay."""
    gone = durable(tainted(documents, benchmark).select("doc_id").distinct())
    out = ngram_join.without_ids(documents, gone)
    discard(gone)
    return out


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold items of the benchmark, one row for each pair."""
    return tainted(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
