"""Order MinHash fingerprints with DataFrame functions only.

A text's k-mers are runs of ``WORDS`` tokens, each numbered by its occurrence
in the text, so that repeated k-mers stay distinct. Tokens are the words
(white space apart); a word of more than ``LONG_WORD`` bytes, as text without
white space has them, gives all its runs of ``GRAM`` characters instead, so an
edit inside it changes a few k-mers and not the whole. Such words are taken in
stretches of ``STRETCH`` characters, which bounds the memory of one.

The fingerprint has ``2 ** BIN_BITS`` slots. A slot puts all numbered k-mers
in an order of its own: by the leading bits of their hash, exclusive-or the
slot's number, then by the other bits. The ``TUPLE`` least are selected, put
back into text order, and the ordered tuple is hashed. So each slot is an order
MinHash of the whole text; with two or more k-mers every tuple has an order,
however short the text. In a long text a slot finds its tuple in its own bin of
leading bits; a slot whose bin holds too few looks at the other bins, too.
Two texts agree in a slot if the same k-mers are least in it and stand in the
same order, which edit distance disturbs and a set comparison doesn't see. A
fingerprint has eight hex digits a slot: the slot and its tuple's hash.

All steps are array functions within a row, on sorted arrays of longs (hash
bits above, position below; an array holds under 2^28 longs, so 29 bits never
wrap). An occurrence number is the length of the run of equal hashes before an
element; it is found by binary descent, so a word repeated through a long text
costs a logarithm.

A text of fewer than ``WORDS`` tokens is one k-mer; a text without words has
the empty fingerprint. The likeness of two fingerprints is the share of
agreeing slots, 1 if both are empty. Null counts as empty text. Columns other
than the id and the text aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.session import durable, read

WORDS = 2
TUPLE = 2
#: 64 slots: the six leading bits of a hash.
BIN_BITS = 6
LONG_WORD = 32
GRAM = 8
STRETCH = 4096
_POS_BITS = 29
_SHIFT = 64 - BIN_BITS
_ID_BITS = 64 - _POS_BITS
_WIDTH = 32 - BIN_BITS
_SPACE = "[ \\t\\n\\u000B\\f\\r]+"


def _high(x: Column) -> Column:
    return F.shiftright(x, _POS_BITS)


def _bin(x: Column) -> Column:
    return F.shiftright(x, _SHIFT)


def _keyed(hashed: Column, low: Column) -> Column:
    return F.shiftleft(_high(hashed), _POS_BITS).bitwiseOR(low.cast("long").bitwiseAND((1 << _POS_BITS) - 1))


def _character_runs(word: Column) -> Column:
    """Hashes of all runs of ``GRAM`` characters of a long word."""

    def runs(stretch: Column) -> Column:
        c = F.split(stretch, "")
        return F.when(F.size(c) < GRAM, F.array(F.xxhash64(stretch))).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.xxhash64(F.slice(c, i + 1, GRAM)))
        )

    return F.flatten(F.transform(F.regexp_extract_all(word, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), runs))


def with_signature(df: DataFrame, text_col: str, out_col: str, words: int = WORDS, size: int = TUPLE) -> DataFrame:
    """``df`` with the signature of ``text_col``: a sorted array of longs, one for each slot."""
    w, t, s, o, f, u = (f"__{x}_{out_col}" for x in ("words", "tokens", "sorted", "picked", "full", "short"))
    kept = df.columns
    long_word = lambda x: F.octet_length(x) > LONG_WORD
    one = lambda x: F.xxhash64(x)
    tokens = F.when(
        F.exists(w, long_word), F.flatten(F.transform(w, lambda x: F.when(long_word(x), _character_runs(x)).otherwise(F.array(one(x)))))
    ).otherwise(F.transform(w, one))
    grams = F.when(
        F.size(t) >= words, F.transform(F.sequence(F.lit(0), F.size(t) - words), lambda i: _keyed(F.xxhash64(*[F.get(F.col(t), i + j) for j in range(words)]), i))
    ).otherwise(F.when(F.size(t) > 0, F.array(_keyed(F.xxhash64(F.col(t)), F.lit(0)))).otherwise(F.array().cast("array<bigint>")))

    def before(i: Column, h: Column) -> Column:
        """How many elements just before place ``i`` of the sorted array have hash ``h``."""
        same = lambda n: (i >= n) & (_high(F.get(F.col(s), i - n)) == h)
        steps = F.array(*[F.lit(1 << b) for b in range(_POS_BITS - 1, -1, -1)])
        count = F.aggregate(steps, F.lit(0), lambda n, step: F.when(same(n + step), n + step).otherwise(n))
        return F.when(same(F.lit(1)), count).otherwise(F.lit(0))

    numbered = F.transform(F.col(s), lambda x, i: _keyed(F.xxhash64(_high(x), before(i, _high(x))), x))
    in_order = F.sort_array(numbered)
    least = lambda a: F.filter(a, lambda x, i: (i < size) | (_bin(F.get(a, i - size)) != _bin(x)))
    at = lambda i: F.get(F.col(f), i)

    def digest(slot: Column, tuple_: Column) -> Column:
        """The slot's number and the hash of its tuple, in text order."""
        by_place = F.sort_array(F.transform(tuple_, lambda x: F.shiftleft(x, _ID_BITS).bitwiseOR(F.shiftrightunsigned(x, _POS_BITS))))
        hashed = F.xxhash64(F.transform(by_place, lambda x: x.bitwiseAND((1 << _ID_BITS) - 1)))
        return F.shiftleft(slot.cast("long"), _WIDTH).bitwiseOR(hashed.bitwiseAND((1 << _WIDTH) - 1))

    half = 1 << (BIN_BITS - 1)  # the order is of signed longs
    first = F.filter(F.sequence(F.lit(0), F.size(f) - 1), lambda i: ((i == 0) | (_bin(at(i - 1)) != _bin(at(i)))) & (_bin(at(i + size - 1)) == _bin(at(i))))
    short = F.array_except(F.sequence(F.lit(0), F.lit(2 * half - 1)), F.transform(first, lambda i: (_bin(at(i)) + half).cast("int")))
    own = F.transform(first, lambda i: digest(_bin(at(i)) + half, F.slice(F.col(f), i + 1, size)))

    def looking_on(mask: Column) -> Column:
        found = F.slice(F.sort_array(F.transform(F.col(f), lambda x: x.bitwiseXOR(mask))), 1, size)
        return digest(F.shiftrightunsigned(mask, _SHIFT), F.transform(found, lambda x: x.bitwiseXOR(mask)))

    signature = F.sort_array(F.concat(own, F.transform(F.col(u), looking_on)))
    steps = [
        (w, F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), _SPACE), "")),
        (t, tokens),
        (s, F.sort_array(grams)),
        (o, in_order),
        (f, least(F.col(o))),
        (u, F.when(F.size(f) > 0, F.transform(short, lambda k: F.shiftleft(k.cast("long"), _SHIFT)))),
        (out_col, F.when(F.size(f) > 0, signature).otherwise(F.array().cast("array<bigint>"))),
    ]
    return reduce(lambda d, step: d.withColumn(*step), steps, df).select(*kept, out_col)


def fingerprint(signature: Column) -> Column:
    """The signature as text."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(one: Column, two: Column) -> Column:
    """Share of agreeing slots, 0 if just one signature is empty."""
    slots = F.greatest(F.size(one), F.size(two))
    return F.when(slots == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one, two)) / slots)


def _successors(keys: DataFrame) -> DataFrame:
    """``(key, next_key)`` in descending id order, the first after the last. ``keys(key, id, tie)`` has each key once.

    Rows get their place from a range-partitioned sort; only the ends of the
    partitions, a few numbers each, pass through the driver.
    """
    placed = durable(keys.orderBy(F.desc_nulls_last("id"), "tie").select("key", F.monotonically_increasing_id().alias("at")))
    ends = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last")).orderBy("part").collect()
    jumps = {a.last: b.first for a, b in zip(ends, ends[1:] + ends[:1], strict=True)}
    if not jumps:
        return placed.select("key", F.col("key").alias("next_key"))
    table = placed.sparkSession.createDataFrame(sorted(jumps.items()), "at long, jump long")  # a row for each partition of the sort
    after = placed.join(F.broadcast(table), "at", "left").select("key", F.coalesce("jump", F.col("at") + 1).alias("next_at"))
    return after.join(placed.select(F.col("key").alias("next_key"), F.col("at").alias("next_at")), "next_at").select("key", "next_key")


def compare_with_edits(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its last half replaced by the start of the next document's, and likenesses.

    Rows that repeat an id are ordered by a hash of their text; rows that
    repeat both share one place in the order and give the same result each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text"))))
    keys = durable(docs.groupBy("key").agg(F.first("doc_id").alias("id"), F.count("*").alias("copies")))
    repeated = keys.where("copies > 1")
    has_copies = not repeated.isEmpty()
    if has_copies:
        docs = docs.dropDuplicates(["key"])
    order = durable(_successors(keys.select("key", "id", F.col("key").alias("tie"))))
    signed = with_signature(docs, "text", "sig")  # both joins below read the same shuffle of it
    half = lambda c: F.floor(F.char_length(c) / 2).cast("int")
    lengths = docs.select("key", half("text").alias("need"))
    asked = order.join(lengths, "key").select(F.col("next_key").alias("key"), F.col("key").alias("asker"), "need")
    given = signed.join(asked, "key").select(F.col("asker").alias("key"), F.col("doc_id").alias("next_doc_id"), F.left("text", F.col("need")).alias("start"), F.col("sig").alias("next_sig"))
    both = signed.join(given, "key")
    n = F.char_length("text")
    edited = both.select("key", "doc_id", n.cast("long").alias("n_chars"), "sig", "next_sig", "next_doc_id", F.concat(F.left("text", n - half("text")), "start").alias("edited"))
    edited = with_signature(edited, "edited", "edited_sig")
    out = edited.select(
        "key", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"), "next_doc_id",
    )
    if has_copies:
        out = out.join(repeated.select("key", "copies"), "key", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int")))).drop("copy", "copies")
    return out.drop("key")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of every document and of its edited text."""
    return compare_with_edits(read(spark, sf_dir, "documents"))
