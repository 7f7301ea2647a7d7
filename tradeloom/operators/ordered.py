"""Global order without a window over one task: range partitions, their counts, and what each hands on to the next.

A table is sorted into range partitions and written. Places, pages, order
statistics and values carried forward then need one figure of each partition,
of which the driver holds as many as there are partitions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.session import discard, durable

#: Where a row stands: the number of its partition, then its place there.
_AT = "_at"
_WITHIN = 33
_PLACES = (1 << _WITHIN) - 1


@dataclass
class Ordered:
    """A table in order: ``table`` with the column ``_at``, and how many rows lie before each partition."""

    table: DataFrame
    before: dict[int, int]
    total: int

    def placed(self, column: str = "place") -> DataFrame:
        """All rows with their places 1, 2, 3 ... in ``column``."""
        spark = self.table.sparkSession
        offsets = spark.createDataFrame(sorted(self.before.items()), "_part long, _before long")
        of = F.shiftrightunsigned(_AT, _WITHIN)
        with_part = self.table.withColumn("_part", of).join(F.broadcast(offsets), "_part")  # a row for each partition
        return with_part.withColumn(column, F.col("_before") + F.col(_AT).bitwiseAND(_PLACES) + 1).drop("_part", "_before", _AT)

    def between(self, first: int, last: int, column: str = "place") -> DataFrame:
        """The rows at places ``first`` to ``last``, read from their own partitions only."""
        kept, wanted = [], F.lit(False)
        for part, start in sorted(self.before.items()):
            low, high = max(first - start - 1, 0), last - start - 1
            if low < self._size(part) and high >= 0:
                kept.append(part)
                at = part << _WITHIN
                wanted = wanted | F.col(_AT).between(at + low, at + min(high, self._size(part) - 1))
        rows = Ordered(self.table.where(wanted), {k: self.before[k] for k in kept} or {0: 0}, self.total)
        return rows.placed(column)

    def page(self, number: int, size: int = 20, column: str = "place") -> DataFrame:
        """Page ``number`` from 1 of ``size`` rows."""
        return self.between((number - 1) * size + 1, number * size, column)

    def _size(self, part: int) -> int:
        later = [n for p, n in self.before.items() if p > part]
        return (min(later) if later else self.total) - self.before[part]

    def discard(self) -> None:
        discard(self.table)


def in_order(df: DataFrame, *order: Column | str) -> Ordered:
    """``df`` sorted by ``order`` over all its partitions, as a durable table.

    Rows that tie in ``order`` keep the order they are read in, which also
    spreads a value of many rows over several partitions.
    """
    spark = df.sparkSession
    keys = [*[F.col(c) if isinstance(c, str) else c for c in order], F.col("_row")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_row")
    table = durable(rows.withColumn(_AT, F.monotonically_increasing_id()))
    sizes = table.groupBy(F.shiftrightunsigned(_AT, _WITHIN).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each partition
    totals = list(accumulate((r.n for r in sizes), initial=0))
    return Ordered(table, {r.part: n for r, n in zip(sizes, totals, strict=False)}, totals[-1])


def carried_forward(df: DataFrame, columns: list[str], *order: Column | str) -> DataFrame:
    """``df`` with each null in ``columns`` replaced by the last value before it in the order; leading nulls stay.

    Two passes: values are filled inside each partition, and what the
    partitions before hand on fills their leading nulls.
    """
    rows = in_order(df, *order)
    spark, part = df.sparkSession, F.shiftrightunsigned(_AT, _WITHIN)
    inside = Window.partitionBy("_part").orderBy(_AT)
    filled = rows.table.withColumn("_part", part).withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    lasts = rows.table.groupBy(part.alias("_part")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(_AT))).alias(c) for c in columns]).orderBy("_part").collect()
    carry, held = [], dict.fromkeys(columns)
    for r in lasts:  # a row for each partition
        carry.append((r._part, *held.values()))
        held |= {c: r[c] for c in columns if r[c] is not None}
    schema = "_part long" + "".join(f", _carry{k} {dict(df.dtypes)[c]}" for k, c in enumerate(columns))
    out = filled.join(F.broadcast(spark.createDataFrame(carry, schema)), "_part")  # a row for each partition
    return out.withColumns({c: F.coalesce(c, f"_carry{k}") for k, c in enumerate(columns)}).select(*df.columns)


def order_statistics(df: DataFrame, column: str, keys: list[str], fractions: list[float], bins: int = 256, most_rounds: int = 40, from_zero: bool = False) -> DataFrame:
    """``(*keys, fraction, value)``: the least value with at least that fraction of the key's values at or below it, exactly.

    With ``from_zero`` the value at place ``floor(fraction * n)`` from 0, the last at most.

    ``column`` is cast to double and its nulls are left out. Each round counts
    the values of every open interval in ``bins`` narrower ones and keeps the one
    with the wanted place, so a key of any size sends a row for each bin and
    task, never its values. It ends when an interval holds one distinct value.
    """
    spark = df.sparkSession
    values = durable(df.select(*keys, F.col(column).cast("double").alias("_x")).where("_x IS NOT NULL"))
    ends = values.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    asked = spark.createDataFrame([(float(f),) for f in fractions], "fraction double")
    # the place sought among the values of the interval [_low, _high], from 1
    place = F.greatest(F.ceil(F.col("fraction") * F.col("_n") - 1e-9), F.lit(1)).cast("long")
    if from_zero:
        place = F.least(F.floor(F.col("fraction") * F.col("_n")) + 1, F.col("_n"))
    state = durable(ends.crossJoin(F.broadcast(asked)).withColumn("_place", place).drop("_n"))  # a few fractions
    done: list[DataFrame] = []
    made = [values, state]
    join_keys = keys or ["_all"]
    if not keys:
        values, state = values.withColumn("_all", F.lit(0)), state.withColumn("_all", F.lit(0))
    for _ in range(most_rounds):
        settled = state.where("_low = _high")
        done.append(settled.select(*keys, "fraction", F.col("_low").alias("value")))
        live = state.where("_low < _high")
        if live.isEmpty():
            break
        width = (F.col("_high") - F.col("_low")) / bins
        place_of = F.least(F.floor((F.col("_x") - F.col("_low")) / width), F.lit(bins - 1))
        met = values.join(F.broadcast(live) if not keys else live, join_keys).where("_x >= _low AND _x <= _high")
        binned = met.groupBy(*join_keys, "fraction", "_place", place_of.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        sums = Window.partitionBy(*join_keys, "fraction").orderBy("_bin")
        upto = binned.withColumn("_upto", F.sum("_c").over(sums))
        made.append(state)
        state = durable(upto.where("_upto >= _place AND _upto - _c < _place").select(*join_keys, "fraction", "_low", "_high", (F.col("_place") - F.col("_upto") + F.col("_c")).alias("_place")))
    else:
        raise RuntimeError(f"order statistics are open after {most_rounds} rounds")
    out = durable(reduce(DataFrame.unionByName, done))
    for used in {id(t): t for t in [*made, state]}.values():
        discard(used)
    return out
