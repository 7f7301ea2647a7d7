"""Which terms of a dictionary occur in which texts, by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.session import discard, durable


def grams(text: Column, width: int) -> Column:
    """The distinct runs of ``width`` characters."""
    places = F.when(F.length(text) >= width, F.sequence(F.lit(1), F.length(text) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(width))))


def contained(texts: DataFrame, terms: DataFrame, size: int = 3) -> DataFrame:
    """``(id, term)``: each of ``terms(term)`` that occurs in a text of ``texts(id, text)``, once.

    A term is sought only where its rarest run of ``size`` characters stands
    (the whole term, if it is shorter), then tested itself. So texts meet terms
    by equality, and frequent runs bring no candidates for terms that hold a
    rarer one. Null and empty terms and texts give nothing.
    """
    listed = durable(terms.select("term").where("term <> ''").distinct())
    rows = texts.select("id", "text").where("text <> ''")
    # as many numbers as ``size`` at most
    widths = [r.w for r in listed.select(F.least(F.length("term"), F.lit(size)).alias("w")).distinct().collect()]
    made = [listed]
    out = texts.select("id").limit(0).withColumn("term", F.lit("").cast("string"))
    for w in sorted(widths):
        mine = listed.where((F.length("term") >= size) if w == size else (F.length("term") == w))
        held = mine.select("term", F.explode(grams(F.col("term"), w)).alias("gram"))
        wanted = held.select("gram").distinct()
        places = durable(rows.select("id", F.explode(grams(F.col("text"), w)).alias("gram")).join(wanted, "gram", "left_semi"))
        counts = places.groupBy("gram").agg(F.count("*").alias("n"))
        rarest = held.join(counts, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
        rarest = durable(rarest.where("r.n > 0").select("term", F.col("r.gram").alias("gram")))
        out = out.unionByName(places.join(rarest, "gram").select("id", "term"))
        made += [places, rarest]
    found = out.join(rows, "id").where(F.contains("text", "term")).select("id", "term").distinct()
    found = durable(found)
    for used in made:
        discard(used)
    return found
