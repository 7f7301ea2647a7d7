"""Screening of companies by their product and country mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def screen(mix: DataFrame, prefix: str, year: int | None = None, direction: str | None = None, top_k: int | None = None, min_ratio: float = 0.0, ratio_weight: float = 0.7, tier_weight: float = 0.3) -> DataFrame:
    """Companies exposed to the codes that start with ``prefix``, best first.

    A cell (company, year, direction) has the sum of its weights and its
    highest tier; a company has the mean and maximum over its cells. The score
    is ``ratio_weight * mean / 100 + tier_weight * tier / 7``.
    """
    rows = mix.where(F.col("code").startswith(prefix))
    if year is not None:
        rows = rows.where(F.col("year") == year)
    if direction is not None:
        rows = rows.where(F.col("direction") == direction)
    cells = rows.groupBy("company", "year", "direction").agg(F.sum("weight").alias("ratio"), F.max("tier").alias("tier"))
    out = cells.groupBy("company").agg(F.avg("ratio").alias("avg_ratio"), F.max("ratio").alias("max_ratio"), F.max("tier").alias("tier"), F.count("*").alias("n_cells")).where(F.col("avg_ratio") >= min_ratio)
    out = out.withColumn("score", F.round(ratio_weight * F.col("avg_ratio") / 100 + tier_weight * F.col("tier") / 7, 6))
    return out if top_k is None else out.orderBy(F.desc("score"), "company").limit(top_k)


def companies_of_codes(mix: DataFrame, prefixes: list[str]) -> DataFrame:
    """``(company)`` with a code under any of the prefixes (chapters)."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("code").startswith(p)
    return mix.where(hit).select("company").distinct()


def resolve_industry(names: str, chapters: dict[str, list[str]]) -> list[str] | None:
    """Chapter prefixes of comma-separated industry names; None for "all"; unknown names are an error."""
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    if "all" in wanted or not wanted:
        return None
    if unknown := [n for n in wanted if n not in chapters]:
        raise ValueError(f"unknown industries: {unknown}")
    return sorted({c for n in wanted for c in chapters[n]})


def code_weights(mix: DataFrame) -> DataFrame:
    """``(company, code, export_weight, import_weight, years)``: sums by direction and the ordered list of yearly parts."""
    part = F.struct("year", "direction", F.round("weight", 6).alias("weight"))
    of = lambda d: F.sum(F.when(F.col("direction") == d, F.col("weight")).otherwise(0.0))
    return mix.groupBy("company", "code").agg(of("EXP").alias("export_weight"), of("IMP").alias("import_weight"), F.sort_array(F.collect_list(part)).alias("years"))


def country_ratios(mix: DataFrame) -> DataFrame:
    """Adds ``ratio``, the country's part of its (company, year, direction, hs) in percent; null where the total is 0."""
    total = F.sum("amount").over(Window.partitionBy("company", "year", "direction", "hs"))
    return mix.withColumn("ratio", 100 * F.col("amount") / F.nullif(total, F.lit(0.0)))


def country_lists(mix: DataFrame) -> DataFrame:
    """``(company, direction, hs, countries)``: country and ratio of all years, largest first, as text."""
    sums = mix.groupBy("company", "direction", "hs", "country").agg(F.sum("amount").alias("amount"))
    total = F.sum("amount").over(Window.partitionBy("company", "direction", "hs"))
    sums = sums.withColumn("ratio", F.round(100 * F.col("amount") / F.nullif(total, F.lit(0.0)), 4))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("n"), "country")))
    return sums.groupBy("company", "direction", "hs").agg(F.array_join(F.transform(ordered, lambda x: x.country), ",").alias("countries"), F.count("*").alias("n_countries"))


def top_mix(mix: DataFrame, n: int = 10) -> DataFrame:
    """The rows of greatest weight, nulls last, ties by company and code."""
    return mix.orderBy(F.desc_nulls_last("weight"), "company", "year", "direction", "code").limit(n)


def tariff_seeds(seeds: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Injected amounts of ``seeds(company, amount, shock_rate, codes)`` by ``weights(company, code, rate)``; and the seeds left out.

    Repeated codes count once; codes without a weight count nothing; a seed
    without any weight is left out with a reason.
    """
    coded = seeds.select("company", "amount", "shock_rate", F.explode(F.array_distinct("codes")).alias("code"))
    joined = coded.join(weights, ["company", "code"], "left").groupBy("company", "amount", "shock_rate").agg(F.sum("rate").alias("rate"), F.count("rate").alias("n_found"))
    kept = joined.where("n_found > 0").select("company", (F.col("amount") * F.col("rate") * F.col("shock_rate")).alias("value"), "n_found")
    return kept, joined.where("n_found = 0").select("company", F.lit("no weight for any code").alias("reason"))


def trade_weights(payload: DataFrame, direction: str) -> DataFrame:
    """``(company, code, rate)`` of ``payload(company, items array<struct<code, direction, rate: string>>)``: one direction, rates in 0-1, the last row of a key holds."""
    items = payload.select("company", F.posexplode("items").alias("at", "i"))
    rows = items.where(F.col("i.direction") == direction).select("company", "at", F.col("i.code").alias("code"), F.expr("try_cast(i.rate AS double)").alias("rate")).where("rate BETWEEN 0 AND 1")
    return rows.groupBy("company", "code").agg(F.max_by("rate", "at").alias("rate"))
