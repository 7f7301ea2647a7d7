"""From tax filings to yearly trade edges, shares and firm totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators.ordered import in_order

POLICIES = ("SUM_ALL", "REPLACE", "FIRST_ONLY")


def yearly_edges(filings: DataFrame, policy: str = "REPLACE", year: int | None = None, only: DataFrame | None = None, normalise: bool = False) -> DataFrame:
    """``(src, dst, trade_year, sly_amt, n_filings[, rate])`` of ``filings(supplier, counterparty, year, quarter, phase, amount)``.

    REPLACE keeps every row of a quarter's highest phase (compared as text),
    FIRST_ONLY the rows of phase 1. Blank keys go after that step, edges
    without a positive sum at the end. ``only(company)`` restricts suppliers.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    rows = filings if year is None else filings.where(F.col("year") == year)
    if only is not None:
        rows = rows.join(only.select(F.col("company").alias("supplier")).distinct(), "supplier", "left_semi")
    if policy == "FIRST_ONLY":
        rows = rows.where("phase = '1'")
    elif policy == "REPLACE":
        last = F.max("phase").over(Window.partitionBy("supplier", "counterparty", "year", "quarter"))
        rows = rows.withColumn("__last", last).where("phase = __last")
    filled = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    rows = rows.where(filled("supplier") & filled("counterparty"))
    edges = rows.groupBy(F.col("supplier").alias("src"), F.col("counterparty").alias("dst"), F.col("year").alias("trade_year")).agg(F.sum("amount").alias("sly_amt"), F.count("*").alias("n_filings"))
    edges = edges.where("sly_amt > 0")
    return source_rate(edges) if normalise else edges


def _share(amount: str, *keys: str):
    total = F.sum(amount).over(Window.partitionBy(*keys))
    return F.when(total > 0, F.col(amount) / total)


def source_rate(edges: DataFrame) -> DataFrame:
    """Adds ``rate``, the share of the source's yearly total."""
    return edges.withColumn("rate", _share("sly_amt", "src", "trade_year"))


def edge_shares(edges: DataFrame, year: int | None = None) -> DataFrame:
    """Adds ``trade_rate`` and ``sell_rate`` (share of the seller's year), ``buy_rate`` (of the buyer's year) and its basis."""
    rows = edges if year is None else edges.where(F.col("trade_year") == year)
    sell, buy = _share("sly_amt", "src", "trade_year"), _share("sly_amt", "dst", "trade_year")
    return rows.withColumn("trade_rate", sell).withColumn("sell_rate", sell).withColumn("buy_rate", buy).withColumn("buy_rate_basis", F.when(buy.isNotNull(), "PURCHASE"))


def share_checks(shares: DataFrame) -> DataFrame:
    """One row: least, greatest and mean sum of sell rates by source and year, the largest distance from 1, rows by basis."""
    sums = shares.groupBy("src", "trade_year").agg(F.sum("sell_rate").alias("total"), F.count_if(F.col("buy_rate_basis") == "PURCHASE").alias("purchase"), F.count_if(F.col("buy_rate_basis").isNull()).alias("none"))
    return sums.agg(F.min("total").alias("least"), F.max("total").alias("most"), F.avg("total").alias("mean"), F.max(F.abs(F.col("total") - 1)).alias("off"), F.sum("purchase").alias("purchase"), F.sum("none").alias("none"))


def buyers_without_sales(edges: DataFrame) -> DataFrame:
    """``(company, bought)`` of buyers whose own sales are missing or not positive."""
    sold = edges.groupBy(F.col("src").alias("company")).agg(F.sum("sly_amt").alias("sold"))
    bought = edges.groupBy(F.col("dst").alias("company")).agg(F.sum("sly_amt").alias("bought"))
    return bought.join(sold, "company", "left").where("sold IS NULL OR sold <= 0").select("company", "bought")


def rate_maps(edges: DataFrame) -> DataFrame:
    """``(src, dst, rate, by_year)``: the share over all years and a map from year to that year's share."""
    yearly = source_rate(edges)
    pairs = yearly.groupBy("src", "dst").agg(F.sum("sly_amt").alias("amount"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("trade_year").cast("string"), F.round("rate", 6))))).alias("by_year"))
    return pairs.withColumn("rate", _share("amount", "src")).select("src", "dst", "rate", "by_year")


def in_shares(edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``(src, dst, share)``: the pair's part of all the buyer's purchases; ``wanted(src, dst)`` picks pairs after the totals are made."""
    out = edges.groupBy("src", "dst").agg(F.sum("sly_amt").alias("amount")).withColumn("share", _share("amount", "dst"))
    return (out if wanted is None else out.join(wanted.select("src", "dst").distinct(), ["src", "dst"], "left_semi")).select("src", "dst", "share")


def partner_shares(edges: DataFrame, firms: DataFrame, side: str) -> DataFrame:
    """``(company, partner, amount, share)`` for each of ``firms(company)``.

    ``side`` 'customer': partners buy from the firm, share of their purchases;
    'supplier': partners sell to it, share of their sales.
    """
    own, other = {"customer": ("src", "dst"), "supplier": ("dst", "src")}[side]
    pairs = edges.groupBy("src", "dst").agg(F.sum("sly_amt").alias("amount"))
    total = pairs.groupBy(other).agg(F.sum("amount").alias("total"))
    mine = pairs.join(firms.select(F.col("company").alias(own)).distinct(), own, "left_semi")
    return mine.join(total, other).select(F.col(own).alias("company"), F.col(other).alias("partner"), "amount", (F.col("amount") / F.col("total")).alias("share"))


def firm_amounts(edges: DataFrame, firms: DataFrame) -> DataFrame:
    """``(company, sold, bought)`` for each of ``firms(company)``, 0 where nothing is known."""
    sold = edges.groupBy(F.col("src").alias("company")).agg(F.sum("sly_amt").alias("sold"))
    bought = edges.groupBy(F.col("dst").alias("company")).agg(F.sum("sly_amt").alias("bought"))
    return firms.select("company").distinct().join(sold, "company", "left").join(bought, "company", "left").na.fill(0.0, ["sold", "bought"])


def edge_stats(edges: DataFrame) -> DataFrame:
    """``(node, customers, suppliers, max_out, max_in)`` of each node of the edges."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("customers"), F.max("sly_amt").alias("max_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("suppliers"), F.max("sly_amt").alias("max_in"))
    return out.join(into, "node", "full").na.fill(0).select("node", "customers", "suppliers", "max_out", "max_in")


def estimates(firms: DataFrame, edges: DataFrame) -> DataFrame:
    """``firms(company, sales, purchases)`` with nulls filled from the edges' totals."""
    got = firm_amounts(edges, firms)
    return firms.join(got, "company", "left").select("company", F.coalesce("sales", "sold").alias("sales"), F.coalesce("purchases", "bought").alias("purchases"))


def largest_outflow(rates: DataFrame) -> DataFrame:
    """One row: the largest sum of a source's rates; above 1 a propagation may diverge."""
    return rates.groupBy("src").agg(F.sum("rate").alias("total")).agg(F.max("total").alias("largest"))


def latest_edges(edges: DataFrame) -> DataFrame:
    """One row for each pair: that of the latest year."""
    return edges.groupBy("src", "dst").agg(F.max(F.struct("trade_year", "sly_amt")).alias("last")).select("src", "dst", "last.trade_year", F.coalesce("last.sly_amt", F.lit(1.0)).alias("weight"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in ``nodes(node)``."""
    keys = nodes.select("node").distinct()
    return edges.join(keys.withColumnRenamed("node", "src"), "src", "left_semi").join(keys.withColumnRenamed("node", "dst"), "dst", "left_semi")


def induced_shares(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Induced positive edges with ``sub_total`` (of those) and ``full_total`` (of all of the source's edges)."""
    full = edges.groupBy("src").agg(F.sum("amount").alias("full_total"))
    kept = induced(edges, nodes).where("amount > 0")
    return kept.withColumn("sub_total", F.sum("amount").over(Window.partitionBy("src"))).join(full, "src")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with rows of ``updates`` in place of those of the same key; of repeated updates the greatest row holds."""
    rest = [c for c in target.columns if c not in keys]
    fresh = updates.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("u")).select(*keys, *[F.col(f"u.{c}").alias(c) for c in rest])
    return target.join(fresh.select(*keys), keys, "left_anti").select(*target.columns).unionByName(fresh.select(*target.columns))


def update_columns(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``target`` with ``columns`` replaced where ``updates`` has the key and a value."""
    new = updates.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = target.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def matrix(edges: DataFrame, targets: list) -> DataFrame:
    """Sources as rows, the named ``targets`` as columns ``d<target>``, the summed rate as cell, null where there is none."""
    wide = edges.groupBy("src").pivot("dst", targets).agg(F.sum("rate"))
    return wide.select("src", *[F.col(f"`{t}`").alias(f"d{t}") for t in targets])


def firm_page(firms: DataFrame, sort_key: str, number: int, size: int = 20, firm: str = "firm") -> DataFrame:
    """Page ``number`` of ``firms`` by ``sort_key``, greatest first, nulls last, ties by firm, with ``place`` and ``total``.

    The order is made once over all partitions; the page is read from its own.
    """
    order = in_order(firms, F.desc_nulls_last(sort_key), firm)
    return order.page(number, size).withColumn("total", F.lit(order.total).cast("long"))
