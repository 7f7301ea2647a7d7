"""What enters a run: graphs of a year, rate triples, seeds; and the links a run leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.text import require, split_valid

#: Edge columns that may serve as weights.
WEIGHTS = ("sly_amt", "trade_cnt", "taxbll_cnt", "tamt_amt", "taxfr_amt")

#: Names under which the three parts of a triple may come.
TRIPLE = {"from": ("from", "from_", "p1"), "to": ("to", "p2"), "rate": ("rate", "w", "w1")}


def edges_of_year(edges: DataFrame, year: int | None = None) -> DataFrame:
    """All edges, or those of one year; the filter reaches the scan."""
    return edges if year is None else edges.where(F.col("trade_year") == F.lit(year))


def weighted_edges(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Edges with ``weight``: a listed column, 1 where it is null or none is asked for; other names are an error."""
    if weight is not None and weight not in WEIGHTS:
        raise ValueError(f"unknown weight {weight!r}; known: {WEIGHTS}")
    value = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    return (edges if weight is None else require(edges, [weight])).withColumn("weight", value)


def graph_of_year(nodes: DataFrame, edges: DataFrame, year: int | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes, those that only edges name included (null attributes), and weighted edges of a year."""
    kept = weighted_edges(edges_of_year(edges, year), weight)
    ends = kept.select(F.col("src").alias("node")).unionByName(kept.select(F.col("dst").alias("node")))
    return nodes.select("node").unionByName(ends).distinct().join(nodes, "node", "left"), kept


def firm_tables(firms: DataFrame, in_sector: DataFrame, relations: dict[str, DataFrame], year: int) -> dict[str, DataFrame]:
    """Firms with their sector, the firm's own before the linked one, and each relation's rows of a year.

    ``in_sector(firm, sector)`` holds several rows for a firm only if it has
    several sectors; the least counts.
    """
    linked = in_sector.groupBy("firm").agg(F.min("sector").alias("linked"))
    out = firms.join(linked, "firm", "left").withColumn("sector", F.coalesce("sector", "linked")).drop("linked")
    return {"firms": out} | {name: df.where(F.col("year") == F.lit(year)) for name, df in relations.items()}


def norm_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(src, dst, rate)`` from any of the known column names, and the rows that lack a part, with a reason.

    The first filled name counts; an end that is blank is missing. A part
    without any column is an error before a job runs.
    """
    parts = {}
    for part, names in TRIPLE.items():
        found = [F.col(f"`{n}`").cast("string") for n in names if n in triples.columns]
        if not found:
            raise ValueError(f"no column for {part}: {names}")
        parts[part] = F.coalesce(*[c if part == "rate" else F.nullif(c, F.lit("")) for c in found])
    flat = triples.select(parts["from"].alias("src"), parts["to"].alias("dst"), parts["rate"].try_cast("double").alias("rate"))
    return split_valid(flat, {f"no {n}": F.col(n).isNotNull() for n in ("src", "dst", "rate")})


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def seed_rules(kind: str) -> dict[str, Column]:
    """Rules of tariff seeds ``(node, company, amount, codes, rate, year)`` or volume seeds ``(node, amount, rate)``, first broken one first."""
    amount = F.col("amount").cast("double")
    rules = {
        "no node": F.col("node").isNotNull(),
        "amount below 0": _finite(amount) & (amount >= 0),
        "rate not finite": _finite(F.col("rate").cast("double")),
    }
    if kind == "volume":
        return rules
    if kind != "tariff":
        raise ValueError("kind must be 'tariff' or 'volume'")
    return rules | {
        "no company": F.col("company").isNotNull(),
        "no code": F.size("codes") > 0,
        "code not of 10 digits": F.forall("codes", lambda c: F.coalesce(c.rlike(r"\A[0-9]{10}\z"), F.lit(False))),
        "year not of 4 digits": F.col("year").cast("string").rlike(r"\A[0-9]{4}\z"),
    }


def checked_seeds(seeds: DataFrame, kind: str = "tariff") -> tuple[DataFrame, DataFrame]:
    """Seeds that meet every rule, and the others with the first rule that they break."""
    return split_valid(seeds, seed_rules(kind))


def impact_links(impact: DataFrame, firms: DataFrame, runs: DataFrame, scenarios: DataFrame) -> dict[str, DataFrame]:
    """``impacts`` of known runs on known firms, one for each (run, firm), and ``executed_as`` between known scenarios and their runs.

    ``runs(run_id, scenario_id)``; a run without scenario has no link. Of rows
    that share a run and firm the greatest row, column by column, counts.
    """
    rest = [c for c in impact.columns if c not in ("run_id", "firm")]
    one = impact.groupBy("run_id", "firm").agg(F.max(F.struct(*rest)).alias("row")).select("run_id", "firm", "row.*")
    hit = one.join(firms.select("firm").distinct(), "firm", "left_semi").join(runs.select("run_id").distinct(), "run_id", "left_semi")
    link = runs.where("scenario_id IS NOT NULL").join(scenarios.select("scenario_id").distinct(), "scenario_id", "left_semi")
    return {"impacts": hit, "executed_as": link.select("scenario_id", "run_id").distinct()}
