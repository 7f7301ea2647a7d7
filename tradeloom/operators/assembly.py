"""One call from seed firms to the input of a propagation, and volume scenarios on it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.text import node_id, split_valid
from tradeloom.operators.edges import in_shares, partner_shares
from tradeloom.operators.exposure import companies_of_codes
from tradeloom.operators.graph import reach
from tradeloom.operators.propagate import propagate
from tradeloom.operators.scenario import assemble
from tradeloom.session import durable

#: The direction in which a change of a side spreads, and the partners on that side.
SIDES = {"sales": ("downstream", "customer"), "purchase": ("upstream", "supplier")}


@dataclass
class Assembled:
    """``edges(src, dst, rate)`` and ``init(node, value)`` by node id, ``nodes(node, bizno, code, name, is_seed, value)``, and warnings."""

    edges: DataFrame
    init: DataFrame
    nodes: DataFrame
    warnings: list[str] = field(default_factory=list)


def propagation_input(
    edges: DataFrame,
    seeds: DataFrame,
    firms: DataFrame,
    depth: int = 3,
    year: int | None = None,
    within: bool = True,
    damping: float = 0.85,
    direction: str = "downstream",
    weight: float = 1.0,
    normalise: str = "source",
    factors: DataFrame | None = None,
    mix: DataFrame | None = None,
    chapters: list[str] | None = None,
) -> Assembled:
    """The rate graph around ``seeds(bizno, value)``: undirected reach to ``depth``, its induced edges, and rates by node id.

    ``edges(src, dst, trade_year, sly_amt)`` are those of ``year`` or of all
    years. With ``chapters``, only firms whose ``mix(company, code)`` touches
    one take part, at every step; totals of all a firm's edges (``within``
    False) still count the others. ``factors(src, dst, factor)`` multiply the
    rates of stored edges, the product counting if a pair repeats. ``firms(bizno,
    code, name)`` give the second half of a node's id, the least code of a
    firm; firms without one have the id ``bizno|``. Seeds of one firm add
    up once each; a null or blank seed is none.
    """
    if not 0 < damping <= 1:
        raise ValueError(f"damping must be over 0 and at most 1: {damping}")
    if normalise not in ("source", "target", "none"):
        raise ValueError(f"unknown normalisation {normalise!r}")
    if weight <= 0:
        raise ValueError(f"weight must be positive: {weight}")
    warnings = []
    if normalise != "none" and weight * damping > 1:
        warnings.append(f"weight x damping is {weight * damping:.3f}, over 1: the run may diverge")
    if normalise != "source":
        warnings.append(f"normalise={normalise}: outgoing rates may sum to over 1, convergence is not certain")
    start = durable(seeds.select(F.trim(F.col("bizno").cast("string")).alias("node"), "value").where("node <> ''").groupBy("node").agg(F.sum("value").alias("value")))
    used = edges if year is None else edges.where(F.col("trade_year") == F.lit(year))
    pairs = used.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "sly_amt").groupBy("src", "dst").agg(F.sum("sly_amt").alias("amount"))
    pairs = durable(pairs)
    if start.isEmpty():
        warnings.append("no seeds")
    walked, kept = pairs, start
    if chapters is not None:
        if mix is None:
            raise ValueError("chapters need a product mix")
        allowed = durable(companies_of_codes(mix, chapters).select(F.col("company").cast("string").alias("node")))
        kept = durable(start.join(allowed, "node", "left_semi"))
        if left := start.count() - kept.count():
            warnings.append(f"{left} seeds are outside the chosen industry")
        ends = lambda c: allowed.withColumnRenamed("node", c)
        walked = durable(pairs.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi"))
    around = durable(reach(walked, kept.select("node"), depth).select("node"))
    rates = assemble(walked if within else pairs, around, direction, normalise, damping, weight, within)
    if factors is not None:
        # an edge that was turned round is known by its stored ends
        stored = ("src", "dst") if direction == "downstream" else ("dst", "src")
        by = factors.select(F.col("src").cast("string").alias(stored[0]), F.col("dst").cast("string").alias(stored[1]), "factor").groupBy("src", "dst").agg(F.product("factor").alias("factor"))
        rates = rates.join(by, ["src", "dst"], "left").withColumn("rate", F.col("rate") * F.coalesce("factor", F.lit(1.0)))
    rates = durable(rates.where("rate > 0").select("src", "dst", "rate"))
    if chapters is not None and rates.isEmpty():
        warnings.append("no edge of the chosen industry")
    known = firms.select(F.trim(F.col("bizno").cast("string")).alias("bizno"), "code", "name").groupBy("bizno").agg(F.min(F.struct(F.col("code").isNull().alias("none"), "code", "name")).alias("f"))
    met = kept.select("node").unionByName(rates.select(F.col("src").alias("node"))).unionByName(rates.select(F.col("dst").alias("node"))).distinct()
    nodes = met.withColumnRenamed("node", "bizno").join(known, "bizno", "left").join(kept.withColumnRenamed("node", "bizno"), "bizno", "left")
    nodes = durable(nodes.select(node_id(F.col("bizno"), F.col("f.code")).alias("node"), "bizno", F.col("f.code").alias("code"), F.col("f.name").alias("name"), F.col("value").isNotNull().alias("is_seed"), F.coalesce("value", F.lit(0.0)).alias("value")))
    if bare := nodes.where("code IS NULL").count():
        warnings.append(f"{bare} firms have no code: their ids end with a bar")
    ids = nodes.select("bizno", "node")
    named = rates.join(ids.select(F.col("bizno").alias("src"), F.col("node").alias("s")), "src").join(ids.select(F.col("bizno").alias("dst"), F.col("node").alias("d")), "dst")
    init = nodes.where("is_seed").select("node", "value")
    return Assembled(named.select(F.col("s").alias("src"), F.col("d").alias("dst"), "rate"), init, nodes, warnings)


def checked_specs(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Volume changes ``(bizno, side, factor, partner)`` that can be run, and the others with a reason."""
    factor = F.col("factor").cast("double")
    finite = factor.isNotNull() & ~F.isnan(factor) & (F.abs(factor) < F.lit(float("inf")))
    return split_valid(specs, {"no firm": F.coalesce(F.trim("bizno"), F.lit("")) != "", "side": F.col("side").isin(*SIDES), "factor": finite & (factor >= 0)})


def spec_deltas(edges: DataFrame, specs: DataFrame, side: str, year: int | None = None) -> DataFrame:
    """``(bizno, value)``: what the changes of one side put on the firms' partners, the partner's share times ``factor - 1``, added up.

    Without ``partner`` a change holds for all partners of the firm on that side.
    """
    used = (edges if year is None else edges.where(F.col("trade_year") == F.lit(year))).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "sly_amt")
    mine = durable(specs.where(F.col("side") == side).select(F.trim("bizno").alias("company"), F.nullif(F.trim("partner"), F.lit("")).alias("only"), F.col("factor").cast("double").alias("factor")))
    shares = partner_shares(used, mine.select("company"), SIDES[side][1]).join(mine, "company")
    return shares.where(F.col("only").isNull() | (F.col("only") == F.col("partner"))).groupBy(F.col("partner").alias("bizno")).agg(F.sum(F.col("share") * (F.col("factor") - 1)).alias("value"))


def volume_scenario(
    edges: DataFrame,
    seeds: DataFrame,
    firms: DataFrame,
    specs: DataFrame | None = None,
    multipliers: DataFrame | None = None,
    edge_multipliers: DataFrame | None = None,
    directions: tuple[str, ...] = ("downstream", "upstream"),
    weights: tuple[float, float] = (1.0, 1.0),
    pin: bool = True,
    epsilon: float = 1e-8,
    **assembly,
) -> tuple[DataFrame, list[str]]:
    """``(direction, node, bizno, value)``: by what factor each firm's volume changes, 1 being no change; and warnings.

    The deviations are ``multiplier - 1`` on seeds (``multipliers(bizno,
    multiplier)``), share times ``factor - 1`` on the buyers of single edges
    (``edge_multipliers(src, dst, factor)``) and on the partners of firms
    (``specs``, which alone settle the directions then). They are propagated once, 1 is
    added. ``pin`` drops edges into all firms that hold a deviation, seeds with
    none included, so that these stay at their input. Deviations of firms
    outside the graph are left out with a warning; ``assembly`` goes to
    :func:`propagation_input`.
    """
    warnings: list[str] = []
    if specs is not None:
        specs, bad = checked_specs(specs)
        specs = durable(specs)
        warnings += [f"{r.n} changes left out: {r.reason}" for r in bad.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").collect()]
        present = {r.side for r in specs.select("side").distinct().collect()}
        directions = tuple(SIDES[s][0] for s in SIDES if s in present) or directions
    if specs is None and multipliers is None and edge_multipliers is None:
        warnings.append("nothing changes")
    year = assembly.get("year")
    base = seeds.select(F.trim(F.col("bizno").cast("string")).alias("bizno")).distinct()
    own = base.withColumn("value", F.lit(0.0))
    if multipliers is not None:
        own = base.join(multipliers.groupBy("bizno").agg(F.max("multiplier").alias("m")), "bizno", "left").select("bizno", (F.coalesce("m", F.lit(1.0)) - 1).alias("value"))
    out = None
    for d in directions:
        graph = propagation_input(edges, own, firms, direction=d, weight=weights[0] if d == "downstream" else weights[1], **assembly)
        warnings += [f"{d}: {w}" for w in graph.warnings]
        parts = []
        if edge_multipliers is not None:
            used = (edges if year is None else edges.where(F.col("trade_year") == F.lit(year))).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "sly_amt")
            held = in_shares(used, edge_multipliers).join(edge_multipliers, ["src", "dst"])
            parts.append(held.groupBy(F.col("dst").alias("bizno")).agg(F.sum(F.col("share") * (F.col("factor") - 1)).alias("value")))
        if specs is not None:
            parts += [spec_deltas(edges, specs, s, year) for s in SIDES if SIDES[s][0] == d]
        init = graph.init
        for part in parts:
            part = durable(part)
            if lost := part.join(graph.nodes, "bizno", "left_anti").count():
                warnings.append(f"{d}: {lost} firms with a change are outside the graph")
            init = init.unionByName(part.join(graph.nodes.select("bizno", "node"), "bizno").select("node", "value"))
        init = durable(init.groupBy("node").agg(F.sum("value").alias("value")))
        arcs = graph.edges.join(init.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "rate") if pin else graph.edges
        values = propagate(durable(arcs), init, epsilon).values.join(graph.nodes.select("node", "bizno"), "node")
        rows = values.select(F.lit(d).alias("direction"), "node", "bizno", (F.col("value") + 1).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out, warnings
