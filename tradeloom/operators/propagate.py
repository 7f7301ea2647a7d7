"""Propagation of amounts over rate edges: round by round, in closed form, and as a linear solve."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.contraction import WORTH, runs, ways
from tradeloom.operators.graph import nodes_of, strong_components
from tradeloom.operators.rounds import AT_ONCE, advance
from tradeloom.session import discard, durable


#: A spectral radius this close to 1 counts as 1, for components of any size.
RADIUS_SLACK = 1e-9


@dataclass
class Propagated:
    values: DataFrame  # node, value
    rounds: int
    converged: bool
    total: float
    table: list[tuple[int, float, float, float]]  # round, sum of the term, running sum, largest term


def propagate(edges: DataFrame, init: DataFrame, epsilon: float = 1e-8, max_iter: int = 500) -> Propagated:
    """``sum over k of R^k init`` with ``edges(src, dst, rate)`` and ``init(node, value)``.

    Contributions whose size is at most ``epsilon`` are cut edge by edge.
    ``rounds`` counts rounds that moved something; reaching ``max_iter`` means
    not converged. All nodes of ``init`` are in the result.
    """
    arcs = durable(edges.groupBy("src", "dst").agg(F.sum("rate").alias("rate")))
    start = durable(init.groupBy("node").agg(F.sum("value").alias("value")))

    def one_round(term: DataFrame) -> DataFrame:
        sent = term.join(arcs, term.node == arcs.src).select(F.col("dst").alias("node"), (F.col("value") * F.col("rate")).alias("value")).where(F.abs("value") > epsilon)
        return sent.groupBy("node").agg(F.sum("value").alias("value"))

    term, total, made = start, start, [start]
    table, converged = [], False
    running = float(start.agg(F.sum("value")).first()[0] or 0.0)
    while not converged and len(table) < max_iter:
        asked = min(AT_ONCE, max_iter - len(table))
        terms, before = advance(term, one_round, len(table) + 1, asked), len(table)
        made.append(terms)
        for r in terms.groupBy("round").agg(F.sum("value").alias("s"), F.max(F.abs("value")).alias("most")).orderBy("round").collect():
            running += r.s
            table.append((r.round, r.s, running, r.most))
        total = total.unionByName(terms.select("node", "value"))
        term = terms.where(F.col("round") == len(table)).select("node", "value")
        converged = len(table) - before < asked  # a round moved nothing
        if len(made) > 16:  # keeps the final sum's plan short
            total = durable(total.groupBy("node").agg(F.sum("value").alias("value")))
            for used in made[:-1]:
                discard(used)
            made = [total, made[-1]]
    values = durable(total.groupBy("node").agg(F.sum("value").alias("value")))
    for used in (arcs, *made):
        discard(used)
    return Propagated(values, len(table), converged, running, table)


def fixed_rounds(edges: DataFrame, init: DataFrame, rounds: int, columns: list[str] = ("value",), include_start: bool = True) -> DataFrame:
    """``sum over k <= rounds of W^k v`` for several vectors at once, without a stop test."""
    arcs = durable(edges.groupBy("src", "dst").agg(F.sum("rate").alias("rate")))
    sums = [F.sum(c).alias(c) for c in columns]
    start = durable(init.groupBy("node").agg(*sums))

    def one_round(term: DataFrame) -> DataFrame:
        return term.join(arcs, term.node == arcs.src).groupBy(F.col("dst").alias("node")).agg(*[F.sum(F.col(c) * F.col("rate")).alias(c) for c in columns])

    term, total, made = start, start if include_start else start.limit(0), [arcs, start]
    for done in range(0, rounds, AT_ONCE):
        terms = advance(term, one_round, done + 1, min(AT_ONCE, rounds - done))
        term = terms.where(F.col("round") == done + AT_ONCE).drop("round")
        total = durable(total.unionByName(terms.drop("round")).groupBy("node").agg(*sums))
        made += [terms, total]
    out = durable(total.groupBy("node").agg(*sums))
    for used in made:
        discard(used)
    return out


def _block(pdf, damping: float):
    """Solve a set of whole components: x = (I - M)^-1 b, each component's own rates damped while its spectral radius is 1 or more.

    ``pdf`` has nodes (``kind`` node: node, value, component) and rates (``kind``
    edge: from ``node`` to ``dst``, ``component`` null between components).
    """
    import pandas as pd

    nodes = pdf.loc[pdf["kind"] == "node"]
    place = {k: i for i, k in enumerate(nodes["node"])}
    m, b = np.zeros((len(place), len(place))), nodes["value"].to_numpy(float)
    edges = pdf.loc[pdf["kind"] == "edge"]
    np.add.at(m, (edges["dst"].map(place).to_numpy(int), edges["node"].map(place).to_numpy(int)), edges["value"].to_numpy(float))
    damped = np.zeros(len(place), np.int64)
    inside = set(edges["component"].dropna())
    for component, mine in nodes.reset_index(drop=True).groupby("component").groups.items():
        if component in inside:
            at = np.ix_(mine, mine)
            while np.abs(np.linalg.eigvals(m[at])).max() >= 1 - RADIUS_SLACK:
                m[at] *= damping
                damped[mine] += 1
    x = np.linalg.solve(np.eye(len(m)) - m, b)
    return pd.DataFrame({"node": nodes["node"].to_numpy(), "value": x, "damped": damped})


def _in_blocks(nodes: DataFrame, rates: DataFrame, group: Column, damping: float) -> DataFrame:
    """``(node, value, damped)`` of ``nodes(node, component, value)`` and ``rates(src, dst, rate, component)``, each ``group`` solved in one task."""
    kind = dict(nodes.dtypes)["node"]
    one = nodes.select(group.alias("g"), F.lit("node").alias("kind"), "node", F.col("node").alias("dst"), "value", "component")
    two = rates.select(group.alias("g"), F.lit("edge").alias("kind"), F.col("src").alias("node"), "dst", F.col("rate").alias("value"), "component")
    return one.unionByName(two).groupBy("g").applyInPandas(lambda pdf: _block(pdf, damping), f"node {kind}, value double, damped long")


def _ready(here: DataFrame, own: DataFrame, damping: float, block_limit: int, epsilon: float, max_iter: int) -> DataFrame:
    """``(node, value, damped)`` of whole components ``here(node, component, size, plain, value)`` whose inflow is complete."""
    nothing = F.lit(0).cast("long").alias("damped")
    live = here.where("NOT plain").groupBy("component", "size").agg(F.max(F.abs("value")).alias("most")).where("most > 0").select("component", "size")
    live = durable(live)
    if live.isEmpty():
        return here.select("node", "value", nothing)
    still = here.join(live, "component", "left_anti").select("node", "value", nothing)
    small, big = live.where(F.col("size") <= block_limit).select("component"), live.where(F.col("size") > block_limit).select("component")
    part = still.unionByName(_in_blocks(here.join(small, "component", "left_semi"), own.join(small, "component", "left_semi"), F.col("component"), damping))
    if not big.isEmpty():
        rates = durable(own.join(big, "component", "left_semi"))
        b = durable(here.join(big, "component", "left_semi").select("component", "node", "value"))
        times = durable(damping_times(rates, damping))
        damped = rates.join(times, "component").select(F.col("dst").alias("i"), F.col("src").alias("j"), (F.col("rate") * F.pow(F.lit(damping), "damped")).alias("w"))
        solved = solve(damped, b.select(F.col("node").alias("i"), F.col("value").alias("b")), epsilon, max_iter)
        part = part.unionByName(solved.withColumnsRenamed({"i": "node", "x": "value"}).join(b.select("node", "component"), "node").join(times, "component").select("node", "value", "damped"))
    return part


def _without(table: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        table = table.join(nodes.select(F.col("node").alias(c)), c, "left_anti")
    return table


def _lightened(state: DataFrame, across: DataFrame, least: int) -> tuple[DataFrame, DataFrame, list]:
    """The state and the arcs between components without runs and ends of plain nodes, and the layers to put back.

    A layer is ``(arcs into the ends, the ends, the runs)``.
    """
    layers: list = []
    while (n := state.count()) > least:
        at = durable(state.join(ways(across), "node", "left").na.fill(0, ["n_in", "n_out"]))
        ends, unary = at.agg(F.count_if(F.col("plain") & (F.col("n_out") == 0)), F.count_if(F.col("plain") & (F.col("n_in") == 1) & (F.col("n_out") == 1))).first()
        if ends + unary < WORTH * n:
            discard(at)
            break
        made = runs(at.where("plain AND n_in = 1 AND n_out = 1"))
        gone = made.table.select("node")
        bypass = made.exits.select(F.col("entry").alias("src"), F.col("exit").alias("dst"), F.col("c").alias("rate"))
        arcs = _without(across, gone, "src", "dst").select("src", "dst", "rate").unionByName(bypass).groupBy("src", "dst").agg(F.sum("rate").alias("rate"))
        arcs = durable(arcs)
        sent = made.exits.groupBy(F.col("exit").alias("node")).agg(F.sum("a").alias("sent"))
        left = durable(_without(at, gone, "node").join(sent, "node", "left").select("node", "component", "size", "plain", (F.col("value") + F.coalesce("sent", F.lit(0.0))).alias("value"), (F.col("plain") & (F.col("n_out") == 0)).alias("ends")))
        last = left.where("ends").select("node", "value")
        into = durable(arcs.join(last.select(F.col("node").alias("dst")), "dst", "left_semi"))
        layers.append((into, left, made))
        old = (state, across)
        state, across = durable(left.where("NOT ends").drop("ends")), durable(_without(arcs, last, "dst"))
        for used in (at, arcs, *old):
            discard(used)
    return state, across, layers


def propagate_closed(edges: DataFrame, init: DataFrame, damping: float = 0.95, block_limit: int = 2000, epsilon: float = 1e-12, max_iter: int = 2000) -> DataFrame:
    """``(node, value, damped)`` by strong components, upstream first; values rounded to 6 digits, zeros dropped.

    Nodes on no cycle that have one way in and out, or no way out, are taken
    out first and put back at the end, so long chains cost a few jobs. Of the
    rest, all components whose inflow is complete are solved together, until
    ``block_limit`` nodes are left, which one task finishes.

    Components up to ``block_limit`` nodes are solved each in one task. A larger
    one never meets in one task: its spectral radius comes from bounds that
    close round by round, its rates are damped by themselves, as a block's are,
    and its system is solved by iteration.
    """
    arcs = durable(edges.groupBy("src", "dst").agg(F.sum("rate").alias("rate")))
    start = durable(init.groupBy("node").agg(F.sum("value").alias("value")))
    scc = strong_components(arcs, finish=block_limit)
    of = lambda side, name: scc.select(F.col("node").alias(side), F.col("component").alias(name))
    inside = durable(arcs.join(of("src", "component"), "src").join(of("dst", "c2"), "dst"))
    own = inside.where("component = c2").select("src", "dst", "rate", "component")
    across = durable(inside.where("component <> c2").select("src", "dst", "rate"))
    cyclic = own.select("component").distinct().withColumn("plain", F.lit(False))
    state = scc.join(start, "node", "left").join(cyclic, "component", "left")
    state = durable(state.select("node", "component", "size", F.coalesce("plain", F.lit(True)).alias("plain"), F.coalesce("value", F.lit(0.0)).alias("value")))
    state, across, layers = _lightened(state, across, block_limit)

    parts: list[DataFrame] = []
    missing = across.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("missing"))
    state = durable(state.join(missing, "node", "left").na.fill(0, ["missing"]))
    arcs_left = across.count()
    met = 0
    while n := state.count():
        if n <= block_limit:
            still = state.select(F.col("node").alias("src"))
            rates = own.join(still, "src", "left_semi").unionByName(across.join(still, "src", "left_semi").withColumn("component", F.lit(None)))
            parts.append(durable(_in_blocks(state, rates, F.lit(0), damping)))
            break
        complete = durable(state.groupBy("component").agg(F.sum("missing").alias("missing")).where("missing = 0").select("component"))
        part = durable(_ready(durable(state.join(complete, "component", "left_semi")), own, damping, block_limit, epsilon, max_iter))
        flow = durable(part.join(across, part.node == across.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("value") * F.col("rate")).alias("came"), F.count("*").alias("n")))
        rest = state.join(complete, "component", "left_anti").join(flow, "node", "left")
        old, state = state, durable(rest.select("node", "component", "size", "plain", (F.col("value") + F.coalesce("came", F.lit(0.0))).alias("value"), (F.col("missing") - F.coalesce("n", F.lit(0))).alias("missing")))
        parts.append(part)
        met += flow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        for used in (old, complete, flow):
            discard(used)
        if 2 * met > arcs_left:  # arcs that were used go once they are half of all
            used, across = across, durable(across.join(state.select(F.col("node").alias("src")), "src", "left_semi"))
            discard(used)
            arcs_left, met = arcs_left - met, 0

    values = reduce(DataFrame.unionByName, parts) if parts else scc.limit(0).select("node", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("damped"))
    nothing = F.lit(0).cast("long").alias("damped")
    for into, left, made in reversed(layers):
        came = into.join(values, into.src == values.node).groupBy("dst").agg(F.sum(F.col("value") * F.col("rate")).alias("came"))
        ends = left.where("ends").select("node", F.col("value").alias("b")).join(came.withColumnRenamed("dst", "node"), "node", "left").select("node", (F.col("b") + F.coalesce("came", F.lit(0.0))).alias("value"), nothing)
        values = durable(values.unionByName(ends))
        entry = values.select(F.col("node").alias("entry"), F.col("value").alias("first"))
        values = durable(values.unionByName(made.nodes.join(entry, "entry").select("node", (F.col("a") + F.col("c") * F.col("first")).alias("value"), nothing)))
    lonely = start.join(scc, "node", "left_anti").select("node", "value", nothing)
    out = durable(values.unionByName(lonely).select("node", F.round("value", 6).alias("value"), "damped").where("value <> 0"))
    for used in (arcs, start, scc, inside, across, state, *parts, *[t for into, left, made in layers for t in (into, left, made.table)]):
        discard(used)
    return out


def damping_times(rates: DataFrame, damping: float, tolerance: float = RADIUS_SLACK, max_rounds: int = 4000) -> DataFrame:
    """``(component, damped)``: how often each strong component of ``rates(component, src, dst, rate)`` is damped until its spectral radius is under 1.

    Power iteration on I + M, whose least and greatest growth bound the radius
    of a component with non-negative rates; it ends when either bound gives the
    same count. A radius within ``tolerance`` of 1 counts as 1. Bounds that
    don't close are an error.
    """
    arcs = durable(rates.select("component", "src", "dst", "rate"))
    ends = arcs.select("component", F.col("src").alias("node")).unionByName(arcs.select("component", F.col("dst").alias("node"))).distinct()
    state = durable(ends.withColumn("x", F.lit(1.0)).withColumn("growth", F.lit(0.0)))

    def one_round(now: DataFrame) -> DataFrame:
        came = now.join(arcs.drop("component"), now.node == arcs.src).select("component", F.col("dst").alias("node"), (F.col("x") * F.col("rate")).alias("y"), F.lit(0.0).alias("x"))
        y = now.select("component", "node", F.col("x").alias("y"), "x").unionByName(came).groupBy("component", "node").agg(F.sum("y").alias("y"), F.sum("x").alias("x"))
        return y.select("component", "node", F.col("y").alias("x"), (F.col("y") / F.col("x")).alias("growth"))

    def times(growth: str):
        """The least k with radius * damping ** k under 1."""
        radius = F.col(growth) - 1
        over = F.floor(F.log(F.greatest(radius, F.lit(1.0)) + tolerance) / -F.log(F.lit(damping))) + 1
        return F.when(radius < 1 - tolerance, 0).otherwise(over).cast("long")

    for done in range(0, max_rounds, AT_ONCE):
        after = advance(state, one_round, done + 1)
        last = after.where(F.col("round") == done + AT_ONCE)
        bounds = durable(last.groupBy("component").agg(F.min("growth").alias("low"), F.max("growth").alias("high"), F.max("x").alias("most")))
        if bounds.where((F.col("high") - F.col("low") > tolerance) & (times("low") != times("high"))).isEmpty():
            discard(state)
            discard(after)
            return bounds.select("component", times("high").alias("damped"))
        scaled = durable(last.join(bounds.select("component", "most"), "component").select("component", "node", (F.col("x") / F.col("most")).alias("x"), "growth"))
        for used in (state, after, bounds):
            discard(used)
        state = scaled
    raise RuntimeError(f"spectral radii aren't known after {max_rounds} rounds")


def dispatch(method: str, edges: DataFrame, init: DataFrame, **options) -> DataFrame:
    """``(node, value)`` by 'iterative' or 'closed'; options of the other method are dropped."""
    if method == "iterative":
        return propagate(edges, init, **{k: v for k, v in options.items() if k in ("epsilon", "max_iter")}).values
    if method == "closed":
        return propagate_closed(edges, init, **{k: v for k, v in options.items() if k in ("damping", "block_limit")}).select("node", "value")
    raise ValueError("method must be 'iterative' or 'closed'")


def spectral_radius(edges: DataFrame, rounds: int = 30) -> float:
    """An estimate for non-negative rates by power iteration on I + M, minus 1, so that periodic blocks settle too."""
    arcs = durable(edges.select("src", "dst", "rate"))
    state = durable(nodes_of(arcs).withColumn("x", F.lit(1.0)))

    def one_round(now: DataFrame) -> DataFrame:
        came = now.join(arcs, now.node == arcs.src).select(F.col("dst").alias("node"), (F.col("x") * F.col("rate")).alias("x"))
        return now.select("node", "x").unionByName(came).groupBy("node").agg(F.sum("x").alias("x"))

    most = before = 1.0
    for done in range(0, rounds, AT_ONCE):
        n = min(AT_ONCE, rounds - done)
        after = advance(state, one_round, done + 1, n)
        tops = {r.round: r.top for r in after.groupBy("round").agg(F.max("x").alias("top")).collect()}
        if not tops:
            return 0.0
        before, most = tops.get(done + n - 1, 1.0), tops[done + n]
        old, state = state, durable(after.where(F.col("round") == done + n).select("node", (F.col("x") / most).alias("x")))
        discard(old)
        discard(after)
    discard(arcs)
    discard(state)
    return most / before - 1.0


def row_normalise(edges: DataFrame) -> DataFrame:
    """Rows (sources) whose absolute sum is over 1 are scaled to 1; the others stay."""
    total = edges.groupBy("src").agg(F.sum(F.abs("rate")).alias("total"))
    return edges.join(total, "src").select("src", "dst", F.when(F.col("total") > 1, F.col("rate") / F.col("total")).otherwise(F.col("rate")).alias("rate"))


def solve(matrix: DataFrame, b: DataFrame, tolerance: float = 1e-10, max_iter: int = 200) -> DataFrame:
    """``(i, x)`` of ``(I - M) x = b`` by BiCGSTAB; ``matrix(i, j, w)``, ``b(i, b)``. The driver holds the dot products of a round.

    A breakdown falls back to the Neumann sum; without convergence that is an error.
    """
    m = durable(matrix.groupBy("i", "j").agg(F.sum("w").alias("w")))
    rows = b.groupBy("i").agg(F.sum("b").alias("b")).unionByName(m.select("i", F.lit(0.0).alias("b"))).unionByName(m.select(F.col("j").alias("i"), F.lit(0.0).alias("b"))).groupBy("i").agg(F.sum("b").alias("b"))

    def times(state: DataFrame, column: str) -> DataFrame:
        """(I - M) applied to a column of the state."""
        got = m.join(state.select(F.col("i").alias("j"), F.col(column).alias("v")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("v")).alias("mv"))
        return state.join(got, "i", "left").withColumn("out", F.col(column) - F.coalesce("mv", F.lit(0.0))).drop("mv")

    s = durable(rows.select("i", F.lit(0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("r0"), F.col("b").alias("p")))
    norm, rho = (float(v or 0.0) for v in s.agg(F.sqrt(F.sum(F.col("r0") ** 2)), F.sum(F.col("r0") * F.col("r"))).first())
    if norm == 0:
        return s.select("i", "x")
    for _ in range(max_iter):
        s = durable(times(s, "p").withColumnRenamed("out", "v"))
        alpha_d = s.agg(F.sum(F.col("r0") * F.col("v"))).first()[0]
        if not alpha_d:
            break
        alpha = rho / alpha_d
        s = durable(times(s.withColumn("s", F.col("r") - alpha * F.col("v")), "s").withColumnRenamed("out", "t"))
        ts, tt = s.agg(F.sum(F.col("t") * F.col("s")), F.sum(F.col("t") ** 2)).first()
        omega = ts / tt if tt else 0.0
        s = s.withColumn("x", F.col("x") + alpha * F.col("p") + omega * F.col("s")).withColumn("r", F.col("s") - omega * F.col("t"))
        s = durable(s)
        left, new = s.agg(F.sqrt(F.sum(F.col("r") ** 2)), F.sum(F.col("r0") * F.col("r"))).first()
        if left <= tolerance * norm:
            return s.select("i", "x")
        if not omega or not new:
            break
        beta = new / rho * alpha / omega
        rho = new
        s = s.select("i", "x", "r", "r0", (F.col("r") + beta * (F.col("p") - omega * F.col("v"))).alias("p"))
    more = propagate(m.select(F.col("j").alias("src"), F.col("i").alias("dst"), F.col("w").alias("rate")), rows.select(F.col("i").alias("node"), F.col("b").alias("value")), 1e-14, 2000)
    if not more.converged:
        raise RuntimeError("no convergence")
    return more.values.select(F.col("node").alias("i"), F.col("value").alias("x"))
