"""Graph measures as rounds of joins and aggregates on edge tables.

Every loop keeps only a frontier or a node vector as state, writes it to the
shared folder each round and asks the driver for one row of figures. Running
out of rounds is an error, unless the operator returns how far it came.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.operators import between
from tradeloom.operators.components import connected_components
from tradeloom.operators.contraction import WORTH, Runs, runs, ways
from tradeloom.operators.ordered import in_order
from tradeloom.session import discard, durable, is_written, new_folder


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def step(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """``(node)`` one undirected step from ``frontier(node)``: two equi-joins in place of one with OR."""
    near = frontier.select("node").distinct()
    out = edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    into = edges.join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    return out.unionByName(into).distinct()


def layers(edges: DataFrame, seeds: DataFrame, depth: int | None = None, direction: str = "out", max_rounds: int = 500) -> DataFrame:
    """``(source, node, layer)``: the number of steps from each source to each node within ``depth`` (None: all), sources at 0.

    ``seeds(source, node)`` may name several nodes for a source.
    """
    arcs = {"out": edges.select("src", "dst"), "in": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "both": both_ways(edges)}[direction].distinct()
    arcs = durable(arcs)
    frontier = durable(seeds.select("source", "node").distinct().withColumn("layer", F.lit(0)))
    seen = frontier
    rounds = 0
    while depth is None or rounds < depth:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        new = frontier.join(arcs, frontier.node == arcs.src).select("source", F.col("dst").alias("node")).distinct().join(seen.select("source", "node"), ["source", "node"], "left_anti")
        frontier = durable(new.withColumn("layer", F.lit(rounds)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(node, layer)`` within ``depth`` undirected steps of ``seeds(node)``."""
    return layers(edges, seeds.select(F.lit(0).alias("source"), "node"), depth, "both").select("node", "layer")


def bfs_depth(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(node, depth)`` along the edges' direction, seeds at depth 1."""
    return layers(edges, seeds.select(F.lit(0).alias("source"), "node")).select("node", (F.col("layer") + 1).alias("depth"))


def expand_top(edges: DataFrame, seeds: DataFrame, depth: int, top_k: int) -> tuple[DataFrame, DataFrame]:
    """Hop expansion that keeps the ``top_k`` largest edges of each hop overall: edges with hop, nodes with hop.

    ``edges(src, dst, amount)``. An edge touching the frontier counts for the
    hop; ties are broken by src, then dst.
    """
    seen = durable(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    frontier, kept = seen, None
    for hop in range(1, depth + 1):
        near = frontier.select("node")
        out = edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst", "amount")
        into = edges.join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "amount")
        top = durable(out.unionByName(into).distinct().orderBy(F.desc("amount"), "src", "dst").limit(top_k).withColumn("hop", F.lit(hop)))
        kept = top if kept is None else kept.unionByName(top)
        frontier = durable(nodes_of(top).join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    if kept is None:
        kept = edges.select("src", "dst", "amount").limit(0).withColumn("hop", F.lit(0))
    return kept.groupBy("src", "dst", "amount").agg(F.min("hop").alias("hop")), seen


def weak_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the undirected graph."""
    return connected_components(edges)


def _least_labels(arcs: DataFrame, nodes: DataFrame, salt: int, max_rounds: int, steps: int = 4) -> DataFrame:
    """``(node, f, b)``: the least label that reaches each node, and the least label that it reaches.

    Labels are node ids under a hash order, so that they split long chains
    evenly. Several steps go between two writes of the state.
    """
    label = F.struct(F.xxhash64("node", F.lit(salt)).alias("h"), F.col("node").alias("id"))
    state = durable(nodes.select("node", label.alias("f"), label.alias("b")))
    nothing = F.lit(None)
    for _ in range(max_rounds):
        after = state
        for _ in range(steps):
            down = after.join(arcs, after.node == arcs.src).select(F.col("dst").alias("node"), "f", nothing.cast(state.schema["b"].dataType).alias("b"))
            up = after.join(arcs, after.node == arcs.dst).select(F.col("src").alias("node"), nothing.cast(state.schema["f"].dataType).alias("f"), "b")
            after = after.unionByName(down).unionByName(up).groupBy("node").agg(F.min("f").alias("f"), F.min("b").alias("b"))
        after = durable(after)
        settled = after.join(state.select("node", F.col("f").alias("f0"), F.col("b").alias("b0")), "node").where("f <> f0 OR b <> b0").isEmpty()
        discard(state)
        state = after
        if settled:
            return state
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def _contracted(arcs: DataFrame, nodes: DataFrame, finish: int) -> tuple[DataFrame, DataFrame, DataFrame, list[tuple[DataFrame, Runs]]]:
    """``arcs`` and ``nodes`` without ends and runs, labels ``(node, label)`` known so far, and the layers taken out.

    A node without a way in or out is a component; so is a ring. A run goes in
    its entry's component if its exit is in it as well, which an arc from entry
    to exit tells. Passes go on while each takes out a share worth it.
    """
    known = nodes.limit(0).select("node", F.col("node").alias("label"))
    layers: list[tuple[DataFrame, Runs]] = []
    while True:
        if nodes.count() <= finish:
            return arcs, nodes, known, layers
        at = durable(ways(arcs.withColumn("rate", F.lit(1.0))))
        n, ends, unary = at.agg(F.count("*"), F.count_if((F.col("n_in") == 0) | (F.col("n_out") == 0)), F.count_if((F.col("n_in") == 1) & (F.col("n_out") == 1))).first()
        if not n or ends + unary < WORTH * n:
            discard(at)
            return arcs, nodes, known, layers
        lone = at.where("n_in = 0 OR n_out = 0")
        made = runs(at.where("n_in = 1 AND n_out = 1").withColumn("value", F.lit(0.0)))
        gone = made.table.select("node")
        ended = durable(lone.select("node"))
        found = durable(ended.select("node", F.col("node").alias("label")).unionByName(made.rings.select("node", F.col("ring").alias("label"))))
        bypass = made.exits.select(F.col("entry").alias("src"), F.col("exit").alias("dst")).where("src <> dst")
        stays = arcs.select("src", "dst")
        for side in ("src", "dst"):
            stays = stays.join(gone.withColumnRenamed("node", side), side, "left_anti")
        stays = stays.select("src", "dst").unionByName(bypass)
        for side in ("src", "dst"):
            stays = stays.join(ended.withColumnRenamed("node", side), side, "left_anti")
        arcs = durable(stays.select("src", "dst").distinct())
        nodes = durable(nodes.join(gone, "node", "left_anti").join(ended, "node", "left_anti"))
        known = known.unionByName(found)
        layers.append((ended, made))
        discard(at)


def _tarjan(pdf):
    """``(node, label)`` of the edges of one bounded graph; a label is the least node of its component."""
    import pandas as pd

    codes, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
    src, dst = codes[: len(pdf)], codes[len(pdf) :]
    order = src.argsort(kind="stable")
    first, after = pd.Series(src[order]).searchsorted(range(len(names) + 1)), dst[order].tolist()
    found, low, waiting, closed = [0] * len(names), [0] * len(names), [], [False] * len(names)
    label, clock = [0] * len(names), 0
    for root in range(len(names)):
        path = [] if found[root] else [(root, int(first[root]))]
        while path:
            v, at = path.pop()
            if not found[v]:
                clock += 1
                found[v] = low[v] = clock
                waiting.append(v)
            elif at > first[v]:  # back from the neighbour before
                w = after[at - 1]
                if not closed[w]:
                    low[v] = min(low[v], low[w])
            while at < first[v + 1] and (found[after[at]] or closed[after[at]]):
                if not closed[after[at]]:
                    low[v] = min(low[v], found[after[at]])
                at += 1
            if at < first[v + 1]:
                path += [(v, at + 1), (after[at], int(first[after[at]]))]
            elif low[v] == found[v]:
                members = [waiting.pop()]
                while members[-1] != v:
                    members.append(waiting.pop())
                least = min(members, key=lambda m: names[m])
                for m in members:
                    closed[m], label[m] = True, least
    return pd.DataFrame({"node": names, "label": [names[m] for m in label]})


def strong_components(edges: DataFrame, max_rounds: int = 200, finish: int = 2000) -> DataFrame:
    """``(node, component, size)``: strongly connected components, named by their least node.

    Ends and runs are taken out first (:mod:`contraction`), so long chains cost
    little. Then each round gives every node the least label upstream and
    downstream. Where both are the same, node and label are on one cycle, so
    these nodes are whole components. Components never cross nodes whose labels
    differ, so only edges between nodes of equal labels stay, and all remaining
    parts go on at the same time. Nodes without an edge left are components by
    themselves. Once ``finish`` nodes are left, one task ends the search.
    """
    every = durable(edges.select("src", "dst").distinct())
    start = durable(nodes_of(every))
    arcs, nodes, done, layers = _contracted(every.where("src <> dst"), start, finish)
    made: list[DataFrame] = []
    for k in range(max_rounds):
        if nodes.count() <= finish:
            kind = dict(nodes.dtypes)["node"]
            alone = nodes.join(nodes_of(arcs), "node", "left_anti").select("node", F.col("node").alias("label"))
            done = durable(done.unionByName(alone).unionByName(arcs.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_tarjan, f"node {kind}, label {kind}")))
            made.append(done)
            break
        touched = nodes_of(arcs)
        lone = durable(nodes.join(touched, "node", "left_anti").select("node", F.col("node").alias("label")))
        done = done.unionByName(lone)
        old, nodes = nodes, durable(nodes.join(touched, "node", "left_semi"))
        made += [lone, old]
        if nodes.isEmpty():
            break
        labels = _least_labels(arcs, nodes, k, max_rounds)
        found = durable(labels.where("f = b").select("node", F.col("f.id").alias("label")))
        done = done.unionByName(found)
        open_ = labels.where("f <> b")
        old, nodes = nodes, durable(open_.select("node"))
        one, two = open_.select(F.col("node").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1")), open_.select(F.col("node").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2"))
        left = durable(arcs.join(one, "src").join(two, "dst").where("f1 = f2 AND b1 = b2").select("src", "dst"))
        made += [found, old, labels]
        arcs = left
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    for _, run in reversed(layers):
        x, y = done.select(F.col("node").alias("entry"), F.col("label").alias("l1")), done.select(F.col("node").alias("exit"), F.col("label").alias("l2"))
        back = run.exits.select("head", "entry", "exit").join(x, "entry").join(y, "exit").where("l1 = l2").select("head", F.col("l1").alias("label"))
        put = run.nodes.select("node", "head").join(back, "head", "left").select("node", F.coalesce("label", "node").alias("label"))
        done = durable(done.unionByName(put))
        made.append(done)
    sizes = done.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    out = durable(done.join(sizes, "label").select("node", "component", "size"))
    for used in (every, start, arcs, nodes, *made, *[t for ended, run in layers for t in (ended, run.table)]):
        discard(used)
    return out


def cycle_edges(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """The edges that take part in a cycle: both ends in one strong component, or a self-loop."""
    scc = strong_components(edges) if components is None else components
    a, b = scc.select(F.col("node").alias("src"), F.col("component").alias("c1")), scc.select(F.col("node").alias("dst"), F.col("component").alias("c2"))
    return edges.join(a, "src").join(b, "dst").where("c1 = c2").drop("c1", "c2")


def summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, numbers of weak and strong components, whether the graph has no cycle."""
    arcs = durable(edges.select("src", "dst").distinct())
    scc = durable(strong_components(arcs))
    weak = weak_components(arcs).agg(F.countDistinct("component").alias("n_weak"))
    strong = scc.agg(F.count("*").alias("n_nodes"), F.countDistinct("component").alias("n_strong"), F.max("size").alias("largest"))
    counts = arcs.agg(F.count("*").alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    one = strong.join(weak, F.lit(True)).join(counts, F.lit(True))  # one row each
    n = F.col("n_nodes")
    return one.select("n_nodes", "n_edges", F.when(n > 1, F.col("n_edges") / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"), "n_weak", "n_strong", ((F.col("largest") == 1) & (F.col("loops") == 0)).alias("is_dag"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """``(node, in_degree, out_degree, degree)`` over the other nodes' number."""
    arcs = edges.select("src", "dst").distinct()
    out = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = arcs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    joined = out.join(into, "node", "full").na.fill(0)
    total = joined.agg(F.count("*").alias("n"))
    scale = F.when(F.col("n") > 1, 1 / (F.col("n") - 1)).otherwise(F.lit(1.0))
    return joined.join(F.broadcast(total), F.lit(True)).select("node", (F.col("n_in") * scale).alias("in_degree"), (F.col("n_out") * scale).alias("out_degree"), ((F.col("n_in") + F.col("n_out")) * scale).alias("degree"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, weighted: bool = True) -> DataFrame:
    """``(node, rank)``; ``edges(src, dst, weight)``. Ends when the L1 change is under nodes times ``tolerance``, or after ``rounds``."""
    w = F.sum("weight") if weighted else F.count("*").cast("double")
    arcs = edges.groupBy("src", "dst").agg(w.alias("weight"))
    arcs = durable(arcs.join(arcs.groupBy("src").agg(F.sum("weight").alias("total")), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    nodes = durable(nodes_of(arcs).join(arcs.select(F.col("src").alias("node")).distinct().withColumn("leads", F.lit(True)), "node", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    state = durable(nodes.select("node", F.lit(1.0 / n).alias("rank"), F.col("leads").isNull().alias("ends")))
    for k in range(rounds):
        dangling = state.where("ends").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        came = state.join(arcs, state.node == arcs.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        new = state.join(came, "node", "left").select("node", (alpha * (F.coalesce("came", F.lit(0.0)) + dangling / n) + (1 - alpha) / n).alias("rank"), "ends", F.col("rank").alias("old"))
        new = durable(new)
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        state = new.drop("old")
        if moved < n * tolerance:
            break
    return state.select("node", "rank")


def shortest_paths(edges: DataFrame, pairs: DataFrame, weighted: bool = True, max_rounds: int = 500) -> DataFrame:
    """``(source, target, length, hops, path, reason)`` for each of ``pairs(source, target)``; the weight is the distance.

    Ties are broken by fewer hops, then the least path. Unknown ends and
    unreachable targets have a reason in place of a path.
    """
    w = F.min("weight") if weighted else F.lit(1.0)
    arcs = durable(edges.groupBy("src", "dst").agg(w.alias("weight")))
    nodes = nodes_of(arcs)
    state = durable(pairs.select("source").distinct().select("source", F.col("source").alias("node"), F.struct(F.lit(0.0).alias("length"), F.lit(0).alias("hops"), F.array(F.col("source")).alias("path")).alias("best")))
    moving = state
    for _ in range(max_rounds):
        came = moving.join(arcs, moving.node == arcs.src).where(~F.array_contains("best.path", F.col("dst")))
        came = came.select("source", F.col("dst").alias("node"), F.struct((F.col("best.length") + F.col("weight")).alias("length"), (F.col("best.hops") + 1).alias("hops"), F.concat("best.path", F.array("dst")).alias("path")).alias("best"))
        best = came.groupBy("source", "node").agg(F.min("best").alias("new"))
        after = durable(state.join(best, ["source", "node"], "full").select("source", "node", F.least("best", "new").alias("best"), (F.col("best").isNull() | (F.col("new") < F.col("best"))).alias("moved")))
        state, moving = after.select("source", "node", "best"), after.where("moved").select("source", "node", "best")
        if moving.isEmpty():
            break
    else:
        raise RuntimeError(f"paths did not settle in {max_rounds} rounds")
    known = nodes.withColumn("known", F.lit(True))
    out = pairs.select("source", "target").distinct().join(state.withColumnRenamed("node", "target"), ["source", "target"], "left")
    out = out.join(known.select(F.col("node").alias("source"), F.col("known").alias("s")), "source", "left").join(known.select(F.col("node").alias("target"), F.col("known").alias("t")), "target", "left")
    reason = F.when(F.col("s").isNull(), "source not in graph").when(F.col("t").isNull(), "target not in graph").when(F.col("best").isNull(), "no path")
    return out.select("source", "target", F.when(reason.isNull(), F.col("best.length")).alias("length"), F.when(reason.isNull(), F.col("best.hops")).alias("hops"), F.when(reason.isNull(), F.col("best.path")).alias("path"), reason.alias("reason"))


#: Rows of (source, node) state that a batch of sources may have.
STATE_ROWS = 1 << 26
#: The same for a graph whose matrix goes by blocks, and when it does: arcs a node, and pairs of nodes an arc at most.
STATE_CELLS = 1 << 27
DENSE_WAYS = 16
DENSE_PAIRS = 1000


def betweenness(
    edges: DataFrame, sources: DataFrame | None = None, weighted: bool = False, normalised: bool = True, max_rounds: int = 500, batch: int | None = None, progress: str | None = None, dense: bool | None = None
) -> DataFrame:
    """``(node, betweenness)`` by Brandes' method; ``sources(node)`` limits the sources, all are exact.

    Sources go batch by batch, so the (source, node) state is bounded, by
    default to ``STATE_ROWS``, or ``STATE_CELLS`` where a graph has so many
    arcs that its matrix goes by blocks (:mod:`between`; ``dense`` tells, else
    the arcs do). Each batch adds a table of its sums to the folder
    ``progress`` and discards its state; a run that finds tables of finished
    batches there goes on after them. The folder serves one graph and one
    choice of sources; without it a new one in the shared folder is used.
    """
    w = F.min("weight") if weighted else F.lit(1.0)
    arcs = durable(edges.where("src <> dst").groupBy("src", "dst").agg(w.alias("weight")))
    nodes = durable(nodes_of(edges))
    n = nodes.count()
    if dense is None:
        dense = not weighted and arcs.count() >= max(DENSE_WAYS * n, n * n // DENSE_PAIRS)
    order = in_order(nodes if sources is None else sources.select("node").distinct(), "node")
    size = batch or max(1, (STATE_CELLS if dense else STATE_ROWS) // max(n, 1))
    folder = progress or new_folder(nodes.sparkSession)
    parts: list[str] = []
    if dense:
        numbered = in_order(nodes, "node")
        places, side = durable(numbered.placed("k").select("node", (F.col("k") - 1).alias("at"))), min(between.SIDE, max(n, 1))
        blocks = between.matrix(arcs, places, side)
        numbered.discard()
    for k in range(-(-order.total // size)):
        path = f"{folder}/sources-{size}-{k}"
        parts.append(path)
        if not is_written(nodes.sparkSession, path):
            start = durable(order.page(k + 1, size).select("node"))
            if dense:
                dep = between.dependencies(blocks, places, start, n, side, max_rounds)
                made = [dep]
            else:
                dep, made = (_weighted_dependencies if weighted else _dependencies)(arcs, start, n, max_rounds)
                dep = dep.where("source <> node").groupBy("node").agg(F.sum("dep").alias("dep"))
            dep.write.mode("overwrite").parquet(path)
            for used in (start, *made):
                discard(used)
    scale = 1.0 / ((n - 1) * (n - 2)) if normalised and n > 2 else 1.0
    total = nodes.sparkSession.read.schema(nodes.select("node", F.lit(0.0).alias("dep")).schema).parquet(*parts) if parts else nodes.select("node", F.lit(0.0).alias("dep"))
    out = durable(nodes.join(total.groupBy("node").agg(F.sum("dep").alias("dep")), "node", "left").select("node", (F.coalesce("dep", F.lit(0.0)) * scale).alias("betweenness")))
    for used in (arcs, nodes, order.table, *([places, blocks] if dense else []), *([total] if parts and progress is None else [])):
        discard(used)
    return out


def _dependencies(arcs: DataFrame, start: DataFrame, n: int, max_rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """``(source, node, dep)`` by numbers of steps, and the tables made: layer by layer path counts go out and dependencies come back."""
    levels = [durable(start.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))]
    while len(levels) <= max_rounds:
        came = levels[-1].join(arcs, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        for seen in levels:
            came = came.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        levels.append(durable(came))
        if levels[-1].isEmpty():
            break
    else:
        raise RuntimeError(f"distances did not settle in {max_rounds} rounds")
    back: list[DataFrame] = []
    below = levels[-1].select("source", "node", "paths", F.lit(0.0).alias("dep"))
    for here in reversed(levels[:-1]):
        after = below.select("source", F.col("node").alias("dst"), F.col("paths").alias("pd"), "dep")
        got = here.join(arcs, F.col("node") == F.col("src")).join(after, ["source", "dst"]).groupBy("source", "node").agg(F.sum(F.col("paths") / F.col("pd") * (1 + F.col("dep"))).alias("dep"))
        below = durable(here.join(got, ["source", "node"], "left").select("source", "node", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep")))
        back.append(below)
    return reduce(DataFrame.unionByName, [b.select("source", "node", "dep") for b in back]), [*levels, *back]


def _weighted_dependencies(arcs: DataFrame, start: DataFrame, n: int, max_rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """``(source, node, dep)`` by weights, and the tables made.

    Distances come first by relaxation; then path counts go forward and
    dependencies backward along the edges that are on a shortest path, in
    order of the number of such edges still open at a node.
    """
    made: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        made.append(durable(df))
        return made[-1]

    dist = kept(start.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("d")))
    moving = dist
    for _ in range(max_rounds):
        came = moving.join(arcs, moving.node == arcs.src).select("source", F.col("dst").alias("node"), (F.col("d") + F.col("weight")).alias("new")).groupBy("source", "node").agg(F.min("new").alias("new"))
        after = kept(dist.join(came, ["source", "node"], "full").select("source", "node", F.least("d", "new").alias("d"), (F.col("d").isNull() | (F.col("new") < F.col("d") - 1e-12)).alias("moved")))
        dist, moving = after.select("source", "node", "d"), after.where("moved").select("source", "node", "d")
        if moving.isEmpty():
            break
    else:
        raise RuntimeError(f"distances did not settle in {max_rounds} rounds")
    u, v = dist.select("source", F.col("node").alias("src"), F.col("d").alias("du")), dist.select("source", F.col("node").alias("dst"), F.col("d").alias("dv"))
    tree = kept(u.join(arcs, "src").join(v, ["source", "dst"]).where(F.abs(F.col("du") + F.col("weight") - F.col("dv")) < 1e-9).select("source", "src", "dst"))
    # the rank of a node is the longest chain of tree edges to it: counts and dependencies go rank by rank
    rank = kept(dist.select("source", "node", F.lit(0).alias("r")))
    for k in range(1, n + 1):
        up = rank.where(F.col("r") == k - 1).join(tree.withColumnRenamed("src", "node"), ["source", "node"]).select("source", F.col("dst").alias("node"), F.lit(k).alias("r")).distinct()
        if up.isEmpty():
            break
        rank = kept(rank.unionByName(up).groupBy("source", "node").agg(F.max("r").alias("r")))
    deepest = rank.agg(F.max("r")).first()[0] or 0
    sigma = kept(rank.where("r = 0").select("source", "node", F.lit(1.0).alias("paths")))
    for k in range(1, deepest + 1):
        came = rank.where(F.col("r") == k).select("source", F.col("node").alias("dst")).join(tree, ["source", "dst"]).join(sigma.withColumnRenamed("node", "src"), ["source", "src"])
        sigma = sigma.unionByName(kept(came.groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))))
    sigma = kept(sigma)
    dep = kept(rank.where(F.col("r") == deepest).select("source", "node", F.lit(0.0).alias("dep")))
    for k in range(deepest - 1, -1, -1):
        below = rank.where(F.col("r") == k).select("source", "node")
        out = below.withColumnRenamed("node", "src").join(tree, ["source", "src"]).join(dep.withColumnRenamed("node", "dst"), ["source", "dst"])
        out = out.join(sigma.select("source", F.col("node").alias("src"), F.col("paths").alias("ps")), ["source", "src"]).join(sigma.select("source", F.col("node").alias("dst"), F.col("paths").alias("pd")), ["source", "dst"])
        got = out.groupBy("source", F.col("src").alias("node")).agg(F.sum(F.col("ps") / F.col("pd") * (1 + F.col("dep"))).alias("dep"))
        dep = dep.unionByName(kept(below.join(got, ["source", "node"], "left").select("source", "node", F.coalesce("dep", F.lit(0.0)).alias("dep"))))
    return dep, made
