"""Strong components, closed form and self-returns on deep and on large components, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import blocked
from tradeloom.operators import graph as G
from tradeloom.operators import propagate as P
from tradeloom.operators import risk as R


def random_links(rng):
    n = rng.randrange(2, 20)
    links = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, int(1.3 * n) + 2))}
    base = 100
    for _ in range(3):  # chains and rings that hang on the rest or stand alone
        length = rng.randrange(1, 7)
        c = list(range(base, base + length))
        base += length
        links |= set(zip(c[:-1], c[1:], strict=True))
        links |= {link for link in [(c[-1], c[0]), (rng.randrange(n), c[0]), (c[-1], rng.randrange(n))] if rng.random() < 0.5}
    return sorted(links) or [(0, 1)]


def plain_components(links):
    nodes = sorted({x for e in links for x in e})
    pos = {v: i for i, v in enumerate(nodes)}
    r = np.eye(len(nodes), dtype=bool)
    for a, b in links:
        r[pos[a], pos[b]] = True
    for k in range(len(nodes)):
        r |= np.outer(r[:, k], r[k])
    return {v: min(w for w, j in pos.items() if r[i, j] and r[j, i]) for v, i in pos.items()}


def plain_closed(rates, init, damping):
    """Values by one dense solve after each component is damped."""
    comp = plain_components([(a, b) for a, b, _ in rates])
    nodes = sorted(comp)
    pos = {v: i for i, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in rates:
        m[pos[b], pos[a]] += w
    for c in set(comp.values()):
        at = [pos[v] for v in nodes if comp[v] == c]
        while np.abs(np.linalg.eigvals(m[np.ix_(at, at)])).max() >= 1 - 1e-9:
            m[np.ix_(at, at)] *= damping
    b = np.array([init.get(v, 0.0) for v in nodes])
    x = np.linalg.solve(np.eye(len(nodes)) - m, b)
    return {v: x[pos[v]] for v in nodes if abs(x[pos[v]]) > 1e-6} | {v: w for v, w in init.items() if v not in pos}


@pytest.mark.parametrize("seed", range(2))
def test_components_and_closed_form_of_odd_graphs(spark, seed):
    rng = random.Random(seed)
    links = random_links(rng)
    rates = [(a, b, round(rng.uniform(0.1, 1.4), 3)) for a, b in links]
    edges = spark.createDataFrame(rates, "src int, dst int, rate double")
    for finish in (0, 2000):
        assert {r.node: r.component for r in G.strong_components(edges, finish=finish).collect()} == plain_components(links)
    init = {v: rng.uniform(1, 5) for v in rng.sample(sorted({x for e in links for x in e}), 2)} | {999: 2.0}
    start = spark.createDataFrame(sorted(init.items()), "node int, value double")
    want = plain_closed(rates, init, 0.9)
    for limit in (2000, 3):
        got = {r.node: r.value for r in P.propagate_closed(edges, start, 0.9, block_limit=limit).collect()}
        assert got == pytest.approx(want, rel=1e-5, abs=2e-5)


def test_a_long_chain_takes_a_few_jobs(spark):
    n = 10_000
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0.999).alias("rate"))
    start = spark.createDataFrame([(0, 1000.0), (5000, 10.0)], "node long, value double")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    before = jobs()
    got = {r.node: r.value for r in P.propagate_closed(edges, start, block_limit=50).collect()}
    x, want = 0.0, {}
    for i in range(n):
        x = 0.999 * x + {0: 1000.0, 5000: 10.0}.get(i, 0.0)
        want[i] = x
    assert got == pytest.approx({i: v for i, v in want.items() if round(v, 6)}, abs=2e-6)
    assert jobs() - before < 400  # adaptive plans make several jobs of a write
    ring = edges.unionByName(spark.createDataFrame([(n - 1, 0, 0.5)], "src long, dst long, rate double"))
    assert G.strong_components(ring, finish=10).select("component", "size").distinct().collect() == [(0, n)]


def test_self_returns_of_large_components(spark):
    rng = np.random.default_rng(4)
    rows, want, settled = [], {}, {}
    for c, (n, degree, radius) in enumerate([(60, 5, 0.9), (17, 3, 0.8), (9, 3, 1.5)]):
        m = np.zeros((n, n))
        for i in range(n):
            m[i, rng.choice(n, degree, replace=False)] = rng.random(degree)
            m[i, (i + 1) % n] += 0.1
        m *= radius / np.abs(np.linalg.eigvals(m)).max()
        if 0.8 * radius < 1:
            total = (np.diag(np.linalg.inv(np.eye(n) - 0.8 * m)) - 1) / 0.8
        else:
            total, power = np.zeros(n), m.copy()
            for _ in range(6):
                total, power = total + np.diag(power), 0.8 * power @ m
        rows += [(1000 * c + i, 1000 * c + int(j), float(m[i, j])) for i in range(n) for j in np.flatnonzero(m[i])]
        want |= {1000 * c + i: total[i] for i in range(n)}
        settled |= {1000 * c + i: 0.8 * radius < 1 for i in range(n)}
    edges = spark.createDataFrame([*rows, (5, 70_000, 0.5), (70_000, 70_001, 0.5)], "src int, dst int, rate double")
    for limit, blocks in ((2000, {}), (4, {"work": 40 * 3000, "cells": 600})):
        got = R.self_returns(edges, 0.8, max_iter=6, block_limit=limit, **blocks).collect()
        assert {r.node: r.self for r in got} == pytest.approx(want, rel=1e-9, abs=1e-11)
        assert {r.node: r.settled for r in got} == settled
    loops = spark.createDataFrame([(1, 1, 2, 0.5), (1, 2, 1, 0.5), (1, 2, 2, 0.25)], "component long, src int, dst int, rate double")
    assert {r.node: r.self for r in blocked.returns(loops, 0.0).collect()} == {1: 0.0, 2: 0.25}


def test_one_task_ends_the_search_as_rounds_would():
    import pandas as pd

    for seed in range(300):
        links = random_links(random.Random(seed))
        got = G._tarjan(pd.DataFrame(links, columns=["src", "dst"]))
        assert dict(zip(got["node"], got["label"], strict=True)) == plain_components(links)


def test_batches_of_sources_add_up_and_start_again(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    links = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(40)})
    edges = spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a, b in links], "src int, dst int, weight double")
    of = lambda df: {r.node: r.betweenness for r in df.collect()}
    whole = of(G.betweenness(edges))
    assert whole == pytest.approx(of(G.betweenness(edges, batch=5)), abs=1e-12)
    even = edges.withColumn("weight", F.lit(1.0))
    assert of(G.betweenness(even, weighted=True)) == pytest.approx(whole, abs=1e-12)
    real, calls = G._dependencies, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("an executor was lost")
        return real(*args)

    monkeypatch.setattr(G, "_dependencies", failing)
    folder = str(tmp_path / "progress")
    with pytest.raises(RuntimeError):
        G.betweenness(edges, batch=5, progress=folder)
    assert of(G.betweenness(edges, batch=5, progress=folder)) == pytest.approx(whole, abs=1e-12)
    assert len(calls) == 4  # three batches, of which the first was not done again


def plain_betweenness(links):
    """Brandes' sums from every source, one at a time."""
    out = {v: [] for v in {x for link in links for x in link}}
    for a, b in sorted(links):
        out[a] += [b] if a != b else []
    total = dict.fromkeys(out, 0.0)
    for s in out:
        level, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in out[v]:
                if w not in level:
                    level[w], paths[w] = level[v] + 1, 0.0
                    order.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        dep = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            dep[v] = sum(paths[v] / paths[w] * (1 + dep[w]) for w in out[v] if level[w] == level[v] + 1)
            total[v] += dep[v] if v != s else 0.0
    return total


def test_dense_graphs_go_by_blocks(spark, monkeypatch):
    """Groups of sources end at different levels; a dense graph makes no pairs of sources and arcs."""
    monkeypatch.setattr(G.between, "SIDE", 7)
    monkeypatch.setattr(G.between, "MOST", 3)
    rng = random.Random(5)
    links = {(a, b) for a in range(18) for b in rng.sample(range(18), 4)} | {(17, 18), (18, 19), (30, 0), (31, 31)}
    of = lambda df: {r.node: r.betweenness for r in df.collect()}
    edges = spark.createDataFrame(sorted(links), "src int, dst int")
    assert of(G.betweenness(edges, batch=12, dense=True, normalised=False)) == pytest.approx(plain_betweenness(links), abs=1e-12)
    full = {(a, b) for a in range(22) for b in range(22) if (a * b) % 7 != 1}
    monkeypatch.setattr(G, "_dependencies", None)
    assert of(G.betweenness(spark.createDataFrame(sorted(full), "src int, dst int"), normalised=False)) == pytest.approx(plain_betweenness(full), abs=1e-12)


def test_large_components_are_inverted_by_blocks(spark, monkeypatch):
    """Blocks of bounded size give what the batches of targets give, in a step a block and not a solution a target."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for c, n in enumerate((23, 10, 7)):
        m = np.where(rng.random((n, n)) < 0.4, rng.normal(size=(n, n)), 0.0)
        m[np.arange(n), (np.arange(n) + 1) % n] = 0.3
        m *= 0.9 / np.abs(np.linalg.eigvals(np.abs(m))).max()
        back = (np.diag(np.linalg.inv(np.eye(n) - 0.8 * m)) - 1) / 0.8
        rows += [(c, 100 * c + i, 100 * c + int(j), float(m[i, j])) for i in range(n) for j in np.flatnonzero(m[i])]
        want |= {100 * c + i: back[i] for i in range(n)}
    arcs = spark.createDataFrame(rows, "component long, src int, dst int, rate double")
    of = lambda **o: {r.node: r.self for r in blocked.returns(arcs, 0.8, **o).collect()}
    assert of(direct=0) == pytest.approx(want, rel=1e-9, abs=1e-11)
    assert of(direct=10, side=5) == pytest.approx(want, rel=1e-9, abs=1e-11)
    monkeypatch.setattr(blocked, "_solve_batch", None)
    assert of(side=5) == pytest.approx(want, rel=1e-9, abs=1e-11)
    assert of() == pytest.approx(want, rel=1e-9, abs=1e-11)


def test_large_components_go_by_a_few_hops(spark, monkeypatch):
    """Targets in groups and a few hops each give what a dense inverse gives, without a solution a target; what stays open is solved as before."""
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for c, (n, degree) in enumerate(((90, 12), (40, 40))):
        m = np.zeros((n, n))
        for i in range(n):
            m[i, rng.choice(n, degree, replace=False)] = rng.random(degree)
        m *= 0.8 / m.sum(1, keepdims=True)
        back = (np.diag(np.linalg.inv(np.eye(n) - 0.5 * m)) - 1) / 0.5
        rows += [(c, 100 * c + i, 100 * c + int(j), float(m[i, j])) for i in range(n) for j in np.flatnonzero(m[i])]
        want |= {100 * c + i: back[i] for i in range(n)}
    of = lambda rows, **o: {r.node: r.self for r in blocked.returns(spark.createDataFrame(rows, "component long, src int, dst int, rate double"), 0.5, direct=0, **o).collect()}
    monkeypatch.setattr(blocked.walks, "LEAST", 1)
    monkeypatch.setattr(blocked.walks, "PIECE", 100)
    monkeypatch.setattr(blocked.walks, "AT_ONCE", 5)
    with monkeypatch.context() as m:
        m.setattr(blocked, "_solve_batch", None)
        assert of(rows) == pytest.approx(want, rel=1e-11, abs=1e-12)
    ring = [(7, 700 + i, 700 + (i + 1) % 5, 1.9) for i in range(5)]  # decays too slowly for hops
    assert of(rows[-1600:] + ring) == pytest.approx({k: v for k, v in want.items() if k >= 100} | {700 + i: (1 / (1 - 0.95**5) - 1) / 0.5 for i in range(5)}, rel=1e-9, abs=1e-11)
