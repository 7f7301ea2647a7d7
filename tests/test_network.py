"""Golden values and brute-force comparisons of the network operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import edges as E
from tradeloom.operators import graph as G
from tradeloom.operators import impacts as I
from tradeloom.operators import propagate as P
from tradeloom.operators import risk as R
from tradeloom.operators import scenario as S

# A graph of five companies and, in the tests, the results it must give.
FIVE = [("A", "B", 0.3), ("A", "D", 0.2), ("D", "B", 0.3), ("D", "E", 0.4), ("B", "C", 0.5), ("B", "A", 0.2)]


def pairs(df):
    return {r[0]: r[1] for r in df.select("node", "value").collect()}


@pytest.fixture(scope="module")
def filings(spark):
    rows = [("A", "B", 2024, 1, "1", 100.0), ("A", "B", 2024, 2, "1", 200.0), ("A", "B", 2024, 2, "2", 50.0), ("A", "C", 2024, 1, "1", 30.0), ("A", "C", 2024, 1, "1", 70.0), ("A", "B", 2025, 1, "2", 400.0), ("A", " ", 2024, 1, "1", 9.0), (None, "B", 2024, 1, "1", 9.0)]
    return spark.createDataFrame(rows, "supplier string, counterparty string, year int, quarter int, phase string, amount double")


@pytest.mark.parametrize(("policy", "want"), [("SUM_ALL", {("A", "B", 2024): (350, 3), ("A", "C", 2024): (100, 2), ("A", "B", 2025): (400, 1)}), ("REPLACE", {("A", "B", 2024): (150, 2), ("A", "C", 2024): (100, 2), ("A", "B", 2025): (400, 1)}), ("FIRST_ONLY", {("A", "B", 2024): (300, 2), ("A", "C", 2024): (100, 2)})])
def test_amendment_policies(filings, policy, want):
    got = {(r.src, r.dst, r.trade_year): (r.sly_amt, r.n_filings) for r in E.yearly_edges(filings, policy).collect()}
    assert got == want


def test_shares_of_replaced_edges(filings):
    got = {r.dst: r.rate for r in E.yearly_edges(filings, "REPLACE", 2024, normalise=True).collect()}
    assert got == {"B": 0.6, "C": 0.4}


def test_iterative_and_closed_agree_with_golden_values(spark):
    edges = spark.createDataFrame(FIVE, "src string, dst string, rate double")
    init = spark.createDataFrame([("A", 100.0)], "node string, value double")
    want = {"A": 107.758621, "B": 38.793103, "C": 19.396552, "D": 21.551724, "E": 8.620690}
    run = P.propagate(edges, init)
    assert run.converged and pairs(run.values) == pytest.approx(want, abs=1e-5)
    closed = P.propagate_closed(edges, init)
    assert pairs(closed) == pytest.approx(want, abs=1e-5)
    assert closed.agg(F.max("damped")).first()[0] == 0


def test_unit_cycle_is_damped_in_closed_form(spark):
    edges = spark.createDataFrame([("a", "b", 0.1), ("b", "c", 0.4), ("b", "d", 0.6), ("c", "b", 1.0), ("d", "b", 1.0)], "src string, dst string, rate double")
    got = {r.node: r for r in P.propagate_closed(edges, spark.createDataFrame([("a", 7.0)], "node string, value double")).collect()}
    assert got["b"].value == pytest.approx(7.1795, abs=1e-3)
    assert {n for n, r in got.items() if r.damped} == {"b", "c", "d"}


def test_large_components_take_the_round_by_round_way(spark):
    edges = spark.createDataFrame(FIVE, "src string, dst string, rate double")
    init = spark.createDataFrame([("A", 100.0)], "node string, value double")
    assert pairs(P.propagate_closed(edges, init, block_limit=1)) == pytest.approx(pairs(P.propagate_closed(edges, init)), abs=1e-5)


def test_large_components_are_damped_each_by_itself(spark):
    rates = [("a", "b", 1.0), ("b", "a", 1.0), ("x", "y", 0.5), ("y", "x", 0.5), ("b", "u", 0.4), ("u", "v", 1.2), ("v", "u", 1.2), ("v", "w", 0.3), ("p", "p", 1.0)]
    edges = spark.createDataFrame(rates, "src string, dst string, rate double")
    init = spark.createDataFrame([("a", 1.0), ("x", 1.0), ("p", 2.0)], "node string, value double")
    blocks, rounds = ({r.node: (r.value, r.damped) for r in P.propagate_closed(edges, init, block_limit=k).collect()} for k in (2000, 1))
    assert rounds == {k: (pytest.approx(v, abs=2e-6), d) for k, (v, d) in blocks.items()}
    assert rounds["x"] == (pytest.approx(1.333333, abs=1e-6), 0) and rounds["a"][1] == 1 and rounds["u"][1] == 4


def test_cumulative_averages_serve_both_networks(spark):
    rng = np.random.default_rng(7)
    score = [None, 2, 4, 5, 3, 7, None, 1]
    m = {side: np.triu(rng.random((8, 8)) * (rng.random((8, 8)) < 0.6), 1) / 4 for side in ("sell", "buy")}
    m["sell"][5, 1], m["buy"] = 0.2, m["buy"].T
    frames = [spark.createDataFrame([(i, j, float(w[i, j])) for i in range(8) for j in range(8) if w[i, j]], "src int, dst int, rate double") for w in m.values()]
    nodes = spark.createDataFrame(list(enumerate(score)), "node int, score int")
    got = {r.node: r for r in R.cumulative_averages(nodes, *frames).collect()}
    for side, w in m.items():
        total = np.linalg.inv(np.eye(8) - w) - np.eye(8)
        np.fill_diagonal(total, 0)
        graded = np.array([s is not None for s in score], float)
        valid, exposure = total @ graded, total @ np.array([s or 0 for s in score], float)
        want = [exposure[i] / valid[i] if valid[i] > 1e-12 else None for i in range(8)]
        assert [got[i][f"{side}_average"] for i in range(8)] == [None if x is None else pytest.approx(x, abs=1e-7) for x in want]


def test_components_paths_and_centrality_match_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 14
    links = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (26, 2)) if a != b})
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src int, dst int, weight double")
    reach = np.eye(n, dtype=bool)
    for a, b in links:
        reach[a, b] = True
    for k in range(n):
        reach |= np.outer(reach[:, k], reach[k])
    named = {x for e in links for x in e}
    want = {i: min(j for j in range(n) if reach[i, j] and reach[j, i]) for i in named}
    assert {r.node: r.component for r in G.strong_components(edges).collect()} == want
    dist = np.full((n, n), np.inf)
    for i in range(n):
        dist[i, i] = 0
    for a, b in links:
        dist[a, b] = 1
    for k in range(n):
        dist = np.minimum(dist, dist[:, [k]] + dist[[k]])
    got = G.layers(edges, edges.select(F.col("src").alias("source"), F.col("src").alias("node")).distinct())
    assert all(dist[r.source, r.node] == r.layer for r in got.collect())
    count = np.zeros((n, n))
    order = np.eye(n)
    for step in range(n):
        count += np.where(dist == step, order, 0)
        adj = np.zeros((n, n))
        for a, b in links:
            adj[a, b] = 1
        order = np.where(dist == step, order, 0) @ adj
    between = {v: 0.0 for v in named}
    for s in named:
        for t in named:
            if s != t and np.isfinite(dist[s, t]):
                for v in named - {s, t}:
                    if dist[s, v] + dist[v, t] == dist[s, t]:
                        between[v] += count[s, v] * count[v, t] / count[s, t]
    have = {r.node: r.betweenness for r in G.betweenness(edges, normalised=False).collect()}
    assert have == pytest.approx(between, abs=1e-9)


def test_risk_sample(spark):
    nodes = spark.createDataFrame([("A", "AA", 1000.0), ("B", "NR", 800.0), ("C", "BBB", 500.0), ("D", "A", 600.0), ("E", "BB", 400.0)], "node string, grade string, sales double").withColumn("score", R.grade_to_score(F.col("grade")))
    sell = [("A", "B", 0.3), ("A", "D", 0.2), ("D", "B", 0.3), ("D", "E", 0.4), ("B", "C", 0.5), ("B", "A", 0.2)]
    m = R.company_metrics(nodes, spark.createDataFrame(sell, "src string, dst string, rate double")).cache()
    a = m.where("node = 'A'").first()
    assert [a.total, a.valid, a.coverage, a.average, a.exposure] == pytest.approx([0.883621, 0.495690, 0.560976, 3.739130, 1.853448], abs=1e-5)
    assert m.where("node = 'C'").first().average is None
    index = R.network_index(m, nodes).first()
    assert [index[0], index[1]] == pytest.approx([3.784242, 0.723983], abs=1e-5)


def test_solve_matches_dense(spark):
    rng = np.random.default_rng(1)
    m = rng.random((8, 8)) * (rng.random((8, 8)) < 0.4) / 4
    b = rng.random(8)
    got = P.solve(spark.createDataFrame([(i, j, float(m[i, j])) for i in range(8) for j in range(8) if m[i, j]], "i int, j int, w double"), spark.createDataFrame(list(enumerate(map(float, b))), "i int, b double"))
    x = np.linalg.solve(np.eye(8) - m, b)
    assert {r.i: r.x for r in got.collect()} == pytest.approx(dict(enumerate(x)), abs=1e-8)


def test_coefficients_skip_households_and_scale_columns(spark):
    edges = spark.createDataFrame([("A", "B", 2024, 300.0, "B2B"), ("C", "B", 2024, 100.0, "B2C"), ("A", "C", 2024, 50.0, "B2B"), ("B", "C", 2024, 50.0, "B2B")], "src string, dst string, year int, amount double, target_cate string")
    firms = spark.createDataFrame([("A", 500.0), ("B", 1000.0), ("C", 50.0)], "firm string, sales double")
    got = {(r.i, r.j): r.w for r in I.coefficients(edges, firms, 2024, ["sales"]).collect()}
    assert got == pytest.approx({("A", "B"): 0.3, ("A", "C"): 0.5, ("B", "C"): 0.5})


def test_volume_run_reports_one_plus_delta(spark):
    rates = spark.createDataFrame([("A", "B", 0.5)], "src string, dst string, rate double")
    out, total = S.run_volume(rates, spark.createDataFrame([("A", 0.8)], "node string, multiplier double"))
    assert pairs(out) == pytest.approx({"A": 0.8, "B": 0.9})
    assert total == pytest.approx(-0.3)


def test_shock_kinds_must_be_known(spark):
    bad = spark.createDataFrame([(1, "X", 12)], "shock_id int, input_type string, duration_month int")
    for c in ("before_tariff", "after_tariff", "price_elasticity", "pass_through", "income_elasticity", "gdp_growth_rate", "revenue_value", "price_m_change_rate", "price_m_elasticity", "import_change", "substitute_elasticity", "price_domestic_value"):
        bad = bad.withColumn(c, F.lit(None).cast("double"))
    with pytest.raises(Exception, match="unknown input_type"):
        I.shock_rates(bad).collect()
