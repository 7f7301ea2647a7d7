"""One-call assembly and volume scenarios on small graphs worked out by hand."""

import pytest

from tradeloom.operators import assembly as A

# A sells to B (60) and C (40), B to C (30), C to A (10), D to B (40), E to D (5); X is far away
EDGES = [("A", "B", 2024, 60.0), ("A", "C", 2024, 40.0), ("B", "C", 2024, 30.0), ("C", "A", 2024, 10.0), ("D", "B", 2024, 40.0), ("E", "D", 2024, 5.0), ("A", "B", 2023, 100.0), ("X", "Y", 2024, 1.0)]


@pytest.fixture(scope="module")
def tables(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, trade_year int, sly_amt double")
    firms = spark.createDataFrame([("A", "1", "a"), ("B", "2", "b"), ("C", None, "c"), ("D", "4", "d"), ("D", "5", "dd")], "bizno string, code string, name string")
    return edges, firms


def seeds(spark, *rows):
    return spark.createDataFrame(list(rows), "bizno string, value double")


def rates(graph):
    return {(r.src, r.dst): round(r.rate, 9) for r in graph.edges.collect()}


def test_rates_of_the_reach_are_named_and_warned_about(spark, tables):
    edges, firms = tables
    got = A.propagation_input(edges, seeds(spark, ("A", 2.0), (" A", 1.0), ("", 5.0), (None, 1.0)), firms, depth=1, year=2024, damping=0.5)
    # one undirected step reaches B and C; totals are of the induced edges
    assert rates(got) == {("A|1", "B|2"): 0.3, ("A|1", "C|"): 0.2, ("B|2", "C|"): 0.5, ("C|", "A|1"): 0.5}
    assert {tuple(r) for r in got.init.collect()} == {("A|1", 3.0)}
    assert {(r.node, r.is_seed) for r in got.nodes.collect()} == {("A|1", True), ("B|2", False), ("C|", False)}
    assert got.warnings == ["1 firms have no code: their ids end with a bar"]
    up = A.propagation_input(edges, seeds(spark, ("B", 1.0)), firms, depth=1, year=2024, damping=1.0, direction="upstream", within=False, factors=spark.createDataFrame([("A", "B", 0.5), ("C", "A", 0.0)], "src string, dst string, factor double"))
    # B's purchases are 100, C's 70; the factor goes by the stored direction, and a rate of 0 is no edge
    assert rates(up) == {("B|2", "A|1"): 0.3, ("B|2", "D|4"): 0.4, ("C|", "A|1"): round(40 / 70, 9), ("C|", "B|2"): round(30 / 70, 9)}
    far = A.propagation_input(edges, seeds(spark, ("E", 1.0)), firms, depth=2, normalise="none", weight=2.0)
    assert rates(far) == {("E|", "D|4"): 2.0, ("D|4", "B|2"): 2.0} and len(far.warnings) == 2


def test_industry_limits_seeds_and_every_step(spark, tables):
    edges, firms = tables
    mix = spark.createDataFrame([("A", "8400000000"), ("B", "8500000000"), ("C", "1000000000"), ("D", "8411111111"), ("E", "8400000000")], "company string, code string")
    got = A.propagation_input(edges, seeds(spark, ("A", 1.0), ("C", 1.0)), firms, year=2024, damping=1.0, mix=mix, chapters=["84", "85"])
    assert {r.bizno for r in got.nodes.collect()} == {"A", "B", "D", "E"}
    assert rates(got) == {("A|1", "B|2"): 1.0, ("D|4", "B|2"): 1.0, ("E|", "D|4"): 1.0}
    assert got.warnings[0] == "1 seeds are outside the chosen industry"
    none = A.propagation_input(edges, seeds(spark, ("C", 1.0)), firms, mix=mix, chapters=["84"])
    assert none.edges.count() == 0 and none.init.count() == 0 and "no edge of the chosen industry" in none.warnings
    assert A.propagation_input(edges, seeds(spark), firms).warnings == ["no seeds"]


def test_volume_changes_spread_by_side(spark, tables):
    edges, firms = tables
    value = lambda rows: {(r.direction, r.bizno): round(r.value, 9) for r in rows.collect()}
    one = seeds(spark, ("A", 0.0))
    got, _ = A.volume_scenario(edges, one, firms, multipliers=spark.createDataFrame([("A", 0.8)], "bizno string, multiplier double"), directions=("downstream",), depth=1, year=2024, damping=0.5)
    assert value(got) == {("downstream", "A"): 0.8, ("downstream", "B"): 0.94, ("downstream", "C"): round(1 - 0.2 * (0.2 + 0.3 * 0.5), 9)}
    fed, _ = A.volume_scenario(edges, one, firms, multipliers=spark.createDataFrame([("A", 0.8)], "bizno string, multiplier double"), directions=("downstream",), pin=False, depth=1, year=2024, damping=0.5)
    assert value(fed)["downstream", "A"] < 0.8
    still, _ = A.volume_scenario(edges, one, firms, multipliers=spark.createDataFrame([("A", 1.0)], "bizno string, multiplier double"), directions=("downstream",), depth=1, year=2024)
    assert set(value(still).values()) == {1.0}
    # the sale to B is 60 of B's purchases of 100: + 20 % of it is + 12 %, the seller itself stays
    edge, _ = A.volume_scenario(edges, one, firms, edge_multipliers=spark.createDataFrame([("A", "B", 1.2)], "src string, dst string, factor double"), directions=("downstream",), depth=1, year=2024, damping=0.5)
    assert value(edge)["downstream", "A"] == 1.0 and value(edge)["downstream", "B"] == 1.12
    specs = spark.createDataFrame([("A", "sales", 0.8, "B"), ("A", "hire", 0.8, None), (None, "sales", 0.8, None), ("A", "sales", -1.0, None)], "bizno string, side string, factor double, partner string")
    sold, warned = A.volume_scenario(edges, one, firms, specs=specs, depth=1, year=2024, damping=0.5)
    assert {d for d, _ in value(sold)} == {"downstream"} and value(sold)["downstream", "B"] == 0.88
    assert warned[:3] == ["1 changes left out: factor", "1 changes left out: no firm", "1 changes left out: side"]
    # purchases of B: A sells 60 of its 100 to B, D all its 40
    bought, _ = A.volume_scenario(edges, seeds(spark, ("B", 0.0)), firms, specs=spark.createDataFrame([("B", "purchase", 1.5, None)], "bizno string, side string, factor double, partner string"), depth=1, year=2024, damping=0.5)
    assert value(bought)["upstream", "A"] == 1.3 and value(bought)["upstream", "D"] == 1.5 and value(bought)["upstream", "B"] == 1.0
