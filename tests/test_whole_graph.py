"""Graph queries without SQL cover all companies and pairs."""

import pytest

from tradeloom.plans import graph_queries as Q


def _views(spark, links, companies):
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, amount double")
    tables = {"v_pair": pairs, "v_block_edge": pairs.where("floor(src / 4) = floor(dst / 4)"), "v_company": spark.createDataFrame([(c,) for c in companies], "company long")}
    return tables.__getitem__


def test_betweenness_is_of_the_whole_graph(spark):
    got = {r.node: r.betweenness for r in Q.g30_betweenness(_views(spark, [(0, 61), (61, 7), (50, 61), (7, 50), (3, 0)], [])).collect()}
    # over 4 * 3 pairs; 0 stands between 3 and three others, 61 between 0, 3 and two, 50 and one, 7 before 50 for three, 50 between 7 and 61
    assert got == pytest.approx({0: 3 / 12, 3: 0.0, 7: 3 / 12, 50: 1 / 12, 61: 5 / 12}, abs=1e-6)


def test_tariff_reaches_all_companies(spark):
    got = {(r.direction, r.node): r.value for r in Q.g10_tariff_both_directions(_views(spark, [(0, 30), (30, 41), (45, 0)], [0, 30, 41, 45])).collect()}
    assert got == pytest.approx({("downstream", 0): 100, ("downstream", 30): 85, ("downstream", 41): 72.25, ("upstream", 0): 100, ("upstream", 45): 85}, abs=1e-4)


def test_linear_solve_has_no_row_for_a_company_without_a_rate(spark):
    """Company 2 of the right side has no edge in the view."""
    rates = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.4), (6, 7, 0.25)], "src long, dst long, rate double")
    companies = spark.createDataFrame([(k,) for k in (0, 1, 2, 6, 7)], "company long")
    got = {r.i: r.x for r in Q.g16_linear_solve({"v_block_rate": rates, "v_company": companies}.__getitem__).collect()}
    assert got == {0: 125.0, 1: 62.5, 6: 100.0, 7: 25.0}


def test_views_that_are_read_again_are_made_once(spark, monkeypatch):
    """Pages of firms and the impact table come from tables that were written."""
    from tradeloom.operators import edges as E
    from tradeloom.operators import impacts as I
    from tradeloom.plans import edge_queries

    seen = []
    page, table = E.firm_page, I.impact_table
    monkeypatch.setattr(E, "firm_page", lambda firms, *a: (seen.append(firms), page(firms, *a))[1])
    monkeypatch.setattr(I, "impact_table", lambda firms, *a: (seen.append(firms), table(firms, *a))[1])
    firms = spark.createDataFrame([(k, float(k), 1.0, 2.0, 3.0) for k in range(45)], "company long, sales_fin double, sales_est double, sales_ml double, purchases double")
    pages = edge_queries.t8_firm_page(lambda v: firms).collect()
    assert [r.company for r in sorted(pages, key=lambda r: (r.sort_key, r.place)) if r.sort_key == "sales_fin"] == list(range(24, 4, -1))
    impact = spark.createDataFrame([(1, "run1", 1999, 1.0, 2.0, 3.0, 1.0, False)], "firm long, run_id string, scenario_seq int, rev_demand double, rev_supply double, cost_total double, cost_direct double, capped boolean")
    assert [r.revenue_sum for r in Q._impact(lambda v: impact).collect()] == [3.0]
    assert len(seen) == 5 and all("/tradeloom-" in f for df in seen for f in df.inputFiles()) and all(df.inputFiles() for df in seen)
