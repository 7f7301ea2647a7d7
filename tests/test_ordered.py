"""Places, pages, carried values and order statistics without a one-task window."""

import random

import pytest

from tradeloom.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([None, "a", "b", "c"]) if i % 3 else None, rng.randrange(40), float(rng.gauss(0, 1e6))) for i in range(5000)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "id long, name string, tie int, x double").repartition(7)


def test_places_and_pages(rows):
    data, df = rows
    in_order = ordered.in_order(df, "tie", "id")
    want = sorted(data, key=lambda r: (r[2], r[0]))
    got = {r.place: r.id for r in in_order.placed().collect()}
    assert got == {k + 1: r[0] for k, r in enumerate(want)} and in_order.total == 5000
    for page in (1, 2, 117, 250):
        assert [(r.place, r.id) for r in in_order.page(page, 20).orderBy("place").collect()] == [(k + 1, want[k][0]) for k in range(20 * page - 20, min(20 * page, 5000))]
    assert in_order.page(251, 20).count() == 0


def test_a_page_reads_its_own_partition(rows):
    plan = ordered.in_order(rows[1], "id").page(3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or" in plan or "GreaterThanOrEqual(_at" in plan


def test_ties_spread_over_partitions(spark):
    table = ordered.in_order(spark.range(4000).selectExpr("1 as k", "id"), "k")
    assert len(table.before) > 2 and max(table._size(p) for p in table.before) < 3000
    assert sorted(r.place for r in table.placed().collect()) == list(range(1, 4001))


def test_values_are_carried_over_partitions(rows):
    data, df = rows
    want, last = [], None
    for r in sorted(data):
        last = r[1] if r[1] is not None else last
        want.append((r[0], last))
    got = ordered.carried_forward(df, ["name"], "id").select("id", "name").collect()
    assert sorted(map(tuple, got)) == want


def test_nothing_to_order(spark):
    none = spark.createDataFrame([], "id long, name string")
    assert ordered.in_order(none, "id").placed().count() == 0
    assert ordered.in_order(none, "id").page(1).count() == 0
    assert ordered.carried_forward(none, ["name"], "id").count() == 0
    assert ordered.order_statistics(none, "id", ["name"], [0.5]).count() == 0


def test_order_statistics_are_exact(rows):
    data, df = rows
    whole = {round(r.fraction, 3): r.value for r in ordered.order_statistics(df, "x", [], [0.0, 0.5, 0.95, 0.99, 1.0], bins=8).collect()}
    xs = sorted(r[3] for r in data)
    assert whole == {0.0: xs[0], 0.5: xs[2499], 0.95: xs[4749], 0.99: xs[4949], 1.0: xs[-1]}
    got = {(r.tie, r.fraction): r.value for r in ordered.order_statistics(df, "x", ["tie"], [0.5]).collect()}
    for tie in range(40):
        mine = sorted(r[3] for r in data if r[2] == tie)
        assert got[tie, 0.5] == mine[-(-len(mine) // 2) - 1]
