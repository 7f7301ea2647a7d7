"""Nearest vectors against a plain version."""

import numpy as np
import pytest

from tradeloom.operators import vectors


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))
    x[5], x[17] = x[9], x[9]  # ties
    x[30] = 0
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    catalog = spark.createDataFrame([*rows, (900, None), (901, [1.0, 2.0])], "code int, vec array<double>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", rows[i][1]) for i in range(0, 900, 30)] + [("none", None)], "query_id string, vec array<double>")
    norm = np.sqrt((x * x).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        sims = np.round((x @ x.T) / norm[:, None] / norm[None], 6)
    want = {}
    for i in range(0, 900, 30):
        if norm[i]:
            order = sorted((j for j in range(900) if norm[j]), key=lambda j: (-sims[i, j], j))[:10]
            want |= {(f"q{i}", j): k + 1 for k, j in enumerate(order)}
    return queries, catalog, want


def test_blocks_give_the_exact_neighbours(tables):
    queries, catalog, want = tables
    for block in (1024, 7):
        got = {(r.query_id, r.code): r.rk for r in vectors.exact(queries, catalog, 10, block).collect()}
        assert got.keys() == want.keys() and sum(got[k] != want[k] for k in want) <= 2  # rounding may swap neighbours at equal distance


def test_lists_find_most_neighbours(tables):
    queries, catalog, _ = tables
    truth = vectors.exact(queries, catalog, 10)
    assert vectors.recall(vectors.by_lists(queries, catalog, 10, lists=12), truth).first().recall >= 0.9
    assert vectors.recall(vectors.by_lists(queries, catalog, 10, lists=12, probes=12), truth).first().recall == pytest.approx(1.0, abs=0.02)


def test_nothing_is_near_nothing(tables):
    queries, catalog, _ = tables
    assert vectors.exact(queries.limit(0), catalog).count() == 0
    assert vectors.exact(queries, catalog.limit(0)).count() == 0


def test_lists_in_pieces_find_what_all_lists_hold(tables, monkeypatch):
    """With every list probed the pieces give the exact neighbours, and each piece sends no more than the pool of a query."""
    queries, catalog, want = tables
    monkeypatch.setattr(vectors, "PIECE", 20)
    monkeypatch.setattr(vectors, "ASKING", 3)
    sent = []
    real = vectors._cut
    monkeypatch.setattr(vectors, "_cut", lambda scored, pool: (sent.append(scored.groupBy("query_id").count().agg({"count": "max"}).first()[0]), real(scored, pool))[1])
    got = {(r.query_id, r.code): r.rk for r in vectors.by_lists(queries, catalog, 10, lists=4, probes=4).collect()}
    assert got.keys() == want.keys() and sum(got[k] != want[k] for k in want) <= 2
    assert sent[-1] < 900  # not every vector of the lists


def test_best_of_batches_keep_ties_by_code():
    rng = np.random.default_rng(3)
    sims = np.round(rng.random((7, 400)), 2)
    sims[:, ::9], sims[4] = np.nan, np.nan
    best, codes = vectors._Best(7, 10), rng.permutation(400)
    for a in (0, 6, 150, 155, 400):
        best.add(sims[:, a : a + {0: 6, 6: 144, 150: 5, 155: 245}.get(a, 0)], codes[a : a + {0: 6, 6: 144, 150: 5, 155: 245}.get(a, 0)])
    for q in range(7):
        order = sorted((k for k in range(400) if not np.isnan(sims[q, k])), key=lambda k: (-sims[q, k], codes[k]))[:10]
        assert list(best.codes[best.at == q]) == [codes[k] for k in order]
