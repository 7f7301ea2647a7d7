"""The top sets of a query against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import search as S
from tradeloom.operators import similar
from tradeloom.session import read


def plain(queries, catalog, pool):
    """Every pair of ``{key: set}`` that shares an element, ranked."""
    out = {}
    for q, a in queries.items():
        scored = sorted((-round(len(a & b) / len(a | b), 6), c) for c, b in catalog.items() if a & b)
        out |= {(q, c): (-s, k + 1) for k, (s, c) in enumerate(scored[:pool])}
    return out


def table(spark, sets, key):
    return spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], f"{key} string, els array<string>").repartition(3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rising_bounds_lose_no_set(spark, seed):
    """Skewed elements, ties, sets of one element, queries with unknown elements or none."""
    r = random.Random(seed)
    draw = lambda n: {f"e{int(60 * r.random() ** 3)}" for _ in range(n)}
    catalog = {f"c{i:03d}": draw(r.randint(1, 14)) for i in range(260)}
    queries = {f"q{i}": draw(r.randint(1, 14)) | ({f"unknown{i}"} if i % 3 == 0 else set()) for i in range(24)} | {"q_all_unknown": {"zz"}, "q_none": set()}
    for pool in (1, 7, 300):
        got = similar.nearest_sets(table(spark, queries, "query_id"), table(spark, catalog, "code"), pool)
        assert {(x.query_id, x.code): (x.score, x.rk) for x in got.collect()} == plain(queries, catalog, pool)


def test_part_names_equal_all_pairs_with_few_candidates(spark):
    part = read(spark, "/root/testdata/sf0.01", "part")
    catalog = part.select(F.col("p_partkey").cast("string").alias("code"), S.trigrams(F.col("p_name")).alias("els"))
    queries = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("string").alias("query_id"), S.trigrams(F.concat_ws(" ", "p_name", "p_type")).alias("els"))
    sets = lambda df, k: {x[k]: set(x.els) for x in df.collect()}
    want = plain(sets(queries, "query_id"), sets(catalog, "code"), 20)
    assert {(x.query_id, x.code): (x.score, x.rk) for x in similar.nearest_sets(queries, catalog, 20).collect()} == want
    pairs, bounds = similar.candidates(queries, catalog, 20)
    sharing = queries.select("query_id", F.explode("els").alias("e")).join(catalog.select("code", F.explode("els").alias("e")), "e").select("query_id", "code").distinct().count()
    print("candidates", pairs.count(), "of", sharing)
    assert bounds.where("bound <= 0").count() == 0
    assert pairs.count() < 0.5 * sharing


def test_pools_are_filled_by_the_smallest_codes(spark):
    catalog = spark.createDataFrame([("3", "abc"), ("1", "xyz"), ("2", None), ("4", "abcd")], "code string, name string")
    queries = spark.createDataFrame([("q", "abc"), ("n", None)], "query_id string, query string")
    got = {(r.query_id, r.code): (r.score > 0, r.rk) for r in S.trigram_signal(queries, catalog, 3, fill=True).collect()}
    assert got[("q", "3")] == (True, 1) and got[("q", "4")] == (True, 2) and got[("q", "1")] == (False, 3)
    assert sorted(rk for (q, _), (_, rk) in got.items() if q == "n") == [1, 2, 3]
    assert S.trigram_signal(queries.limit(0), catalog, 3, fill=True).count() == 0 and S.trigram_signal(queries, catalog.limit(0), 3, fill=True).count() == 0


def test_copies_meet_as_one_and_rank_as_all_pairs(spark, monkeypatch):
    """Copies of texts: both signals equal a plain version, and only distinct texts are met."""
    names = ["red bolt", "red ring", "old bolt", "hot red gear"]
    catalog = spark.createDataFrame([(f"c{k:03d}", names[k % 4], "iron" if k % 8 < 4 else "steel bolt") for k in range(96)], "code string, name string, kind string").repartition(3)
    queries = spark.createDataFrame([(f"q{k}", ["red bolt", "hot gear steel", None][k % 3]) for k in range(12)], "query_id string, query string")
    met = []
    seen = similar.nearest_sets

    def spy(q, c, pool):
        met.append((q.count(), c.count()))
        return seen(q, c, pool)

    monkeypatch.setattr(S, "nearest_sets", spy)
    sets = lambda rows, f: {k: f(v) for k, v in rows}
    grams = lambda t: {("  " + (t or "") + " ")[i : i + 3] for i in range(len(t or "") + 1)}
    texts, rows = [(r.query_id, r.query) for r in queries.collect()], catalog.collect()
    weights = {r.code: dict.fromkeys(r.kind.split(), 0.4) | dict.fromkeys(r.name.split(), 1.0) for r in rows}
    index = S.weighted_tokens(catalog, {"kind": "B", "name": "A"})
    assert {(r.code, r.token): r.weight for r in index.collect()} == {(c, t): w for c, x in weights.items() for t, w in x.items()}
    for pool in (1, 30, 60):
        got = {(r.query_id, r.code): (r.score, r.rk) for r in S.trigram_signal(queries, catalog, pool).collect()}
        assert got == plain(sets(texts, grams), sets([(r.code, r.name) for r in rows], grams), pool)
        got = {(r.query_id, r.code): (r.score, r.rk) for r in S.token_signal(queries, index, pool).collect()}
        want = {}
        for q, t in texts:
            scores = sorted((-round(sum(w for x, w in weights[c].items() if x in (t or "").split()), 6), c) for c in weights)
            want |= {(q, c): (-s, k + 1) for k, (s, c) in enumerate([x for x in scores if x[0] < 0][:pool])}
        assert got == want
    assert met == [(3, 4)] * 3


@pytest.mark.parametrize("weighted", [False, True])
def test_many_blocks_give_the_pools_of_all_pairs(spark, monkeypatch, weighted):
    """Blocks of few sets and pieces of few queries: bounds of the first blocks cut nothing that belongs to a pool, ties included."""
    monkeypatch.setattr(similar, "SETS", 20)
    monkeypatch.setattr(similar, "ASKING", 7)
    r = random.Random(5)
    draw = lambda n: {f"e{int(40 * r.random() ** 2)}" for _ in range(n)}
    catalog = {f"c{i:03d}": draw(r.randint(0, 9)) for i in range(300)}
    queries = {f"q{i}": draw(r.randint(0, 9)) for i in range(20)}
    weight = lambda c, e: (len(c) + int(c[1:]) % 3 + len(e)) / 10
    for pool in (1, 5, 200):
        if weighted:
            rows = spark.createDataFrame([(c, sorted(v), [weight(c, e) for e in sorted(v)]) for c, v in catalog.items()], "code string, els array<string>, weights array<double>")
            got = similar.heaviest_sets(table(spark, queries, "query_id"), rows, pool)
            want = {}
            for q, a in queries.items():
                scored = sorted((-round(sum(weight(c, e) for e in a & b), 6), c) for c, b in catalog.items() if a & b)
                want |= {(q, c): (-s, k + 1) for k, (s, c) in enumerate(scored[:pool])}
        else:
            got, want = similar.nearest_sets(table(spark, queries, "query_id"), table(spark, catalog, "code"), pool), plain(queries, catalog, pool)
        assert {(x.query_id, x.code): (x.score, x.rk) for x in got.collect()} == want


def test_names_that_all_share_their_words_make_no_pair_a_row(spark, monkeypatch):
    """4,000 different names of two words and a number: no plan joins the sets by their elements, and each text finds its own."""
    names = spark.range(4000).select(F.col("id").alias("k"), F.concat_ws(" ", F.lit("steel bolt"), (F.col("id") + 100000).cast("string")).alias("name"))
    catalog = names.select(F.col("k").alias("code"), S.trigrams(F.col("name")).alias("els"))
    queries = names.where("k % 20 = 0").select(F.col("k").alias("query_id"), S.trigrams(F.concat_ws(" ", "name", F.lit("large"))).alias("els"))
    kind = type(queries)
    met, seen = [], kind.join
    monkeypatch.setattr(kind, "join", lambda self, *a, **k: met.append(a) or seen(self, *a, **k))
    found = similar.nearest_sets(queries, catalog, 5)
    assert not met
    assert found.where("query_id = code AND rk = 1").count() == 200


def test_tokens_are_summed_in_as_many_pieces_as_the_catalog_asks_for(spark, monkeypatch):
    """Small rows aren't gathered into few tasks before they are cut into tokens."""
    monkeypatch.setattr(S, "ROWS", 10)
    catalog = spark.range(300).select(F.col("id").cast("string").alias("code"), F.lit("red bolt").alias("name"))
    index = S.weighted_tokens(catalog, {"name": "A"})
    assert index.rdd.getNumPartitions() == 30 and index.count() == 600
