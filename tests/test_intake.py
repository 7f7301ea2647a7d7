"""Graphs of a year, triples, seeds, run links, labels, top lists and masters on small tables."""

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import labels as L
from tradeloom.operators import impacts as I
from tradeloom.operators import intake as N
from tradeloom.operators import search as S
from tradeloom.sources import tables as T


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_graph_of_a_year_keeps_nodes_that_only_edges_name(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "node string, name string")
    edges = spark.createDataFrame([("a", "c", 2020, None), ("b", "a", 2021, 5)], "src string, dst string, trade_year int, sly_amt long")
    got, kept = N.graph_of_year(nodes, edges, 2020, "sly_amt")
    assert _rows(got) == [("a", "A"), ("b", "B"), ("c", None)]
    assert _rows(kept.select("src", "dst", "weight")) == [("a", "c", 1.0)]
    assert _rows(N.graph_of_year(nodes, edges)[1].select("src", "weight")) == [("a", 1.0), ("b", 1.0)]
    with pytest.raises(ValueError, match="unknown weight"):
        N.weighted_edges(edges, "src")


def test_firms_take_their_own_sector_before_the_linked_one(spark):
    firms = spark.createDataFrame([(1, "x"), (2, None), (3, None)], "firm int, sector string")
    linked = spark.createDataFrame([(1, "y"), (2, "z"), (2, "w")], "firm int, sector string")
    exports = spark.createDataFrame([(1, 2020), (2, 2021)], "firm int, year int")
    got = N.firm_tables(firms, linked, {"exports": exports}, 2021)
    assert _rows(got["firms"]) == [(1, "x"), (2, "w"), (3, None)]
    assert _rows(got["exports"]) == [(2, 2021)]


def test_triples_of_any_names(spark):
    t = spark.createDataFrame([("", "b", "c", 0.0), (None, None, "c", 0.5), ("a", None, None, 0.5), ("a", None, "d", None)], "from_ string, p1 string, to string, w double")
    good, bad = N.norm_triples(t)
    assert _rows(good) == [("b", "c", 0.0)]
    assert sorted(r.reason for r in bad.collect()) == ["no dst", "no rate", "no src"]
    with pytest.raises(ValueError, match="no column for rate"):
        N.norm_triples(t.drop("w"))


def test_seeds_are_checked_one_rule_after_the_other(spark):
    ten = "0101210000"
    rows = [
        ("ok", "c", 0.0, [ten], -2.0, "2025"), (None, "c", 1.0, [ten], 0.1, "2025"), ("n", "c", -1.0, [ten], 0.1, "2025"), ("i", "c", 1.0, [ten], float("inf"), "2025"),
        ("e", "c", 1.0, [], 0.1, "2025"), ("s", "c", 1.0, [ten, "0101"], 0.1, "2025"), ("l", "c", 1.0, [ten + "\n"], 0.1, "2025"), ("z", "c", 1.0, [None], 0.1, "2025"), ("y", "c", 1.0, [ten], 0.1, "25"), ("c", None, 1.0, [ten], 0.1, "2025"),
    ]
    seeds = spark.createDataFrame(rows, "node string, company string, amount double, codes array<string>, rate double, year string")
    good, bad = N.checked_seeds(seeds)
    assert [r.node for r in good.collect()] == ["ok"]
    assert {r.node: r.reason for r in bad.collect()} == {
        None: "no node", "n": "amount below 0", "i": "rate not finite", "e": "no code", "s": "code not of 10 digits", "l": "code not of 10 digits", "z": "code not of 10 digits", "y": "year not of 4 digits", "c": "no company",
    }
    assert N.checked_seeds(seeds.drop("codes", "company", "year"), "volume")[0].count() == 7
    assert N.checked_seeds(seeds.limit(0))[0].count() == 0
    with pytest.raises(ValueError, match="kind"):
        N.seed_rules("price")


def test_links_of_runs_need_known_ends(spark):
    impact = spark.createDataFrame([("r1", 1, 2.0), ("r1", 1, 3.0), ("r1", 9, 1.0), ("r9", 1, 1.0)], "run_id string, firm int, revenue_sum double")
    firms = spark.createDataFrame([(1,), (2,)], "firm int")
    runs = spark.createDataFrame([("r1", "s1"), ("r2", None), ("r3", "s9")], "run_id string, scenario_id string")
    got = N.impact_links(impact, firms, runs, spark.createDataFrame([("s1",)], "scenario_id string"))
    assert _rows(got["impacts"]) == [("r1", 1, 3.0)]
    assert _rows(got["executed_as"]) == [("s1", "r1")]


def test_labels_and_texts(spark):
    df = spark.createDataFrame([("1", "9", " ", "b"), (None, "2", "Kim", "None"), ("7", None, None, None)], "scaledivcd string, ltgmktdivcd string, rep string, frgivs_crp_yn string")
    got = df.select(L.label("scaledivcd", F.col("scaledivcd")), L.label("ltgmktdivcd", F.col("ltgmktdivcd")))
    assert _rows(got) == sorted([("대기업", "기타"), ("-", "코스닥"), ("7", "-")], key=repr)
    text = L.profile_text("id", {"rep": "who"}, {"scaledivcd": "size", "frgivs_crp_yn": "foreign"})
    assert [r[0] for r in df.withColumn("id", F.monotonically_increasing_id() * 0).select(text).collect()] == ["id: 0\nwho: -\nsize: 대기업\nforeign: b", "id: 0\nwho: Kim", "id: 0\nwho: -\nsize: 7"]
    codes = spark.createDataFrame([("0101",), ("0101210000",), (None,)], "c string").select(*L.padded_code(F.col("c")))
    assert _rows(codes) == sorted([("0101000000", True), ("0101210000", False), ("0000000000", True)], key=repr)


def test_verdicts_on_refusals(spark):
    rows = [(True, 0, "질문과 무관", "거부(정상)"), (True, 2, "확실하지 않음", "부분거부"), (True, 0, "x", "부분거부"), (True, 1, None, "오추천"), (False, 1, "x", "유효 추천"), (False, 1, "무관", "거부"), (False, None, "x", "후보없음")]
    df = spark.createDataFrame(rows, "unrelated boolean, n int, answer string, want string")
    verdict = L.refusal_verdict(F.col("unrelated"), F.col("n"), F.col("answer"))[1]
    assert df.where(~verdict.eqNullSafe(F.col("want"))).count() == 0


def test_top_lists_break_ties_by_firm(spark):
    df = spark.createDataFrame([(3, -5.0, 0.1), (1, 5.0, 0.1), (2, 1.0, 0.9)], "firm int, revenue_sum double, tis double")
    assert [r.firm for r in I.top_impacts(df, 2).collect()] == [1, 3]
    assert [r.firm for r in I.top_scores(df, 2).collect()] == [2, 1]


def test_autocomplete_is_between_0_and_1(spark):
    firms = spark.createDataFrame([(1, "Daehan Steel"), (2, "Daehan Oil"), (3, "Zeta")], "firm int, name string")
    got = S.autocomplete(spark.createDataFrame([("q", "daehan oil")], "query_id string, query string"), firms).collect()
    assert [(r.firm, r.rk) for r in got] == [(2, 1), (1, 2)] and got[0].score == 1.0


def test_masters_are_upserted(spark, tmp_path):
    one = spark.createDataFrame([("S1", "old"), ("S2", "b")], "code string, name string")
    two = spark.createDataFrame([("S1", "new")], "code string, name string")
    assert T.load_masters({"sectors": one}, str(tmp_path)) == {"sectors": 2}
    T.load_masters({"sectors": two}, str(tmp_path))
    assert _rows(spark.read.parquet(str(tmp_path / "sectors"))) == [("S1", "new"), ("S2", "b")]
    with pytest.raises(ValueError, match="unknown masters"):
        T.load_masters({"colours": one}, str(tmp_path))
