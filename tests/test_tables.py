"""Loaders, text rules, search and the two streams on small tables."""

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import text as T
from tradeloom.operators import search as S
from tradeloom.sources import tables as L
from tradeloom.streaming import flows


def test_product_code_cases(spark):
    rows = [("01059910", False, "0105991000"), ("271020974", False, "2710209740"), ("0507901", False, "0507901000"), ("101211000", True, "0101211000"), ("2071320", True, "0207132000"), ("12345678901", False, None), ("12a", False, None), ("", False, None), (None, False, None)]
    df = spark.createDataFrame(rows, "raw string, numeric boolean, want string")
    assert df.where(~T.product_code(F.col("raw"), F.col("numeric")).eqNullSafe(F.col("want"))).count() == 0


def test_csv_loading_and_required_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("firm,sales\nx,12.5\ny,bad\n,3\n")
    got = L.read_csv(spark, str(tmp_path / "a.csv"), ["sales"], {"firm": "company"}, ["company", "sales"]).collect()
    assert [tuple(r) for r in got] == [("x", 12.5), ("y", None), (None, 3.0)]
    with pytest.raises(ValueError, match="missing"):
        L.read_csv(spark, str(tmp_path / "a.csv"), required=["nothing"])


def test_risk_pair_rejects_bad_input(spark):
    c = spark.createDataFrame([("A", "AA", 1.0), ("A", "B", 1.0)], "id string, grade string, sales double")
    e = spark.createDataFrame([("A", "Z", 0.5)], "source string, target string, share double")
    with pytest.raises(ValueError, match="repeated"):
        L.risk_pair(c, e)
    with pytest.raises(ValueError, match="unknown"):
        L.risk_pair(c.limit(1), e)


def test_industry_sheet_fills_down(spark):
    cols = "row_no int, c1 string, n1 string, c2 string, n2 string, c3 string, n3 string, c4 string, n4 string, c5 string, n5 string"
    rows = [(1, "A", "Farms (01~03)", "01", "Crops", "011", "Grain", "0111", "Rice", "01110", "Paddy"), (2, None, None, None, None, None, None, "0112", "Wheat", "01120", "Wheat"), (3, None, None, "02", "Wood", "021", "Trees", "0211", "Oak", "02110", "Oaks")]
    got = {(r.level, r.code): r for r in L.industry_levels(spark.createDataFrame(rows, cols)).collect()}
    assert got[1, "A"].name == "Farms" and got[1, "A"].span == "01~03" and got[1, "A"].children == "Crops Grain Wood Trees"
    assert got[2, "01"].children == "Grain Rice Paddy Wheat"


def test_upsert_table_replaces_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    L.upsert_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    L.upsert_table(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert L.truncate(spark, path) == 3 and spark.read.parquet(path).count() == 0


def test_text_gates(spark):
    df = spark.createDataFrame([("a b?", True), ("one two three four five six", True), ("please find rice", True), ("rice seed", False)], "t string, want boolean")
    assert df.where(T.looks_like_sentence(F.col("t"), ["please"]) != F.col("want")).count() == 0
    one = spark.createDataFrame([("<think>x</think> say {\"a\": 1} end",)], "t string").select(T.outer_json(F.col("t"), "a int").alias("j")).first()
    assert one.j.a == 1


def test_fusion_adds_reciprocal_ranks(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, code string, rk int")
    b = spark.createDataFrame([("q", "y", 1)], "query_id string, code string, rk int")
    got = [(r.code, round(r.score, 6)) for r in S.fuse([a, b], 5).orderBy("rk").collect()]
    assert got == [("y", round(1 / 61 + 1 / 62, 6)), ("x", round(1 / 61, 6))]


def test_late_filing_phase_replaces_its_quarter(spark, tmp_path):
    schema = "supplier string, counterparty string, year int, quarter int, phase string, amount double"
    source = str(tmp_path / "in")
    for rows in ([("A", "B", 2024, 1, "1", 100.0), ("A", "C", 2024, 1, "1", 5.0)], [("A", "B", 2024, 1, "2", 40.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        flows.filing_edges(stream, str(tmp_path / "raw"), str(tmp_path / "edges"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.src, r.dst): r.sly_amt for r in spark.read.parquet(str(tmp_path / "edges")).collect()}
    assert got == {("A", "B"): 40.0, ("A", "C"): 5.0}


def test_weak_search_queue_keeps_latest(spark, tmp_path):
    schema = "query string, ts timestamp, event_id long, top_score double"
    source = str(tmp_path / "in")
    for rows in ([("rice", 1, 0.01), ("oak", 2, 0.5)], [("rice", 3, 0.02)]):
        spark.createDataFrame([(q, i, s) for q, i, s in rows], "query string, event_id long, top_score double").withColumn("ts", F.timestamp_seconds("event_id")).select("query", "ts", "event_id", "top_score").coalesce(1).write.mode("append").parquet(source)
        flows.weak_search_queue(spark.readStream.schema(schema).parquet(source), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    assert [(r.query, r.event_id) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("rice", 3)]


def test_words_of_any_script(spark):
    df = spark.createDataFrame([("Café 희토류-자석, МОТОР x2 x2",), ("--",), (None,)], "t string")
    assert [r[0] for r in df.select(S.tokens(F.col("t"))).collect()] == [["café", "희토류", "자석", "мотор", "x2"], [], None]


def test_synonyms_must_improve_on_the_query_alone(spark):
    cand = spark.createDataFrame([(q, "magnet", t, 0.9) for q, t in [(1, "ferrite"), (2, "ferrite"), (3, "ferrite"), (4, "ferrite"), (5, "magnet"), (6, "ferrite")]], "query_id int, query string, term string, cosine double")
    alone = cand.select("query_id", "term", F.lit("8505110000").alias("code"), F.lit(0.02).alias("score"), F.lit(1).alias("rk"))
    joint = {1: 0.031, 2: 0.031, 3: 0.028, 4: 0.0164, 5: 0.05, 6: 0.031}
    combined = alone.withColumn("score", F.create_map(*[F.lit(x) for kv in joint.items() for x in kv])[F.col("query_id")])
    combined = combined.withColumn("code", F.when(F.col("query_id") == 6, "0101210000").otherwise("8505190000"))
    plain = spark.createDataFrame([(1, 0.03), (2, 0.032), (3, 0.016)], "query_id int, score double")
    got = S.learned_synonyms(cand, alone, combined, plain).orderBy("query_id").collect()
    # 1: over the threshold; 2: below its baseline; 3: half as much again; 4: one signal only; 5: part of the query; 6: no shared family
    assert [(r.query_id, r.term, r.score) for r in got] == [(1, "ferrite", 0.031), (3, "ferrite", 0.028)]
