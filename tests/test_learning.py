"""The search flow and the loop from weak searches to synonyms."""

import tempfile

import pytest

from tradeloom.operators import learning as L
from tradeloom.operators import search as S
from tradeloom.sources import versions
from tradeloom.streaming.flows import weak_search_table

NAMES = {"1111000000": "steel pipe seamless", "1111100000": "steel pipe welded", "2222000000": "green tea leaf", "2222100000": "black tea leaf", "3333000000": "copper wire", "4444000000": "paper box"}


@pytest.fixture(scope="module")
def find(spark):
    catalog = spark.createDataFrame([(c, n, "2999-12-31") for c, n in NAMES.items()], "code string, name string, valid_to string").cache()
    index = S.weighted_tokens(catalog, {"name": "A"}).cache()
    return lambda queries, limit: S.search(queries, catalog, index, limit)


@pytest.fixture(scope="module")
def quick(spark):
    """Token matches, counted as two signals."""
    index = S.weighted_tokens(spark.createDataFrame(list(NAMES.items()), "code string, name string"), {"name": "A"}).cache()
    return lambda queries, limit: S.fuse([S.token_signal(queries, index)] * 2, limit)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_flow_extracts_expands_corrects_and_logs(spark, find):
    queries = spark.createDataFrame([(1, "where do I find STEEL  pipe?", ["steel pipe", "STEEL  pipe", "tea"]), (2, "cha", None), (3, "zzzz", []), (4, "leafx", None), (5, None, None)], "query_id int, query string, items array<string>")
    synonyms = spark.createDataFrame([("cha", "green tea"), ("find", "welded")], "alias string, official string")
    ready = {r.query_id: r.expanded for r in L.prepared(queries, synonyms).collect()}
    assert ready == {1: "STEEL pipe welded", 2: "cha green tea", 3: "zzzz", 4: "leafx", 5: ""}
    verdicts = spark.createDataFrame([(4, "ambiguous", "copper wire"), (2, "unrelated", None), (3, "unrelated", None)], "query_id int, verdict string, keywords string")
    hits, log = L.search_flow(queries, find, synonyms, verdicts)
    got = {(r.query_id, r.rk): r.code for r in hits.collect()}
    # the second query's score is high, so its verdict doesn't count; the fourth's is low
    assert got[1, 1] == "1111100000" and got[2, 1] == "2222000000" and got[4, 1] == "3333000000" and {q for q, _ in got} == {1, 2, 4}
    rows = [(r.query_id, r.expanded, r.low_confidence) for r in log.collect()]
    assert (4, "leafx", True) in rows and (4, "[again] copper wire", False) in rows and len(rows) == 6


def test_loop_registers_once_and_finds_more(spark, quick, folder):
    queue, learned = f"{folder}/queue", f"{folder}/learned"
    log = [("pekoe", "2024-01-01 10:00:00", 1, 0.0), ("pekoe", "2024-01-02 10:00:00", 2, 0.0), ("tubing", "2024-01-01 11:00:00", 3, 0.01), ("hopeless", "2024-01-01 12:00:00", 4, 0.0), ("steel pipe", "2024-01-01 12:00:00", 5, 0.9), (None, "2024-01-01 12:00:00", 6, 0.0)]
    frame = lambda rows: spark.createDataFrame(rows, "query string, ts string, event_id long, top_score double").selectExpr("query", "to_timestamp(ts) AS ts", "event_id", "top_score")
    frame(log[:3]).write.mode("append").parquet(f"{folder}/log")
    run = lambda: weak_search_table(spark.readStream.schema("query string, ts timestamp, event_id long, top_score double").parquet(f"{folder}/log"), queue, f"{folder}/offsets").awaitTermination()
    run()
    frame(log[3:]).write.mode("append").parquet(f"{folder}/log")
    run()
    state = lambda: {r.query: (r.event_id, r.resolved) for r in versions.read_versioned(spark, queue).collect()}
    assert state() == {"pekoe": (2, False), "tubing": (3, False), "hopeless": (4, False)}
    candidates = spark.createDataFrame(
        [("pekoe", "black tea leaf", 0.8, 1), ("pekoe", "copper wire", 0.2, 2), ("pekoe", "bad;term", 0.9, 0), ("tubing", "tubing", 0.9, 1), ("tubing", "steel pipe", 0.7, 2), ("hopeless", "qqqq", 0.9, 1), *[("hopeless", f"vain{i}", 0.9, 2 + i) for i in range(5)], ("hopeless", "green tea", 0.9, 9)],
        "query string, term string, cosine double, place int",
    )
    builtin = spark.createDataFrame([("brew", "tea")], "alias string, official string")
    tried = L.learn(spark, queue, learned, candidates, builtin, quick, dry_run=True)
    assert tried.count() == 2 and not any(done for _, done in state().values()) and versions.current(spark, learned)["version"] == 0
    asked = spark.createDataFrame([("pekoe", "pekoe")], "query_id string, query string")
    before = L.search_flow(asked, quick, L.synonyms_of(spark, builtin, learned))[0].count()
    first = {(r.alias, r.official) for r in L.learn(spark, queue, learned, candidates, builtin, quick).collect()}
    assert first == {("pekoe", "black tea leaf"), ("tubing", "steel pipe")}
    assert state() == {"pekoe": (2, True), "tubing": (3, True), "hopeless": (4, False)}
    assert L.learn(spark, queue, learned, candidates, builtin, quick).count() == 0
    assert versions.read_versioned(spark, learned).count() == 2
    hits = L.search_flow(asked, quick, L.synonyms_of(spark, builtin, learned))[0]
    assert before == 0 and hits.where("rk = 1").first().code == "2222100000"
    # a repeated batch opens nothing, a later weak search does
    L.enqueue(frame(log), queue)
    assert state()["pekoe"] == (2, True)
    L.enqueue(frame([("pekoe", "2024-02-01 10:00:00", 9, 0.0)]), queue)
    assert state()["pekoe"] == (9, False)


def test_a_run_that_stopped_before_closing_is_closed_by_the_next(spark, quick, folder):
    queue, learned = f"{folder}/queue", f"{folder}/learned"
    rows = spark.sql("SELECT 'pekoe' AS query, TIMESTAMP '2024-01-01 00:00:00' AS ts, 1L AS event_id, 0.0D AS top_score")
    L.enqueue(rows, queue)
    done = rows.selectExpr("query AS alias", "'black tea leaf' AS official", "0.03D AS score", "true AS enabled", "query", "ts")
    versions.upsert_versioned(done, learned, ["alias"])  # the crash comes here
    candidates = spark.createDataFrame([("pekoe", "green tea leaf", 0.9, 1)], "query string, term string, cosine double, place int")
    builtin = spark.createDataFrame([], "alias string, official string")
    assert L.learn(spark, queue, learned, candidates, builtin, quick).count() == 0
    assert L.open_queries(spark, queue).count() == 0
