"""Changes of tables by key: only touched buckets are written, and a crash leaves the table readable."""

import pytest
from pyspark.sql import functions as F

from tradeloom.sources import tables as L
from tradeloom.sources import versions as V
from tradeloom.streaming import flows

SCHEMA = "k int, v string, extra double"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        V.read_versioned(spark, path)
    V.upsert_versioned(spark.createDataFrame([(i, f"a{i}", 0.5) for i in range(200)], SCHEMA), path, ["k"], buckets=16)
    before = V.current(spark, path)["buckets"]
    V.upsert_versioned(spark.createDataFrame([(7, "new", None), (900, "more", 1.0)], SCHEMA), path, ["k"])
    after = V.current(spark, path)["buckets"]
    assert len(before) == 16 and sum(after[b] != before[b] for b in before) <= 2
    assert rows(V.read_versioned(spark, path).where("k in (7, 900) or k < 2")) == [(0, "a0", 0.5), (1, "a1", 0.5), (7, "new", None), (900, "more", 1.0)]
    assert V.read_versioned(spark, path).count() == 201
    with pytest.raises(ValueError, match="keys"):
        V.upsert_versioned(spark.createDataFrame([(7, "x", None)], SCHEMA), path, ["v"])
    for i in range(3):
        V.upsert_versioned(spark.createDataFrame([(7, f"n{i}", None)], SCHEMA), path, ["k"])
    assert V.vacuum(spark, path) and V.read_versioned(spark, path).count() == 201


def test_a_crash_before_the_list_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.upsert_versioned(spark.createDataFrame([(1, "a", None)], SCHEMA), path, ["k"], buckets=4)
    real = V._put_list
    monkeypatch.setattr(V, "_put_list", lambda *a: (_ for _ in ()).throw(RuntimeError("the driver was lost")))
    with pytest.raises(RuntimeError):
        V.upsert_versioned(spark.createDataFrame([(1, "b", None), (2, "c", None)], SCHEMA), path, ["k"])
    assert rows(V.read_versioned(spark, path)) == [(1, "a", None)]
    monkeypatch.setattr(V, "_put_list", real)
    V.upsert_versioned(spark.createDataFrame([(1, "b", None), (2, "c", None)], SCHEMA), path, ["k"])
    assert rows(V.read_versioned(spark, path)) == [(1, "b", None), (2, "c", None)]


def test_a_crash_between_the_renames_is_mended(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    L.upsert_table(spark.createDataFrame([(1, "a", None)], SCHEMA), path, ["k"])
    real = V._move

    def failing(session, old, new):
        if new == path:
            raise RuntimeError("the driver was lost")
        real(session, old, new)

    monkeypatch.setattr(V, "_move", failing)
    with pytest.raises(RuntimeError):
        L.upsert_table(spark.createDataFrame([(2, "b", None)], SCHEMA), path, ["k"])
    monkeypatch.setattr(V, "_move", real)
    L.upsert_table(spark.createDataFrame([(3, "c", None)], SCHEMA), path, ["k"])
    assert rows(spark.read.parquet(path)) == [(1, "a", None), (2, "b", None), (3, "c", None)]


def test_late_phases_touch_their_own_buckets(spark, tmp_path):
    kind = "supplier long, counterparty long, year int, quarter int, phase string, amount double, order_key long"
    source, raw, edges, checkpoint = (str(tmp_path / n) for n in ("in", "raw", "edges", "ck"))
    batches = [[(s, s + 1, 2024, 1, "1", 100.0, s) for s in range(40)], [(3, 4, 2024, 1, "2", 50.0, 99)], [(3, 4, 2024, 2, "1", 7.0, 100), (90, 91, 2024, 1, "1", 1.0, 101)]]
    lists = []
    for batch in batches:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(source)
        flows.filing_tables(spark.readStream.schema(kind).parquet(source), raw, edges, checkpoint, buckets=16).awaitTermination()
        lists.append(V.current(spark, edges)["buckets"])
    got = {(r.src, r.dst): r.sly_amt for r in V.read_versioned(spark, edges).collect()}
    assert len(got) == 41 and got[3, 4] == 57.0 and got[5, 6] == 100.0 and got[90, 91] == 1.0
    assert sum(lists[1][b] != lists[0][b] for b in lists[0]) == 1
    assert V.read_versioned(spark, raw).agg(F.count("*")).first()[0] == 43
