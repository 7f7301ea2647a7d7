"""The shared folder of durable tables."""

from types import SimpleNamespace

import pytest

from tradeloom import session


def stand_in(master, setting=None):
    conf = SimpleNamespace(get=lambda key, default=None: setting or default)
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None))
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(stand_in("spark://host:7077"))
    assert session.shared_folder(stand_in("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"


def test_tables_are_read_back_and_discarded(spark):
    table = session.durable(spark.range(5).toDF("n"))
    assert sorted(r.n for r in table.collect()) == [0, 1, 2, 3, 4]
    session.discard(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0]).count()
