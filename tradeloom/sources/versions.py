"""Tables that change by key without a moment in which they can't be read.

A versioned table lies in folders of key buckets. A change writes the buckets it
touches to folders of a new version and then puts one small list of the current
folders in place by a rename, so readers see all of a change or none, and a
crash before the rename leaves the table as it was. A plain table is replaced
by two renames, and a reader that comes between them puts the new one in place.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.operators.edges import upsert
from tradeloom.session import is_written

BUCKETS = 64


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, files = _files(spark, path)
    return files.exists(at)


def _move(spark: SparkSession, old: str, new: str) -> None:
    (a, files), (b, _) = _files(spark, old), _files(spark, new)
    if files.exists(b) or not files.rename(a, b):
        raise RuntimeError(f"{new} is there already, or {old} could not be moved")


def _delete(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)


def current(spark: SparkSession, path: str) -> dict:
    """The newest list: ``version``, ``buckets`` (number to version), ``count``, ``keys``, ``schema``; version 0 without a table."""
    at, files = _files(spark, f"{path}/lists")
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    versions = [int(n[:-5]) for n in names if n.endswith(".json")]
    if not versions:
        return {"version": 0, "buckets": {}}
    text = spark.read.text(f"{path}/lists/{max(versions)}.json", wholetext=True).first().value
    return json.loads(text)


def _folders(path: str, listed: dict, only: set[int] | None = None) -> list[str]:
    return [f"{path}/v{v}/bucket={b}" for b, v in listed["buckets"].items() if only is None or int(b) in only]


def read_versioned(spark: SparkSession, path: str) -> DataFrame:
    """The table as its newest list has it."""
    listed = current(spark, path)
    if not listed["version"]:
        raise ValueError(f"no table at {path}")
    folders = _folders(path, listed)
    return spark.read.schema(listed["schema"]).parquet(*folders) if folders else spark.createDataFrame([], listed["schema"])


def read_touched(spark: SparkSession, path: str, touched: DataFrame) -> DataFrame:
    """The rows of the buckets that hold the keys of ``touched``."""
    listed = current(spark, path)
    bucket = F.pmod(F.xxhash64(*listed["keys"]), F.lit(listed["count"])).cast("int").alias("bucket")
    folders = _folders(path, listed, {r.bucket for r in touched.select(bucket).distinct().collect()})  # as many as there are buckets
    return spark.read.schema(listed["schema"]).parquet(*folders) if folders else spark.createDataFrame([], listed["schema"])


def change(path: str, touched: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame], schema: str, buckets: int = BUCKETS) -> int:
    """Give the rows of the buckets of ``touched(*keys)`` to ``make`` and keep what it returns in their place; returns the new version.

    ``make`` gets all rows of these buckets, those of other keys included, and
    must return them too. The number of buckets is fixed by the first change.
    """
    spark = touched.sparkSession
    listed = current(spark, path)
    count, version = listed.get("count", buckets), listed["version"] + 1
    if listed.get("keys", keys) != keys:
        raise ValueError(f"the table's keys are {listed['keys']}")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int").alias("bucket")
    hit = {r.bucket for r in touched.select(bucket).distinct().collect()}  # as many as there are buckets
    folders = _folders(path, listed, hit)
    old = spark.read.schema(listed["schema"]).parquet(*folders) if folders else spark.createDataFrame([], schema)
    new = make(old)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
    new.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{version}")
    at, files = _files(spark, f"{path}/v{version}")
    made = {s.getPath().getName().split("=")[1] for s in files.listStatus(at) if s.getPath().getName().startswith("bucket=")}
    kept = {b: v for b, v in listed["buckets"].items() if int(b) not in hit}
    text = json.dumps({"version": version, "buckets": kept | dict.fromkeys(sorted(made, key=int), version), "count": count, "keys": keys, "schema": kind})
    _put_list(spark, path, version, text)
    return version


def _put_list(spark: SparkSession, path: str, version: int, text: str) -> None:
    """The one step that makes a change visible; a second writer of the same version fails."""
    draft = f"{path}/drafts/{version}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(draft)
    at, files = _files(spark, draft)
    part = next(s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().startswith("part-"))
    folder, _ = _files(spark, f"{path}/lists")
    files.mkdirs(folder)
    _move(spark, f"{draft}/{part}", f"{path}/lists/{version}.json")


def upsert_versioned(updates: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Rows of ``updates`` replace those with their keys or are added; other buckets stay as they are."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.schema.fields)
    return change(path, updates.select(*keys), keys, lambda old: upsert(old, updates, keys), schema, buckets)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete the folders of versions that none of the last ``keep`` lists names; returns these versions."""
    newest = current(spark, path)["version"]
    lists = [json.loads(spark.read.text(f"{path}/lists/{v}.json", wholetext=True).first().value) for v in range(max(1, newest - keep + 1), newest + 1)]
    used = {v for listed in lists for v in listed["buckets"].values()}
    gone = [v for v in range(1, newest + 1) if v not in used and _exists(spark, f"{path}/v{v}")]
    for v in gone:
        _delete(spark, f"{path}/v{v}")
    return gone


def recover(spark: SparkSession, path: str) -> bool:
    """Finish or undo a replacement of a plain table that stopped half-way; returns whether there is a table."""
    if not _exists(spark, path):
        if is_written(spark, f"{path}.next"):
            _move(spark, f"{path}.next", path)
        elif _exists(spark, f"{path}.before"):
            _move(spark, f"{path}.before", path)
    return _exists(spark, path)


def replace(df: DataFrame, path: str) -> None:
    """Write ``df``, which may come from the table itself, beside the table at ``path`` and put it in its place."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.next")
    if recover(spark, path):
        _delete(spark, f"{path}.before")
        _move(spark, path, f"{path}.before")
    if not _exists(spark, path):
        recover(spark, path)
    _delete(spark, f"{path}.before")
