"""The two append flows as Structured Streaming: the queue of weak searches and late filing phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradeloom.operators.edges import yearly_edges
from tradeloom.operators.learning import enqueue
from tradeloom.sources import versions


def latest_low_confidence(rows: DataFrame, low: float) -> DataFrame:
    """``(query, ts, event_id)``: the latest row of each query whose score is under ``low``."""
    last = rows.where(F.col("top_score") < low).groupBy("query").agg(F.max(F.struct("ts", "event_id")).alias("l"))
    return last.select("query", "l.ts", "l.event_id")


def _read(spark, path: str, schema) -> DataFrame:
    return spark.read.parquet(path) if versions.recover(spark, path) else spark.createDataFrame([], schema)


def weak_search_queue(log: DataFrame, table: str, checkpoint: str, low: float = 0.025) -> StreamingQuery:
    """Keep in ``table`` the latest low-confidence row of each query of a streamed search log ``(query, ts, event_id, top_score)``."""

    def upsert(batch: DataFrame, _: int) -> None:
        new = latest_low_confidence(batch, low)
        old = _read(batch.sparkSession, table, new.schema)
        both = old.unionByName(new).groupBy("query").agg(F.max(F.struct("ts", "event_id")).alias("l"))
        versions.replace(both.select("query", "l.ts", "l.event_id"), table)

    return log.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weak_search_table(log: DataFrame, queue: str, checkpoint: str, low: float = 0.025) -> StreamingQuery:
    """As :func:`weak_search_queue`, in the versioned queue that :func:`learning.learn` works off; a batch rewrites only the buckets of its queries."""
    return log.writeStream.foreachBatch(lambda batch, _: enqueue(batch, queue, low)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def filing_edges(filings: DataFrame, raw: str, edges: str, checkpoint: str) -> StreamingQuery:
    """Append streamed filings to ``raw`` and keep yearly REPLACE edges in ``edges``.

    A late phase replaces its quarter, however late it is, so there is no
    watermark: only the touched pairs and years are made anew from all raw
    filings. A batch that runs again appends nothing twice, as its rows are
    stored under its number.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{raw}/batch={number}")
        every = spark.read.schema(batch.schema).parquet(f"{raw}/batch=*")
        keys = batch.select("supplier", "counterparty", "year").distinct()
        fresh = yearly_edges(every.join(keys, ["supplier", "counterparty", "year"], "left_semi"), "REPLACE")
        touched = keys.select(F.col("supplier").alias("src"), F.col("counterparty").alias("dst"), F.col("year").alias("trade_year"))
        old = _read(spark, edges, fresh.schema).join(touched, ["src", "dst", "trade_year"], "left_anti")
        versions.replace(old.unionByName(fresh), edges)

    return filings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def filing_tables(filings: DataFrame, raw: str, edges: str, checkpoint: str, buckets: int = versions.BUCKETS) -> StreamingQuery:
    """As :func:`filing_edges`, in versioned tables: a batch reads and rewrites only the key buckets that its filings touch.

    A batch that runs again drops the rows it stored under its number before.
    Both tables are read by :func:`versions.read_versioned`.
    """
    keys, pair = ["supplier", "counterparty", "year"], ["src", "dst", "trade_year"]

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("batch", F.lit(number).cast("long"))
        kind = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        touched = batch.select(*keys).distinct()
        versions.change(raw, touched, keys, lambda old: old.where(F.col("batch") != number).unionByName(new), kind(new), buckets)
        mine = versions.read_touched(spark, raw, touched).join(touched, keys, "left_semi")
        fresh = yearly_edges(mine.drop("batch"), "REPLACE")
        gone = touched.select(F.col("supplier").alias("src"), F.col("counterparty").alias("dst"), F.col("year").alias("trade_year"))
        versions.change(edges, gone, pair, lambda old: old.join(gone, pair, "left_anti").unionByName(fresh), kind(fresh), buckets)

    return filings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
