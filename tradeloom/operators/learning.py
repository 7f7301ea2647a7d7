"""Search as a whole flow on query tables, and synonyms learned from the searches that found little.

The feedback loop runs over two versioned tables. The queue keeps the latest
weak row of each query, ``(query, ts, event_id, top_score, resolved)``; the
learned synonyms are ``(alias, official, score, enabled, query, ts)``, where
``query`` and ``ts`` name the row of the queue that a synonym came from. Both
change by key in the buckets they touch, so a run may stop anywhere and be
repeated: a synonym whose row of the queue is still open closes it before
anything else is searched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.functions.text import expand_queries, keep_items, merge_synonyms, normalise_query
from tradeloom.operators import search as S
from tradeloom.session import discard, durable
from tradeloom.sources import versions

QUEUE = "query string, ts timestamp, event_id bigint, top_score double, resolved boolean"
SYNONYMS = "alias string, official string, score double, enabled boolean, query string, ts timestamp"

#: Fixed value: score under which the first hit of a query is judged.
JUDGED_BELOW = 0.025

#: ``(queries(query_id, query), limit)`` to ``(query_id, code, score, rk)``.
Searcher = Callable[[DataFrame, int], DataFrame]


def prepared(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``(query_id, query, expanded)``: the extracted items that a query holds, else the query, normalised and expanded.

    ``queries(query_id, query[, items array<string>])``; synonyms are sought in
    the query as it came too, as extraction may cut an alias.
    """
    items = F.coalesce(F.col("items"), F.array().cast("array<string>")) if "items" in queries.columns else F.array().cast("array<string>")
    x = durable(queries.select("query_id", F.col("query").alias("asked"), normalise_query(F.coalesce("query", F.lit(""))).alias("raw"), items.alias("items")))
    x = x.withColumn("items", keep_items(F.col("items"), F.col("raw")))
    x = x.select("query_id", "asked", "raw", F.when(F.size("items") > 0, F.array_join("items", " ")).otherwise(F.col("raw")).alias("query"))
    wider = expand_queries(x.select("query_id", "query", F.concat_ws(" ", "query", "raw").alias("match")), synonyms, "match")
    return x.join(wider, "query_id").select("query_id", F.col("asked").alias("query"), "expanded")


def search_flow(queries: DataFrame, find: Searcher, synonyms: DataFrame, verdicts: DataFrame | None = None, limit: int = 10, low: float = JUDGED_BELOW) -> tuple[DataFrame, DataFrame]:
    """Hits ``(query_id, code, score, rk)`` and rows for the search log, the second searches' included.

    ``verdicts(query_id, verdict, keywords)`` count for queries whose first hit
    scores below ``low``: 'unrelated' leaves no hits, 'ambiguous' adds those
    of a search by the keywords; without keywords, or under another name, a
    verdict changes nothing.
    """
    ready = durable(prepared(queries, synonyms))
    hits = durable(find(ready.select("query_id", F.col("expanded").alias("query")), limit))
    row = lambda found, of: S.log_rows(found, of, low).join(of.select("query_id", "expanded"), "query_id")
    log = row(hits, ready)
    if verdicts is None:
        return hits, log
    weak = hits.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") < low)
    judged = durable(verdicts.join(weak, "query_id", "left_semi").where("verdict = 'unrelated' OR (verdict = 'ambiguous' AND trim(keywords) <> '')").dropDuplicates(["query_id"]))
    again = durable(prepared(judged.where("verdict = 'ambiguous'").select("query_id", F.col("keywords").alias("query")), synonyms))
    second = durable(find(again.select("query_id", F.col("expanded").alias("query")), limit))
    asked = again.drop("query").join(ready.select("query_id", "query"), "query_id")
    better = S.corrected(hits, judged.select("query_id", "verdict"), second, low, limit)
    more = row(second, asked.select("query_id", "query", F.concat(F.lit("[again] "), "expanded").alias("expanded"))).where("top_score > 0")
    return better, log.unionByName(more)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return versions.read_versioned(spark, path) if versions.current(spark, path)["version"] else spark.createDataFrame([], schema)


def enqueue(rows: DataFrame, queue: str, low: float = JUDGED_BELOW) -> None:
    """Put the latest weak row of each query of ``rows(query, ts, event_id, top_score)`` into the queue, open, unless it is there or a later one is.

    A repeated batch changes nothing; a query that is weak again after it was resolved is open again.
    """
    weak = rows.where((F.col("top_score") < low) & F.col("query").isNotNull())
    last = weak.groupBy("query").agg(F.max(F.struct("ts", "event_id", "top_score")).alias("l"))
    new = durable(last.select("query", F.col("l.ts").cast("timestamp").alias("ts"), F.col("l.event_id").cast("long").alias("event_id"), F.col("l.top_score").cast("double").alias("top_score"), F.lit(False).alias("resolved")))
    if not new.isEmpty():
        # of equal rows the one that was resolved is the greater
        latest = lambda old: old.unionByName(new).groupBy("query").agg(F.max(F.struct("ts", "event_id", "resolved", "top_score")).alias("l")).select("query", "l.ts", "l.event_id", "l.top_score", "l.resolved")
        versions.change(queue, new.select("query"), ["query"], latest, QUEUE)
    discard(new)


def open_queries(spark: SparkSession, queue: str) -> DataFrame:
    """The rows of the queue that aren't resolved."""
    return _table(spark, queue, QUEUE).where("NOT resolved")


def synonyms_of(spark: SparkSession, builtin: DataFrame, learned: str) -> DataFrame:
    """``(alias, official)``, the learned ones before the built-in ones."""
    return merge_synonyms(builtin, _table(spark, learned, SYNONYMS).select("alias", "official", "enabled"))


def _resolve(spark: SparkSession, queue: str, learned: str) -> None:
    """Close the rows of the queue that a learned synonym came from."""
    came = _table(spark, learned, SYNONYMS).select("query", "ts").distinct()
    done = durable(open_queries(spark, queue).join(came, ["query", "ts"], "left_semi").withColumn("resolved", F.lit(True)))
    if not done.isEmpty():
        versions.upsert_versioned(done, queue, ["query"])
    discard(done)


def proposals(open_rows: DataFrame, candidates: DataFrame, synonyms: DataFrame, find: Searcher, most: int = 5) -> DataFrame:
    """``(alias, official, score, query, ts)`` for the open queries with a candidate that passes the guards of :func:`search.learned_synonyms`.

    ``candidates(query, term, cosine, place)``: what a model proposed for a
    query, its likeness to it and its place; the ``most`` first that can be
    terms count. Terms that stand in the expanded query are none.
    """
    rows = durable(open_rows.select(F.col("query").alias("query_id"), "query", "ts").dropDuplicates(["query_id"]))
    ready = durable(prepared(rows, synonyms).select("query_id", F.col("expanded").alias("query")))
    term = normalise_query(F.col("term"))
    fit = candidates.where(F.col("term").rlike("^[\\p{IsHangul}0-9A-Za-z ()]{1,40}$")).select(F.col("query").alias("query_id"), term.alias("term"), "cosine", "place")
    first = fit.where("term <> ''").groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "term", "cosine"))), 1, most).alias("l"))
    listed = durable(first.join(ready, "query_id").select("query_id", "query", F.explode("l").alias("x")).select("query_id", "query", "x.term", "x.cosine").where(~F.contains("query", "term")).groupBy("query_id", "query", "term").agg(F.max("cosine").alias("cosine")))
    both = F.struct("query_id", "term").alias("query_id")
    run = lambda text: durable(find(listed.select(both, text.alias("query")), 3).select("query_id.query_id", "query_id.term", "code", "score", "rk"))
    alone, combined = run(F.col("term")), run(F.concat_ws(" ", "query", "term"))
    baseline = durable(find(ready.join(listed.select("query_id").distinct(), "query_id", "left_semi"), 1).select("query_id", "score"))
    best = S.learned_synonyms(listed, alone, combined, baseline)
    out = best.join(ready, "query_id").join(rows.select("query_id", F.col("query").alias("asked"), "ts"), "query_id")
    return out.select(F.col("query").alias("alias"), F.col("term").alias("official"), "score", F.col("asked").alias("query"), "ts")


def learn(spark: SparkSession, queue: str, learned: str, candidates: DataFrame, builtin: DataFrame, find: Searcher, dry_run: bool = False) -> DataFrame:
    """Register the best candidate of each open query as a synonym and close the query; returns the proposals, a durable table.

    Queries without a good candidate stay open for the next run. Of open
    queries with one normal form the greatest score is registered, and all that
    were proposed are closed. ``dry_run`` changes no table.
    """
    if not dry_run:
        _resolve(spark, queue, learned)
    found = durable(proposals(open_queries(spark, queue), candidates, synonyms_of(spark, builtin, learned), find))
    if dry_run or found.isEmpty():
        return found
    best = found.groupBy("alias").agg(F.max(F.struct("score", "official", "query", "ts")).alias("b"))
    rows = best.select("alias", "b.official", F.col("b.score").cast("double").alias("score"), F.lit(True).alias("enabled"), "b.query", "b.ts")
    versions.upsert_versioned(rows, learned, ["alias"])
    closed = open_queries(spark, queue).join(found.select("query", "ts").distinct(), ["query", "ts"], "left_semi")
    versions.upsert_versioned(durable(closed.withColumn("resolved", F.lit(True))), queue, ["query"])
    return found
