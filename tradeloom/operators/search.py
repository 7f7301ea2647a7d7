"""Batch catalog search: token, trigram and vector signals, rank fusion, evaluation and synonym guards.

Queries and catalogs are tables; every signal is a join, every cut a rank
within a query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators import vectors
from tradeloom.operators.ordered import order_statistics
from tradeloom.operators.similar import by_member, classes, filled, heaviest_sets, nearest_sets
from tradeloom.session import durable

#: Weights of the token labels.
LABEL_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}

#: Joint score from which a synonym is learned, and just above the score of a first place in one signal.
LEARN_THRESHOLD = 0.03
ONE_SIGNAL = 0.0165

#: Rows of a catalog whose tokens one task sums up.
ROWS = 25_000


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters, marks and digits of any script."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), ""))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case text with two spaces before and one after."""
    padded = F.concat(F.lit("  "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def weighted_tokens(catalog: DataFrame, labels: dict[str, str]) -> DataFrame:
    """``(code, token, weight)``: distinct tokens of each labelled column, the best label of a token holding.

    A row gives each token once. The rows of a code meet before they are cut
    into tokens, in partitions of so many rows each, so what a task sums up
    doesn't grow with the catalog.
    """
    entries, before = [], None
    for c, label in sorted(labels.items(), key=lambda x: -LABEL_WEIGHTS[x[1]]):
        own = F.coalesce(tokens(F.col(c)), F.array().cast("array<string>"))
        new = own if before is None else F.array_except(own, before)
        before = own if before is None else F.concat(before, own)
        weight = F.lit(LABEL_WEIGHTS[label]).alias("weight")
        entries.append(F.transform(new, lambda t: F.struct(t.alias("token"), weight)))  # noqa: B023 (called here)
    pieces = max(1, math.ceil(catalog.count() / ROWS))  # a number that is given isn't made less where the rows are small before they are cut
    rows = catalog.select("code", *labels).repartition(pieces, "code").select("code", F.explode(F.concat(*entries)).alias("e"))
    return rows.groupBy("code", "e.token").agg(F.max("e.weight").alias("weight"))


def top(scored: DataFrame, pool: int) -> DataFrame:
    """``(query_id, code, score, rk)``: the ``pool`` best of each query, ties by code. The cut starts before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "code")
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= pool)


def by_text(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(query_id, query)`` with one id for each text, a durable table, and ``(query_id, query)`` of all; of rows that share an id the least text counts."""
    every = queries.where("query_id IS NOT NULL").groupBy("query_id").agg(F.min("query").alias("query"))
    return durable(every.groupBy("query").agg(F.min("query_id").alias("query_id")).select("query_id", "query")), every


def _for_all(hits: DataFrame, texts: DataFrame, every: DataFrame) -> DataFrame:
    """The hits of each text for all queries with it."""
    found = texts.withColumnRenamed("query", "text").join(hits, "query_id").drop("query_id")
    return every.join(found, every["query"].eqNullSafe(found["text"])).select("query_id", "code", "score", "rk")


def _token_hits(texts: DataFrame, index: DataFrame, pool: int) -> DataFrame:
    """Codes that have the same weighted tokens, of those that queries ask for, are met as one."""
    q = texts.select("query_id", tokens(F.col("query")).alias("els"))
    entry = F.array_sort(F.collect_list(F.struct("token", "weight")))
    wanted = durable(q.select(F.explode("els").alias("token")).distinct())
    have = index.where("code IS NOT NULL").join(wanted, "token", "left_semi").groupBy("code").agg(entry.alias("content"))
    members, sets = classes(have, pool)
    met = heaviest_sets(q, sets.select("code", F.col("content.token").alias("els"), F.col("content.weight").alias("weights")), pool)
    return durable(by_member(met, members, pool))


def token_signal(queries: DataFrame, index: DataFrame, pool: int = 50) -> DataFrame:
    """Sum of the label weights of the distinct query tokens that a code has.

    Queries of one text are searched once. Null ids and codes don't appear.
    """
    texts, every = by_text(queries)
    return _for_all(_token_hits(texts, index, pool), texts, every)


def _trigram_hits(texts: DataFrame, catalog: DataFrame, pool: int, column: str, fill: bool = False) -> DataFrame:
    """Codes of the same text are met as one."""
    have = catalog.where("code IS NOT NULL").select("code", F.col(column).alias("content")).repartition("code").groupBy("code").agg(F.min("content").alias("content"))
    members, sets = classes(have, 2 * pool if fill else pool)  # the smallest codes of all are among these
    met = nearest_sets(texts.select("query_id", trigrams(F.col("query")).alias("els")), sets.select("code", trigrams(F.col("content")).alias("els")), pool)
    hits = durable(by_member(met, members, pool))
    return filled(hits, texts, members, pool) if fill else hits


def trigram_signal(queries: DataFrame, catalog: DataFrame, pool: int = 50, column: str = "name", fill: bool = False) -> DataFrame:
    """Jaccard similarity of the trigram sets, the ``pool`` best of each query (:mod:`similar`).

    Pairs without a shared trigram don't appear, unless ``fill`` fills each
    pool with the smallest other codes at 0, as an order by distance with a
    limit does. Of rows that share an id or code the least text counts; queries
    of one text are searched once.
    """
    texts, every = by_text(queries)
    return _for_all(_trigram_hits(texts, catalog, pool, column, fill), texts, every)


def vector_signal(queries: DataFrame, catalog: DataFrame, pool: int = 50, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """Cosine similarity of ``queries(query_id, vec)`` and ``catalog(code, vec)``: exactly, or with ``lists`` through an index of so many (:mod:`vectors`)."""
    return vectors.exact(queries, catalog, pool) if lists is None else vectors.by_lists(queries, catalog, pool, lists, probes)


def autocomplete(typed: DataFrame, firms: DataFrame, limit: int = 10) -> DataFrame:
    """``(query_id, firm, score, rk)``: firm names by trigram similarity from 0 to 1 to what was typed, the best first."""
    names = firms.select(F.col("firm").alias("code"), "name")
    return trigram_signal(typed, names, limit).withColumnRenamed("code", "firm").orderBy("query_id", "rk")


def fuse(signals: list[DataFrame], limit: int = 10, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of ``1 / (k + rank)`` over the lists a code is in."""
    rows = None
    for s in signals:
        part = s.select("query_id", "code", (1.0 / (F.lit(k) + F.col("rk"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return top(rows.groupBy("query_id", "code").agg(F.round(F.sum("part"), 8).alias("score")), limit)


def search(queries: DataFrame, catalog: DataFrame, index: DataFrame, limit: int = 10, pool: int = 50, k: int = 60, as_of: str | None = None, prefix: str | None = None, vector_tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Fused hits of a catalog ``(code, name, valid_to)``; filters apply before the pools are cut."""
    if as_of is not None:
        catalog = catalog.where(F.col("valid_to") >= F.lit(as_of).cast("date"))
    if prefix is not None:
        catalog = catalog.where(F.col("code").startswith(prefix))
    if as_of is not None or prefix is not None:
        index = index.join(catalog.select("code"), "code", "left_semi")
    texts, every = by_text(queries)
    signals = [_trigram_hits(texts, catalog, pool, "name"), _token_hits(texts, index, pool)]
    if vector_tables is None:
        return _for_all(durable(fuse(signals, limit, k)), texts, every)
    signals = [_for_all(s, texts, every) for s in signals]  # queries of one text may have several vectors
    signals.append(vector_signal(vector_tables[0], vector_tables[1].join(catalog.select("code"), "code", "left_semi"), pool))
    return fuse(signals, limit, k)


def merge_hits(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """The best score of each code from two hit lists, ``k`` best of each query."""
    both = one.select("query_id", "code", "score").unionByName(two.select("query_id", "code", "score"))
    return top(both.groupBy("query_id", "code").agg(F.max("score").alias("score")), k)


def ranks(targets: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, exact, family)``: the rank of the target, and of the first hit with its first six characters; null if absent."""
    x = targets.select("query_id", "target").join(hits.select("query_id", "code", "rk"), "query_id", "left")
    same = F.col("code") == F.col("target")
    near = F.substring("code", 1, 6) == F.substring("target", 1, 6)
    return x.groupBy("query_id").agg(F.min(F.when(same, F.col("rk"))).alias("exact"), F.min(F.when(near, F.col("rk"))).alias("family"))


def retrieval_metrics(ranked: DataFrame, column: str = "exact", *keys: str) -> DataFrame:
    """Number of queries, share found, hit@1, @5, @10 and mean reciprocal rank."""
    r = F.col(column)
    hit = lambda k: F.avg(F.when(r <= k, 1.0).otherwise(0.0))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(r.isNotNull().cast("int")).alias("found"), hit(1).alias("hit1"), hit(5).alias("hit5"), hit(10).alias("hit10"), F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"))


def nearest_rank(df: DataFrame, column: str, q: float, *keys: str) -> DataFrame:
    """``(*keys, value)``: the value at place ``floor(q * n)`` from 0 in order, the last at most; exact, by counts in narrowing intervals."""
    found = order_statistics(df, column, list(keys), [q], from_zero=True)
    return found.select(*keys, F.col("value").cast(dict(df.dtypes)[column]))


def stability(runs: DataFrame, metric: str, baseline: float) -> DataFrame:
    """Over runs: mean, population deviation, extremes, spread, distance from a baseline in deviations, verdict."""
    x = runs.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.min(metric).alias("least"), F.max(metric).alias("most"))
    sigma = F.when(F.col("std") > 0, (F.col("mean") - baseline) / F.col("std"))
    verdict = F.when(sigma.isNull(), F.when(F.col("mean") == baseline, "same").otherwise("changed")).when(F.abs(sigma) <= 2, "noise").otherwise("changed")
    return x.select("mean", "std", "least", "most", (F.col("most") - F.col("least")).alias("spread"), sigma.alias("delta_sigma"), verdict.alias("verdict"))


def unstable_queries(runs: DataFrame) -> DataFrame:
    """Queries whose rank differs between runs, a miss being a rank of its own."""
    return runs.groupBy("query_id").agg(F.countDistinct(F.coalesce(F.col("rk").cast("string"), F.lit("miss"))).alias("n")).where("n > 1").select("query_id")


def evaluation_set(catalog: DataFrame, unique_name: bool = True, least: int = 2, n: int | None = None) -> DataFrame:
    """``(query_id, query, target)`` from catalog names of at least ``least`` characters, those of one code only if asked."""
    rows = catalog.where(F.length(F.trim("name")) >= least)
    if unique_name:
        one = rows.groupBy("name").agg(F.countDistinct("code").alias("n")).where("n = 1").select("name")
        rows = rows.join(one, "name", "left_semi")
    out = rows.select(F.col("code").alias("query_id"), F.col("name").alias("query"), F.col("code").alias("target"))
    return out if n is None else out.orderBy(F.xxhash64("query_id"), "query_id").limit(n)


def log_rows(hits: DataFrame, queries: DataFrame, low: float = 0.025) -> DataFrame:
    """``(query_id, query, top_score, top_codes, low_confidence)`` for the search log."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("top_score"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rk", "code"))), lambda x: x.code), 1, 5).alias("top_codes"))
    return queries.select("query_id", "query").join(best, "query_id", "left").select("query_id", "query", F.coalesce("top_score", F.lit(0.0)).alias("top_score"), "top_codes", (F.coalesce("top_score", F.lit(0.0)) < low).alias("low_confidence"))


def corrected(hits: DataFrame, verdicts: DataFrame, second: DataFrame, low: float = 0.025, k: int = 10) -> DataFrame:
    """Low-confidence queries judged 'unrelated' have no hits, 'ambiguous' ones also those of a second search."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    weak = best.where(F.col("best") < low).join(verdicts, "query_id", "left").select("query_id", F.coalesce("verdict", F.lit("fit")).alias("verdict"))
    gone = weak.where("verdict = 'unrelated'").select("query_id")
    again = weak.where("verdict = 'ambiguous'").select("query_id")
    kept = hits.join(gone, "query_id", "left_anti")
    return merge_hits(kept, second.join(again, "query_id", "left_semi"), k)


def learned_synonyms(candidates: DataFrame, alone: DataFrame, combined: DataFrame, baseline: DataFrame, least_cosine: float = 0.5, threshold: float = LEARN_THRESHOLD) -> DataFrame:
    """The candidate of each query that passes the guards: text, cosine, shared 4-character family of the top 3, improvement.

    ``candidates(query_id, query, term, cosine)``; a term that stands in its
    query is none. Hit lists ``(query_id, term, code, score, rk)`` come from the
    search with the term alone and with query and term, ``baseline(query_id,
    score)`` from the query alone (0 without a hit). The joint score must pass
    the baseline, and ``threshold`` or half as much again as the baseline and
    more than one signal's first place gives.
    """
    ok = candidates.where(F.col("term").rlike("^[\\p{IsHangul}0-9A-Za-z ]{1,40}$") & (F.col("cosine") >= least_cosine) & ~F.coalesce(F.contains("query", "term"), F.lit(False)))
    family = lambda df: df.where("rk <= 3").select("query_id", "term", F.substring("code", 1, 4).alias("family")).distinct()
    meet = family(alone).join(family(combined), ["query_id", "term", "family"]).select("query_id", "term").distinct()
    best = combined.groupBy("query_id", "term").agg(F.max("score").alias("joint"))
    plain = baseline.groupBy("query_id").agg(F.max("score").alias("plain"))
    x = ok.join(meet, ["query_id", "term"], "left_semi").join(best, ["query_id", "term"]).join(plain, "query_id", "left").na.fill(0.0, ["plain"])
    joint, plain = F.col("joint"), F.col("plain")
    x = x.where((joint > plain) & ((joint >= threshold) | ((joint >= plain * 1.5) & (joint > ONE_SIGNAL))))
    return x.groupBy("query_id").agg(F.max(F.struct("joint", "cosine", "term")).alias("b")).select("query_id", F.col("b.term").alias("term"), F.col("b.joint").alias("score"))


def grounding(answers: DataFrame) -> DataFrame:
    """``(answer_id, cited, grounded, faithfulness)`` of ``answers(answer_id, text, sources array<string>)``: cited 10-digit codes that are sources."""
    codes = F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]{10})"), 1))
    x = answers.withColumn("codes", codes)
    good = F.size(F.array_intersect("codes", "sources"))
    return x.select("answer_id", F.size("codes").alias("cited"), good.alias("grounded"), F.when(F.size("codes") > 0, good / F.size("codes")).alias("faithfulness"))


def context_text(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(query_id, context)``: a numbered line for each hit in rank order."""
    x = hits.join(catalog.select("code", "name"), "code")
    line = F.concat(F.col("rk").cast("string"), F.lit(". "), "code", F.lit(" "), "name").alias("line")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rk", line))), lambda s: s.line)
    return x.groupBy("query_id").agg(F.array_join(lines, "\n").alias("context"))


def chains(codes: DataFrame, headings: DataFrame, sizes: list[int]) -> DataFrame:
    """``(code, chain)``: names of the heading at each prefix length, in order, adjacent equal names once.

    ``headings(prefix, name)``; prefixes are exploded, so the join is an equi-join.
    """
    keys = codes.select("code", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.substring("code", 1, n).alias("prefix")) for n in sizes])).alias("k")).select("code", "k.*")
    named = headings.groupBy("prefix").agg(F.min("name").alias("name"))
    listed = keys.join(named, "prefix").groupBy("code").agg(F.array_sort(F.collect_list(F.struct("level", "name"))).alias("l"))
    names = F.transform("l", lambda x: x["name"])
    once = F.filter(names, lambda x, i: (i == 0) | (x != F.get(names, i - 1)))
    return codes.select("code").join(listed, "code", "left").select("code", F.coalesce(F.array_join(once, " > "), F.lit("")).alias("chain"))


def missing_vectors(catalog: DataFrame, embed, dim: int, limit: int | None = None) -> DataFrame:
    """``(code, vec)`` for rows without a vector; ``embed`` maps a list of texts to vectors and runs on the executors."""
    todo = catalog.where(F.col("vec").isNull()).select("code", "name")
    todo = todo if limit is None else todo.orderBy("code").limit(limit)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"code": pdf["code"], "vec": [list(map(float, v[:dim])) for v in embed(list(pdf["name"]))]})

    return todo.mapInPandas(run, "code string, vec array<double>")
