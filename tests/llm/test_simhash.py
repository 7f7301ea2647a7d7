"""Fingerprints and their groups against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tradeloom.llm import simhash

BASE = " ".join(f"token{i} moves along the quiet river" for i in range(60))
TEXTS = [None, "", " \n\t", "one", "One", "one two three", "ONE  two\tthree", BASE, BASE, BASE.upper(), BASE + " end", BASE.replace("token7 ", "token8 "), "é ü ñ 漢字 more", " ".join(f"w{i % 7919}" for i in range(40_000))]
SCHEMA = "doc_id long, text string, id long, fp long, n string, variant int"


def plain_fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_groups(rows, distance):
    """The smallest id reachable, by comparing all pairs; ``rows`` are (id, fingerprint)."""
    fps = sorted({f for _, f in rows})
    at, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(at ^ at[i]) <= distance):
            root[find(int(j))] = find(i)
    low = defaultdict(list)
    place = {f: i for i, f in enumerate(fps)}
    for d, f in rows:
        if d is not None:
            low[find(place[f])].append(d)
    return [(d, f"{f:016x}", min(low[find(place[f])], default=None)) for d, f in rows]


KEY = lambda r: tuple(-1 if v is None else v for v in r)


def test_near_duplicates_match_all_pairs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (5, "same id"), (None, BASE), (None, "nobody else says this at all")]
    docs = spark.createDataFrame([(d, t, 1, 2, "x", 3) for d, t in rows], SCHEMA)
    want = plain_groups([(d, plain_fingerprint(t)) for d, t in rows], 4)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=KEY) == sorted(want, key=KEY)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_whole_table_matches_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got) == sorted(plain_groups(rows, 4))


@pytest.mark.parametrize(("distance", "many"), [(4, 64), (4, 0), (3, 2), (0, 0), (7, 3)])
def test_links_connect_just_what_all_pairs_connect(spark, distance, many):
    """Random fingerprints, clouds of near ones, chains, and one crowded segment."""
    rng = random.Random(distance)
    fps = {0, 1, (1 << 64) - 1, 1 << 63} | {rng.getrandbits(64) for _ in range(300)}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for _ in range(rng.randrange(0, 9)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    chain = rng.getrandbits(64)
    for _ in range(30):
        chain ^= sum(1 << p for p in rng.sample(range(64), max(distance, 1)))
        fps.add(chain)
    low = rng.getrandbits(21)
    fps |= {rng.getrandbits(43) << 21 | low for _ in range(200)}  # one segment in common, unlinked
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in sorted(fps)]
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    pairs, _ = simhash.links(classes, distance, many)
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in pairs.collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in found)
    number = {f: i for i, f in enumerate(sorted(fps))}
    root = list(range(len(number)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(number[a])] = find(number[b])
    want = {f"{f:016x}": c for _, f, c in []} | {r[1]: r[2] for r in plain_groups([(number[f], f) for f in fps], distance)}
    least = defaultdict(lambda: 1 << 60)
    for i in number.values():
        least[find(i)] = min(least[find(i)], i)
    assert {f"{f:016x}": least[find(i)] for f, i in number.items()} == want


def test_segments_leave_one_bit_at_most():
    for distance in range(8):
        parts = simhash.segments(distance)
        assert sum(n for _, n in parts) == 64 and 2 * len(parts) > distance >= 2 * (len(parts) - 1)


def test_copies_of_one_text_are_one_class(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(BASE).alias("text"))
    assert simhash.near_duplicates(docs).select("component_id", "n_copies").distinct().collect() == [(0, 5000)]


def test_exploded_variants_are_never_broadcast(spark):
    """Spark sizes the 64 variants of a class as one row: many classes are near the limit of a broadcast, their variants far over it."""
    classes = spark.range(300).select(F.col("id").alias("fp"), F.col("id").alias("component"))
    rows = simhash.variants(classes, 4)
    joined = simhash._across(rows, rows, ["variant", "rest"], 4, F.col("p") < F.col("q"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
