"""Exact membership by a chain of bit sets settles on any keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.llm import ngram_join, sketches

U64 = np.uint64


def plain_chain(inside, outside, last):
    """The chain that sketches.members builds, with numpy in place of Spark."""
    out, mine, others = sketches.Members(), inside, outside
    while len(mine) > last:
        bits, salt = sketches.bits_for(len(mine)), len(out.levels)
        packed = np.zeros(bits // 8, np.uint8)
        at = sketches.bit_places(mine, bits, salt).ravel()
        np.bitwise_or.at(packed, at >> U64(3), (U64(1) << (at & U64(7))).astype(np.uint8))
        out.levels.append(packed)
        mine, others = others[sketches.in_bit_set(packed, others, bits, salt)], mine
        assert len(out.levels) < 20
    out.last = np.sort(mine)
    return out


@pytest.mark.parametrize("kind", ["random", "counted", "low bits agree"])
def test_chains_settle(kind, monkeypatch):
    monkeypatch.setattr(sketches, "LEAST_BITS", 1 << 6)
    rng = np.random.default_rng(7)
    for k in range(400):
        n = int(rng.integers(1, 3000))
        keys = np.unique(rng.integers(0, 2**64, n, dtype=U64))
        if kind == "counted":
            keys = np.arange(n, dtype=U64)
        elif kind == "low bits agree":
            keys = np.unique(keys << U64(40))
        member = rng.random(len(keys)) < rng.choice([0.01, 0.09, 0.5, 0.99])
        found = plain_chain(keys[member], keys[~member], last=0 if k % 2 else 5)
        assert (found.holds(keys) == member).all()


def test_every_remainder_of_ids_goes_exactly(spark, monkeypatch):
    monkeypatch.setattr(sketches, "LAST_KEYS", 16)
    docs = spark.range(221_000).withColumnRenamed("id", "doc_id")
    for rest in range(11):
        left = ngram_join.without_ids(docs, docs.where(F.col("doc_id") % 11 == rest))
        n, wrong = left.agg(F.count("*"), F.sum((F.col("doc_id") % 11 == rest).cast("int"))).first()
        assert (n, wrong) == (221_000 - len(range(rest, 221_000, 11)), 0)


def test_millions_of_ids(spark):
    docs = spark.range(2_200_000).withColumnRenamed("id", "doc_id")
    left = ngram_join.without_ids(docs, docs.where("doc_id % 11 = 3"))
    assert tuple(left.agg(F.count("*"), F.min(F.col("doc_id") % 11 != 3)).first()) == (2_000_000, True)
