"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tradeloom.llm import importance

SCHEMA = "doc_id long, text string, id long, n long, bucket int, weight long, rank long"
LONG = " ".join(f"wörd{i % 911}" for i in range(60_000))
TEXTS = [None, "", " .,! ", "One TWO three", "É é ÀB ab_c-d e f 漢字 12a", "x" * 5000, LONG, "alpha beta gamma delta " * 6, "alpha beta gamma delta " * 6] + [f"Some {i} words about the price of {i * 7} apples and {i % 3} pears, then more words to make it long enough: plus ten" for i in range(40)]


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_features(text, most):
    w = plain_words(text)
    return Counter(" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1))


def plain(rows, items, most, buckets, least, percent):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for texts, into in (([x for _, x in rows], s), (items, t)):
        for x in texts:
            for f, n in plain_features(x, most).items():
                into[of(f)] += n
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for d, x in rows:
        f = plain_features(x, most)
        weight = sum(n * gain(of(k)) for k, n in f.items())
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("most", "piece"), [(1, 1 << 18), (3, 64)])
def test_resample_matches_a_plain_version(spark, monkeypatch, most, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    rows = list(enumerate(TEXTS)) + [(8, TEXTS[8]), (8, "same id"), (None, TEXTS[20])]
    docs = spark.createDataFrame([(d, t, 1, 2, 3, 4, 5) for d, t in rows], SCHEMA)
    items = ["How many apples and pears at this price?", None, "", "words wörd3 wörd4"]
    target = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, text string")
    got = importance.resample(docs, target, most_words=most, buckets=500, percent=40)
    key = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, items, most, 500, 20, 40), key=key)
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == len(rows)


def test_everything_or_nothing_can_be_drawn(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(9)], "doc_id long, text string")
    ranks = lambda percent: sorted(r.rank for r in importance.resample(docs, docs, least_words=3, percent=percent).collect() if r.rank)
    assert ranks(100) == list(range(1, 10))
    assert ranks(0) == []
    assert len(ranks(34)) == 3
