"""The Gray-code walk and the audit against counting document by document."""

import re
from itertools import permutations

import numpy as np
import pytest

from tradeloom.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, mask int, first long, n long"
GOOD = " ".join(f"word{i} flows on by" if i % 2 else f"some river{i} runs" for i in range(40))
TEXTS = [None, "", " \t\n", GOOD, GOOD, GOOD.upper(), GOOD + " # hash", "same same " * 60, "same same " * 60, "short one", "short one", "Ünïcode text with odd spaces " * 9, " ".join(f"long{i}" for i in range(30_000)), "A|B", "naïve A" * 50]


def plain_mask(text, earlier):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), earlier]
    return fails


def plain_audit(rows, labels):
    ids = {}
    for d, t, _ in rows:
        if d is not None:
            ids[t or ""] = min(ids.get(t or "", d), d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = []
    for part in sorted({s or "" for _, _, s in rows}):
        mine = [(d, plain_mask(t or "", d is not None and d > ids[t or ""])) for d, t, s in rows if (s or "") == part]
        figures, total = [], dict.fromkeys(range(5), 0)
        for order in permutations(range(5)):
            left = mine
            for step, k in enumerate(order):
                gone, stay = [x for x in left if x[1][k]], [x for x in left if not x[1][k]]
                failing = sum(f[k] for _, f in mine)
                alone = sum(f[k] and sum(f) == 1 for _, f in mine)
                total[k] += len(gone)
                figures.append((k, ["".join("ABCDE"[j] for j in order), step + 1, len(stay), len(gone), failing - len(gone), alone, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]))
                left = stay
        out += [(part, *f, total[k]) for k, f in figures]
    return sorted(out)


def test_walk_counts_every_subset():
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 50, (7, 32, 3))
    states = filter_audit.gray_states(cells)
    for subset in range(32):
        assert (states[:, subset] == cells[:, [m for m in range(32) if not m & subset]].sum(1)).all()


def test_audit_matches_counting(spark):
    rows = [(i, t, [None, "", "web", "news"][i % 4]) for i, t in enumerate(TEXTS * 3)]
    rows += [rows[3], rows[3], (None, GOOD, "web"), (None, GOOD, "web"), (7, "same id other text", "news")]
    docs = spark.createDataFrame([(d, t, s, "clash", 5, 1, 2) for d, t, s in rows], SCHEMA)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 40, 3)] + [(3, 0, 1), (4, None, None), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.interactions(filter_audit.failures(docs, table), "ABCDE")
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)
    assert filter_audit.failures(docs.limit(0), table).count() == 0
    assert filter_audit.interactions(filter_audit.failures(docs.limit(0), table), "ABCDE").count() == 0


@pytest.mark.parametrize("letters", ["XE", "E"])
def test_other_filters(spark, letters):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s"), (3, "c", "s")], "doc_id long, text string, source string")
    filters = {"X": filter_audit.too_short(2)} if "X" in letters else {}
    got = filter_audit.interactions(filter_audit.failures(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), filters), letters)
    rows = {(r.filter_order, r.step): (r.kept, r.removed) for r in got.collect()}
    assert rows == ({("XE", 1): (2, 1), ("XE", 2): (1, 1), ("EX", 1): (2, 1), ("EX", 2): (1, 1)} if "X" in letters else {("E", 1): (2, 1)})
