"""Each operator against a plain version, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tradeloom.llm import decontaminate, labelled, licences, ngram_join, order_minhash, packing, pii, quality, sketches, token_counts, token_ids, toxicity, url_lists

BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank and wonder what all that noise is about today"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20000))
TEXTS = [None, "", "  \n ", "one two", "One  TWO", BASE, BASE.upper(), BASE + " indeed", BASE.replace("seven", "eight"), BASE.replace("river", "lake").replace("noise", "fuss"), "completely different words that share nothing at all with others here ok", LONG, LONG + " tail"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, cls string, n string"


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with clashing extra columns; the rows of id 3 repeat, as does id 5 with another text."""
    rows = [(i, t, "en", "s", len(t or ""), i, "x", "y") for i, t in enumerate(TEXTS)]
    rows += [rows[3], (5, "same id other text", "en", "s", 5, 1, "x", "y"), (None, BASE, "en", "s", 5, 1, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain_components(rows, k, percent):
    """Component of each (id, text) row by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            root[find(b)] = find(a)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return [(d, len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def test_ngram_join_matches_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "only rows without an id"), (None, "Only rows without an ID")]
    got = ngram_join.linked_documents(docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(rows[-2:], "doc_id long, text string")), 4, 70)
    key = lambda t: tuple(-1 if v is None else v for v in t)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key) == sorted(plain_components(rows, 4, 70), key=key)


def test_ngram_join_of_nothing(empty):
    assert ngram_join.linked_documents(empty).count() == 0


def test_removed_ids_are_exact_whatever_the_filter_lets_pass(spark, monkeypatch):
    rows = [(i if i % 7 else None, f"t{i}") for i in range(400)] * 2
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    gone = spark.createDataFrame([(i,) for i in range(0, 400, 3)], "doc_id long")
    want = sorted((r for r in rows if r[0] is None or r[0] % 3), key=str)
    for last, most in ((1 << 16, 1 << 23), (3, 1 << 23), (3, 10)):  # a list alone, a chain of sets, a join
        monkeypatch.setattr(sketches, "LAST_KEYS", last)
        monkeypatch.setattr(sketches, "MOST_KEYS", most)
        monkeypatch.setattr(sketches, "LEAST_BITS", 1 << 8)
        monkeypatch.setattr(sketches, "BITS_A_KEY", 2)  # each set passes many others wrongly
        assert sorted(map(tuple, ngram_join.without_ids(docs, gone).collect()), key=str) == want
        assert ngram_join.without_ids(docs, gone.limit(0)).count() == len(rows)


def test_shingle_sets_match_plain_sets():
    import pyarrow as pa

    got = [len(s) for s in ngram_join.shingle_sets(pa.array(TEXTS), 4)]
    assert got == [len(shingles(t, 4)) for t in TEXTS]


def test_pattern_spans_and_edges(docs, empty):
    text = "mail a.b@x.org, ip 10.0.0.300 and 10.0.0.30, card 4111 1111 1111 1111 call +1 (499) 555-6503."
    assert pii.joined(pii.base_spans(text)) == "email:5:14,ip:34:43,card:50:69,phone:75:92"
    assert pii.base_spans("9" * 50_000 + "." * 1000) == [] and pii.base_spans("a" * 200_000) == []
    found = pii.find_spans(docs, pii.disclosing_terms(docs))
    assert found.count() == docs.count() and found.where("size(spans) > 0").count() == 0
    assert pii.sanitise(empty).columns == empty.columns and pii.sanitise(empty).count() == 0


def test_terms_that_disclose_are_generalised(spark):
    rows = [(i, f"w{i} u{i} zorblax meets bob.x@mail.com near {i} things v{i}") for i in range(6)] + [(50 + i, f"plain note {i} things") for i in range(60)] + [(200 + i, "copy of one text zorkol bob.y@mail.com with the same words") for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(table, least_texts=3).collect()}
    assert out[0] == "w0 u0 [TERM] [TERM] [EMAIL] [TERM] 0 things v0"
    assert out[200] == "copy of one text zorkol [EMAIL] with the same words"  # copies are no evidence
    out = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert out[200] == "[TERM] of one [TERM] [TERM] [EMAIL] [TERM] the [TERM] [TERM]" and out[50] == "plain note 0 things"


def plain_terms(texts, least, threshold=0.9, reach=8):
    """Terms by their definition, from a list of texts."""
    texts = sorted({t for t in texts if t})
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    usable = lambda t: len(t) >= 4 and not re.search("[0-9]", t)
    with_term, with_entity, both = defaultdict(set), defaultdict(set), defaultdict(set)
    for k, text in enumerate(texts):
        spans = pii.base_spans(text)
        every = [(m.start(), m.end(), lower(m[0])) for m in re.finditer("[A-Za-z0-9\u0080-\U0010ffff]+", text)]
        for _, _, t in every:
            if usable(t):
                with_term[t].add(k)
        free = [w for w in every if not any(w[0] < e and s < w[1] for s, e, _ in spans)]
        for s, e, kind in spans:
            entity = (kind, pii._value(text[s:e], kind))
            with_entity[entity].add(k)
            for w in [x for x in free if x[1] <= s][-reach:] + [x for x in free if x[0] >= e][:reach]:
                if usable(w[2]):
                    both[entity, w[2]].add(k)
    out = set()
    for (entity, t), docs in both.items():
        pe, pt, pb = len(with_entity[entity]) / len(texts), len(with_term[t]) / len(texts), len(docs) / len(texts)
        ratio = math.log(pb / (pe * pt)) / max(-math.log(pe), 1e-9)
        if len(docs) >= least and 2 * len(docs) > len(with_term[t]) and ratio >= threshold:
            out.add((t, round(ratio, 9)))
    return out


def test_terms_match_their_definition(spark):
    """Names planted beside addresses and phones, among shared words, with copies, non-ASCII words and close values."""
    rng = np.random.default_rng(5)
    common = [f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Élan", "groß", "né"]
    texts = []
    for p in range(40):
        for _ in range(1 + p % 4):
            w = [*rng.choice(common, 30)]
            w[10:10] = [f"Nomen{chr(97 + p % 26)}{chr(97 + p // 26)}", f"p{p}.x@mail{p}.org"]
            if p % 3 == 0:
                w[20:20] = [f"+49 (30) {1000000 + p}", "Straße"]
            texts.append(" ".join(w))
    texts += [" ".join(rng.choice(common, 25)) for _ in range(200)] + texts[:9] + [None, "", "Nomenaa alone"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (1, 3):
        got = {(r.term, round(r.disclosure, 9)) for r in pii.disclosing_terms(table, least_texts=least).collect()}
        assert got == plain_terms(texts, least)
    terms, words = pii.study(table)
    listed = {r.term for r in terms.collect()}
    planted = {f"nomen{chr(97 + p % 26)}{chr(97 + p // 26)}" for p in range(40)}
    assert len(planted & listed) >= 39  # "nomenaa" stands alone elsewhere
    for r in pii.find_spans(table, terms, words).collect():
        text = texts[r.doc_id] or ""
        words_of = {(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9\u0080-\U0010ffff]+", text) if re.sub("[A-Z]", lambda m: m[0].lower(), m[0]) in listed}
        base = pii.base_spans(text)
        assert {(s.start, s.end) for s in r.spans if s.kind == "term"} == {w for w in words_of if not any(w[0] < e and s < w[1] for s, e, _ in base)}
        assert [(s.start, s.end, s.kind) for s in r.spans if s.kind != "term"] == base
    assert {tuple(r) for r in pii.find_spans(table, terms).selectExpr("doc_id", "to_json(spans)").collect()} == {tuple(r) for r in pii.find_spans(table, terms, words).selectExpr("doc_id", "to_json(spans)").collect()}


def test_reparameterised_questions_are_found(spark, docs, empty):
    items = spark.createDataFrame([(7, "If Mary buys 10 apples and gives 2 kg to John each day, how many apples does Mary keep then?"), (8, ""), (9, None), (10, "in common with it")], "item_id long, text string")
    texts = [(1, "Intro. If Alice buys 30 apples and gives 12 kg to Robert each day, how many apples does Alice keep then? End"), (2, "If Carol buys 31 apples and gives 14 kg to Peter each day, how many apples does Dora keep then?"), (3, None), (4, ""), (5, "nothing in common with it"), (1, "repeated id")]
    got = {(r.doc_id, r.item_id): r.same_values for r in decontaminate.tainted(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()}
    assert got == {(1, 7): False, (5, 10): True}
    assert decontaminate.clean_documents(docs, items).count() == docs.where("doc_id IS NULL OR doc_id >= 0").count()
    assert decontaminate.tainted(empty, items).count() == 0 and decontaminate.tainted(docs, items.limit(0)).count() == 0


def test_packing_is_an_exact_round_trip(docs, empty):
    rows = packing.pack_documents(docs, 64, keep_ids=True).collect()
    coder = token_ids.TextEncoder(token_ids.vocabulary_path())
    want = sorted((r.doc_id if r.doc_id is not None else -1, ids + b"\0\0\0\0") for r, ids in zip(docs.collect(), coder.encode([r.text or "" for r in docs.collect()]), strict=True))
    fills, by = defaultdict(list), defaultdict(list)
    for r in rows:
        raw = np.array(r.ids, "<u4").tobytes()
        assert zlib.crc32(raw) == r.ids_crc32 and len(r.ids) == r.length
        fills[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id if r.doc_id is not None else -1].append((r.start, raw))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    total = lambda d: sum(len(x) for k, x in want if k == d)
    assert {d: sum(len(x) for _, x in v) for d, v in by.items()} == {d: total(d) for d in {k for k, _ in want}}
    assert b"".join(x for _, x in sorted(by[11])) == next(x for d, x in want if d == 11)
    assert packing.pack_documents(empty).count() == 0


def test_fast_library_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    coder = token_ids.TextEncoder(token_ids.vocabulary_path())
    own = Tokenizer.from_file(token_ids.vocabulary_path())
    texts = ["", " ", "  a  b \n c", "a \n b", "\n\n x  ", "é  b  c", " lead", "don't  I'll \t we've", "x" * 5000 + " y", "<|endoftext|> hi", "a\x1c b", "1 2  3\r\n 4", BASE, BASE + "\nNext line.", "a" + " " * 200_000 + "b", "9" * 40_000]
    odd = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\ufeff", "'s", "'S", "'ll", "a", "B", "é", "ß", "1", "٣", "²", "½", "_", "-", ".", "中", "\u0301", "😀", "\x00", "\x7f"]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(odd, rng.integers(0, 15))) for _ in range(3000)]
    texts += [f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}b  {chr(c)}." for c in range(0, 0x3000)]
    assert list(coder.encode(texts)) == [np.array(e.ids, "<u4").tobytes() for e in own.encode_batch(texts, add_special_tokens=False)]


def test_sum_of_squares_picks_the_least_change():
    packer = packing.SumOfSquaresPacker(8)
    packer.add(1, b"\0\0\0\0" * 3)
    packer.add(2, b"\0\0\0\0" * 3)  # 3 + 3 in one window: one partial window, not two
    assert packer.levels.tolist() == [0, 0, 0, 0, 0, 0, 1, 0, 0]
    packer.add(3, b"\0\0\0\0" * 2)  # completes it
    assert packer.levels.sum() == 0 and len(packer.closed) == 1


def test_sections_add_up(docs, empty):
    got = defaultdict(list)
    for r in token_counts.section_tokens(docs.where("doc_id <> 5 AND doc_id <> 3")).collect():
        got[r.doc_id].append(r)
    assert all(sum(r.n_tokens for r in v) == v[0].doc_tokens for v in got.values())
    assert [r.n_tokens for r in got[0]] == [0] and [r.n_tokens for r in got[1]] == [0]
    assert token_counts.section_tokens(empty).count() == 0
    # a token over a boundary goes to the section with most of it, the earlier of two equals
    assert token_counts.attribute(np.array([2, 6, 8]), np.array([0, 4])).tolist() == [0, 0, 1]
    assert token_counts.attribute(np.array([2, 7]), np.array([0, 4])).tolist() == [0, 1]


def test_fingerprints(docs, empty):
    rows = order_minhash.compare_with_edits(docs.where("doc_id <> 5 OR n_chars > 5")).collect()
    assert len(rows) == docs.where("doc_id <> 5 OR n_chars > 5").count()
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id IS NOT NULL AND (doc_id <> 5 OR n_chars > 5)").collect()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in rows}
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[a])
        edited = texts[a][: n - n // 2] + texts[b][: n // 2]
        assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[a].n_chars == n
    assert got[0].fingerprint == got[1].fingerprint == "" and got[1].near_next == 1.0
    assert 0.15 < got[11].near_edited < 0.6 and got[10].near_next == 0.0  # half of the words are left, in order
    assert order_minhash.compare_with_edits(empty).count() == 0


def plain_signature(text):
    """The signature by its definition: every slot orders all numbered k-mers of the text."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chain = lambda values, seed=42: [seed := xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v % (1 << 64)).to_bytes(8, "little"), seed) for v in values][-1]
    tokens = []
    for w in [x for x in re.split(order_minhash._SPACE, text or "") if x]:
        if len(w.encode()) <= order_minhash.LONG_WORD:
            tokens.append(chain([w.encode()]))
            continue
        for at in range(0, len(w), order_minhash.STRETCH):
            part, g = w[at : at + order_minhash.STRETCH], order_minhash.GRAM
            tokens += [chain([part.encode()])] if len(part) < g else [chain([c.encode() for c in part[i : i + g]]) for i in range(len(part) - g + 1)]
    low = order_minhash._POS_BITS
    grams = [chain([a, b]) >> low for a, b in zip(tokens, tokens[1:])] or [chain(t for t in tokens) >> low for _ in tokens[:1]]
    seen, numbered = defaultdict(int), []
    for place, g in enumerate(grams):
        number, seen[g] = seen[g], seen[g] + 1
        high = signed(g << low) >> low
        numbered.append((chain([high, number.to_bytes(4, "little")]) >> low, place))
    out = []
    for slot in range(64 if numbered else 0):
        picked = sorted(numbered, key=lambda x: (signed((x[0] << low) ^ (slot << 58)), x[1]))[:2]
        out.append(slot << 26 | chain([g for g, _ in sorted(picked, key=lambda x: x[1])]) & ((1 << 26) - 1))
    return out


def test_fingerprints_match_their_definition(spark):
    rng = np.random.default_rng(11)
    texts = [None, "", " ", "one", "a b", "a a a a a", BASE, LONG[:30000], "x" * 40, "0123456789" * 900, "\u4e2d\u6587" * 30, "w " * 500]
    texts += [" ".join(rng.choice([*"abcdefgh", "\u00e9t\u00e9", "u" * 33, "\u4e2d" * 11, "\U0001f600" * 9], n)) for n in (3, 20, 64, 130, 400)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: list(r.sig) for r in order_minhash.with_signature(table, "text", "sig").collect()}
    assert [i for i, t in enumerate(texts) if got[i] != plain_signature(t)] == []


def test_fingerprints_of_edits_without_white_space_or_in_short_texts(spark):
    rng = np.random.default_rng(2)
    run = "".join(rng.choice(list("acgt"), 3000))
    short = " ".join(f"s{i}" for i in range(40))
    moved = " ".join(f"s{i}" for i in [*range(20, 40), *range(20)])
    pairs = [(run, run[:1500] + "n" + run[1500:]), (short, short.replace("s20", "new")), (short, moved)]
    df = order_minhash.with_signature(spark.createDataFrame(pairs, "a string, b string"), "a", "sa")
    one, two, three = (r[0] for r in order_minhash.with_signature(df, "b", "sb").select(order_minhash.likeness(F.col("sa"), F.col("sb"))).collect())
    assert one > 0.9 and 0.5 < two < 1 and three < two


def test_order_matters_to_fingerprints(spark):
    a = " ".join(f"t{i}" for i in range(400))
    b = " ".join(f"t{i}" for i in [*range(200, 400), *range(200)])
    df = order_minhash.with_signature(spark.createDataFrame([(a, b)], "a string, b string"), "a", "sa")
    df = order_minhash.with_signature(df, "b", "sb")
    assert df.select(order_minhash.likeness(F.col("sa"), F.col("sb"))).first()[0] < 0.75
    assert df.select(order_minhash.likeness(F.col("sa"), F.col("sa"))).first()[0] == 1.0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""


def test_whole_notices_are_named_however_they_are_set(spark):
    v2, lesser = GPL.replace("version 3", "version 2").replace("software:", "software;"), GPL.replace("General Public", "Lesser General Public")
    affero = GPL.replace("GNU General", "GNU Affero General")
    notices = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "GPL-2.0-or-later": v2, "LGPL-3.0-or-later": lesser, "AGPL-3.0-or-later": affero, "MPL-2.0": MPL, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD3, "ISC": ISC}
    ways = {
        "as it is": lambda t: t,
        "one line a paragraph": lambda t: "\n".join(" ".join(p.split()) for p in t.split("\n\n")),
        "one line": lambda t: " ".join(t.split()),
        "hash comments": lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")),
        "star comments": lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */",
        "dashes, other line ends": lambda t: "\r\n".join(f"-- {x}".rstrip() for x in t.split("\n")),
        "under a copyright line": lambda t: f"Copyright (c) 2020 Some One\n{t}\nint main() {{}}",
        "in prose": lambda t: f"Some words come before.\n\n{t}\n\nSome words come after it. And more",
    }
    rows = [(f"{way}: {name}", set_as(text), name) for name, text in notices.items() for way, set_as in ways.items()]
    got = {r.k: (r.name, list(r.licences)) for r in licences.scan(spark.createDataFrame(rows, "k string, text string, name string")).collect()}
    assert {k: found for k, (name, found) in got.items() if found != [name]} == {}


def test_licence_columns_of_the_same_name_are_replaced(spark):
    table = spark.createDataFrame([(1, "MIT License", "x", 2)], "n_sentences int, text string, licences string, `a b` int")
    row = licences.scan(table).first()
    assert (row.n_sentences, row.sentence_ids, row.licences, row["a b"]) == (1, ["MitTitle"], ["MIT"], 2)


def test_licence_rules_consume_sentences(spark, docs, empty):
    text = "Intro text.\nMIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nAll rights reserved."
    got = licences.scan(spark.createDataFrame([(1, text), (2, None), (3, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string"))
    found = {r.doc_id: (r.sentence_ids, r.licences) for r in got.collect()}
    assert found == {1: (["MitTitle", "MitGrant", "AllRights"], ["MIT"]), 2: ([], []), 3: (["CcByNc4"], ["CC-BY-NC-4.0"])}
    assert licences.scan(docs).count() == docs.count() and licences.scan(empty).count() == 0


def test_lists_are_judged_at_fetch_time(spark):
    captures = spark.createDataFrame([(1, "http://a.b.com/x", "2023-01-10"), (2, "http://a.b.com/x", "2023-02-10"), (3, "https://WWW.B.com./y", "2023-03-01"), (4, None, "2023-01-01"), (5, "nonsense", "2023-01-01"), (1, "http://a.b.com/x", "2023-01-10"), (6, "http://a.b.com", None)], "capture_id long, url string, d string").withColumn("fetched_on", F.col("d").cast("date"))
    entries = spark.createDataFrame([("a.b.com", "block", "add", "2023-01-05"), ("a.b.com", "block", "remove", "2023-02-01"), ("b.com", "allow", "add", "2023-02-05"), ("b.com", "block", "add", "2023-02-05"), (None, "block", "add", "2023-01-01")], "pattern string, list string, action string, d string").withColumn("effective_on", F.col("d").cast("date"))
    got = {r.capture_id: (r.verdict, r.pattern) for r in url_lists.judge(captures, entries).collect()}
    assert got == {1: ("block", "a.b.com"), 2: ("allow", "b.com"), 3: ("allow", "b.com"), 4: ("none", None), 5: ("none", None), 6: ("none", None)}
    assert url_lists.judge(captures.limit(0), entries).count() == 0 and url_lists.judge(captures, entries.limit(0)).count() == 6


def labelled_rows(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("ra", "lo", "ti", "sun", "men")]
    rows = []
    for i in range(400):
        w = list(rng.choice(vocabulary, rng.integers(30, 120)))
        bad, toxic = i % 4 == 0, i % 5 == 1
        if bad:
            w = [f"{x}***" if k % 2 else f"{x}$$$" for k, x in enumerate(w)]
        if toxic:
            w[5] = w[17] = "vileword"
        rows.append((i, " ".join(w), int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").cache()


def test_classifiers_on_held_out_rows(spark, docs, empty):
    rows = labelled_rows(spark)
    texts, labels = rows.select("doc_id", "text"), rows.select("doc_id", "quality", "toxic")
    model = quality.fit(texts, labels)
    scored = quality.score_documents(texts, model).join(rows, "doc_id").where(labelled.fold("doc_id") == 0)
    assert scored.where("predicted <> quality").count() <= 2
    assert quality.score_documents(docs.select("doc_id", "text"), model).where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.good_documents(docs, labels).columns == docs.columns
    toxic = toxicity.fit(texts, labels)
    scored = toxicity.score_documents(texts, toxic).join(rows, "doc_id").where(labelled.fold("doc_id") == 0)
    assert scored.where("predicted <> toxic").count() <= 2
    assert toxicity.score_documents(docs, toxic).where("score IS NULL").count() == 0
    nothing = labels.limit(0)
    assert quality.score_documents(texts, quality.fit(texts, nothing)).where("score <> 0.5").count() == 0
    assert toxicity.score_documents(texts, toxicity.fit(texts, nothing)).where("predicted = 1").count() == 0
    assert toxicity.score_documents(empty, toxic).count() == 0


def test_scores_match_plain_versions(spark, docs):
    import pyarrow as pa
    import zstandard

    rows = labelled_rows(spark)
    texts, labels = rows.select("doc_id", "text"), rows.select("doc_id", "quality", "toxic")
    every = [r.text for r in docs.collect()] + [r.text for r in rows.limit(30).collect()] + ["Gr\u00f6\u00dfe-Vileword vilewords,vileword", "x" * 70]

    def of_words(text):
        return {int(f) for w in set(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())) for f in toxicity.features_of(pa.array([w], pa.binary()).cast(pa.string()))[1]}

    model = toxicity.fit(texts, labels)
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert weights and max(weights.values()) > 0
    got = model.score(pa.array(every))
    for text, score in zip(every, got, strict=True):
        total = model.bias + sum(weights.get(f, 0.0) for f in of_words(text))
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9
    count = defaultdict(int)
    for r in texts.collect():
        for f in of_words(r.text):
            count[f] += 1
    told = np.sort(np.array(list(count), np.uint64))
    for wanted in (None, told):
        used = {r.feature: r.n for r in toxicity._usage(texts, wanted).collect()}
        assert used.pop(None) == 400 and {int(np.int64(f).view(np.uint64)): n for f, n in used.items()} == count

    judge = quality.fit(texts, labels)
    for text in every:
        raw = (text or "").encode()
        size = lambda d, block: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(block))
        blocks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)] or [b""]
        pairs = [(size(judge.good, x), size(judge.bad, x), max(1, len(x))) for x in blocks]
        g, b = sum(x[0] for x in pairs), sum(x[1] for x in pairs)
        x = [(b - g) / (b + g), math.log(min((g + b) / (2 * max(1, len(raw))), 1.5) + 0.02), math.log(min(min(min(p[:2]) / p[2] for p in pairs), 1.5) + 0.02), math.log(len(raw) + 20)]
        terms = x + [x[i] * x[j] for i in range(4) for j in range(i, 4)]
        total = judge.weights[-1] + sum(w * (t - m) / s for w, t, m, s in zip(judge.weights[:-1], terms, judge.centre, judge.scale, strict=True))
        assert abs(float(judge.score(np.array([judge.features(raw)]))[0]) - 1 / (1 + math.exp(-total))) < 1e-9


def test_repeated_ids_do_not_change_a_fit(spark):
    rows = labelled_rows(spark)
    texts, labels = rows.select("doc_id", "text"), rows.select("doc_id", "quality", "toxic")
    twice = texts.union(texts.where("doc_id % 3 = 0"))
    one, two = quality.fit(texts, labels), quality.fit(twice, labels)
    assert (one.good, one.bad) == (two.good, two.bad) and np.allclose(one.weights, two.weights)
    assert toxicity.fit(twice, labels, 50, 100).features.size > 0


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    pos = np.zeros((60, 4), np.float32)
    pos[:, 0] = 1
    unl = np.zeros((300, 4), np.float32)
    unl[:30, 0] = 1
    unl[:, 1:] = rng.random((300, 3)) < 0.5
    pos[:, 1:] = rng.random((60, 3)) < 0.5
    w, b = toxicity.non_negative_fit(pos, unl, 0.1)
    assert w[0] + b > 0 > b


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    rows = labelled_rows(spark)
    item = "unique benchmark question about nine green birds that fly over the tall hill"
    texts = [(r.doc_id, r.text) for r in rows.limit(60).collect()]
    good = [t for d, t in texts if "***" not in t]
    texts += [(1000, good[0]), (1001, good[1] + " mail me at some.one@mail.org now"), (1002, good[2] + " " + item + " " + good[3]), (1003, "")]
    d = tmp_path / "sf"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    rows.select("doc_id", "quality", "toxic").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    documents = spark.read.parquet(str(d / "documents.parquet"))
    kept = {r.doc_id for r in quality.good_documents(documents, spark.read.parquet(str(d / "labels.parquet"))).collect()}
    pool = sorted((i, t) for i, t in texts if i in kept)
    groups = plain_components(pool, 5, 80)
    left = [(i, t) for (i, t), (_, _, c) in zip(pool, groups, strict=True) if c == i and item not in t]
    clean = {i: t.replace("some.one@mail.org", "[EMAIL]") for i, t in left}
    coder = token_ids.TextEncoder(token_ids.vocabulary_path())
    want = {i: len(ids) // 4 + 1 for i, ids in zip(clean, coder.encode(list(clean.values())), strict=True)}
    got: dict = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(d)).collect():
        got[r.doc_id] += r.length
    assert dict(got) == want and 1002 not in want and 1000 not in want
