"""Results that an operator once cut short."""

from tradeloom.llm import decontaminate, pii


def test_copies_take_no_evidence_away(spark):
    rows = [(i, f"w{i} u{i} zorblax meets bob.x@mail.com near {i} things v{i}") for i in range(10)] + [(1000 + i, f"plain note {i} things near") for i in range(90)]
    rows += [(100 + i, rows[0][1]) for i in range(21)]
    terms = pii.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string"), least_texts=3)
    once = pii.disclosing_terms(spark.createDataFrame(rows[:100], "doc_id long, text string"), least_texts=3)
    found = {(r.term, round(r.disclosure, 9)) for r in terms.collect()}
    assert found == {(r.term, round(r.disclosure, 9)) for r in once.collect()} == {("zorblax", 1.0), ("meets", 1.0)}


def test_windows_are_judged_one_by_one(spark):
    item = "a farmer sells 3 baskets of ripe plums and 5 sacks of dry beans at the old market each day so what does the farmer earn"
    twice = item.replace("5", "3")
    names = "we saw Mary walk past the old mill by the lake and then saw Mary again near the tall tower on the hill where many people had met"
    dense = "add 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 then find out how many of these are even"
    short = "sum 31 32 33 34 35 36 37 38 39 40 41 42"
    items = spark.createDataFrame(list(enumerate([item, twice, names, dense, short], 1)), "item_id long, text string")
    texts = [
        (1, item.replace("3", "4").replace("5", "4")),
        (2, twice.replace("3", "7", 1).replace("3", "8")),
        (3, names.replace("Mary", "Dora", 1)),
        (4, dense.replace("1", "5").replace("2", "6")),
        (5, "so " + short),
        (6, short.replace("3", "5")),
    ]
    got = {(r.doc_id, r.item_id) for r in decontaminate.tainted(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)} <= got and not {i for d, i in got if d == 6}


def test_common_windows_are_evidence_for_no_item(spark):
    start = "please read the following question with care and then write down the answer in full on the sheet of paper "
    parts = [" ".join(f"w{k}x{j}" for j in range(14)) for k in range(40)]
    items = [(k, start + p) for k, p in enumerate(parts)] + [(100, start + parts[3])]
    docs = [(k, start + " ".join(f"other{k}y{j}" for j in range(14))) for k in range(30)]
    docs += [(50, "so then: " + start + parts[7] + " and more"), (51, "some text before " + parts[3] + " and after it"), (52, start)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.tainted(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(50, 7), (51, 3), (51, 100)}


def test_items_of_one_form_dont_hide_each_other(spark):
    ask = "a trader has {} crates of fine apples and sells {} crates of them on market day so how many crates are left"
    items = [(k, ask.format(100 + k, 10 + k)) for k in range(30)]
    docs = [(1, "note " + ask.format(105, 15) + " end"), (2, "note " + ask.format(900, 800) + " end")]
    got = {(r.doc_id, r.item_id, r.same_values) for r in decontaminate.tainted(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (1, 5, True) in got and {d for d, _, _ in got} == {1, 2} and {i for d, i, same in got if same} == {5}
