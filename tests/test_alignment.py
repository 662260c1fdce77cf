"""Alignments against plain tables of edit distances and common subsequences."""

import random

from vellum.operators.alignment import edit_counts, matched_lines, ratio, word_rates


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(before[j], row[-1]))
    return row[-1]


def test_edit_counts_are_shortest():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in "ab")
        inserted, deleted, replaced = edit_counts(a, b)
        assert inserted + deleted + replaced == distance(a, b) and inserted - deleted == len(b) - len(a)


def test_ratio():
    rng = random.Random(6)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in "ab")
        assert ratio(a, b) == (200 * common(a, b) / (len(a) + len(b)) if a or b else 100)


def test_word_rates_edges(spark):
    rows = [(1, "a b c", "a b c"), (2, "a b", "a x b"), (3, "a b", "b"), (4, "", "x"), (5, None, None), (6, "a", None)]
    got = {r.k: (r.insertion_rate, r.deletion_rate) for r in word_rates(spark.createDataFrame(rows, "k int, r string, f string"), ["k"], "r", "f").collect()}
    assert got == {1: (0, 0), 2: (0.5, 0), 3: (0, 0.5), 4: (0, 0), 5: (0, 0), 6: (0, 1)}


def test_matched_lines(spark):
    ref = [(1, 0, "total amount"), (1, 1, "total amount"), (1, 2, "other words"), (2, 0, None)]
    found = [(1, 10, "tota1 amount"), (1, 11, "zzz"), (2, 12, ""), (3, 13, "alone"), (1, 14, None)]
    made = matched_lines(spark.createDataFrame(found, "page int, id int, text string"), spark.createDataFrame(ref, "page int, ref_id int, ref_text string"), ["page"])
    assert {r.id: r.ref_id for r in made.collect()} == {10: 0, 11: None, 12: 0, 13: None, 14: None}


def test_whole_tables_match_brute_force(spark):
    from vellum import catalog, catalog_records
    from vellum.operators.alignment import LEAST_RATIO

    native, _, ocr = catalog_records._segments(spark, "/root/testdata/sf0.001")
    pages: dict = {}
    for r in native.collect():
        pages.setdefault((r.doc_id, r.page), []).append((r.id, r.text))
    got = {(r.doc_id, r.page, r.id): r.ref_id for r in catalog.QUERIES["fuzzy_lines"](spark, "/root/testdata/sf0.001").collect()}
    short = [r for r in ocr.collect() if len(r.text) < 40 and sum(len(t) for _, t in pages[r.doc_id, r.page]) < 1500]
    assert short
    for r in short:
        like, at = max((200 * common(r.text, t) / (len(r.text) + len(t)), -i) for i, t in pages[r.doc_id, r.page])
        assert got[r.doc_id, r.page, r.id] == (-at if like >= LEAST_RATIO else None)
