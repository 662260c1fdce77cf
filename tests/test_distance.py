"""Edit distances in batches against the trace of one pair at a time, and the pages' texts they are taken of."""

import random
import time

from pyspark.sql import functions as F

from vellum.operators import distance
from vellum.operators.alignment import edit_counts
from vellum.operators.distance import edit_distance, edit_distances


def test_equals_brute_force():
    rng = random.Random(5)
    ones, others = [], []
    for letters in ("ab", "abcdefg é", "\U0001f600漢字xyz", "".join(map(chr, range(40_000, 73_000)))):
        for _ in range(60):
            x = [rng.choice(letters) for _ in range(rng.choice((0, 1, 2, 7, 40, 300)))]
            y = [rng.choice(letters) for _ in range(rng.choice((0, 1, 50)))] if rng.random() < 0.4 else list(x)
            for _ in range(rng.randrange(40)):  # many edits make a first band too narrow
                at = rng.randrange(len(y) + 1)
                y[at : at + rng.randrange(2)] = [rng.choice(letters) for _ in range(rng.randrange(2))]
            ones.append("".join(x))
            others.append("".join(y))
    assert edit_distances(ones, others).tolist() == [sum(edit_counts(a, b)) for a, b in zip(ones, others, strict=True)]
    long = "ab" * 9000, "ba" * 8000
    assert edit_distances([long[0]], [long[1]]).tolist() == [sum(edit_counts(*long))]


def test_nulls(spark):
    rows = spark.createDataFrame([(None, "a"), ("a", None), ("kitten", "sitting"), ("", "")], "x string, y string")
    assert [r.d for r in rows.select(edit_distance(F.col("x"), F.col("y")).alias("d")).collect()] == [None, None, 3, 0]


def test_pages_take_time_of_length_times_distance(spark):
    rng = random.Random(1)
    pages = [" ".join("".join(rng.choice("eeeatthhioxyz") for _ in range(rng.randrange(2, 10))) for _ in range(240)) for _ in range(1500)]
    start = time.process_time()
    edit_distances(pages, [p.replace("x", "").replace("th", "t h") for p in pages])
    assert time.process_time() - start < 15


def test_page_texts_are_the_words_in_order(spark, tmp_path):
    from vellum.sources import words as source

    text = "\n".join(" ".join(f"w{i}.{j}" for j in range(i % 15)) + "  x" for i in range(70))
    spark.createDataFrame([(1, text), (2, None), (3, " \n\n"), (None, "a  b\nc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = source.words(spark, str(tmp_path)).collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r.vline, r.k)):
        want.setdefault((r.doc_id, r.page), []).append(r.text)
    got = {(r.doc_id, r.page): r.text for r in source.page_texts(spark, str(tmp_path)).collect()}
    assert got == {k: " ".join(v) for k, v in want.items()} and len(got) == 5 and "Exchange" not in source.page_texts(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_truth_metrics_shuffles_no_words(spark):
    from vellum import catalog_evidence

    plan = catalog_evidence.truth_metrics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan and "levenshtein" not in plan


def test_bits_take_less_time_than_cells():
    rng = random.Random(2)
    words = ["the", "then", "with", "that", "see", "ever", "more", "oath", "and", "of", "licence", "thesis"]
    pages = [" ".join(rng.choice(words) for _ in range(240)) for _ in range(2000)]
    damaged = [p.replace("e", "").replace("th", "t h") for p in pages]
    pairs = [(i, x, y, 160) for i, (x, y) in enumerate(zip(pages, damaged, strict=True))]
    spent = {}
    for way in (distance._by_bits, distance._banded):
        start = time.process_time()
        for part in distance._parts(pairs):
            found, least_beyond = way(part)
            assert (found <= least_beyond).all()
            spent.setdefault(way, []).extend(found.tolist())
        spent[way, "s"] = time.process_time() - start
    assert spent[distance._by_bits] == spent[distance._banded] and 1.5 * spent[distance._by_bits, "s"] < spent[distance._banded, "s"]


def test_bits_equal_brute_force_in_widths_about_a_word():
    rng = random.Random(4)
    ones, others = [], []
    for n in (1, 2, 61, 62, 63, 64, 125, 126, 127, 189, 400, 1100):
        for letters in ("ab", "abcdefghij ", "".join(map(chr, range(0x4E00, 0x5E00)))):
            for _ in range(6):
                x = [rng.choice(letters) for _ in range(n)]
                y = list(x)
                for _ in range(rng.randrange(1 + n // 5)):
                    at = rng.randrange(len(y) + 1)
                    y[at : at + rng.randrange(3)] = [rng.choice(letters) for _ in range(rng.randrange(3))]
                ones.append("".join(x))
                others.append("".join(y))
    assert edit_distances(ones, others).tolist() == [sum(edit_counts(a, b)) for a, b in zip(ones, others, strict=True)]


def test_truth_metrics_joins_nothing(spark, tmp_path):
    from vellum import catalog_evidence

    spark.createDataFrame([(1, "the tree\nthere", "en"), (2, None, "en"), (3, "abc", None), (None, "the", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog_evidence.truth_metrics(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    assert {r.lang: (r.pages, r.pages_within) for r in made.collect()} == {"en": (1, 0), None: (1, 1)}
