"""Literal cases of layout, bands, selections, metrics, floors, stores and guards."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

WORDS = "doc_id long, page int, vline int, k int, text string, x0 double, top double, x1 double, bottom double"


def words(spark, rows, page=1):
    """rows: (text, x0, top, x1, bottom)."""
    return spark.createDataFrame([(1, page, i, 0, t, float(a), float(b), float(c), float(d)) for i, (t, a, b, c, d) in enumerate(rows)], WORDS)


def bands(spark, tops, height=12.0):
    from vellum.operators import layout

    got = layout.line_bands(words(spark, [(str(i), 10, t, 20, t + height) for i, t in enumerate(tops)])).orderBy("vline").collect()
    return [r.band for r in got]


def test_lines(spark):
    assert bands(spark, [100, 100, 101]) == [0, 0, 0]
    assert bands(spark, [130, 100]) == [1, 0]
    assert bands(spark, [100, 107]) == [0, 0] and bands(spark, [100, 107.5]) == [0, 1]


def columns(spark, rows):
    from vellum.operators import layout

    return layout.column_ranges(words(spark, rows), 612.0).orderBy("col").collect()


def test_columns_and_reading_order(spark):
    from vellum.operators import layout

    two = [(f"{side}{i}", x, 100 + 20 * i, y, 110 + 20 * i) for i in range(6) for side, x, y in (("L", 60, 120), ("R", 330, 400))]
    assert [(r.low, r.high) for r in columns(spark, two)] == [(0.0, 225.0), (225.0, 612.0)]
    got = layout.segments(words(spark, two[:8]), 612.0).orderBy("order_pos").collect()
    assert [r.text for r in got] == ["L0", "L1", "L2", "L3", "R0", "R1", "R2", "R3"] and [r.order_pos for r in got] == list(range(8))
    header = [("title", 60, 60, 120, 72), ("date", 500, 60, 560, 72)] + [("full", 60, 100 + 20 * i, 480, 112 + 20 * i) for i in range(8)]
    assert len(columns(spark, header)) == 1
    assert len(columns(spark, [(w, x, 100 + 20 * i, x + 95, 112 + 20 * i) for i in range(10) for w, x in (("a", 60), ("b", 160))])) == 1
    both = layout.segments(words(spark, [("First", 60, 100, 90, 112), ("line.", 95, 100, 120, 112), ("Second", 60, 120, 100, 132), ("line.", 105, 120, 130, 132)]), 612.0).orderBy("order_pos").collect()
    assert [r.text for r in both] == ["First line.", "Second line."]
    assert layout.segments(words(spark, [("x", 0, 0, 1, 1)]).limit(0), 612.0).count() == 0


def test_no_word_is_lost_beside_the_page(spark):
    from vellum.operators import layout

    rows = [(f"{side}{i}", x, 100 + 20 * i, y, 110 + 20 * i) for i in range(6) for side, x, y in (("L", 60, 120), ("R", 330, 400))]
    beyond = [("edge", 610, 100, 614, 110), ("left", -5, 120, 3, 130)]
    got = layout.segments(words(spark, rows + beyond), 612.0).collect()
    assert sorted(w for r in got for w in r.text.split()) == sorted(t for t, *_ in rows + beyond)
    assert {r.col for r in got if "edge" in r.text or "left" in r.text} == {1}


def test_segment_id(spark):
    from vellum.operators import layout

    got = layout.segments(words(spark, [("a", 10, 20, 40, 32), ("b", 45, 21, 80, 33)]), 612.0).collect()
    assert [(r.x0, r.top, r.x1, r.bottom, r.text) for r in got] == [(10.0, 20.0, 80.0, 33.0, "a b")]
    assert got[0].segment_id == hashlib.sha1(f"1:[10, 20, 80, 33]:{hashlib.sha1(b'a b').hexdigest()}".encode()).hexdigest()[:12]


def test_table_regions(spark):
    from vellum.operators import records

    segments = spark.createDataFrame([(1, 1, 0, 80.0, 210.0, 110.0, 222.0), (1, 1, 1, 500.0, 500.0, 550.0, 512.0)], "doc_id long, page int, id int, x0 double, top double, x1 double, bottom double")
    region = spark.createDataFrame([(1, 1, 0, 72.0, 172.8, 374.4, 259.2)], "doc_id long, page int, region_no int, x0 double, top double, x1 double, bottom double")
    assert [r.region_no for r in records.table_hints(segments, region, ["doc_id", "page"]).orderBy("id").collect()] == [0, None]


BANDS = [(0.001, 0, 0.0, 0, "blank"), (0.09, 150, 0.25, 0, "native_ok"), (0.05, 0, 0.0, 0, "needs_ocr"), (0.012, 66, 0.06, 3, "needs_ocr"), (0.0, 8, 0.01, 0, "native_ok"), (0.08, 2, 0.001, 0, "needs_ocr"), (0.05, 66, 0.06, 3, "needs_ocr")]


def evidence(spark, rows):
    return spark.createDataFrame([(1, p, b, i, c, a, g) for p, b, i, c, a, g in rows], "doc_id long, page int, band int, ink double, chars long, native_ratio double, gibberish long")


def test_band_and_page_classes(spark):
    from vellum.operators import reliability

    got = reliability.band_class(evidence(spark, [(1, b, *x[:4]) for b, x in enumerate(BANDS)])).orderBy("band").collect()
    assert [r.kind for r in got] == [x[4] for x in BANDS]
    ok, bad, blank = (0.09, 150, 0.25, 0), (0.05, 0, 0.0, 0), (0.001, 0, 0.0, 0)
    pages = {1: [ok, ok], 2: [bad, bad], 3: [ok, bad], 4: [ok, blank, blank], 5: [blank, blank], 6: [bad, blank]}
    classed = reliability.band_class(evidence(spark, [(p, b, *x) for p, rows in pages.items() for b, x in enumerate(rows)]))
    classes = reliability.page_class(classed)
    found = {r.page: r.page_class for r in classes.collect()}
    assert found == {1: "native_text_sufficient", 2: "ocr_required", 3: "hybrid_native_and_ocr", 4: "native_text_sufficient", 5: "native_text_sufficient", 6: "ocr_required"}
    regions = reliability.ocr_regions(classed, classes, 792.0).groupBy("page").count().collect()
    assert {r.page: r["count"] for r in regions} == {2: 1, 3: 1, 6: 1}


def test_crops_and_pixels(spark):
    from vellum.operators import records

    box = spark.createDataFrame([(72.0, 100.0, 540.0, 230.0), (None, None, None, None)], "x0 double, top double, x1 double, bottom double")
    got = box.select(records.crop_margins({c: F.col(c) for c in ("x0", "top", "x1", "bottom")}, 612.0, 792.0).alias("m")).collect()
    assert [tuple(r.m) for r in got] == [(72.0, 562.0, 72.0, 100.0), (0.0, 0.0, 0.0, 0.0)]
    at = spark.range(1).select(*(records.on_page(F.lit(float(p)), F.lit(0.0), 2.0).alias(str(p)) for p in (20, 40, 60, 80)), *(records.on_page(F.lit(float(p)), F.lit(float(o)), 1.0).alias(f"o{p}") for p, o in ((0, 72), (20, 72), (10, 100)))).first()
    assert tuple(at) == (10.0, 20.0, 30.0, 40.0, 72.0, 92.0, 110.0)


@pytest.mark.parametrize("asked, code", [(["pt", "en"], "por+eng"), (["pt", "pt-br", "por", "pt"], "por"), ([], "por"), (["xx"], "xx")])
def test_engine_languages(spark, asked, code):
    from vellum.operators import reconcile

    assert spark.createDataFrame([(asked,)], "a array<string>").select(reconcile.engine_languages(F.col("a")).alias("c")).first().c == code


SELECTIONS = [("2,5-7,10-12", None, [[2, 2], [5, 7], [10, 12]]), ("1-3,4", None, [[1, 4]]), ("10-5", "reversed", []), ("2,foo,5", "non_numeric", []), ("2-6,5-9", "overlap", []), ("0", "not_one_based", []), ("-1", "non_numeric", []), ("3,,4", "empty", []), ("", None, []), (None, None, []), ("7,3", None, [[3, 3], [7, 7]]), ("3,3", "overlap", []), ("1.0", "non_numeric", [])]


def test_selections(spark):
    from vellum.operators import selection

    rows = spark.createDataFrame([(i, s) for i, (s, *_) in enumerate(SELECTIONS)], "i int, s string").select("i", selection.parsed(F.col("s")).alias("p"))
    got = rows.select("i", "p.*", selection.token(F.col("p.ranges")).alias("token"), selection.pages(F.col("p.ranges"), F.lit(20)).alias("pages"), selection.beyond(F.col("p.ranges"), F.lit(11)).alias("beyond")).orderBy("i").collect()
    assert [(r.fault, [[x.lo, x.hi] for x in r.ranges]) for r in got] == [(f, m) for _, f, m in SELECTIONS]
    assert got[0].token == "2_5-7_10-12" and got[0].pages == [2, 5, 6, 7, 10, 11, 12] and got[0].beyond == 12 and got[4].twice == "5-6"
    assert got[8].token == "all" and got[8].pages == list(range(1, 21)) and got[1].beyond is None
    back = spark.createDataFrame([("2_5-7_10-12",), ("all",)], "t string").select(selection.from_token(F.col("t")).alias("r")).collect()
    assert [[x.lo, x.hi] for x in back[0].r] == [[2, 2], [5, 7], [10, 12]] and back[1].r == []


def test_floors(spark):
    from vellum.operators import metrics

    def passed(cer=0.20, diacritic=0.90, numeric=0.95):
        rows = [("A", "pt", m, v) for m, v in (("cer", cer), ("diacritic_accuracy", diacritic), ("numeric_token_exact_match", numeric)) if v is not None]
        r = metrics.floors(spark.createDataFrame(rows, "engine string, lang string, metric string, value double"), ["engine", "lang"]).first()
        return r.passed, r.diacritic_ok

    assert passed() == (True, True) and passed(cer=0.20 + 1e-9)[0] is False and passed(diacritic=0.90 - 1e-9)[0] is False and passed(numeric=0.95 - 1e-9)[0] is False
    assert passed(diacritic=None) == (True, None)


def test_canonical_json_and_keys(spark):
    from vellum.operators import identity

    value = 'é "q" \\ \n\t'
    made = spark.createDataFrame([(value, ["b", "a"], [[72.0, 100.12345, 1.5, 2.0]])], "v string, c array<string>, b array<array<double>>")
    region = identity.region(F.lit(3), F.col("b"), F.col("c"))
    row = made.select(identity.literal_choice(F.lit("select"), F.col("v")).alias("choice"), region.alias("region")).first()
    assert row.choice == json.dumps({"mode": "select", "value": value}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert row.region == '{"candidates":["a","b"],"page":3,"regions":[[72.0,100.123,1.5,2.0]]}'

    def key(candidates=("b", "a"), box=(72.0, 100.0, 1.5, 2.0), config="{}", kind="literal_content", sha="s"):
        df = spark.createDataFrame([(list(candidates), [list(box)])], "c array<string>, b array<array<double>>")
        return df.select(identity.applicability_key(F.lit(sha), F.lit(kind), identity.region(F.lit(1), F.col("b"), F.col("c")), F.lit(config)).alias("k")).first().k

    base = key()
    assert base == key(candidates=("a", "b")) and len({base, key(candidates=("a", "c")), key(box=(72.0, 100.0, 1.5, 2.1)), key(config='{"x":1}'), key(kind="reading_order"), key(sha="t")}) == 6
    assert base == hashlib.sha256('s\nliteral_content\n{"candidates":["a","b"],"page":1,"regions":[[72.0,100.0,1.5,2.0]]}\n{}'.encode()).hexdigest()


def test_store_fails_closed_by_key(spark):
    from vellum.operators import resolutions, review

    log = [("a", 0, "a0", None, "x"), ("a", 1, "a1", "a0", "y"), ("b", 2, "b0", None, "x"), ("b", 3, "b1", "gone", "y"), ("c", 4, "c0", None, "x"), ("c", 5, "c1", "c0", "y"), ("c", 6, "c2", "c0", "z"), ("d", 7, "d0", None, "x"), ("d", 7, "d1", "d0", "y"), ("e", 8, "e0", "other", "x")]
    df = spark.createDataFrame(log, "key string, seq long, resolution_id string, supersedes string, value string")
    items = spark.createDataFrame([(k,) for k in "abcdef"], "key string")
    got = {r.key: (r.value, r.raised) for r in resolutions.replay(items, review.current(review.chain(df))).collect()}
    assert got["a"] == ("y", None) and got["f"] == (None, "no_decision") and all(got[k][0] is None and got[k][1].startswith("failed_closed:") for k in "bcde")
    assert resolutions.next_sequence(df).first()[0] == 9 and resolutions.next_sequence(df.limit(0)).first()[0] == 0
    empty = spark.createDataFrame([], "k string, v string").agg(review.set_digest(F.col("k"), F.col("v")).alias("d")).first().d
    assert empty == hashlib.sha256(b"").hexdigest()


def test_guard_rejects_near_misses(spark):
    from vellum.operators import review

    near = ["R$ 1.599,80", "R$ 1.599,80 ", "R$ 1.599.80", "r$ 1.599,80", "café", "café"]
    got = spark.createDataFrame([(x,) for x in near], "s string").select(review.guard_literal(F.col("s"), F.array(F.lit("R$ 1.599,80"), F.lit("café"))).alias("v")).collect()
    assert [r.v for r in got] == ["accept", "reject", "reject", "reject", "reject", "accept"]


def test_flips(spark):
    from vellum.operators import resolutions

    rows = spark.createDataFrame([(0, 0), (0, 1), (None, None), (1, None)], "a int, b int").select(resolutions.flip_check(F.col("a"), F.col("b"), F.array(F.lit("x"), F.lit("y"))).alias("f")).collect()
    assert [(r.f.agree, r.f.value) for r in rows] == [(True, "x"), (False, None), (False, None), (False, None)]
