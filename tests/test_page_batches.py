"""Segments of batches of pages against one page after the other in plain Python, and how the query gets them."""

import random

import pyarrow as pa

from vellum.operators.page_batches import segments_of

FIELDS = ("top", "vline", "k", "text", "x0", "x1", "bottom")
TYPE = pa.list_(pa.struct([("top", pa.float64()), ("vline", pa.int32()), ("k", pa.int32()), ("text", pa.string()), ("x0", pa.float64()), ("x1", pa.float64()), ("bottom", pa.float64())]))


def plain(ws, width):
    """(col, band, x0, top, x1, bottom, text, order_pos) of a page's segments."""
    struct = lambda *names: lambda w: tuple((w[n] is not None, w[n] or "") if n == "text" else w[n] for n in names)
    lines, total, high = [], 0.0, 0.0
    for w in sorted(ws, key=struct(*FIELDS)):
        h = w["bottom"] - w["top"]
        if lines and abs(w["top"] - total / len(lines[-1])) <= max(1.0, 0.6 * max(high, h)):
            lines[-1].append(w)
            total, high = total + w["top"], max(high, h)
        else:
            lines.append([w])
            total, high = w["top"], h
    islands = []
    for a, b in sorted({(w["x0"], w["x1"]) for w in ws}):
        if islands and a <= islands[-1][1]:
            islands[-1][1] = max(islands[-1][1], b)
        else:
            islands.append([a, b])
    need = max(3.0, 0.15 * len(lines))
    splits = []
    for (_, a), (b, _) in zip(islands, islands[1:]):
        if b - a >= 0.02 * width and sum(any(w["x0"] < a for w in x) for x in lines) >= need and sum(any(w["x0"] >= b for w in x) for x in lines) >= need:
            splits.append((a + b) / 2)
    parts = {}
    for band, line in enumerate(lines):
        for w in line:
            c = (w["x0"] + w["x1"]) / 2
            parts.setdefault((sum(s <= c for s in splits) if 0 <= c < width else len(splits), band), []).append(w)
    box = lambda x: (min(w["x0"] for w in x), min(w["top"] for w in x), max(w["x1"] for w in x), max(w["bottom"] for w in x))
    text = lambda x: " ".join(w["text"] for w in sorted(x, key=struct("x0", "vline", "k", "text", "top", "x1", "bottom")) if w["text"] is not None)
    order = sorted(parts, key=lambda p: (p[0], box(parts[p])[1], p[1]))
    return sorted((*p, *box(x), text(x), order.index(p)) for p, x in parts.items())


def test_equals_one_page_at_a_time():
    rng, pages, columns = random.Random(3), [[]], 0
    for i in range(300):
        ws = []
        for j in range(rng.choice((1, 3, 40, 150))):
            x0 = rng.choice((40, 90, 140, 330, 400, 500)) + rng.choice((0, 0, 0.5, 9)) if rng.random() < 0.97 else rng.choice((-30.0, 640.0))
            top = 70 + 14.0 * rng.randrange(30) + rng.choice((0, 0.25, 3))
            tied = i % 5 == 0  # equal places: the text decides
            ws.append(dict(zip(FIELDS, (top, 0 if tied else j, 0, rng.choice(("a", "b", "é", "\U0001f600", None)) if tied else f"w{j}", float(x0), x0 + rng.choice((5.0, 30.0, 45.0)), top + rng.choice((8, 10, 10, 25))), strict=True)))
        pages += [ws, []] if i % 50 == 0 else [ws]
    page, made = segments_of(pa.array([[], *pages], TYPE).slice(1), 612.0)
    rows = [[] for _ in pages]
    for p, row in zip(page.tolist(), zip(*(c.to_pylist() for c in made), strict=True), strict=True):
        rows[p].append(row)
    for ws, got in zip(pages, rows, strict=True):
        assert sorted(got) == plain(ws, 612.0)
        columns += any(r[0] for r in got)
    assert columns > 50


def test_segments_need_no_shuffle(spark):
    from vellum import catalog

    plan = catalog.segments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_pages_are_the_words(spark, tmp_path):
    from vellum.sources import words as source

    long = "\n".join(" ".join(f"w{i}é{j}" for j in range(i % 15)) + "  x" for i in range(3000))
    spark.createDataFrame([(3, long), (1, long), (2, None), (4, " \n\n"), (-3, "\U0001f600 b\n\nc"), (None, "a  b\nc\nd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "page", "vline", "k", "text", "x0", "top", "x1", "bottom"]
    want = source.words(spark, str(tmp_path)).select(names).collect()
    got = source.pages(spark, str(tmp_path)).selectExpr("doc_id", "page", "inline(ws)").select(names).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 40_000
