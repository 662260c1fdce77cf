"""Candidates of several techniques: page selections, coverage, alignment, literal and order decisions, review items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least overlap of boxes that aligns two segments; least confidence of an automatic choice; largest Kendall distance without a conflict.
IOU, CONFIDENT, DISTANCE = 0.5, 0.75, 0.2
#: Height of the grid cells that bring segments together, in points.
CELL = 14.0
#: Layout labels and their hints; language codes of the OCR engine.
HINTS = {"title": "heading", "section_header": "heading", "list_item": "list_item", "table": "table", "caption": "caption", "page_header": "other", "page_footer": "other"}
CODES = {"pt": "por", "pt-br": "por", "por": "por", "en": "eng", "eng": "eng", "es": "spa", "spa": "spa", "fr": "fra", "fra": "fra", "de": "deu", "deu": "deu", "it": "ita", "ita": "ita"}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def hint_of(label: Column) -> Column:
    return literal_map(HINTS)[label]


def engine_languages(languages: Column) -> Column:
    """Codes joined by ``+``, each once, in order; unknown ones as they are; none: Portuguese."""
    clean = F.transform(languages, lambda x: F.lower(F.trim(x)))
    codes = F.array_distinct(F.transform(clean, lambda x: F.coalesce(literal_map(CODES)[x], x)))
    return F.when(F.size(codes) > 0, F.array_join(codes, "+")).otherwise("por")


def confidence(raw: Column, engine: Column) -> Column:
    """Confidence from 0 to 100, whatever the engine's scale."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(engine == "rapidocr", raw * 100).otherwise(raw)))


def page_selection(specs: DataFrame, key: str, spec: str) -> DataFrame:
    """Per key: the normal token of a selection such as ``2,5-7`` (adjacent ranges merged), or the first pages that appear twice."""
    part = F.split(F.trim("part"), "-")
    ranges = specs.select(key, F.explode(F.split(spec, ",")).alias("part")).select(key, part[0].cast("int").alias("lo"), F.coalesce(F.try_element_at(part, F.lit(2)), part[0]).cast("int").alias("hi"))
    order = Window.partitionBy(key).orderBy("lo", "hi")
    ranges = ranges.withColumn("reach", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = ranges.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach") + 1), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = ranges.withColumn("twice", F.when(F.col("lo") <= F.col("reach"), F.concat_ws("-", F.col("lo").cast("string"), F.least("reach", "hi").cast("string"))))
    islands = ranges.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("twice", F.when(F.col("twice").isNotNull(), F.struct("lo", "hi"))).alias("twice"))
    name = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))
    token = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", name.alias("name")))), lambda x: x["name"]), "_")
    made = islands.groupBy(key).agg(token.alias("token"), F.min_by("twice", F.when(F.col("twice").isNotNull(), F.col("island"))).alias("twice"))
    return made.withColumn("token", F.when(F.col("twice").isNull(), F.col("token")))


def coverage_status(pages: DataFrame, key: str, outcome: str) -> DataFrame:
    """pages(key, page, covered, outcome): ok, partial or failed; pages that are missing make an ok partial."""
    missing = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("covered"), F.col("page")))), lambda p: p.cast("string")), ",")
    made = pages.groupBy(key).agg(F.first(outcome).alias("outcome"), missing.alias("missing"))
    status = F.when(F.col("outcome") == "success", F.when(F.col("missing") == "", "ok").otherwise("partial")).when(F.col("outcome") == "partial_success", "partial").otherwise("failed")
    return made.select(key, status.alias("status"), "missing")


def cluster_order(cells: DataFrame, page: list[str], cluster: str, within: list[str]) -> DataFrame:
    """Cells in the order of their clusters; cells that no cluster claims come last, as they stand."""
    order = Window.partitionBy(*page).orderBy(F.col(cluster).asc_nulls_last(), *within)
    return cells.withColumn("order_pos", (F.row_number().over(order) - 1).cast("int"))


def overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes (columns a_x0 .. a_bottom); 0 where both are empty."""
    c = lambda p, n: F.col(f"{p}_{n}")
    wide = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    high = F.least(c(a, "bottom"), c(b, "bottom")) - F.greatest(c(a, "top"), c(b, "top"))
    inner = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    area = lambda p: (c(p, "x1") - c(p, "x0")) * (c(p, "bottom") - c(p, "top"))
    union = area(a) + area(b) - inner
    return F.when(union > 0, inner / union).otherwise(0.0)


def compared(text: Column) -> Column:
    """The key texts are compared by: quotes folded, white space collapsed. Never delivered."""
    return F.trim(F.regexp_replace(F.translate(text, "“”‘’", "\"\"''"), "[ \\t\\n\\r]+", " "))


def token_likeness(a: Column, b: Column) -> Column:
    x, y = F.split(F.lower(compared(a)), " "), F.split(F.lower(compared(b)), " ")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def align(base: DataFrame, other: DataFrame, page: list[str]) -> DataFrame:
    """Per base segment the best other of its page: overlap, then tokens in common, then the smaller id.

    Both sides: page columns, id, text, x0, top, x1, bottom. Segments meet in grid cells, so no page is a cross join.
    """
    cells = lambda d, p: d.select(*page, *(F.col(n).alias(f"{p}_{n}") for n in ("id", "text", "x0", "top", "x1", "bottom")), F.explode(F.sequence(F.floor(F.col("top") / CELL), F.floor(F.col("bottom") / CELL))).alias("cell"))
    met = cells(base, "a").join(cells(other, "b"), [*page, "cell"]).withColumn("iou", overlap("a", "b")).where(F.col("iou") >= IOU)
    met = met.where(F.col("cell") == F.greatest(F.floor(F.col("a_top") / CELL), F.floor(F.col("b_top") / CELL)))
    rank = F.struct(F.col("iou"), token_likeness(F.col("a_text"), F.col("b_text")).alias("likeness"), (-F.col("b_id")).alias("id"))
    return met.groupBy(*page, F.col("a_id").alias("id")).agg(F.max(F.struct(rank.alias("rank"), F.col("b_text").alias("text"))).alias("m")).select(*page, "id", (-F.col("m.rank.id")).alias("other_id"), F.col("m.rank.iou").alias("iou"), F.col("m.text").alias("other_text"))


def literal_decision(groups: DataFrame) -> DataFrame:
    """groups(native, layout, ocr, ocr_conf; absent ones null) with method, value, confidence and reason.

    Equal after comparison, or different in white space and case only: the native value, verbatim. Other conflicts go to review, as no
    chooser is at hand; the reason says whether one would have been trusted.
    """
    n, a, o = (compared(F.col(c)) for c in ("native", "layout", "ocr"))
    there = F.array_compact(F.array(n, a, o))
    same = lambda x: F.size(F.filter(there, lambda v: v == x))
    most = F.greatest(*(F.coalesce(same(x), F.lit(0)) for x in (n, a, o)))
    bare = F.array_distinct(F.transform(there, lambda v: F.lower(F.replace(v, F.lit(" "), F.lit("")))))
    words = lambda x: F.split(F.coalesce(x, n), " ")
    differing = F.concat(F.array_except(words(o), words(n)), F.array_except(words(n), words(o)))
    digits = F.exists(differing, lambda w: F.regexp_like(w, F.lit("[0-9]")))
    sure = 0.5 * most / F.size(there) + F.when(n.isNotNull(), 0.2).otherwise(0.0) + 0.2 * F.coalesce(F.col("ocr_conf") / 100, F.lit(1.0)) + F.when(digits, 0.0).otherwise(0.1)
    settled = F.size(bare) <= 1
    return groups.withColumn("confidence", sure).withColumn("method", F.when(settled, "deterministic").otherwise("review")).withColumn("value", F.when(settled, F.coalesce("native", "layout", "ocr"))).withColumn("reason", F.when(~settled, F.when(sure >= CONFIDENT, "no_llm").otherwise("below_threshold")))


def order_decision(tau: Column) -> Column:
    """Equal orders are settled; a Kendall distance above the limit is a conflict; small ones follow geometry."""
    return F.when(tau == 1.0, "deterministic").when((1 - tau) / 2 > DISTANCE, "conflict").otherwise("geometry")


def guard_order(selected: Column, candidates: Column, geometry: Column) -> Column:
    """Accepted only if equal to a candidate's order or the geometric one, element by element; never sorted to fit."""
    return F.when(F.array_contains(candidates, selected) | (selected == geometry), "accept").otherwise("reject")
