"""Where native text can be trusted: evidence per band of a page, classes of pages, regions for OCR."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
#: Bands of a page, ink below which a band is blank, least share of native area, share of bad bands that makes a whole page.
BANDS, BLANK, COVERAGE, WHOLE = 12, 0.02, 0.015, 0.85
MOJIBAKE = "[ÂÃ][\\x{80}-\\x{BF}]"


def band_evidence(words: DataFrame, width: float, height: float) -> DataFrame:
    """Per page and band (by the middle of each word): characters, share of native area, mojibake matches, and ink.

    words: with native (whether the text layer has the word) and shown (as which text). All words' area stands in for a raster's ink.
    """
    tall = height / BANDS
    area = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    rows = words.withColumn("band", F.floor((F.col("top") + F.col("bottom")) / 2 / tall).cast("int")).where(f"band >= 0 and band < {BANDS}")
    return rows.groupBy(*PAGE, "band").agg(
        F.sum(F.when(F.col("native"), F.length("text")).otherwise(0)).cast("long").alias("chars"),
        (F.sum(F.when(F.col("native"), area).otherwise(0.0)) / (width * tall)).alias("native_ratio"),
        F.sum(F.when(F.col("native"), F.regexp_count("shown", F.lit(MOJIBAKE))).otherwise(0)).cast("long").alias("gibberish"),
        (F.sum(area) / (width * tall)).alias("ink"),
    )


def band_class(evidence: DataFrame) -> DataFrame:
    text, inked = F.col("chars") > 0, F.col("ink") >= BLANK
    reason = F.when(text & (F.col("gibberish") > 0), "encoding_gibberish").when(inked & ~text, "no_native_text").when(inked & (F.col("native_ratio") < COVERAGE), "insufficient_native_coverage")
    # Wrong letters count however faint they are; text without ink has nothing to recover.
    kind = F.when(reason.isNotNull(), "needs_ocr").when(text, "native_ok").otherwise("blank")
    return evidence.withColumn("kind", kind).withColumn("reason", reason)


def page_class(classed: DataFrame) -> DataFrame:
    """Classes by the share of bad bands among those that aren't blank."""
    counts = classed.groupBy(*PAGE).agg(F.count_if(F.col("kind") == "needs_ocr").alias("bad"), F.count_if(F.col("kind") != "blank").alias("inked"))
    share = F.col("bad") / F.greatest("inked", F.lit(1))
    return counts.withColumn("page_class", F.when(F.col("bad") == 0, "native_text_sufficient").when(share >= WHOLE, "ocr_required").otherwise("hybrid_native_and_ocr"))


def ocr_regions(classed: DataFrame, pages: DataFrame, height: float) -> DataFrame:
    """One region for a page that needs OCR as a whole, else one per bad band."""
    tall = height / BANDS
    whole = pages.where("page_class = 'ocr_required'").select(*PAGE, F.lit(-1).alias("band"), F.lit(0.0).alias("top"), F.lit(height).alias("bottom"), F.lit("whole_page_native_text_unreliable").alias("reason"))
    parts = classed.where("kind = 'needs_ocr'").join(pages.where("page_class = 'hybrid_native_and_ocr'").select(*PAGE), PAGE, "left_semi")
    return whole.unionByName(parts.select(*PAGE, "band", (F.col("band") * tall).alias("top"), ((F.col("band") + 1) * tall).alias("bottom"), "reason"))


def ocr_lines(words: DataFrame, threshold: float = 70.0) -> DataFrame:
    """OCR words to lines by (block, paragraph, line): words in order, the least confidence, the union box."""
    keys = [*PAGE, F.floor(F.col("vline") / 10).cast("int").alias("block"), F.floor(F.col("vline") / 5).cast("int").alias("par"), F.col("vline").alias("line")]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda w: w["text"]), " ")
    return words.where(F.trim("text") != "").groupBy(*keys).agg(text.alias("text"), F.min(F.greatest("conf", F.lit(0.0))).alias("confidence"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def region_records(lines: DataFrame, threshold: float = 70.0) -> DataFrame:
    return lines.groupBy(*PAGE).agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.count_if(F.col("confidence") < threshold).alias("low_confidence"), F.count("*").alias("lines"))


def lines_in_regions(regions: DataFrame, lines: DataFrame, threshold: float = 70.0) -> DataFrame:
    """regions(page, band, top, bottom) with their lines, by the lines' middles: how many, how many of low confidence, and the mean (0 without any)."""
    middle = (F.col("l_top") + F.col("l_bottom")) / 2
    near = lines.select(*PAGE, "confidence", F.col("top").alias("l_top"), F.col("bottom").alias("l_bottom"))
    held = regions.select(*PAGE, "band", "top", "bottom").join(near, PAGE).where((middle >= F.col("top")) & (middle < F.col("bottom")))
    counted = held.groupBy(*PAGE, "band").agg(F.count("*").alias("lines"), F.count_if(F.col("confidence") < threshold).alias("low_confidence"), F.avg("confidence").alias("mean_confidence"))
    return regions.select(*PAGE, "band").join(counted, [*PAGE, "band"], "left").na.fill(0, ["lines", "low_confidence"]).na.fill(0.0, ["mean_confidence"])
