"""Records and answers: torn logs, artifact names, model answers, invariants of decisions, boxes, table hints, headings and tables as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points by which a segment may stick out of a table region.
SLACK = 0.5


def log_lines(lines: DataFrame, key: str, place: str, line: str) -> DataFrame:
    """Non-empty lines of append-only logs with a status: record, torn (an unreadable last line) or corrupt (any other).

    The last line comes from an aggregate, not a window, so that a long log isn't sorted in one task. Null lines are empty.
    """
    there = lines.where(F.coalesce(line, F.lit("")) != "")
    last = there.groupBy(key).agg(F.max(place).alias("last_"))
    status = F.when(F.try_parse_json(line).isNotNull(), "record").when(F.col(place) == F.col("last_"), "torn").otherwise("corrupt")
    return there.join(last, key).withColumn("status", status).drop("last_")


def artifact_name(stem: Column, token: Column, run: Column, kind: str) -> Column:
    """A file name of a document and its pages; a null or empty token is the whole document."""
    base = F.when(F.coalesce(token, F.lit("")) == "", stem).otherwise(F.concat(stem, F.lit("__p"), token))
    if kind == "base":
        return base
    if kind == "markdown":
        return F.concat(base, F.lit(".md"))
    if kind == "unverified":
        return F.concat(F.lit("intermediates/"), base, F.lit("."), run, F.lit(".unverified.md"))
    raise ValueError(f"no such kind of artifact: {kind}")


def chosen_index(answer: Column, candidates: Column) -> Column:
    """The candidate (from 0) that a model's JSON answer names, by a whole number in range or else by an equal value; else null."""
    parsed = F.try_parse_json(answer)
    number = F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.selected_index", "variant")) == "BIGINT", F.try_variant_get(parsed, "$.selected_index", "long"))
    value = F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.selected", "variant")) == "STRING", F.try_variant_get(parsed, "$.selected", "string"))
    at = F.array_position(candidates, value) - 1
    return F.when((number >= 0) & (number < F.size(candidates)), number).when(at >= 0, at)


def breaks_invariant(method: Column, value: Column, candidates: Column) -> Column:
    """Whether a decision that no person made has a value that isn't one of its candidates."""
    return (method != "human") & ~F.coalesce(F.array_contains(candidates, value), F.lit(False))


def crop_margins(box: dict[str, Column], width: float, height: float) -> Column:
    """What to cut off a page to leave a box: left, bottom, right, top; nothing without a box."""
    cut = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(cut(box["x0"]).alias("left"), cut(height - box["bottom"]).alias("bottom"), cut(width - box["x1"]).alias("right"), cut(box["top"]).alias("top"))


def on_page(pixel: Column, origin: Column, scale: float) -> Column:
    """A coordinate of a picture of a region, in points of its page."""
    return origin + pixel / scale


def table_hints(segments: DataFrame, regions: DataFrame, page: list[str]) -> DataFrame:
    """segments with the first of their page's regions(page, region_no, x0, top, x1, bottom) that holds them, else null."""
    r = regions.select(*page, "region_no", *(F.col(c).alias(f"r_{c}") for c in ("x0", "top", "x1", "bottom")))
    inside = (F.col("x0") >= F.col("r_x0") - SLACK) & (F.col("x1") <= F.col("r_x1") + SLACK) & (F.col("top") >= F.col("r_top") - SLACK) & (F.col("bottom") <= F.col("r_bottom") + SLACK)
    held = segments.join(r, page).where(inside).groupBy(*page, "id").agg(F.min("region_no").alias("region_no"))
    return segments.join(held, [*page, "id"], "left")


def heading(level: Column, text: Column) -> Column:
    """Six levels have a Markdown form; deeper ones carry their number."""
    return F.when(level <= 6, F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), text)).otherwise(F.concat(F.lit("[L"), level.cast("string"), F.lit("] "), text))


def table_text(rows: Column) -> Column:
    """rows: array<array<struct<text, span>>>, header first. A pipe table, or HTML where a cell spans columns."""
    pipe = lambda c: F.replace(F.replace(F.coalesce(c["text"], F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    lines = F.transform(rows, lambda r: line(F.transform(r, pipe)))
    rule = line(F.transform(rows[0], lambda _: F.lit("---")))
    plain = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")

    def cell(c: Column) -> Column:
        text = F.coalesce(c["text"], F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return F.concat(F.when(c["span"] > 1, F.concat(F.lit('<td colspan="'), c["span"].cast("string"), F.lit('">'))).otherwise("<td>"), text, F.lit("</td>"))

    html = F.concat(F.lit("<table>\n"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))), "\n"), F.lit("\n</table>"))
    merged = F.exists(rows, lambda r: F.exists(r, lambda c: c["span"] > 1))
    return F.when(F.size(rows) == 0, "").when(merged, html).otherwise(plain)
