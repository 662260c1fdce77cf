"""Delivered text: blocks, escapes, stitched tables, checks of slices, defects and their routes, run states and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_kind(text: Column, place: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit("^[0-9]+[.)] ")), "clause").when(F.regexp_like(text, F.lit("^[-*] ")), "list_item").when(place == 0, "heading").otherwise("paragraph")


def escaped(text: Column) -> Column:
    """A value whose first characters mean something to Markdown gets a backslash, so that it is rendered as it stands."""
    return F.regexp_replace(text, "^([#>*+_`-]|[0-9]+\\.)", "\\\\$1")


def rendered(kind: Column, text: Column) -> Column:
    return F.when(kind == "heading", F.concat(F.lit("# "), text)).when(kind == "list_item", F.concat(F.lit("- "), F.substring(text, F.lit(3), F.length(text)))).when(kind == "clause", text).otherwise(escaped(text))


def markdown(blocks: DataFrame, key: str) -> DataFrame:
    """blocks(key, block, kind, text): one Markdown text per key, blocks in order with an empty line between."""
    lines = F.array_sort(F.collect_list(F.struct("block", rendered(F.col("kind"), F.col("text")).alias("line"))))
    return blocks.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("markdown"))


def stitched_tables(parts: DataFrame, key: str) -> DataFrame:
    """parts(key, page, header, rows): parts on consecutive pages with one header are one table, its header counted once."""
    order = Window.partitionBy(key).orderBy("page")
    new = ~F.coalesce((F.lag("page").over(order) == F.col("page") - 1) & F.lag("header").over(order).eqNullSafe(F.col("header")), F.lit(False))
    numbered = parts.withColumn("new", new.cast("int")).withColumn("table_no", (F.sum("new").over(order) - 1).cast("int"))
    return numbered.groupBy(key, "table_no").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.first("header").alias("header"), F.sum("rows").alias("body_rows"), (F.count("*") - 1).alias("headers_dropped"))


def verified(spans: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """spans(key, block, start, end, text) against delivered(key, delivered): slices equal and starts in order."""
    at = spans.withColumn("rising", F.coalesce(F.col("start") > F.lag("start").over(Window.partitionBy(key).orderBy("block")), F.lit(True)))
    ok = F.expr("substring(delivered, cast(start as int) + 1, cast(end - start as int))") == F.col("text")
    return at.join(delivered, key).groupBy(key).agg(F.count("*").alias("spans"), F.count_if(~ok).alias("differing"), F.bool_and("rising").alias("in_order"))


def token_defects(pairs: DataFrame, key: str, reference: Column, hypothesis: Column) -> DataFrame:
    """Tokens whose counts differ, with the defect and whether delivery or reconciliation has to mend it."""
    one = lambda c, r, h: pairs.select(key, F.explode(c).alias("token"), F.lit(r).alias("r"), F.lit(h).alias("h"))
    counts = one(reference, 1, 0).unionByName(one(hypothesis, 0, 1)).groupBy(key, "token").agg(F.sum("r").alias("in_source"), F.sum("h").alias("in_delivered"))
    kind = F.when(F.col("in_delivered") > F.col("in_source"), "not_in_source").otherwise("missing")
    return counts.where("in_source <> in_delivered").withColumn("defect", kind).withColumn("route", F.when(kind == "missing", "rerender").otherwise("reconcile"))


def run_state(open_items: Column, failed: Column, rendered_same: Column, decided: Column, passed: Column, authorized: Column) -> Column:
    """The first state that holds."""
    return F.when(open_items, "unresolved").when(failed, "delivery_blocked_verification_failed").when(rendered_same & (~decided | passed), "delivered").when(authorized, "authorized").otherwise("resolved_unauthorized")


def may_publish(open_items: Column, authorized: Column, checked: Column, decided: Column, passed: Column) -> Column:
    return ~open_items & authorized & checked & (~decided | passed)
