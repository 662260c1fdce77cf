"""Extraction candidates as tables: segments of all paths, one header a path and document, failures, and differences of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def family(technique: Column) -> Column:
    """``ocr:tesseract`` and ``ocr:rapidocr`` are of one family."""
    return F.split_part(technique, F.lit(":"), F.lit(1))


def failure_name(path: Column) -> Column:
    """The technique of a path that died before it named its engine."""
    return F.when(path == "ocr", "ocr:unknown").otherwise(path)


def literal(original: Column, shown: Column) -> Column:
    """struct(text, fallback): what the layout model read, or else what it shows, with a note that it did."""
    there = F.coalesce(original, F.lit("")) != ""
    return F.struct(F.when(there, original).otherwise(shown).alias("text"), (~there).alias("fallback"))


def assembled(paths: dict[str, DataFrame], key: str, order: list[str]) -> DataFrame:
    """The paths' segments in one table, with ``technique`` and ``order_pos``, their place among all of a document's (in the order of the columns named)."""
    rows = reduce(DataFrame.unionByName, (df.withColumn("technique", F.lit(name)) for name, df in paths.items()))
    place = Window.partitionBy(key, "technique").orderBy(*order)
    return rows.withColumn("order_pos", (F.row_number().over(place) - 1).cast("int"))


def headers(segments: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """One row for each of outcomes(key, technique, pages, outcome, detail): status, what is covered, and how many segments there are.

    A path without an outcome has failed. Pages that nothing covers make an ok candidate partial, and are named behind the path's own detail.
    """
    covered = segments.groupBy(key, "technique").agg(F.array_sort(F.collect_set("page")).alias("covered"), F.count("*").alias("n_segments"))
    made = outcomes.join(covered, [key, "technique"], "left").withColumn("covered", F.coalesce("covered", F.array().cast("array<int>")))
    missing = F.array_except("pages", "covered")
    note = F.when((F.col("outcome") == "success") & (F.size(missing) > 0), F.concat(F.lit("missing pages: "), F.array_join(missing.cast("array<string>"), ", ")))
    status = F.when(F.col("outcome") == "success", F.when(F.size(missing) == 0, "ok").otherwise("partial")).when(F.col("outcome") == "partial_success", "partial").otherwise("failed")
    name = F.when(status == "failed", failure_name(F.col("technique"))).otherwise(F.col("technique"))
    failed = status == "failed"
    return made.select(key, name.alias("technique"), family(F.col("technique")).alias("family"), status.alias("status"), F.concat_ws("; ", "detail", note).alias("status_detail"), F.when(failed, 0).otherwise(F.coalesce("n_segments", F.lit(0))).cast("long").alias("n_segments"), F.when(failed, "").otherwise(F.array_join(F.col("covered").cast("array<string>"), ",")).alias("pages_covered"))


def run_difference(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only one of two runs has, with how often each has them (none: the runs are equal). Repeated rows count."""
    a, b = one.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")), other.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b"))
    return a.unionByName(b).groupBy(*keys).agg(F.sum("a").alias("first_run"), F.sum("b").alias("second_run")).where("first_run <> second_run")


def is_permutation(order: Column, ids: Column) -> Column:
    """Whether an order names exactly the ids, each as often as it is there."""
    return F.coalesce(F.array_sort(order) == F.array_sort(ids), F.lit(False))


def union_in_order(*tokens: Column) -> Column:
    """Each token once, in the order of first appearance."""
    return F.array_distinct(F.concat(*tokens))
