"""Human decisions: replay onto review items, shapes, queues, and choosers that are asked twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_sequence(log: DataFrame) -> DataFrame:
    """The number of the next record; the first is 0."""
    return log.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("next_seq"))


def replay(items: DataFrame, current: DataFrame) -> DataFrame:
    """items(key, ...) with the decision that applies. A key without one, or whose chain failed, is raised anew; the reason says which.

    current: a row per key (resolution_id, value, failed), which is what makes this one equi-join.
    """
    made = items.join(current.select("key", "resolution_id", "value", "failed"), "key", "left")
    reason = F.when(F.col("failed").isNotNull(), F.concat(F.lit("failed_closed:"), "failed")).when(F.col("resolution_id").isNull(), "no_decision")
    return made.withColumn("raised", reason).withColumn("replayed", reason.isNull()).withColumn("value", F.when(reason.isNull(), F.col("value"))).withColumn("resolution_id", F.when(reason.isNull(), F.col("resolution_id"))).drop("failed")


def shape_fault(conflict: Column, mode: Column, value: Column, order: Column, verified: Column) -> Column:
    """What is wrong with a decision's content, or null. An order decision is a list of ids and nothing else; a literal one has a mode and a value, and
    says whether a person checked it, which for an entered value they must have."""
    return (
        F.when((conflict == "reading_order") & (F.coalesce(F.size(order), F.lit(0)) < 1), "order_missing")
        .when((conflict == "reading_order") & (mode.isNotNull() | value.isNotNull() | verified.isNotNull()), "order_and_more")
        .when(conflict == "reading_order", None)
        .when(order.isNotNull(), "order_in_literal")
        .when(~F.coalesce(mode.isin("select", "entered"), F.lit(False)), "mode")
        .when(value.isNull(), "value_missing")
        .when(verified.isNull(), "verified_missing")
        .when((mode == "entered") & ~verified, "entered_unverified")
    )


def queue_faults(items: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Queues whose summary(open, resolved) isn't the number of their items, or with order items that name no segments."""
    counted = items.groupBy(key).agg(F.count_if(F.col("status") == "open").alias("n_open"), F.count_if(F.col("status") == "resolved").alias("n_resolved"), F.count_if((F.col("conflict") == "reading_order") & (F.coalesce(F.size("segment_ids"), F.lit(0)) < 1)).alias("n_without_ids"))
    made = summaries.join(counted, key, "left").na.fill(0, ["n_open", "n_resolved", "n_without_ids"])
    wrong = (F.col("n_open") != F.col("open")) | (F.col("n_resolved") != F.col("resolved"))
    return made.withColumn("summary_differs", wrong).where(wrong | (F.col("n_without_ids") > 0))


def flip_check(first: Column, second: Column, candidates: Column) -> Column:
    """struct(agree, value): a chooser's two answers (places) agree only if both name the same candidate; its value is copied from the list."""
    agree = F.coalesce(first == second, F.lit(False))
    return F.struct(agree.alias("agree"), F.when(agree, F.get(candidates, first.cast("int"))).alias("value"))


def reproducibility(first: Column, second: Column) -> Column:
    """Of an endpoint that answered one request twice."""
    return F.when(first == second, "deterministic").otherwise("best_effort")


def prompt(question: Column, candidates: Column) -> Column:
    """The question, and the candidates by number."""
    return F.concat(question, F.lit("\n\nCandidates:\n"), F.array_join(F.transform(candidates, lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("] '"), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'"))), "\n"))


def issues(answer: Column) -> Column:
    """The objects of a review answer's list ``issues``, as JSON texts; none of what isn't JSON or has no such list."""
    listed = F.try_variant_get(F.try_parse_json(answer), "$.issues", "array<variant>")
    return F.coalesce(F.transform(F.filter(listed, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))), lambda x: F.to_json(x)), F.array().cast("array<string>"))
