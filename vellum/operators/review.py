"""The append-only review log: chains of decisions per key, the latest valid one, digests, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain(log: DataFrame) -> DataFrame:
    """log(key, seq, resolution_id, supersedes, value) with the first rule a record breaks.

    Rules in order: sequence numbers are unique in the store; a key's first record supersedes nothing; others supersede something;
    that is the record right before. A key's chain is ordered in one task: decisions of people, few a key.
    """
    order = Window.partitionBy("key").orderBy("seq", "resolution_id")
    before = F.lag("resolution_id").over(order)
    seqs = log.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1").select("seq", F.lit(True).alias("dup"))
    marked = log.join(seqs, "seq", "left").withColumn("before", before)
    broken = (
        F.when(F.col("dup"), "duplicate_sequence")
        .when(F.col("before").isNull() & F.col("supersedes").isNotNull(), "first_supersedes")
        .when(F.col("before").isNotNull() & F.col("supersedes").isNull(), "missing_supersedes")
        .when(F.col("before") != F.col("supersedes"), "not_the_one_before")
    )
    return marked.withColumn("violation", broken).drop("dup", "before")


def current(chained: DataFrame) -> DataFrame:
    """Per key: the latest record, or the reason why the key fails closed."""
    at = F.struct("seq", "resolution_id")  # numbers may repeat in a broken store
    return chained.groupBy("key").agg(F.count("*").alias("records"), F.max_by("resolution_id", at).alias("resolution_id"), F.max_by("value", at).alias("value"), F.min_by("violation", F.when(F.col("violation").isNotNull(), at)).alias("failed"))


def set_digest(keys: Column, values: Column) -> Column:
    """sha256 of the sorted ``key=value`` lines of a group; of nothing: of the empty string."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(keys, F.lit("="), values))), "\n"), 256)


def guard_literal(selected: Column, candidates: Column) -> Column:
    """Accepted only if equal to a candidate, code point by code point."""
    return F.when(F.array_contains(candidates, selected), "accept").otherwise("reject")


def run_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16)
