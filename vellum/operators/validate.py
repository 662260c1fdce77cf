"""Metrics and checks of delivered text against its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.distance import edit_distance

NUMBER = "(R\\$|US\\$|€|£|\\d+x\\b|\\d[\\d.,]*%?)"
TOKEN = "([\\p{L}\\p{N}]+(?:[.,][\\p{L}\\p{N}]+)*|R\\$|US\\$|%)"


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length; 0 if both are empty, 1 if only the reference is."""
    return F.when(F.length(reference) > 0, edit_distance(reference, hypothesis) / F.length(reference)).when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)


def multiset_recall(pairs: DataFrame, key: str, reference: Column, hypothesis: Column) -> DataFrame:
    """Per key: how many of the reference's tokens the hypothesis has, counted with multiplicity; 1 without tokens."""
    ref = pairs.select(key, F.explode(reference).alias("token"))
    hyp = pairs.select(key, F.explode(hypothesis).alias("token"))
    both = ref.select(key, "token", F.lit(1).alias("r"), F.lit(0).alias("h")).unionByName(hyp.select(key, "token", F.lit(0).alias("r"), F.lit(1).alias("h")))
    counts = both.groupBy(key, "token").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    found = counts.groupBy(key).agg(F.sum("r").alias("tokens"), F.sum(F.least("r", "h")).alias("matched"))
    return pairs.select(key).join(found, key, "left").select(key, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("matched", F.lit(0)).alias("matched"), F.when(F.coalesce("tokens", F.lit(0)) == 0, 1.0).otherwise(F.col("matched") / F.col("tokens")).alias("recall"))


def kendall_tau(order: Column) -> Column:
    """(concordant - discordant) / pairs of an order of numbers; ties count as neither, fewer than two give 1."""
    n = F.size(order)
    signs = F.aggregate(F.transform(order, lambda x, i: F.aggregate(F.slice(order, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, y: a + F.signum(y - x).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(n < 2, 1.0).otherwise(signs / (n * (n - 1) / 2))


def reflow(lines: Column) -> Column:
    """Lines as one text: a hyphen between a letter and a line's end joins the word, all other ends become spaces."""
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "(\\p{L})-\n(\\p{Ll})", "$1$2"), "\n", " ")


def spans(blocks: DataFrame, key: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """Half-open code-point spans of blocks in a text that joins them with ``gap`` characters."""
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0))
    return blocks.withColumn("start", start).withColumn("end", start + F.length(text))
