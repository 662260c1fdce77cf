"""Alignments that need a trace: word insertions and deletions, and the best match of lines. Whole Python integers serve as bit rows."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Percent of likeness below which lines don't match.
LEAST_RATIO = 40


def edit_counts(reference: Sequence[Hashable], found: Sequence[Hashable]) -> tuple[int, int, int]:
    """Insertions, deletions and substitutions of a shortest edit from reference to found.

    Column deltas of the edit table are bits (Hyyrö's form of Myers' algorithm); their rows are kept, one per found word, and
    the trace goes from the end, taking a deletion before an insertion before a substitution.
    """
    head = 0
    while head < min(len(reference), len(found)) and reference[head] == found[head]:
        head += 1
    tail = 0
    while tail < min(len(reference), len(found)) - head and reference[-1 - tail] == found[-1 - tail]:
        tail += 1
    ref, hyp = reference[head : len(reference) - tail], found[head : len(found) - tail]
    if not ref or not hyp:
        return len(hyp), len(ref), 0
    where: dict[Hashable, int] = {}
    for i, w in enumerate(ref):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(ref)) - 1
    up, down, rows = full, 0, []
    for w in hyp:
        equal = where.get(w, 0)
        zero = (((equal & up) + up) ^ up) | equal | down
        right_up, right_down = down | (full & ~(zero | up)), zero & up
        right_up, right_down = (right_up << 1 | 1) & full, (right_down << 1) & full
        up, down = right_down | (full & ~(zero | right_up)), right_up & zero
        rows.append((up, down))
    i, j = len(ref), len(hyp)
    inserted = deleted = replaced = 0
    while i and j:
        if rows[j - 1][0] >> (i - 1) & 1:
            deleted, i = deleted + 1, i - 1
        elif j > 1 and rows[j - 2][1] >> (i - 1) & 1:
            inserted, j = inserted + 1, j - 1
        else:
            replaced += ref[i - 1] != hyp[j - 1]
            i, j = i - 1, j - 1
    return inserted + j, deleted + i, replaced


def word_rates(pairs: DataFrame, keys: list[str], reference: str, found: str) -> DataFrame:
    """keys, insertion_rate, deletion_rate: counts over the reference's words; 0 and 0 without any. Null texts are empty."""
    made = pairs.select(*keys, F.col(reference).cast("string").alias("r_"), F.col(found).cast("string").alias("f_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = []
            for r, f in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                words = (r or "").split()
                inserted, deleted, _ = edit_counts(words, (f or "").split()) if words else (0, 0, 0)
                rates.append((inserted / max(1, len(words)), deleted / max(1, len(words))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array([x[i] for x in rates], pa.float64()) for i in (0, 1))], names=[*keys, "insertion_rate", "deletion_rate"])

    types = {f.name: f.dataType.simpleString() for f in made.schema}
    return made.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "insertion_rate double", "deletion_rate double"]))


def ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / both lengths; 100 for two empty texts."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    left = full
    for c in b:
        both = left & where.get(c, 0)
        left = ((left + both) | (left - both)) & full
    return 200 * (len(a) - left.bit_count()) / (len(a) + len(b))


def matched_lines(found: DataFrame, reference: DataFrame, page: list[str]) -> DataFrame:
    """found(page, id, text) with ref_id and ratio of its page's most alike line of reference(page, ref_id, ref_text), the first of
    equals, if at least 40 % alike; else both null. A page's lines are the join's only fan-out, and Python sees pairs, never a page."""
    clean = found.withColumn("text_", F.coalesce("text", F.lit("")))
    lines = reference.select(*page, "ref_id", F.coalesce("ref_text", F.lit("")).alias("ref_text"))
    # Equal lines need no rating, and lengths alone rule out pairs that can't be alike enough.
    same = clean.join(lines.withColumnRenamed("ref_text", "text_"), [*page, "text_"]).groupBy(*page, "id").agg(F.min("ref_id").alias("same_"))
    rest = clean.join(same, [*page, "id"], "left_anti").select(*page, "id", F.col("text_").alias("text"))
    possible = 200 * F.least(F.length("text"), F.length("ref_text")) >= LEAST_RATIO * (F.length("text") + F.length("ref_text"))
    keys = [*page, "id"]
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    narrow = rest.repartition(tasks, *keys).join(lines, page).where(possible).select(*keys, "ref_id", "text", "ref_text")
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys) + 1
            made = [ratio(a, b) for a, b in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, pa.float64())], names=[*keys, "ref_id", "ratio"])

    rated = narrow.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in [*keys, "ref_id"]), "ratio double"])).where(F.col("ratio") >= LEAST_RATIO)
    best = rated.groupBy(*keys).agg(F.min_by(F.struct("ref_id", "ratio"), F.struct(-F.col("ratio"), F.col("ref_id"))).alias("best_"))
    made = found.join(best, keys, "left").join(same, keys, "left")
    return made.withColumn("ref_id", F.coalesce("same_", "best_.ref_id")).withColumn("ratio", F.when(F.col("same_").isNotNull(), 100.0).otherwise(F.col("best_.ratio"))).drop("best_", "same_")
