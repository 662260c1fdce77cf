"""Document fingerprints by winnowing: rolling hashes of character k-grams, the rightmost minimum of every window, and its place.

Any two texts that share ``k + window - 1`` characters in a row share a fingerprint hash; nothing shorter than k is ever matched.

Edge cases: null texts are empty; an empty text has no hashes, and two empty texts are alike (1), an empty and another
not at all (0); a text shorter than k is one gram; a text with fewer grams than a window is one window; repeated rows give equal
fingerprints.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import arrow_schema, range_cuts, small_batches

#: Characters of a gram (a power of two) and grams of a window (a power of two): every shared passage of 31 characters is found.
GRAM, WINDOW = 16, 16
#: Documents of a range of the neighbour query, and ranges that a task gets, on average.
RANGE_DOCS, TASK_RANGES = 1000, 4

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnow(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the selected grams in order of place."""
    n = len(points)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = _mix(points.astype(_U) + _U(1))
    if n < gram:
        power = np.cumprod(np.full(n, _BASE))
        return _mix(np.array([(h * power).sum()])), np.zeros(1, np.int64)
    width, power = 1, np.array([_BASE])
    while width < gram:  # the hash of 2 w characters from those of w, each times the base's power
        h = h[:-width] * power + h[width:]
        width, power = 2 * width, power * power
    h = _mix(h)
    best, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < window and len(best) > 1:
        step = min(width, len(best) - 1)
        left, right = best[:-step], best[step:]
        take = right <= left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        width *= 2
    while len(h) < window and len(best) > 1:  # fewer grams than a window
        take = best[1:] <= best[:-1]
        best, at = np.where(take, best[1:], best[:-1]), np.where(take, at[1:], at[:-1])
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    return best[new], at[new].astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def digest(selected: tuple[np.ndarray, np.ndarray]) -> str:
    """32 hexadecimal digits of the selected hashes and their places."""
    return hashlib.sha256(selected[0].astype("<u8").tobytes() + selected[1].astype("<u8").tobytes()).hexdigest()[:32]


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """A row per document: doc_id, n_chars, hashes and places of its selected grams, digest."""
    small_batches(docs.sparkSession)
    ddl = "doc_id long, n_chars long, hashes array<long>, places array<int>, digest string"
    schema = arrow_schema(docs.sparkSession, ddl)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                points = code_points(t or "")
                got = winnow(points, gram, window)
                rows.append((len(points), got[0].astype(np.int64).tolist(), got[1].tolist(), digest(got)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(make, ddl)


def compare_with_next(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document, against its half-replaced text and the next document in descending key order (after the last: the first).

    Keys are cut into ranges in proportion to the rows (a number for each thousand documents reaches the driver); each range's
    rows stream in order through a task, with the first row of the next range behind them, so a neighbour is always at hand and two texts
    are held at a time. Null keys come last; equal keys are in descending order of their texts' hashes, which cut ranges, too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    keys = rows.select("k", "h")
    ranges = -(-rows.count() // RANGE_DOCS)
    cuts = range_cuts(keys, ranges)

    @F.arrow_udf("int")
    def range_of(k: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([bisect_right(cuts, x) for x in zip(k.to_pylist(), h.to_pylist(), strict=True)], pa.int32())

    # The first of each range in the order of the query stands behind the range before it, and that of the highest behind the lowest.
    first = {r.range: (r.top.k, r.top.h) for r in keys.withColumn("range", range_of("k", "h")).groupBy("range").agg(F.max(F.struct("k", "h")).alias("top")).collect()}  # a row a range
    order = sorted(first)
    heads = {}
    for i, r in enumerate(order):
        heads.setdefault(first[r], []).append(order[(i + 1) % len(order)])

    @F.arrow_udf("array<int>")
    def places_of(k: pa.Array, h: pa.Array) -> pa.Array:
        """The row's range, and behind it the ranges that it stands behind."""
        return pa.array([[bisect_right(cuts, x), *heads.get(x, ())] for x in zip(k.to_pylist(), h.to_pylist(), strict=True)], pa.list_(pa.int32()))

    both = rows.select("doc_id", "text", "k", "h", F.posexplode(places_of("k", "h")).alias("at", "range")).withColumn("ghost", F.col("at") > 0)
    dealt = both.repartition(max(1, -(-ranges // TASK_RANGES)), "range").sortWithinPartitions("range", "ghost", F.col("k").desc(), F.col("h").desc())
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = arrow_schema(spark, ddl)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out = []
            for doc, body, place, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ghost and (held is None or held[4]):
                    continue
                points = code_points(body)
                got = winnow(points)
                now = (doc, points, got, np.unique(got[0]), ghost, place)
                if held is not None and held[5] == place:
                    out.append(against(held, now))
                held = now
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return dealt.select("doc_id", "text", "range", "ghost").mapInArrow(compare, ddl)


def against(one: tuple, other: tuple) -> tuple:
    points, half = one[1], len(one[1]) // 2
    edited = np.concatenate([points[: len(points) - half], other[1][:half]])
    got = winnow(edited)
    sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return one[0], len(points), sha, digest(one[2]), digest(got), likeness(one[3], np.unique(got[0])), likeness(one[3], other[3])
