"""Best-fit packing of token pieces into sequences by a configuration linear program over the length histogram.

Only the histogram (at most ``capacity`` numbers) reaches the driver. There, multiplicative weights solve the covering
program "use configurations, each a multiset of lengths of at most ``capacity`` tokens, so that every length's pieces are
placed, with as few configurations as possible". Lengths have weights, the program's dual prices; a knapsack dynamic program finds the
configuration of the greatest price, it is used for a step, and the weights of its lengths fall by what share of their demand it
covers. Demand over the greatest price is a lower bound of the program at any time. Turns begin from the lengths' shares of a
sequence. In the first, a step ends with a length's whole demand; there are at most as many as lengths. Later turns take smaller
steps, until the number of sequences is within ``GAP`` of the bound or all of ``STEP_SIZES`` are done; ``solve`` reports the bound. The fractional solution is
rounded down, never above the demand; the rest goes by best fit, decreasing, on counts. The best of the turns' plans is used, and
never more sequences than best fit alone makes. The plan says for each
length which ranks go to which configurations, so every piece finds its place by its rank among the pieces of its length:
no sequence is built on the driver, and no length's pieces meet in one task.

Edge cases: null text is empty; an empty document is one piece with the end id alone; repeated rows are packed each for
itself; no documents give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import arrow_schema, materialize, small_batches
from vellum.llm.tokens import encoder, vocabulary_path

CAPACITY = 2048
#: Largest share of a length's demand that a step covers, turn by turn; how near the bound a plan must come for an early end.
STEP_SIZES, GAP = (1.0, 0.3, 0.1, 0.05), 0.001
#: Knapsack tables and steps of a later turn at most; a turn that needs more ends there with what it has, and the bound tells how good that is.
TABLES, STEPS = 200, 6_000
#: Vector operations of a knapsack over single lengths above which it is computed over capacities.
FEW_OPERATIONS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"


def token_pieces(docs: DataFrame, *, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of at most capacity ids per document; the first may be shorter. pid, nth: the task, and the rank among its pieces of that length."""
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()
    schema = arrow_schema(docs.sparkSession, PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        pid, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode_batch
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                data = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                n, at, piece = len(data) // 4, 0, 0
                length = n % capacity or min(n, capacity)
                while at < n:
                    rows.append((doc, piece, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), pid, seen[length]))
                    seen[length] += 1
                    at, piece, length = at + length, piece + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, PIECES)


class Knapsack:
    """The greatest price of a multiset of lengths for every capacity, by dynamic programming; prices has 0 for lengths that don't count."""

    def __init__(self, prices: np.ndarray) -> None:
        self.prices, top = prices, len(prices) - 1
        lengths = np.flatnonzero(prices)
        times = [1 << j for n in lengths.tolist() for j in range((top // n).bit_length())]
        of = [n for n in lengths.tolist() for _ in range((top // n).bit_length())]
        self.taken: list[tuple[int, int, np.ndarray]] = []
        if len(of) <= FEW_OPERATIONS:
            # 1, 2, 4 ... of a length at a time.
            self.best = np.zeros(top + 1)
            for n, k in zip(of, times, strict=True):
                if n * k <= top:
                    got = self.best[: top + 1 - n * k] + k * prices[n]
                    better = got > self.best[n * k :] + 1e-15
                    self.best[n * k :] = np.where(better, got, self.best[n * k :])
                    self.taken.append((n, k, better))
            return
        # A multiset of several lengths is two smaller ones, of which one has at most half of the capacity.
        self.best, self.split = prices.copy(), np.zeros(top + 1, np.int32)
        for c in range(2, top + 1):
            half = c // 2
            got = self.best[1 : half + 1] + self.best[c - 1 : c - half - 1 : -1]
            i = int(got.argmax())
            if got[i] > self.best[c] + 1e-15:
                self.best[c], self.split[c] = got[i], i + 1

    def configuration(self, capacity: int) -> Counter[int]:
        """A multiset of the greatest price."""
        out: Counter[int] = Counter()
        if self.taken:
            for n, k, better in reversed(self.taken):
                if capacity >= n * k and better[capacity - n * k]:
                    out[n] += k
                    capacity -= n * k
            return out
        open_ = [capacity]
        while open_:
            c = open_.pop()
            if self.split[c]:
                open_ += [int(self.split[c]), c - int(self.split[c])]
            elif self.prices[c] > 0:
                out[c] += 1
        return out


class Program:
    """min sum x over configurations that cover the demand, by multiplicative weights. ``bound``: no solution has fewer, rounded or not."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity, self.lengths = capacity, np.array(sorted(histogram))
        self.demand = np.array([histogram[n] for n in self.lengths.tolist()], float)
        self.index = {n: i for i, n in enumerate(self.lengths.tolist())}
        # Configurations that a step used; of each, the indexes of its lengths and how many pieces it has of them.
        self.keys: dict[tuple[tuple[int, int], ...], int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.bound = 0.0

    def knapsack(self, weights: np.ndarray) -> Knapsack:
        prices = np.zeros(self.capacity + 1)
        prices[self.lengths] = weights
        return Knapsack(prices)

    def row(self, configuration: Counter[int]) -> int:
        key = tuple(sorted(configuration.items()))
        if key not in self.keys:
            self.keys[key] = len(self.keys)
            self.parts.append((np.array([self.index[n] for n, _ in key]), np.array([k for _, k in key], float)))
        return self.keys[key]

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The configurations' parts joined, and where each configuration's begin."""
        sizes = np.array([len(at) for at, _ in self.parts])
        return np.concatenate([at for at, _ in self.parts]), np.concatenate([k for _, k in self.parts]), np.cumsum(sizes) - sizes

    def whole_lengths(self) -> np.ndarray:
        """The first turn: each step covers what is left of some length. Of one table comes the best configuration with any given length."""
        weights, left = self.lengths / self.capacity, self.demand.copy()
        amounts: dict[int, float] = {}
        while (left > 0).any():
            prices = np.where(left > 0, weights, 0.0)
            table = self.knapsack(prices)
            top = table.best[self.capacity]
            if not amounts:
                self.bound = max(self.bound, float(prices @ self.demand) / top)
            worth = np.where(left > 0, prices + table.best[self.capacity - self.lengths], 0.0)
            order = np.argsort(-worth, kind="stable")
            for i in order[worth[order] >= top * (1 - 1e-6)].tolist():
                if left[i] <= 0:
                    continue
                found = table.configuration(self.capacity - int(self.lengths[i]))
                found[int(self.lengths[i])] += 1
                if any(left[self.index[n]] <= 0 for n in found):
                    continue
                j = self.row(found)
                at, pieces = self.parts[j]
                step = float((left[at] / pieces).min())
                amounts[j] = amounts.get(j, 0.0) + step
                left[at] -= step * pieces
                left[left < 1e-9] = 0.0
                weights[at] *= np.exp(-step * pieces / self.demand[at])
        return np.array([amounts.get(j, 0.0) for j in range(len(self.keys))])

    def small_steps(self, size: float) -> np.ndarray:
        """A later turn: until all demand is covered several times, of which the first third is left out; scaled to cover it once."""
        weights, covered = self.lengths / self.capacity, np.zeros(len(self.lengths))
        goal = 3 * math.log(len(self.lengths) + 1) + 3
        amounts, top, early, tables, steps = np.zeros(len(self.keys)), math.inf, None, 0, 0
        ats, pieces, starts = self.flat()
        while covered.min() < goal and steps < STEPS:
            steps += 1
            worth = np.add.reduceat(weights[ats] * pieces, starts)
            j = int(worth.argmax())
            if worth[j] < (1 - size / 4) * top:  # weights only fall, so top is no less than the greatest price
                if tables == TABLES:
                    break
                tables += 1
                table = self.knapsack(weights)
                top = table.best[self.capacity]
                self.bound = max(self.bound, float(weights @ self.demand) / top)
                j = self.row(table.configuration(self.capacity))
                if j == len(amounts):
                    amounts, (ats, pieces, starts) = np.append(amounts, 0.0), self.flat()
            at, each = self.parts[j]
            step = size * float((self.demand[at] / each).min())
            amounts[j] += step
            share = step * each / self.demand[at]
            covered[at] += share
            weights[at] *= np.exp(-share)
            if early is None and covered.min() >= goal / 3:
                early = amounts.copy(), covered.copy()
        if early is not None:
            amounts, covered = amounts - np.pad(early[0], (0, len(amounts) - len(early[0]))), covered - early[1]
        return amounts / max(float(covered.min()), 1.0)

    def rounded(self, amounts: np.ndarray) -> list[tuple[dict[int, int], int]]:
        """Whole numbers of configurations that place the demand exactly: the amounts rounded down, the rest by best fit."""
        left = {n: int(d) for n, d in zip(self.lengths.tolist(), self.demand.tolist(), strict=True)}
        plan = []
        keys = list(self.keys)
        for j in np.argsort(-amounts, kind="stable").tolist():
            times = min(int(amounts[j] + 1e-9), min(left[n] // k for n, k in keys[j]))
            if times > 0:
                plan.append((dict(keys[j]), times))
                for n, k in keys[j]:
                    left[n] -= times * k
        return plan + best_fit({n: k for n, k in left.items() if k}, self.capacity)


def sequences(plan: list[tuple[dict[int, int], int]]) -> int:
    return sum(k for _, k in plan)


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Configurations and how often each is used, which together place exactly the histogram's pieces; and a lower bound of their number."""
    left = {n: k for n, k in histogram.items() if k}
    full = left.pop(capacity, 0)
    plan = [({capacity: 1}, full)] if full else []
    if not left:
        return plan, float(full)
    program, best = Program(left, capacity), None
    for size in STEP_SIZES:
        made = program.rounded(program.whole_lengths() if size == 1 else program.small_steps(size))
        best = made if best is None or sequences(made) < sequences(best) else best
        if sequences(best) <= math.ceil(program.bound * (1 + GAP)):
            break
    plain = best_fit(left, capacity)
    return plan + (plain if sequences(plain) < sequences(best) else best), full + program.bound


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, decreasing, on counts: bins that hold the same are kept together."""
    bins: dict[int, list[list]] = {}  # room -> [what a bin holds, how many bins]
    done: list[tuple[dict[int, int], int]] = []
    for n in sorted(left, reverse=True):
        k = left[n]
        while k:
            room = min((r for r in bins if r >= n), default=None)
            if room is None:
                each = min(capacity // n, k)
                held, count = {n: each}, k // each
                room, used = capacity - each * n, each * count
            else:
                what, have = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                each = min(room // n, k)
                count = min(have, k // each)
                if have > count:
                    bins.setdefault(room, []).append([what, have - count])
                held, used = {**what, n: each}, each * count
                room -= each * n
            k -= used
            bins.setdefault(room, []).append([held, count])
    for some in bins.values():
        done += [(held, count) for held, count in some]
    return done


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, pieces in a sequence, first sequence, offset) in order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for held, count in plan:
        offset = 0
        for n, k in sorted(held.items(), reverse=True):
            out.setdefault(n, []).append((ranks[n], k, sequence, offset))
            ranks[n] += k * count
            offset += n * k
        sequence += count
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (length, pid, nth, and any other columns).

    A task's ranks of a length begin where those of the tasks before it end. That is a number for each task and length, so no task or
    driver holds them all: pieces meet their task's numbers in a join that Spark broadcasts only under its size threshold.
    """
    counts = materialize(pieces.groupBy("pid", "length").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    where = places(solve(histogram, capacity)[0])
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("pid", "length", "base")
    ranked = pieces.join(bases, ["pid", "length"]).withColumn("nth", F.col("nth") + F.col("base")).drop("base", "pid")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "nth")
    names = [f.name for f in ranked.schema if f.name != "nth"]
    schema = arrow_schema(pieces.sparkSession, f"{fields}, sequence_id long, offset long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                rows = where[n]
                r = rows[np.searchsorted(rows[:, 0], nth[at], side="right") - 1]
                inside = nth[at] - r[:, 0]
                sequence[at], offset[at] = r[:, 2] + inside // r[:, 1], r[:, 3] + inside % r[:, 1] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
