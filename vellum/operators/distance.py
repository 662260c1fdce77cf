"""Edit distances of many pairs of texts at once, exact, in time of length times distance instead of length times length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Cells of the diagonals that are held at once: they stay in the processor's cache.
CELLS = 24_576
#: Longest pair, both texts counted, whose distances are kept in 16 bits.
SHORT = 16_000
#: Diagonals in a word of bits (the highest bit takes the carry), most words of a band that is computed by bits, words held at once, entries of a table of pairs by letters, and pairs that are few.
WORD, WORDS, ROOM, LETTERS, FEW = 63, 16, 1 << 21, 1 << 22, 300
#: Letters that are counted apart for a guess.
LETTER_CODES = 512
_U = np.uint64
_MASK = _U((1 << WORD) - 1)


def edit_distances(ones: list[str], others: list[str]) -> np.ndarray:
    """Levenshtein distances, by code points, of ones[i] and others[i].

    Of texts of n >= m characters, a path of edits that visits diagonal k costs at least |k| + |n - m - k|. So only diagonals from -s to n - m + s are
    computed (s at first by the letters' counts), of which every path beyond costs at least n - m + 2 (s + 1); a pair that turns out not to be cheaper is computed again with twice the s, at last with all diagonals.
    Bands of at most ``WORDS`` words are computed by bits, a column of many pairs at a time, others by cells.
    """
    out = np.zeros(len(ones), np.int64)
    todo = []
    for i, (x, y) in enumerate(zip(ones, others, strict=True)):
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        if not y:
            out[i] = len(x)
        elif x != y:
            todo.append((i, x, y, 0))
    todo = [(i, x, y, min(len(y), 8 + more)) for (i, x, y, _), more in zip(todo, _inserted(todo), strict=True)]
    while todo:
        again = []
        for part in _parts(todo):
            found, least_beyond = _by_bits(part) if _width(part[-1]) <= WORDS else _banded(part)
            for (i, x, y, spare), d, least in zip(part, found.tolist(), least_beyond.tolist(), strict=True):
                if d <= least or spare >= len(y):
                    out[i] = d
                else:
                    again.append((i, x, y, min(len(y), 2 * spare)))
        todo = again
    return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _inserted(pairs: list[tuple[int, str, str, int]]) -> list[int]:
    """How many letters the shorter text of each pair has more often than the longer: about as many steps lead away from the straight way. Only a guess of a band, which is proved or doubled."""
    out: list[int] = []
    for low in range(0, len(pairs), FEW):
        some = pairs[low : low + FEW]
        x, y = (_codes([p[j] for p in some]) % LETTER_CODES for j in (1, 2))
        n, m = (np.repeat(np.arange(len(some), dtype=np.uint32) * LETTER_CODES, [len(p[j]) for p in some]) for j in (1, 2))
        more = np.bincount(m + y, minlength=len(some) * LETTER_CODES) - np.bincount(n + x, minlength=len(some) * LETTER_CODES)
        out += np.maximum(more, 0).reshape(len(some), LETTER_CODES).sum(axis=1).tolist()
    return out


def _breadth(pair: tuple[int, str, str, int]) -> int:
    return len(pair[1]) - len(pair[2]) + 2 * pair[3]


def _width(pair: tuple[int, str, str, int]) -> int:
    """Words of a pair's band."""
    return _breadth(pair) // WORD + 1


def _parts(todo: list[tuple[int, str, str, int]]) -> Iterator[list[tuple[int, str, str, int]]]:
    """Pairs of like breadth and length together, few enough for the cache; those of bands computed by bits come first, and few of a width are put to the next width."""
    part: list[tuple[int, str, str, int]] = []
    most = letters = 0
    kind = lambda p: (len(p[2]) // 768, _width(p), p[3] // 16)
    for p in sorted((p for p in todo if _width(p) <= WORDS), key=lambda p: (kind(p), len(p[2]))):
        own, longest = min(len(p[1]), 64), max(most, len(p[2]))
        if part and ((letters + own) * (longest // WORD + WORDS) > ROOM or len(part) >= FEW and kind(p) > kind(part[-1])):
            yield part
            part, letters, longest = [], 0, len(p[2])
        part.append(p)
        letters, most = letters + own, longest
    if part:
        yield part
    part = []
    for p in sorted((p for p in todo if _width(p) > WORDS), key=lambda p: (_breadth(p).bit_length(), len(p[1]) + len(p[2]))):
        if part and ((len(part) + 1) * _breadth(p) > 2 * CELLS or _breadth(p).bit_length() > _breadth(part[0]).bit_length()):
            yield part
            part = []
        part.append(p)
    if part:
        yield part


def _letter_rows(page: np.ndarray, codes: np.ndarray, pages: int, other_page: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A number for each letter of each page, from 1; the same for other letters of the pages, 0 where the page doesn't have them; and how many numbers there are."""
    most = int(max(codes.max(), others.max())) + 1
    there = np.zeros(most, bool)
    there[codes] = True
    number = np.cumsum(there) * there  # letters that no page has are 0
    kinds = int(number.max()) + 1
    one, other = page * kinds + number[codes], other_page * kinds + number[others]
    if pages * kinds <= LETTERS:
        there = np.zeros(pages * kinds, bool)
        there[one] = True
        row = np.cumsum(there, dtype=np.int32) * there
        return row[one], row[other], int(row.max()) + 1
    found, row = np.unique(one, return_inverse=True)
    at = np.minimum(np.searchsorted(found, other), len(found) - 1)
    return row + 1, np.where(found[at] == other, at + 1, 0), len(found) + 1


def _by_bits(part: list[tuple[int, str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """As ``_banded``: the differences of neighbours in the band as bits (Myers; Hyyrö's band along the diagonal), a column of all pairs at a time.

    Bit p stands for diagonal n - m + p - last of each pair, so the diagonals that the distances end on are one bit of all. Cells beyond the band only
    take costs of real paths, so a distance is never too small, and it is exact if no path beyond the band is cheaper.
    """
    n, m = (np.array([len(p[j]) for p in part]) for j in (1, 2))
    spares = np.array([p[3] for p in part])
    straight, spare = int((n - m + spares).max()), int(spares.max())
    width = (straight + spare) // WORD + 1
    last = straight + (width * WORD - 1 - straight - spare) // 2
    spare = width * WORD - 1 - last
    first = last - (n - m)
    steps = int(m.max())
    texts = [_codes([p[j] for p in part]) for j in (1, 2)]
    pair = np.arange(len(part))
    long_pair, short_pair = np.repeat(pair, n), np.repeat(pair, m)
    long_row, short_row, rows = _letter_rows(long_pair, texts[0], len(part), short_pair, texts[1])
    # Where each letter of the longer text stands; row 0 is for letters that it doesn't have.
    depth = (steps - 1) // WORD + width + 1
    bit = np.arange(len(long_row)) - np.repeat(np.cumsum(n) - n - first, n)
    if int((first + n).max()) > depth * WORD:  # beyond what the band meets
        inside = bit < depth * WORD
        bit, long_row = bit[inside], long_row[inside]
    each = np.arange(depth * WORD)
    where = np.zeros((depth, rows), _U)
    np.add.at(where.reshape(-1), (each // WORD * rows)[bit] + long_row, (_U(1) << (each % WORD).astype(_U))[bit])
    letters = np.zeros((steps, len(part)), np.intp)
    letters[np.arange(len(short_row)) - np.repeat(np.cumsum(m) - m, m), short_pair] = short_row
    # At first costs grow along the longer text, and rows above it are level.
    low = np.clip(first - np.arange(width)[:, None] * WORD, 0, WORD)
    up = np.where(low < WORD, (_MASK >> low.astype(_U)) << low.astype(_U), _U(0))
    down = np.zeros_like(up)
    seen = np.empty((width + 1, len(part)), _U)
    diagonal, cross, x, y = (np.empty_like(up) for _ in range(4))
    # Numbers as arrays without dimensions: numpy is slower with scalars.
    carry, free, one, mask, top, beyond = np.empty(len(part), _U), np.zeros(len(part), _U), *(np.array(v, _U) for v in (1, _MASK, WORD - 1, WORD))
    # Pairs that have ended don't count on; the others come first when ordered by length.
    by_length = np.argsort(-m, kind="stable")
    if (by_length != pair).any():
        letters, up = np.ascontiguousarray(letters[:, by_length]), np.ascontiguousarray(up[:, by_length])
    live = np.searchsorted(-m[by_length], -np.arange(1, steps + 1), side="right").tolist()
    end, place = divmod(last, WORD)
    place, shifts = np.array(place, _U), [np.array(v, _U) for v in range(WORD + 1)]
    for j in range(steps):
        k, shift = divmod(j, WORD)
        np.take(where[k : k + width + 1], letters[j], axis=1, out=seen, mode="clip")
        np.right_shift(seen[:-1], shifts[shift], out=x)
        np.left_shift(seen[1:], shifts[WORD - shift], out=y)
        x |= y
        np.bitwise_and(x, up, out=diagonal)
        diagonal += up
        for w in range(1, width):
            np.right_shift(diagonal[w - 1], beyond, out=carry)
            diagonal[w] += carry
        diagonal ^= up
        diagonal |= x
        diagonal |= down
        diagonal &= mask
        np.right_shift(diagonal[end, : live[j]], place, out=carry[: live[j]])
        carry[: live[j]] &= one
        free[: live[j]] += carry[: live[j]]
        np.bitwise_or(diagonal, up, out=cross)
        np.invert(cross, out=cross)
        cross |= down
        np.right_shift(diagonal, one, out=x)
        if width > 1:
            np.left_shift(diagonal[1:], top, out=y[:-1])
            x[:-1] |= y[:-1]
        np.bitwise_and(diagonal, up, out=y)
        # Bits above a word's highest are those of the next word's lowest; they must not stay in sums.
        np.bitwise_and(x, cross, out=down)
        down &= mask
        x |= cross
        np.invert(x, out=x)
        x |= y
        np.bitwise_and(x, mask, out=up)
    out = np.empty(len(part), np.int64)
    out[by_length] = n[by_length] - free.astype(np.int64)
    return out, n - m + 2 * (np.minimum(spare, first) + 1)


def _banded(part: list[tuple[int, str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distances within the part's band of diagonals, and what a path beyond it costs at least.

    Antidiagonal t = i + j is computed from the two before it. Even and odd diagonals are in turn; row x of them is diagonal low + 2 x (+ 1), and a pair has a column.
    """
    n, m = (np.array([len(p[j]) for p in part]) for j in (1, 2))
    half = (max(p[3] for p in part) + 1) // 2
    width = half + (int((n - m).max()) + 2 * half) // 2 + 1
    low, high, last, most = -2 * half, 2 * (width - half) - 1, int((n + m).max()), int(m.max())
    kind = np.int16 if last <= SHORT else np.int32
    codes = np.frombuffer("".join(t for p in part for t in p[1:3]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if int(codes.max()) + 2 > np.iinfo(kind).max:
        codes = np.unique(codes, return_inverse=True)[1]
        kind = np.int16 if kind is np.int16 and int(codes.max()) + 2 <= np.iinfo(np.int16).max else np.int32
    codes = codes.astype(kind) + kind(2)  # 0 and 1 stand beside the texts and are equal to nothing
    before = max(0, last // 2 - most + half)
    a, b = np.zeros((half + (last + 1) // 2 + width, len(part)), kind), np.ones((before + most + width, len(part)), kind)
    at = 0
    for c, (x, y) in enumerate(zip(n.tolist(), m.tolist(), strict=True)):
        a[half : half + x, c] = codes[at : at + x]
        b[before + most - y : before + most, c] = codes[at + x : at + x + y][::-1]
        at += x + y
    far = 15_000 if kind is np.int16 else 1 << 30
    even, odd = np.full((width + 1, len(part)), far, kind), np.full((width + 1, len(part)), far, kind)
    even[half] = 0
    # The row after the last even diagonal and the one before the first odd one stay far.
    here, there = (even[:-1], odd[1:]), ((odd[:-1], odd[1:]), (even[:-1], even[1:]))
    cost, step = np.empty((width, len(part)), kind), np.empty((width, len(part)), kind)
    ends: dict[int, list[int]] = {}
    for c, t in enumerate((n + m).tolist()):
        ends.setdefault(t, []).append(c)
    out = np.zeros(len(part), np.int64)
    one = np.ones((width, len(part)), kind)  # with a scalar, numpy's minimum takes six times as long
    for t in range(1, last + 1):
        i, j, own = (t + 1) // 2 - 1, before + most - t // 2 - half, here[t & 1]
        np.bitwise_xor(a[i : i + width], b[j : j + width], out=cost)
        np.minimum(cost, one, out=cost)
        cost += own
        np.minimum(*there[t & 1], out=step)
        step += one
        np.minimum(cost, step, out=own)
        for c in ends.get(t, ()):
            out[c] = own[(n[c] - m[c] - low) // 2, c]
    return out, np.minimum(2 * (1 - low) + n - m, 2 * (high + 1) - (n - m))


@F.arrow_udf(LongType())
def edit_distance(one: pa.Array, other: pa.Array) -> pa.Array:
    """The distance of two text columns; null where one is null."""
    x, y = one.to_pylist(), other.to_pylist()
    none = np.array([a is None or b is None for a, b in zip(x, y, strict=True)], bool)
    return pa.array(edit_distances([a or "" for a in x], [b or "" for b in y]), pa.int64(), mask=none)
