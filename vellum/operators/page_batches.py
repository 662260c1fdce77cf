"""Lines, columns and segments of many pages at once, as arrays over all their words. Rules are those of ``layout``, whose queries hold against SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fields of a segment that stand beside its page's keys.
SEGMENT = "col int, band int, x0 double, top double, x1 double, bottom double, text string, order_pos int"


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before in any key."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _in_order(keys: tuple[np.ndarray, ...], rest: tuple[np.ndarray, ...], texts: pa.Array) -> np.ndarray:
    """Places of rows in order of keys, the most significant first; equal ones by text and then by rest, as sorted structs are."""
    order = np.lexsort(keys[::-1])
    begin = _starts(*(k[order] for k in keys))
    end = np.append(begin[1:], len(order))
    for low, high in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
        tied = order[low:high].tolist()
        names = texts.take(pa.array(tied)).to_pylist()
        order[low:high] = [i for _, _, i in sorted(((n is not None, n or ""), tuple(r[i] for r in rest), i) for n, i in zip(names, tied, strict=True))]
    return order


def _bands(first: np.ndarray, count: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """The line of each word: a fold over the words of a page in order, one word of every page at a time."""
    band = np.zeros(len(top), np.int32)
    by_count = np.argsort(-count, kind="stable")
    first, left = first[by_count], -count[by_count]
    total, n, high, at = np.zeros(len(first)), np.zeros(len(first)), np.zeros(len(first)), np.full(len(first), -1, np.int32)
    for r in range(-int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(left, -r, side="left"))
        i = first[:live] + r
        t, h = top[i], bottom[i] - top[i]
        highest = np.maximum(high[:live], h)
        same = (n[:live] > 0) & (np.abs(t - total[:live] / np.maximum(n[:live], 1)) <= np.maximum(1.0, 0.6 * highest))
        total[:live] = np.where(same, total[:live] + t, t)
        n[:live] = np.where(same, n[:live] + 1, 1)
        high[:live] = np.where(same, highest, h)
        at[:live] += ~same
        band[i] = at[:live]
    return band


def _ranks(*values: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Values as their ranks among all of them, and the number of ranks."""
    distinct, at = np.unique(np.concatenate(values), return_inverse=True)
    return np.split(at.astype(np.int64), np.cumsum([len(v) for v in values])[:-1]), max(1, len(distinct))


def _below(page: np.ndarray, values: np.ndarray, of_page: np.ndarray, limits: np.ndarray, side: str) -> np.ndarray:
    """For each limit: how many of its page's values are below it (side left), or at most it (right)."""
    (v, x), n = _ranks(values, limits)
    keys = np.sort(page * n + v)
    return np.searchsorted(keys, of_page * n + x, side=side) - np.searchsorted(keys, of_page * n, side="left")


def _splits(page: np.ndarray, band: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Page and place of each split between columns; words in order of page and band."""
    order = np.lexsort((x1, x0, page))
    p, a, b = page[order], x0[order], x1[order]
    (rank,), n = _ranks(b)
    reach = b[np.argsort(rank, kind="stable")][np.searchsorted(np.sort(rank), np.maximum.accumulate(p * n + rank) - p * n)]
    apart = np.flatnonzero((p[1:] == p[:-1]) & (a[1:] > reach[:-1]) & (a[1:] - reach[:-1] >= 0.02 * width))
    of_page, left, right = p[apart], reach[apart], a[apart + 1]
    if not len(apart):
        return of_page, left
    lines = _starts(page, band)
    line_page = page[lines]
    total = np.bincount(line_page, minlength=int(page[-1]) + 1)[of_page]
    need = np.maximum(3.0, 0.15 * total)
    begun = _below(line_page, np.minimum.reduceat(x0, lines), of_page, left, "left")
    ended = total - _below(line_page, np.maximum.reduceat(x0, lines), of_page, right, "left")
    good = (begun >= need) & (ended >= need)
    return of_page[good], (left[good] + right[good]) / 2


def segments_of(words: pa.ListArray, width: float) -> tuple[np.ndarray, list[pa.Array]]:
    """Of pages as lists of words: the page of each segment, and the columns of ``SEGMENT``."""
    flat, counts = words.flatten(), pc.fill_null(words.value_lengths(), 0).to_numpy().astype(np.int64)
    page = np.repeat(np.arange(len(counts)), counts)
    top, bottom, x0, x1 = (flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in ("top", "bottom", "x0", "x1"))
    vline, k = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("vline", "k"))
    texts = flat.field("text")
    order = _in_order((page, top, vline, k), (x0, x1, bottom), texts)
    top, bottom, x0, x1, vline, k, texts = *(c[order] for c in (top, bottom, x0, x1, vline, k)), texts.take(pa.array(order))
    band = _bands(np.cumsum(counts) - counts, counts, top, bottom)
    split_page, split = _splits(page, band, x0, x1, width)
    centre = (x0 + x1) / 2
    # A page's columns are one more than its splits; words beside all of them are in the last.
    col = np.where((centre < 0) | (centre >= width), np.bincount(split_page, minlength=len(counts))[page], _below(split_page, split, page, centre, "right")).astype(np.int32)
    order = _in_order((page, col, band, x0, vline, k), (top, x1, bottom), texts)
    page, col, band = page[order], col[order], band[order]
    at = _starts(page, col, band)
    texts = texts.take(pa.array(order))
    there = texts.is_valid().to_numpy(zero_copy_only=False)
    ends = np.append(at, len(order))
    offsets = np.concatenate([[0], np.cumsum(there)])[ends]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts.drop_null()), " ")
    if not len(at):
        return page, [pa.array([], t) for t in (pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.int32())]
    page, col, band = page[at], col[at], band[at]
    box = [f.reduceat(v[order], at) for f, v in ((np.minimum, x0), (np.minimum, top), (np.maximum, x1), (np.maximum, bottom))]
    order = np.lexsort((band, box[1], col, page))
    first = _starts(page[order])
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return page, [pa.array(col), pa.array(band), *map(pa.array, box), joined, pa.array(place)]
