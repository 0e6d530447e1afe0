"""Pairs of names with like trigrams, cell by cell of two blocks of names.

A pair with similarity ``least`` has a number of common trigrams that follows
from its two sizes. Names of a cell are put in classes of one size, their
trigrams in order of frequency, the rare first; the names of two classes meet in
as much of their rare ends as such a pair needs to have ``MEET`` trigrams in
common there, and only those that do are compared whole. Which block a name is
in follows from its hash, so a pair is met in one cell, no pair is shuffled and
a cell takes the same room however many names there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Common trigrams asked for in the rare ends, where a pair needs as many.
MEET = 3
#: Meetings that are looked at together.
ROOM = 4_000_000
Classes = dict[int, tuple[np.ndarray, np.ndarray]]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and trigram, repeats included, of texts of words with single blanks between them: as in ``functions.text.trigrams``."""
    text = "  " + "\0  ".join(w.replace(" ", "   ") + " " for w in words) + "\0"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.cumsum(c == 0)
    a, b, d = c[:-2], c[1:-1], c[2:]
    # what reaches over two texts or from one word to the next is no trigram
    own = (a != 0) & (b != 0) & (d != 0) & ~((b == 32) & (d == 32))
    return row[:-2][own], (a << 42 | b << 21 | d)[own]


def _distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order."""
    own = np.sort(values)
    return own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own


def classes(x: list[str], y: list[str]) -> tuple[Classes, Classes, int]:
    """For both sides by number of trigrams: the places of the texts and their trigrams, the rare first; and how many different ones there are."""
    (rx, gx), (ry, gy) = codes(x), codes(y)
    different = _distinct(np.r_[gx, gy])
    many = max(1, len(different))
    key = _distinct(np.r_[rx, ry + len(x)] * many + np.searchsorted(different, np.r_[gx, gy]))
    row, token = key // many, key % many
    rank = np.empty(many, np.int64)
    rank[np.argsort(np.bincount(token, minlength=many), kind="stable")] = np.arange(many)
    token = (np.sort(row * many + rank[token]) - row * many).astype(np.int32)
    n = np.bincount(row, minlength=len(x) + len(y))
    start = np.cumsum(n) - n

    def by(lo: int, hi: int) -> Classes:
        got = {}
        for size in np.unique(n[lo:hi]):
            if size:
                own = np.flatnonzero(n[lo:hi] == size)
                got[int(size)] = own, token[start[lo:hi][own][:, None] + np.arange(size)]
        return got

    return by(0, len(x)), by(len(x), len(x) + len(y)), many


def needed(na: int, nb: int, least: float) -> int:
    """Common trigrams of two texts of ``na`` and ``nb`` with a similarity that is ``least`` when rounded to six places."""
    least -= 1e-6
    return max(1, int(np.ceil((na + nb) * least / (1 + least) - 1e-9)))


def like(x: list[str], y: list[str], least: float, meet: int = MEET, room: int = ROOM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Places in x and y, common trigrams and the sum of both sizes of all pairs that have as many in common as they need."""
    left, right, many = classes(x, y)
    for na, (ia, ta) in left.items():
        for nb, (ib, tb) in right.items():
            need = needed(na, nb, least)
            if need > min(na, nb):
                continue
            times = min(meet, need)
            pa_, pb_ = na - need + times, nb - need + times
            tokens, others = ta[:, :pa_].ravel(), tb[:, :pb_].ravel()
            order = np.argsort(others, kind="stable") // pb_
            count = np.bincount(others, minlength=many)
            first = np.cumsum(count) - count
            c = count[tokens]
            ends = np.cumsum(c.reshape(-1, pa_).sum(axis=1))
            lo = 0
            while lo < len(ia):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + room, "right")))
                own, k = tokens[lo * pa_ : hi * pa_], c[lo * pa_ : hi * pa_]
                at = np.repeat(first[own] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                pair = np.sort(np.repeat(np.arange(len(own)) // pa_ * len(ib), k) + order[at])
                lo, base = hi, lo
                if len(pair) < times:
                    continue
                hit = pair[times - 1 :][pair[times - 1 :] == pair[: len(pair) - times + 1]]
                if not len(hit):
                    continue
                hit = hit[np.r_[True, hit[1:] != hit[:-1]]]  # sorted, so equal ones are neighbours
                for part in np.array_split(hit, 1 + len(hit) * (na + nb) // (4 * room)):
                    i, j = part // len(ib) + base, part % len(ib)
                    both = np.concatenate([ta[i], tb[j]], axis=1)
                    both.sort(axis=1)
                    common = (both[:, 1:] == both[:, :-1]).sum(axis=1)
                    found = common >= need
                    if found.any():
                        yield ia[i[found]], ib[j[found]], common[found], na + nb


def similarity(common: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """Common trigrams through all of both texts, in millionths, rounded as ``round(x, 6)`` does it."""
    common = common.astype(np.int64)
    return (2_000_000 * common + (total - common)) // (2 * (total - common))


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first place of every place's group, when the groups of each a and b are made one."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def _gathered(parts: Iterator[tuple], room: int = ROOM // 4) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts of pairs (i, j, common, total) put together until they hold ``room`` pairs."""
    own, n = [], 0
    for i, j, common, total in parts:
        own.append((i, j, common, np.full(len(i), total)))
        n += len(i)
        if n >= room:
            yield tuple(map(np.concatenate, zip(*own)))
            own, n = [], 0
    if own:
        yield tuple(map(np.concatenate, zip(*own)))


def _first(parts: Iterator[tuple], order: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The ``top`` most similar pairs of every i, at a tie those whose j comes first in the order."""
    kept = None
    for part in parts:
        i, j, common, total = part if kept is None else map(np.concatenate, zip(kept, part))
        by = np.lexsort((order[j], -similarity(common, total), i))
        group = i[by]
        new = np.r_[True, group[1:] != group[:-1]]
        at = np.arange(len(by))
        by = by[at - np.maximum.accumulate(np.where(new, at, 0)) < top]
        kept = i[by], j[by], common[by], total[by]
    if kept is not None:
        yield kept


def _cell(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.Array], list[list[str]], list[np.ndarray]]:
    """Of both sides of a cell (side 2 is on both): the texts, their words, and numbers that are the same for the same text."""
    cell = pa.Table.from_batches(batches).select(["side", "text", "words"])
    sides = [cell.filter(pc.not_equal(cell.column("side"), other)) for other in (1, 0)]
    texts = [t.column("text").combine_chunks() for t in sides]
    number = pa.concat_arrays(texts).dictionary_encode().indices.to_numpy()
    return texts, [pc.coalesce(t.column("words"), t.column("text")).to_pylist() for t in sides], [number[: len(texts[0])], number[len(texts[0]) :]]


def met(least: float, top: int | None = None):
    """A function of the rows (side, text, words) of a cell that gives a, b, common, total of its pairs of different texts; with ``top`` only the first of each a, the most similar first, then by b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), words, (own, other) = _cell(batches)
        if not len(a) or not len(b):
            return
        parts = like(*words, least)
        differ = ((i[d], j[d], common[d], total) for i, j, common, total in parts for d in [own[i] != other[j]])
        if top is None:
            pairs = _gathered(differ, ROOM // 16)
        else:
            order = np.empty(len(b), np.int64)
            order[pc.sort_indices(b).to_numpy()] = np.arange(len(b))
            pairs = _first(_gathered(differ), order, top)
        for i, j, common, total in pairs:
            for lo in range(0, len(i), ROOM // 16):
                at = slice(lo, lo + ROOM // 16)
                yield pa.RecordBatch.from_arrays([a.take(pa.array(i[at])), b.take(pa.array(j[at])), pa.array(common[at], pa.int32()), pa.array(total[at], pa.int32())], names=["a", "b", "common", "total"])

    return run


def links(least: float):
    """A function of the rows of a cell that gives a, b: fewer pairs than texts, which link what the cell's pairs link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, words, (own, other) = _cell(batches)
        if not len(own) or not len(other):
            return
        root = np.arange(max(own.max(), other.max()) + 1)
        for i, j, common, total in _gathered(like(*words, least)):
            near = similarity(common, total) / 1e6 >= least
            root = united(root, own[i[near]], other[j[near]])
        text = pa.concat_arrays(texts).dictionary_encode().dictionary
        linked = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([text.take(pa.array(linked)), text.take(pa.array(root[linked]))], names=["a", "b"])

    return run
