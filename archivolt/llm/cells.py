"""Pairs of texts that share enough tokens, cell by cell of two blocks of texts of like length.

Texts are written once, in blocks by their number of words; a task reads two
blocks from the shared folder and finds their pairs in memory. So neither tokens
nor pairs are shuffled: what is on disk is each text once, however many meet.
The bounds are those of ``neardup``; the order of rarity is a cell's own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds

#: Texts in a block.
BLOCK = 20_000
#: Meetings that are looked at together.
ROOM = 4_000_000
#: Texts of a cell that have a token before its frequency counts.
COMMON = 8


class Block:
    """Keys, words and, for a kind of token, the (token, text) entries of some texts in order."""

    def __init__(self, table: pa.Table):
        lists = table.column("words").combine_chunks()
        self.keys = table.column("key").to_numpy()
        self.values = lists.flatten().to_numpy()
        self.n = np.asarray(lists.value_lengths())
        self.start = np.cumsum(self.n) - self.n
        self._entries: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def words(self, i: int) -> np.ndarray:
        return self.values[self.start[i] : self.start[i] + self.n[i]]

    def entries(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        from archivolt.llm.neardup import _hashed

        if gram in self._entries:
            return self._entries[gram]
        text = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        if gram:
            size = max(0, len(self.values) - gram + 1)
            inside = text[:size] == text[len(text) - size :]
            token = _hashed([self.values[k : size + k] for k in range(gram)])[inside] if size else np.zeros(0, np.int64)
            text = text[:size][inside]
        else:
            order = np.lexsort((self.values, text))
            word, text = self.values[order], text[order]
            at = np.arange(len(word))
            new = np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])] if len(word) else np.zeros(0, bool)
            token = _hashed([word, at - np.maximum.accumulate(np.where(new, at, 0))]) if len(word) else np.zeros(0, np.int64)
        order = np.argsort(token, kind="stable")  # texts of a token stay in order
        token, text = token[order], text[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (text[1:] != text[:-1])] if len(token) else np.zeros(0, bool)
        self._entries[gram] = token[new], text[new]
        return self._entries[gram]


def _rare(token: np.ndarray, text: np.ndarray, df: np.ndarray, size: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether an entry is in its text's rare part: the first ``end`` of its tokens by frequency, and all that few texts have."""
    keep = np.ones(len(token), bool)
    often = np.flatnonzero(df >= COMMON)
    often = often[np.lexsort((token[often], df[often], text[often]))]
    own = text[often]
    many = np.bincount(own, minlength=len(size))
    rank = np.arange(len(often)) - (np.cumsum(many) - many)[own]
    keep[often] = size[own] - many[own] + rank < end[own]
    return keep & (end[text] > 0)


def meetings(left: Block, right: Block, gram: int, share: float, extra: float, only: tuple[np.ndarray, np.ndarray] | None = None, room: int = ROOM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of texts (left, right) that share enough rare tokens; with ``only``, of the marked texts alone. In one and the same block each pair once."""
    from archivolt.llm.neardup import needed

    same = left is right
    sides = []
    for block, marked in zip((left, right), only or (None, None)):
        token, text = block.entries(gram)
        if marked is not None:
            token, text = token[marked[text]], text[marked[text]]
        size = np.bincount(text, minlength=len(block.n))
        need = np.maximum(0, needed(block.n, size, share, gram)).astype(np.int64)
        some = np.maximum(1, np.floor(extra * need)).astype(np.int64)
        sides.append((token, text, size, need, need - some, np.where(need > 0, np.minimum(size, size - need + some), 0)))
    (ta, xa, size_a, need_a, beyond_a, end_a), (tb, xb, size_b, need_b, beyond_b, end_b) = sides
    both = ta if same and only is None else np.sort(np.r_[ta, tb])
    df = lambda t: np.searchsorted(both, t, "right") - np.searchsorted(both, t, "left")
    ka, kb = _rare(ta, xa, df(ta), size_a, end_a), _rare(tb, xb, df(tb), size_b, end_b)
    ta, xa, tb, xb = ta[ka], xa[ka], tb[kb], xb[kb]
    first = np.searchsorted(tb, ta, "left")
    c = np.searchsorted(tb, ta, "right") - first
    order = np.argsort(xa, kind="stable")
    order = order[c[order] > 0]
    xa, first, c = xa[order], first[order], c[order]
    ends = np.cumsum(c)
    lo = 0
    while lo < len(xa):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + room, "right"))
        hi = int(np.searchsorted(xa, xa[min(max(hi, lo), len(xa) - 1)], "left"))  # whole texts
        if hi <= lo:
            hi = int(np.searchsorted(xa, xa[lo], "right"))
        k, at = c[lo:hi], first[lo:hi]
        i = np.repeat(xa[lo:hi].astype(np.int64), k)
        j = xb[np.repeat(at - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
        lo = hi
        fits = np.minimum(left.n[i], right.n[j]) >= (share - 1e-9) * np.maximum(left.n[i], right.n[j])
        if same and only is None:
            fits &= i < j
        pair = np.sort((i * len(right.n) + j)[fits])
        if not len(pair):
            continue
        at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        n, pair = np.diff(np.r_[at, len(pair)]), pair[at]
        i, j = pair // len(right.n), pair % len(right.n)
        meet = np.maximum(1, np.maximum(need_a[i], need_b[j]) - np.minimum(beyond_a[i], beyond_b[j]))
        yield i[n >= meet], j[n >= meet]


def candidates(left: Block, right: Block, share: float, gram: int, extra: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of texts that may be versions: met on n-grams, and on words where n-grams tell nothing of one of them."""
    from archivolt.llm.neardup import needed

    yield from meetings(left, right, gram, share, extra)
    weak = [needed(b.n, np.bincount(b.entries(gram)[1], minlength=len(b.n)), share, gram) <= 0 for b in (left, right)]
    every = [np.ones(len(b.n), bool) for b in (left, right)]
    # the second time those that are weak on the left are left out, so no pair comes twice
    if weak[0].any():
        for i, j in meetings(left, right, 0, share, 0.0, (weak[0], every[1])):
            own = (i != j) & ((i < j) | ~weak[1][j]) if left is right else np.ones(len(i), bool)
            yield i[own], j[own]
    if left is not right and weak[1].any():
        yield from meetings(left, right, 0, share, 0.0, (~weak[0], weak[1]))


def read(path: str, block: int) -> Block | None:
    """A block, or None where its part of a length got no text."""
    if not os.path.isdir(path):
        raise FileNotFoundError(f"{path} has to be mounted on the executors")
    if not os.path.isdir(f"{path}/block={block}"):
        return None
    return Block(ds.dataset(f"{path}/block={block}", format="parquet").to_table(columns=["key", "words"]))


def blocks_of(counts: list[tuple[int, int]], block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(least words, most words, parts) of bands of lengths with about ``block`` texts; a length that more texts have is a band of parts."""
    bands: list[list[int]] = []
    for n, k in sorted(counts):
        if bands and bands[-1][2] + k <= block:
            bands[-1][1:] = [n, bands[-1][2] + k]
        else:
            bands.append([n, n, k])
    return [(lo, hi, -(-k // block)) for lo, hi, k in bands]


def cells_of(bands: list[tuple[int, int, int]], share: float) -> list[tuple[int, int]]:
    """Numbers of two blocks, the first the shorter one, that may hold texts of like length."""
    own = [(lo, hi) for lo, hi, parts in bands for _ in range(parts)]
    return [(i, j) for i in range(len(own)) for j in range(i, len(own)) if own[i][1] >= (share - 1e-9) * own[j][0]]
