"""Splitting of oversized texts at natural boundaries.

Separators form a hierarchy: section, paragraph, sentence, word, character. A
text beyond the limit is cut at the strongest separator, runs of parts that
fit together are packed greedily, and only a part that is too long by itself
is cut at the next weaker separator.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4000
OVERLAP = 200

#: A part ends where the match ends; strongest separator first.
LEVELS = (
    regex.compile(r"\f|\n[^\S\n]*\n[^\S\n]*\n+|\n(?=[^\S\n]*(?:[-=*_~]{5,}|DELETED PAGE)[^\n]*\n)"),
    regex.compile(r"\n[^\S\n]*\n+"),
    regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+|\n(?=[^\S\n]*[\p{Lu}\d][^\n]{0,40}[.:]\s)"),
    regex.compile(r"\s+"),
)


def _cuts(text: str, start: int, end: int, level: int) -> list[int]:
    return [*(m.end() for m in LEVELS[level].finditer(text, start, end) if start < m.end() < end), end]


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP, bounds: Iterable[int] = ()) -> list[int]:
    """Ends of the pieces' new content. ``bounds`` are given cuts above all separators, such as ends of pages."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    ends: list[int] = []
    at = 0  # end of the last piece

    def room() -> int:
        return limit if not ends else limit - overlap

    def walk(start: int, end: int, level: int) -> None:
        """Take start to end; what is open lies between at and start."""
        nonlocal at
        if end - at <= room():
            return
        if level > len(LEVELS):  # characters
            while end - at > room():
                ends.append(at + room())
                at = ends[-1]
            return
        cuts = [*sorted(b for b in set(bounds) if start < b < end), end] if level == 0 else _cuts(text, start, end, level - 1)
        for to in cuts:
            if to - at > room():
                if start > at:
                    ends.append(start)
                    at = start
                if to - at > room():
                    walk(start, to, level + 1)
            start = to

    walk(0, len(text), 0)
    if at < len(text) or not ends:
        ends.append(len(text))
    return ends


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, bounds: Iterable[int] = ()) -> list[tuple[int, int, int]]:
    """(start, start of the new content, end) of each piece; an empty text is one empty piece."""
    got, at = [], 0
    for end in cut_points(text, limit, overlap, bounds):
        got.append((max(0, at - overlap), at, end))
        at = end
    return got


def pieces(items: DataFrame, keys: list[str], text: str, bounds: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every item whose text is longer than ``limit`` code points.

    Returns keys, piece_no (from 0), start_at, new_from, end_at and piece.
    Items that fit, null and empty texts have no rows; the whole text counts,
    however long. Each piece has at most ``limit`` code points and repeats the
    last ``overlap`` of the one before; the parts from new_from on make up the
    text exactly. Repeated items give repeated pieces. Other columns drop out.
    """
    over = items.where(F.length(F.col(text)) > limit).select(*keys, F.col(text).alias("__text"), (F.col(bounds) if bounds else F.array().cast("array<int>")).alias("__bounds"))
    kinds = {f.name: f.dataType.simpleString() for f in over.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                body = row[-2]
                for n, (a, b, c) in enumerate(split(body, limit, overlap, row[-1])):
                    rows.append((*row[:-2], n, a, b, c, body[a:c]))
            yield pd.DataFrame(rows, columns=[*keys, "piece_no", "start_at", "new_from", "end_at", "piece"])

    return over.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", piece_no int, start_at int, new_from int, end_at int, piece string")
