"""Distances of short strings that need a sequential loop; Arrow-batched and memoised."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Cost of reading one for the other in scans; fixed values. An empty right side is a sign that is lost.
CONFUSIONS = {
    ("rn", "m"): 0.2, ("m", "rn"): 0.2, ("cl", "d"): 0.3, ("d", "cl"): 0.3, ("vv", "w"): 0.2, ("w", "vv"): 0.2, ("ri", "n"): 0.3, ("n", "ri"): 0.3, ("nn", "m"): 0.3, ("ii", "u"): 0.3, ("li", "h"): 0.4, ("fi", "h"): 0.4,
    ("l", "1"): 0.1, ("1", "l"): 0.1, ("I", "l"): 0.1, ("l", "I"): 0.1, ("O", "0"): 0.1, ("0", "O"): 0.1, ("S", "5"): 0.2, ("5", "S"): 0.2, ("Z", "2"): 0.3, ("B", "8"): 0.3, ("e", "c"): 0.4, ("a", "o"): 0.4, ("u", "n"): 0.3, ("h", "b"): 0.4,
    (".", ""): 0.1, (",", ""): 0.1, ("'", ""): 0.1, ("-", ""): 0.1, (" ", ""): 0.2,
}
#: Cost of a change of case alone.
CASE = 0.1
_COST = {(b, a): c for (a, b), c in CONFUSIONS.items()} | CONFUSIONS


def reading_cost(a: str, b: str) -> float:
    """Cost of reading a for b, either way round; 1 a letter where nothing is known of them."""
    if a == b:
        return 0.0
    known = _COST.get((a, b))
    if known is not None:
        return known
    if len(a) == len(b) == 1:
        if a.lower() == b.lower():
            return CASE
        return min(1.0, CASE + min((_COST.get((x, y), 1.0) for x in {a.lower(), a.upper()} for y in {b.lower(), b.upper()}), default=1.0))
    return float(max(len(a), len(b)))


@lru_cache(maxsize=100_000)
def ocr_distance(a: str, b: str) -> float:
    """Edit distance in which readings that scans confuse cost less, pairs of letters, case and lost signs included."""
    lost_b = [_COST.get((y, ""), 1.0) for y in b]
    pairs_b = [b[j - 1 : j + 1] if j else "" for j in range(len(b))]
    before, last = [], [0.0]
    for c in lost_b:
        last.append(last[-1] + c)
    for i, x in enumerate(a):
        lost, pair = _COST.get((x, ""), 1.0), a[i - 1 : i + 1] if i else ""
        now = [last[0] + lost]
        for j, y in enumerate(b):
            best = min(last[j + 1] + lost, now[j] + lost_b[j], last[j] + (0.0 if x == y else _letter_cost(x, y)))
            # two letters for one cost no more than a change and a loss where nothing is known of them
            if pair and (c := _COST.get((pair, y))) is not None and before[j] + c < best:
                best = before[j] + c
            if j and (c := _COST.get((x, pairs_b[j]))) is not None and last[j - 1] + c < best:
                best = last[j - 1] + c
            now.append(best)
        before, last = last, now
    return last[-1]


_letter_cost = lru_cache(maxsize=100_000)(reading_cost)


def normalized_ocr_distance(a: str, b: str) -> float:
    """The distance over the longer string's length: 0 for equal and empty strings, at most 1."""
    return min(1.0, ocr_distance(a, b) / max(len(a), len(b))) if a or b else 0.0


@F.pandas_udf(DoubleType())
def ocr_edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else round(ocr_distance(x, y), 6) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def normalized_ocr_edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else round(normalized_ocr_distance(x, y), 6) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings, for pairs that blocking has left."""
    return pd.Series([None if x is None or y is None else round(SequenceMatcher(None, x, y, autojunk=False).ratio(), 6) for x, y in zip(a, b)])
