"""All pairs of strings within a bounded edit distance, by sharded tries.

How many edits two strings may be apart goes by the shorter one's length. Strings
are sharded by segments: of a string cut into one segment more than edits, at
least one is whole in every string within them, shifted by no more; a swap of
letters over a bound of segments counts for both, so it is tried undone. A shard
is the strings of one length with one segment at one place; it is made a trie,
and the strings that contain the segment near that place walk it with their
Levenshtein automata. A hot segment makes a large trie that is walked, never a
product of its strings, and the strings that walk it are dealt to blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.automaton import Automaton, Trie
from archivolt.shared import cut, spread

#: Letters from which on strings may be one edit apart, and two.
ONE_EDIT, TWO_EDITS = 4, 8
#: Strings that walk one shard's trie in one task.
BLOCK = 20_000


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of the segments of a string of this length; the last ones take the rest."""
    size, more = divmod(length, parts)
    got, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - more)
        got.append((at, n))
        at += n
    return got


def transposed(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit; more than ``most`` where it is beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], [*range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            d = min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d = min(d, before[j - 1] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def allowed(n: int) -> int:
    """Edits that may part two strings, by the shorter one's length."""
    return 0 if n < ONE_EDIT else 1 if n < TWO_EDITS else 2


def _index(s: str) -> Iterator[tuple[int, int, str]]:
    """(edits, place of the segment, segment) under which a string is kept; swaps over the bounds of segments undone, too."""
    n = len(s)
    for most in {allowed(n), allowed(n - 1)} - {0}:
        parts = segments(n, most + 1)
        rows = set()
        for swaps in product((False, True), repeat=most):
            text = list(s)
            for (at, _), swap in zip(parts[1:], swaps):
                if swap:
                    text[at - 1], text[at] = text[at], text[at - 1]
            rows |= {(most, k, "".join(text[at : at + size])) for k, (at, size) in enumerate(parts)}
        yield from sorted(rows)


def _probes(s: str) -> Iterator[tuple[int, int, int, str]]:
    """(edits, length, place, segment) of all shards that may hold a string within the edits."""
    n = len(s)
    rows = set()
    for m in range(max(ONE_EDIT, n - 2), n + 3):
        most, d = allowed(min(n, m)), n - m
        if most and abs(d) <= most:
            for k, (at, size) in enumerate(segments(m, most + 1)):
                for shift in range(-most, most + 1):
                    if abs(shift) + abs(d - shift) <= most and 0 <= at + shift and at + shift + size <= n:
                        rows.add((most, m, k, s[at + shift : at + shift + size]))
    yield from sorted(rows)


def near_strings(strings: DataFrame, column: str, group: str | None = None, block: int = BLOCK) -> DataFrame:
    """a, b, distance (and the group) of all pairs of different strings within the allowed edits, a < b.

    A swap of neighbouring letters is one edit. Only strings of one ``group``
    are compared, where it is given. Null and empty strings take no part, repeats
    count once; strings of less than ONE_EDIT letters have no pairs. An empty table
    gives no pairs.
    """
    own = F.col(group).cast("string") if group else F.lit("")
    distinct = strings.select(F.col(column).alias("s"), own.alias("g")).where("s <> '' and g is not null").distinct()

    def shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for s, g in zip(frame["s"], frame["g"]):
                rows += [(f"{g}|{most}|{len(s)}|{k}|{text}", 0, s) for most, k, text in _index(s)]
                rows += [(f"{g}|{most}|{m}|{k}|{text}", 1, s) for most, m, k, text in _probes(s)]
            yield pd.DataFrame(rows, columns=["shard", "side", "s"])

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for frame in frames:
                yield from zip(frame["shard"], frame["block"], frame["side"], frame["s"])

        found: list[tuple[str, str, str, int]] = []
        automata: dict[str, Automaton] = {}
        for (name, _), own in groupby(rows(), key=lambda r: r[:2]):
            index: list[str] = []
            trie = None
            g, most, *_ = name.split("|")
            for *_, side, s in own:
                if side == 0:
                    index.append(s)
                elif index and (len(index) > 1 or index[0] != s):
                    trie = trie or Trie(index)
                    if len(automata) > 50_000:
                        automata.clear()
                    spelled = automata.get(s)
                    if spelled is None:
                        spelled = automata[s] = Automaton(s, False)
                    for d, t in spelled.words(trie, int(most)):
                        if s < t:
                            found.append((g, s, t, d))
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["g", "a", "b", "distance"])
                found = []
        yield pd.DataFrame(found, columns=["g", "a", "b", "distance"])

    sharded = cut(spread(distinct).mapInPandas(shard, "shard string, side int, s string"))
    hot = sharded.where("side = 1").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    if hot.isEmpty():
        dealt = sharded.withColumn("block", F.lit(0))
    else:
        blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
        every = F.when(F.col("side") == 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("s"), blocks).cast("int")))
        dealt = sharded.join(hot, "shard", "left").select("shard", F.explode(every).alias("block"), "side", "s")
    sorted_ = dealt.repartition("shard", "block").sortWithinPartitions("shard", "block", "side", "s")
    pairs = sorted_.select("shard", "block", "side", "s").mapInPandas(join, "g string, a string, b string, distance int").distinct()
    return pairs.withColumnRenamed("g", group) if group else pairs.drop("g")
