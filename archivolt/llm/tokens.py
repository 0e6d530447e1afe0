"""Token ids of a public byte-level BPE vocabulary.

Each pre-token is merged with a segment tree over the ranks of its adjacent
pairs. The root holds the leftmost pair of the lowest rank; a merge changes the
pair itself and its two neighbours, each in logarithmic time, until the root
says that nothing can be merged. A pre-token of n bytes so takes O(n log n),
also where it has a million bytes. Ids of distinct pre-tokens are remembered in
the worker up to a bounded number.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
NEVER = 1 << 62
REMEMBERED = 400_000
#: Pre-tokens longer than this are not remembered.
LONG = 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary's rank file is installed."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


@lru_cache(maxsize=4)
def _vocabulary(path: str, pattern: str | None) -> tuple[dict[bytes, int], regex.Pattern]:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return ranks, regex.compile(pattern)


@lru_cache(maxsize=4)
def whole_words(path: str, least: int = 3, titled: bool = True) -> frozenset[str]:
    """Words that the public vocabulary holds whole, as they follow a blank: common words, however large the corpus is; ``titled`` with names."""
    ranks, _ = _vocabulary(path, None)
    texts = (t[1:].decode("utf-8", "replace") for t in ranks if t[:1] == b" ")
    return frozenset(t.lower() for t in texts if len(t) >= least and t.isalpha() and (t.islower() or titled and t.istitle()))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by the segment tree."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    size = 1 << max(0, (n - 2).bit_length())  # leaves: pair i is the parts that start at i and after it
    rank_of = ranks.get
    tree = [NEVER] * (2 * size)  # rank * n + place, so that the minimum is the leftmost of the lowest rank
    for i in range(n - 1):
        r = rank_of(word[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))  # start of the part before it

    def put(i: int, key: int) -> None:
        i += size
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            m = a if a < b else b
            if tree[i] == m:
                return
            tree[i] = m
            i >>= 1

    def pair(i: int) -> int:
        j = end[i]
        if j >= n:
            return NEVER
        r = rank_of(word[i : end[j]])
        return NEVER if r is None else r * n + i

    while (low := tree[1]) != NEVER:
        i = low % n
        j = end[i]
        end[i] = end[j]
        if end[i] < n:
            before[end[i]] = i
        if j < n - 1:
            put(j, NEVER)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes whole texts; strings that look like special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str | None = None):
        self.ranks, self.pattern = _vocabulary(path, pattern)
        self.known: dict[str, list[int]] = {}

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, got = self.known, []
        for word in self.pattern.findall(text):
            one = known.get(word)
            if one is None:
                one = merge(word.encode("utf-8", "surrogatepass"), self.ranks)
                if len(word) <= LONG:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = one
            got += one
        return got

    def count(self, text: str | None) -> int:
        return len(self.ids(text))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str | None = None) -> Encoder:
    return Encoder(path, pattern)


def encode(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, ids: the token ids of each row's whole text, without special tokens.

    Null and empty texts give an empty list; nothing is trimmed or normalised.
    Repeated rows stay repeated; a null key stays null; other columns drop out.
    ``path`` is the vocabulary's rank file, as the executors see it.
    """
    return _mapped(df, key, text, path or vocabulary_path(), pattern, "ids array<int>", lambda e, texts: pa.array([e.ids(t) for t in texts], pa.list_(pa.int32())))


def count_tokens(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns ``keep`` and n_tokens (bigint) of each row's whole text; null and empty texts have 0."""
    return _mapped(df, key, text, path or vocabulary_path(), pattern, "n_tokens bigint", lambda e, texts: pa.array([e.count(t) for t in texts], pa.int64()), keep)


def _mapped(df, key, text, path, pattern, made, make, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = df.select(F.col(f"`{key}`"), *(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    name = made.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            *rest, texts = batch.columns
            yield pa.RecordBatch.from_arrays([*rest, make(e, texts.to_pylist())], names=[*batch.schema.names[:-1], name])

    return rows.mapInArrow(run, f"{kinds}, {made}")
