"""Near-duplicate texts by rare-first prefix filtering of word n-grams.

A text is the sequence of its words as a scan would read them at worst:
line breaks, hyphens, marks and furniture are gone, and letters that scanning
confuses are one letter. Two texts are versions of each other if the words
they share, counted with repeats, are at least ``share`` of the longer one.

A text of m words has at most m (1 - share) words that the other lacks; each of
them breaks at most n of its n-grams, and each seam (a place where words were
put in, left out or moved) at most n - 1. What is left of its distinct n-grams
is what two versions must share; it is worked out for each text from its own
number of n-grams, with a stated number of seams (``seams_of``). The n-grams are
put in order of frequency, the rare first (any order finds every pair, this one
soonest, so only the frequent ones need counts); texts meet in the rare part only,
have to meet several times there, and pass filters on length, position and
suffix before the words of a pair are compared, once.

Texts for which the bound is nothing, such as short or very repetitive ones, are
joined on their words in the same way with all texts of like length, which needs
no bound on seams. So every pair of versions is found that has no more than the
stated seams, however its words are replaced, and every pair at all that has
such a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm import cells
from archivolt.llm.radix import local_path
from archivolt.llm.readings import LOOKS, PAIRS
from archivolt.operators.graph import components
from archivolt.shared import cut, scratch, spread

SHARE = 0.8
GRAM = 4
#: Meetings in the rare part asked for, as a share of the n-grams that have to agree.
EXTRA = 0.35
#: N-grams that this share of the texts has are put in the order of their frequency, all others before them.
KNOWN_SHARE = 1e-3
#: Texts whose n-grams are counted together.
BLOCK_TEXTS = 4096
LEAST_CHARS = 300
#: Seams allowed in any text, and words of a text for each one more.
SEAMS, WORDS_A_SEAM = 2, 100
#: Texts with one n-gram that one task joins with the others.
HOT = 2000

#: Lines at each edge of a page that may be its furniture, and forms of numbers and entry marks.
EDGES = 2
NUMBER = regex.compile(r"(?i)^\W*(?:(?:page|p\.?|pg\.?|seite|с\.?|стр\.?)\s*)?(\d{1,4}|[ivxlc]{1,8})(?:\s*[-—–\])])?\s*$")
LETTERHEAD = regex.compile(r"(?:From|To|Date|No|Subject)\s*[.:]|p\.\s?\d+\s|No\. \d")
BROKEN = regex.compile(r"[-‐‑–—­¬][^\S\n]*\n\s*")
MARK = regex.compile(r"[^\p{L}\p{N}\s!@]+")


def canonical(word: str) -> int:
    """32-bit hash of a word under the confusions of scanning; numbers stay as they are."""
    if not word.isdigit():
        for two, one in PAIRS:
            word = word.replace(two, one)
        word = word.translate(LOOKS)
    return xxhash.xxh32_intdigest(word) - (1 << 31)


def titles(lines: list[str]) -> set[int]:
    """Lines at a page's edges that are set aside for comparison: page numbers, and short ones in capitals or without the end of a sentence."""
    full = [i for i, line in enumerate(lines) if line.strip()]
    got: set[int] = set()
    for side in (full[:EDGES], full[::-1][:EDGES]):
        for i in side:
            bare = lines[i].strip()
            words = bare.split()
            title = len(bare) < 60 and len(words) <= 7 and not bare[0].islower() and bare[-1] not in ".,;:?!-" and ":" not in bare and not LETTERHEAD.match(bare)
            if not (NUMBER.match(bare) or title):
                break
            got.add(i)
    return got


def words_of(text: str, memo: dict[str, int]) -> list[int]:
    lines = text.split("\n")
    drop = titles(lines)
    body = "\n".join(line for i, line in enumerate(lines) if i not in drop)
    got = []
    for word in MARK.sub("", BROKEN.sub("", body).lower()).split():
        h = memo.get(word)
        if h is None:
            if len(memo) > 500_000:
                memo.clear()
            h = memo[word] = canonical(word)
        got.append(h)
    return got


def worded(df: DataFrame, key: str, text: str, least_chars: int = LEAST_CHARS) -> DataFrame:
    """key, words of the texts of at least ``least_chars`` characters; null keys and texts drop out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "words": [words_of(t, memo) for t in frame["text"]]})

    long_ = df.where(F.col(f"`{key}`").isNotNull() & (F.length(F.col(f"`{text}`")) >= least_chars)).select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    return spread(long_).mapInPandas(run, "key bigint, words array<int>").where("size(words) > 0")


def classes_of(texts: DataFrame) -> DataFrame:
    """key, class: the smallest key with the same sequence of words."""
    hashed = texts.select("key", F.xxhash64("words").alias("h"), F.hash("words").alias("g"))
    return hashed.join(hashed.groupBy("h", "g").agg(F.min("key").alias("class")), ["h", "g"]).select("key", "class").distinct()


def seams_of(n):
    """Seams allowed in a text of n words."""
    return SEAMS + n // WORDS_A_SEAM


def _hashed(parts: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def n_grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct n-grams of a text's words."""
    if len(words) < n:
        return np.zeros(0, np.int64)
    return np.unique(_hashed([words[k : len(words) - n + 1 + k] for k in range(n)]))


def numbered_words(words: np.ndarray) -> np.ndarray:
    """Hashes of the words, the second occurrence of a word another one than the first."""
    own = np.sort(words)
    new = np.r_[True, own[1:] != own[:-1]]
    at = np.arange(len(own))
    return _hashed([own, at - np.maximum.accumulate(np.where(new, at, 0))])


def needed(n, size, share: float, gram: int):
    """Tokens a text of n words and ``size`` tokens shares at least with any version; at 0 or less its n-grams tell nothing."""
    if not gram:
        return np.ceil(n * share - 1e-9)
    return size - gram * np.floor(n * (1 - share) + 1e-9) - (gram - 1) * seams_of(n)


def _texts(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key, words, tokens) of each text: with ``gram`` its distinct n-grams, with 0 its numbered words."""
    for batch in batches:
        lists = batch.column("words")
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for key, a, b in zip(batch.column("key").to_pylist(), ends[:-1], ends[1:]):
            yield key, int(b - a), n_grams(values[a:b], gram) if gram else numbered_words(values[a:b])


def surveyed(texts: DataFrame, share: float, gram: int, known: float = KNOWN_SHARE) -> DataFrame:
    """(what, id, n): ``frequent`` tokens with counts, and ``weak`` keys with their words, whose n-grams tell nothing.

    Blocks of texts report the tokens that half the share ``known`` of the block
    has. A token that the share of all texts has is therefore reported by blocks
    with at least half of its texts, and what is kept has at least half the share:
    at most 2 / known times the mean number of tokens of a text, at any size.
    """
    n = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        weak: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= max(2, known / 2 * len(held))
            what = ["frequent"] * int(often.sum()) + ["weak"] * len(weak)
            ids = np.r_[u[often], np.array([k for k, _ in weak], np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(what), pa.array(ids, pa.int64()), pa.array(np.r_[c[often], np.array([w for _, w in weak], np.int64)], pa.int64())], names=["what", "id", "n"])

        for key, words, tokens in _texts(batches, gram):
            held.append(tokens)
            if needed(words, len(tokens), share, gram) <= 0:
                weak.append((key, words))
            if len(held) == BLOCK_TEXTS:
                yield flush()
                held, weak = [], []
        if held:
            yield flush()

    told = texts.select("key", "words").mapInArrow(run, "what string, id bigint, n bigint")
    return cut(told.groupBy("what", "id").agg(F.sum("n").alias("n")).where((F.col("what") == "weak") | (F.col("n") >= known / 2 * n)))


def met(texts: DataFrame, frequent: DataFrame, share: float, gram: int, extra: float = EXTRA, hot: int = HOT) -> DataFrame:
    """a, b: pairs of texts that share enough of their rarest tokens; no pair that shares what both need is missing.

    The order of rarity is that of the ``frequent`` tokens' counts (a bounded
    table, see ``surveyed``), all others before them. Each text's rare part is
    made where the text is, so its tokens are shuffled once, for the join.
    """
    known = frequent.where("what = 'frequent'").orderBy("id").select("id", "n").toArrow()
    table = texts.sparkSession.sparkContext.broadcast((known.column("id").to_numpy(), known.column("n").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = table.value
        rows: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["token", "salt", "side", "key", "n", "size", "need", "at"])

        held = 0
        for key, words, tokens in _texts(batches, gram):
            size = len(tokens)
            need = int(needed(words, size, share, gram))
            if need <= 0:
                continue
            if len(ids):
                place = np.minimum(np.searchsorted(ids, tokens), len(ids) - 1)
                df = np.where(ids[place] == tokens, counts[place], 0)
            else:
                df = np.zeros(size, np.int64)
            end = min(size, size - need + max(1, int(extra * need)))
            first = np.lexsort((tokens, df))[:end]
            token, at = tokens[first], np.arange(end, dtype=np.int32)
            blocks = (df[first] // hot + 1).astype(np.int32)
            salt, side = np.zeros(end, np.int32), np.full(end, 2, np.int8)
            if (many := np.flatnonzero(blocks > 1)).size:
                # the texts of a frequent token are dealt to blocks on one side and go to every block on the other
                salt[many], side[many] = (xxhash.xxh32_intdigest(str(key)) >> 1) % blocks[many].astype(np.int64), 0
                again = np.repeat(many, blocks[many])
                token, at, side = np.r_[token, token[again]], np.r_[at, at[again]], np.r_[side, np.ones(len(again), np.int8)]
                salt = np.r_[salt, np.concatenate([np.arange(b, dtype=np.int32) for b in blocks[many]])]
            rows.append((token, salt, side, np.full(len(token), key, np.int64), *(np.full(len(token), x, np.int32) for x in (words, size, need)), at))
            held += len(token)
            if held > 200_000:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()

    prefix = texts.select("key", "words").mapInArrow(run, "token bigint, salt int, side tinyint, key bigint, n int, size int, need int, at int")
    # both sides are the same rows, so they are shuffled once; which side a row stands for is asked of each pair
    a, b = (prefix.select("token", "salt", *(F.col(c).alias(c + s) for c in ("side", "key", "n", "size", "need", "at"))) for s in ("_a", "_b"))
    sides = (F.col("side_a") * 3 + F.col("side_b")).isin(1, 8)
    both = F.greatest("need_a", "need_b")
    lengths = F.least("n_a", "n_b") >= F.lit(share - 1e-9) * F.greatest("n_a", "n_b")
    position = F.least("at_a", "at_b") + F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= both
    together = a.join(b, ["token", "salt"]).where((F.col("key_a") < F.col("key_b")) & sides & lengths & position)
    # what both need, less what may stand in the frequent parts, has to be met in the rare ones
    beyond = lambda s: F.col(f"need_{s}") - F.greatest(F.lit(1), F.floor(F.lit(extra) * F.col(f"need_{s}")))
    meet = F.greatest(F.lit(1), both - F.least(beyond("a"), beyond("b"))).cast("int")
    counted = together.groupBy(F.col("key_a").alias("a"), F.col("key_b").alias("b"), meet.alias("meet")).agg(F.count(F.lit(1)).alias("c"))
    return counted.where("c >= meet").select("a", "b")


def candidates(texts: DataFrame, share: float, gram: int, extra: float) -> DataFrame:
    """a, b: pairs of keys that may be versions (see the module for which are found)."""
    told = surveyed(texts, share, gram)
    pairs = met(texts, told, share, gram, extra)
    weak = told.where("what = 'weak'").select(F.col("id").alias("key"), "n")
    if weak.isEmpty():
        return pairs
    near = weak.select(F.explode(F.sequence(F.ceil(F.lit(share) * F.col("n") - 1e-9).cast("int"), F.floor(F.col("n") / F.lit(share) + 1e-9).cast("int"))).alias("n")).distinct()
    like = cut(texts.withColumn("n", F.size("words")).join(near, "n", "left_semi").select("key", "words"))
    found = met(like, surveyed(like, share, 0), share, 0, 0.0)
    flag = lambda s: weak.select(F.col("key").alias(s), F.lit(True).alias(f"weak_{s}"))
    with_weak = found.join(flag("a"), "a", "left").join(flag("b"), "b", "left").where("weak_a or weak_b").select("a", "b")
    return pairs.unionByName(with_weak).distinct()


def _suffix(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> int:
    """A lower bound of the words of only one of two sorted arrays, by halving at the larger's middle."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    pivot = y[len(y) // 2] if len(y) >= len(x) else x[len(x) // 2]
    i, j = np.searchsorted(x, pivot), np.searchsorted(y, pivot)
    least = abs(i - j) + abs((len(x) - i) - (len(y) - j))
    if least > most:
        return least
    return _suffix(x[:i], y[:j], most, depth - 1) + _suffix(x[i:], y[j:], most, depth - 1)


def shared_words(x: np.ndarray, y: np.ndarray) -> int:
    """Words of both, counted with repeats."""
    u, n = np.unique(x, return_counts=True)
    v, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def links(texts: DataFrame, share: float = SHARE, gram: int = GRAM, extra: float = EXTRA, block: int = cells.BLOCK) -> DataFrame:
    """a, b, similarity of every two texts (key, words) that are versions of each other, a < b, each verified once.

    Texts are written once in blocks of like length; every two blocks that may
    hold versions are a task, which reads both (see ``cells``). The shared folder
    has to be mounted on the executors.
    """
    spark = texts.sparkSession
    bands = cells.blocks_of([tuple(r) for r in texts.groupBy(F.size("words").alias("n")).count().collect()], block)
    todo = cells.cells_of(bands, share)
    path = scratch(spark, "blocks")
    if todo:
        number, first = F.lit(0), 0
        for lo, _, parts in bands:
            number = F.when(F.col("n") >= lo, F.lit(first) + (F.pmod(F.xxhash64("key"), F.lit(parts)) if parts > 1 else F.lit(0))).otherwise(number)
            first += parts
        own = texts.select("key", "words", F.size("words").alias("n"))
        own.select("key", "words", number.cast("int").alias("block")).write.partitionBy("block").parquet(path)
    at = str(local_path(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for batch in batches for n in batch.column("id").to_pylist()):
            i, j = todo[number]
            x = cells.read(at, i)
            y = x if i == j else cells.read(at, j)
            if x is None or y is None:
                continue
            for left, right in cells.candidates(x, y, share, gram, extra):
                rows = []
                for p, q in zip(left.tolist(), right.tolist()):
                    u, v = np.sort(x.words(p)), np.sort(y.words(q))
                    longer = max(len(u), len(v))
                    apart = len(u) + len(v) - 2 * int(np.ceil(share * longer - 1e-9))
                    if _suffix(u, v, apart) <= apart and (alike := shared_words(u, v) / longer) >= share:
                        rows.append((*sorted((int(x.keys[p]), int(y.keys[q]))), alike))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=found)

    found = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
    return spark.range(0, len(todo), 1, max(1, len(todo))).mapInArrow(run, "a bigint, b bigint, similarity double").distinct()


def near_duplicates(df: DataFrame, key: str, text: str, share: float = SHARE, gram: int = GRAM, least_chars: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """Membership (key, class) of every text that takes part, and links (a, b, similarity) between classes.

    A class is all texts with one sequence of words, named by its smallest key;
    links are between classes of different texts, so copies are never paired.
    Null and short texts take no part, a repeated key counts once (with the least
    of its texts, where they differ), empty tables give empty results.
    """
    texts = cut(worded(df, key, text, least_chars))
    if texts.groupBy("key").count().where("count > 1").limit(1).count():
        texts = cut(texts.groupBy("key").agg(F.min("words").alias("words")))
    member = cut(classes_of(texts))
    reps = cut(texts.join(member.where("key = class").select("key"), "key", "left_semi"))
    return member, cut(links(reps, share, gram))


def groups(member: DataFrame, linked: DataFrame) -> DataFrame:
    """key, class, n_links (of its class to others), copies (in its class) and group (the smallest class joined by links)."""
    ends = linked.select(F.col("a").alias("class")).unionAll(linked.select(F.col("b").alias("class"))).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    group = components(linked).select(F.col("node").alias("class"), F.col("component").alias("group"))
    copies = member.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    told = copies.join(ends, "class", "left").join(group, "class", "left").select("class", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group", "class").alias("group"))
    return member.join(told, "class").select("key", "class", "n_links", "copies", "group")


def expanded(member: DataFrame, linked: DataFrame) -> DataFrame:
    """a, b: all pairs of keys that are versions, copies included; for results that ask for pairs."""
    m1, m2 = member.select(F.col("key").alias("a"), F.col("class").alias("ca")), member.select(F.col("key").alias("b"), F.col("class").alias("cb"))
    many = member.groupBy("class").count().where("count > 1").select("class")
    inside = m1.join(many.withColumnRenamed("class", "ca"), "ca", "left_semi").join(m2, F.col("ca") == F.col("cb")).where("a < b").select("a", "b")
    between = linked.select(F.col("a").alias("ca"), F.col("b").alias("cb")).join(m1, "ca").join(m2, "cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return inside.unionAll(between).distinct()
