"""Variant spellings of the names of persons and organisations.

A name is read as a person (given name, initials, surname) or an organisation
(own name, activity, kind), whatever the order of its parts; titles, particles
and fillers are put aside. A given name may be any: those of a list only add
their short forms and tell which part they are. Surnames and own names are linked
by the trie join (trie_join.py); where no part is a listed given name all parts go
through it, and names whose parts pair off in any order are linked. Full names of
one surname and one given name are a bearer, and shorter forms go to the only
bearer they can mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.llm import name_terms as terms
from archivolt.llm.readings import DIGITS, PAIRS
from archivolt.llm.automaton import Automaton, Trie
from archivolt.llm.tokens import vocabulary_path, whole_words
from archivolt.llm.trie_join import near_strings
from archivolt.operators.graph import components
from archivolt.shared import cut, spread

#: Endings of one sound in transcriptions; fixed values.
ENDINGS = ((regex.compile(r"o+(?:ff|v|w)$"), "ov"), (regex.compile(r"e+(?:ff|v|w)$"), "ev"), (regex.compile(r"i+(?:ff|v|w)$"), "iv"), (regex.compile(r"(?<=[nr])(?:ts|tz|z|cz|cs|c)$"), "ts"), (regex.compile(r"(?:ij|yi|iy|y|ii)$"), "i"))
LETTERS = (("ph", "f"), ("w", "v"), ("sch", "sh"), ("y", "i"))


def sound(word: str) -> str:
    """A surname in one transcription."""
    for pattern, to in ENDINGS:
        word = pattern.sub(to, word)
    for a, b in LETTERS:
        word = word.replace(a, b)
    return word


def _forms(table: dict[str, str]) -> dict[str, str]:
    got = {s: name for name, short in table.items() for s in short.split()}
    return got | {name: name for name in table}


@lru_cache(maxsize=1)
def _tables() -> tuple[tuple[dict[str, str], Trie], ...]:
    forms = [_forms(t) for t in (terms.GIVEN, terms.KINDS, terms.ACTIVITIES)]
    return tuple((f, Trie(sorted(f))) for f in forms)


@lru_cache(maxsize=1)
def _common() -> frozenset[str]:
    return whole_words(vocabulary_path(), titled=False)


@lru_cache(maxsize=200_000)
def _ordinary(word: str) -> bool:
    """Whether a word is common, short, or made of two common words."""
    own = _common()
    return len(word) < 3 or word in own or word in terms.FILLERS or any(word[:k] in own and word[k:] in own for k in range(3, len(word) - 2))


@lru_cache(maxsize=200_000)
def _look_up(word: str, which: int) -> tuple[str, int] | None:
    """The canonical form a word stands for and its edits: one in words of four letters, two in words of eight."""
    table, trie = _tables()[which]
    if word in table:
        return table[word], 0
    for two, one in PAIRS:
        if two in word and (joined := word.replace(two, one)) in table:
            return table[joined], 1
    best: dict[str, int] = {}
    for d, form in Automaton(word, False).words(trie, 2 if len(word) >= 7 else 1):
        canonical = table[form]
        least = min(len(word) + 1, len(form))
        most = 2 if least >= 8 else 1 if least >= (4 if form == canonical else 5) else 0
        if d <= most:
            best[canonical] = min(d, best.get(canonical, 9))
    if best:
        d = min(best.values())
        near = [c for c, k in best.items() if k == d]
        return (near[0], d) if len(near) == 1 else None
    return None


def _glued(word: str) -> tuple[str, str] | None:
    """(given name, surname) of a word that is both run together."""
    for n in range(min(len(word) - 5, 12), 3, -1):
        if word[:n] in terms.GIVEN:
            return word[:n], word[n:]
    return None


def _freed(word: str) -> str:
    """A given name without a particle run together with it."""
    for p in terms.PARTICLES:
        if word.endswith(p) and word[: -len(p)] in terms.GIVEN:
            return word[: -len(p)]
    return word


def parse(name: str) -> tuple[str, str, str, str, str] | None:
    """(kind, own, main, more, words), own names of several words in alphabetical order: for persons kind ``p``, surname, given name and initials; for organisations
    ``o``, own name, kind of organisation and activity. ``words`` are the parts of a person's name where no list
    tells which is the given name, else empty. None for single words and phrases of common words alone."""
    words = [w.translate(DIGITS) if any(c.isalpha() for c in w) else w for w in name.split()]
    words = [regex.sub(r"[^\p{L}\p{N}]", "", w) for w in words]
    words = [w for w in words if w]
    kinds = [k[0] for w in words if (k := _look_up(w, 1))]
    if kinds and len(words) > 1:
        acts = [a[0] for w in words if not _look_up(w, 1) and (a := _look_up(w, 2))]
        own = [w for w in words if not _look_up(w, 1) and not _look_up(w, 2) and w not in terms.FILLERS and w not in terms.PARTICLES and w not in terms.TITLES]
        if own and not all(w in _common() or len(w) < 3 for w in own):
            return "o", " ".join(sorted(map(sound, own))), kinds[0], acts[0] if acts else "", ""
        return None
    titled = any(w in terms.TITLES for w in words)
    rest = [w for w in words if w not in terms.TITLES and w not in terms.PARTICLES and w not in terms.SUFFIXES]
    rest = [_freed(w) for w in rest]
    initials = [w for w in rest if len(w) == 1]
    long_ = [w for w in rest if len(w) > 1]
    if not long_:
        return None
    if len(long_) == 1:
        both = _glued(long_[0])
        if both:
            return "p", sound(both[1]), both[0], "".join(initials), ""
        return ("p", sound(long_[0]), "", "".join(initials), "") if initials or titled else None
    read = sorted((k[1], i) for i, w in enumerate(long_) if (k := _look_up(w, 0)))
    if read:
        given = long_[read[0][1]]
        also = [long_[i] for d, i in read if d == read[0][0]]
        own = [w for i, w in enumerate(long_) if i != read[0][1] and (w not in also or len(also) == len(long_))]
        if own:
            # which of two given names is the surname can't be told, so the parts are also compared in any order
            return "p", sound(" ".join(sorted(own))), _look_up(given, 0)[0], "".join(initials), " ".join(long_) if len(also) == len(long_) else ""
    short = [w for w in long_ if len(w) <= 4 and any(g.startswith(w) for g in terms.GIVEN)]
    if len(long_) == 2 and len(short) == 1:
        own = next(w for w in long_ if w != short[0])
        if not _ordinary(own):
            return "p", sound(own), "", short[0] + "".join(initials), ""
    if all(map(_ordinary, long_)):
        return None
    return "p", sound(long_[-1]), " ".join(long_[:-1]), "".join(initials), " ".join(long_)


def parsed(names: DataFrame, column: str = "name") -> DataFrame:
    """name, kind, own, main, more and words of every name that is read as one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(n, *p) for n in frame["name"] if (p := parse(n))]
            yield pd.DataFrame(rows, columns=["name", "kind", "own", "main", "more", "words"])

    return spread(names.select(F.col(column).alias("name"))).mapInPandas(run, "name string, kind string, own string, main string, more string, words string")


def permuted(names: DataFrame) -> DataFrame:
    """a, b: names (name, words) of as many parts, whose parts pair off in any order, at most two of them spelled differently.

    Parts are linked by the trie join; each name asks for its sorted parts with one
    or two of them put in place of near ones, an equality join on whole names.
    """
    parts = names.select("name", F.posexplode(F.split("words", " ")).alias("at", "part"))
    near = near_strings(parts, "part")
    reach = near.select(F.col("a").alias("part"), F.col("b").alias("other")).unionAll(near.select(F.col("b").alias("part"), F.col("a").alias("other")))
    others = parts.join(reach, "part").groupBy("name", "at").agg(F.collect_set("other").alias("others")).groupBy("name").agg(F.collect_list(F.struct("at", "others")).alias("others"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, words, near in zip(frame["name"], frame["words"], frame["others"]):
                own = words.split(" ")
                keys = {" ".join(sorted(own))}
                there = {} if near is None else {x["at"]: list(x["others"]) for x in near}
                for many in (1, 2):
                    for places in combinations(sorted(there), many):
                        for put in product(*(there[p] for p in places)):
                            made = list(own)
                            for p, w in zip(places, put):
                                made[p] = w
                            keys.add(" ".join(sorted(made)))
                rows += [(name, k) for k in keys]
            yield pd.DataFrame(rows, columns=["a", "key"])

    asked = names.join(others, "name", "left").select("name", "words", "others").mapInPandas(run, "a string, key string")
    index = names.select(F.col("name").alias("b"), F.array_join(F.array_sort(F.split("words", " ")), " ").alias("key"))
    return asked.join(index, "key").where("a <> b").select("a", "b").distinct()


def entities(names: DataFrame, column: str = "name") -> DataFrame:
    """name, entity of every distinct name that has an entity in common with another or stands for one.

    ``names``: folded distinct names. Names that aren't read as a person's or an
    organisation's have no entity. A form that could mean several bearers of its
    surname goes to none of them. Null and empty names drop out.
    """
    read = cut(parsed(names.select(column).where(f"{column} <> ''").distinct(), column))
    ok = cut(near_strings(read, "own", "kind").select(F.concat("kind", "a").alias("a"), F.concat("kind", "b").alias("b"), "distance"))
    sides = ok.select("a", "b", "distance").unionAll(ok.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    own = read.withColumn("key", F.concat("kind", "own"))
    same = own.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0).alias("distance")).distinct()
    reach = cut(sides.unionAll(same))

    # the trait of a whole name is the given name, or an organisation's kind with its activity; of a part its first
    # initial or its kind; a surname alone has none
    person = F.col("kind") == "p"
    is_whole = F.when(person, F.col("main") != "").otherwise(F.col("more") != "")
    initials = F.regexp_extract("more", r"^(\p{L}*)", 1)
    start = F.when(person, F.left(initials, F.when(F.length(initials) > 2, 3).otherwise(1))).otherwise(F.concat("main", F.lit(" ")))
    told = own.withColumn("start", start).withColumn("tier", F.when(is_whole, "1").when(F.col("start") != "", "2").otherwise("3"))
    trait = F.when(F.col("tier") == "1", F.when(person, F.col("main")).otherwise(F.concat_ws(" ", "main", "more"))).when(F.col("tier") == "2", F.when(person, F.left("start", F.lit(1))).otherwise(F.col("start"))).otherwise("")
    told = cut(told.withColumn("trait", trait).withColumn("node", F.concat_ws("|", "tier", "key", "trait")).withColumn("free", (F.col("words") != "").cast("int")).select("name", "key", "start", "tier", "trait", "node", "free"))
    nodes = told.select("tier", "key", "trait", "node").distinct()
    ends = nodes.select("tier", "trait", F.col("key").alias("b"), F.col("node").alias("other"))
    edges = nodes.join(reach, F.col("key") == F.col("a")).join(ends, ["tier", "trait", "b"]).select("node", "other")
    free = cut(read.where("words <> ''").select("name", "words"))
    if not free.isEmpty():
        # names whose given name no list tells: the same parts in another order or spelling
        at = told.select("name", "node")
        found = permuted(free).join(at.withColumnRenamed("name", "a"), "a").join(at.select(F.col("name").alias("b"), F.col("node").alias("other")), "b")
        edges = edges.unionByName(found.select("node", "other").distinct())
    known = cut(told.join(components(edges, "node", "other"), "node").select("name", "key", "start", "tier", "trait", "free", F.col("component").alias("bearer")))

    def attach(part: DataFrame, to: DataFrame, fits) -> DataFrame:
        """name, bearer where one bearer alone fits, the nearest spelling of the surname first, then those with a listed given name."""
        options = part.select("name", "key", "start").join(reach, F.col("key") == F.col("a")).join(to.select(F.col("key").alias("b"), "trait", "bearer", "free").distinct(), "b").where(fits)
        options = options.withColumn("distance", F.col("distance") * 2 + F.col("free"))
        first = options.withColumn("d", F.min("distance").over(Window.partitionBy("name"))).where("distance = d")
        return first.groupBy("name").agg(F.min("bearer").alias("bearer"), F.max("bearer").alias("other")).where("bearer = other").select("name", "bearer")

    whole, part = known.where("tier = '1'"), known.where("tier <> '1'")
    hit = cut(attach(part, whole, F.col("trait").startswith(F.col("start"))))
    left = cut(part.join(hit.select("name"), "name", "left_anti"))
    # initials without a bearer stand for one of their own; a bare surname goes to the only one there is
    second, bare = left.where("tier = '2'"), left.where("tier = '3'")
    lone = cut(attach(bare, second, F.lit(True)))
    rest = bare.join(lone.select("name"), "name", "left_anti")
    taken = rest.join(reach, F.col("key") == F.col("a")).join(whole.select(F.col("key").alias("b")).distinct(), "b", "left_semi").select("name").distinct()
    alone = rest.join(taken, "name", "left_anti")
    out = whole.select("name", "bearer")
    for d in (hit, second, lone, alone):
        out = out.unionAll(d.select("name", "bearer"))
    return out.select("name", F.col("bearer").alias("entity")).distinct()


def variants(found: DataFrame) -> DataFrame:
    """name_a, name_b: pairs of different names of one entity, the smaller first."""
    a, b = (found.select("entity", F.col("name").alias(f"name_{s}")) for s in "ab")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
