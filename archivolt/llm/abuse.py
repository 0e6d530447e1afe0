"""Scores of abusive, hateful and sexual wording.

The words of the lists (abuse_terms.py) are a trie. Every distinct token of the
texts that is no listed word is run through the intersection of the trie with
its Levenshtein automaton (automaton.py): letters put in place of others,
inserted marks, masked, repeated or spaced letters cost nothing, a wrong,
missing, added or swapped letter costs an error. A token that a public
vocabulary holds whole is a word of its own and isn't read as another one.

What is read gets its score from its window: idioms, patterns of roles (who is
to suffer what from whom), words towards a person, words of innocent uses, and
errors, which take away. So a misspelled word tells as much as the words around
it allow. Another window tells quotation from abuse; both are found.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm import abuse_terms as terms
from archivolt.llm.automaton import Automaton, Trie
from archivolt.llm.tokens import vocabulary_path, whole_words

WINDOW = 9
GAP = 4
LEAST = 0.5
#: What an error in a word takes from the score of its pattern or idiom.
ERROR = 0.2
#: Letters of listed words that may hold one error, or two.
ONE_ERROR, TWO_ERRORS = 5, 9
CATEGORIES = ("insult", "threat", "hate", "sexual")
INVISIBLE = regex.compile(r"[\u200b-\u200f\u2060-\u2064\ufeff\u00ad\u0300-\u036f]")
SPACED = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{L}\p{N}@$*] ){2,}[\p{L}\p{N}@$*](?![\p{L}\p{N}])")
OUTER = regex.compile(r"^[^\p{L}\p{N}@$*]+|[^\p{L}\p{N}@$*]+$")
REPEATED = regex.compile(r"(\p{L})\1\1")
STOP = regex.compile(r"[.!?][\"'”’»)\]]*$")
QUOTES = regex.compile(r"[\"“”«»„]")
CONTENT = frozenset({"kill", "hurt", "myself", "killed", "vermin", "breed", "rot", "at_home", "dead", "human", "houses"})


def plain(text: str) -> str:
    """Lower case without accents and invisible characters."""
    if text.isascii():
        return text.lower()
    return INVISIBLE.sub("", unicodedata.normalize("NFKD", text)).lower().replace("ß", "ss").replace("’", "'")


class Reading(NamedTuple):
    """Listed words a token may stand for with their errors, its roles with theirs, and whether it was masked."""

    words: dict[str, int]
    roles: dict[str, int]
    masked: bool


class Scorer:
    """Scores whole texts; made once per worker. ``fuzzy`` off takes tokens as they stand, for comparison."""

    def __init__(self, vocabulary: str | None = None, fuzzy: bool = True) -> None:
        norm = lambda s: [plain(w) for w in s.split()]
        self.fuzzy = fuzzy
        self.own = whole_words(vocabulary or vocabulary_path())
        self.strong = {w: c for c, s in terms.STRONG.items() for w in norm(s)}
        self.depending: dict[str, set[str]] = {}
        for c, s in terms.DEPENDING.items():
            for w in norm(s):
                self.depending.setdefault(w, set()).add(c)
        self.roles: dict[str, set[str]] = {}
        for role, s in terms.ROLES.items():
            for w in norm(s):
                self.roles.setdefault(w, set()).add(role)
        self.towards, self.innocent, self.reporting, self.persons = (frozenset(norm(s)) for s in (terms.TOWARDS, terms.INNOCENT, terms.REPORTING, terms.PERSONS))
        self.phrases: dict[str, list[tuple[str, list[tuple[str, bool]]]]] = {}
        in_phrases: set[str] = set()
        for c, block in terms.PHRASES.items():
            for line in block.strip().splitlines():
                for phrase in line.strip().split("|"):
                    words, loose = [], False
                    for w in norm(phrase):
                        if w == "~":
                            loose = True
                        else:
                            words.append((w, loose))
                            in_phrases.add(w)
                            loose = False
                    self.phrases.setdefault(words[0][0], []).append((c, words))
        self.patterns: dict[str, list[tuple[str, float, list[tuple[str, int]]]]] = {}
        for c, score, text in terms.PATTERNS:
            parts = text.split()
            steps = [(r, int(g)) for r, g in zip(parts[2::2], parts[1::2])]
            self.patterns.setdefault(parts[0], []).append((c, score, steps))
        self.words = frozenset(self.strong) | frozenset(self.depending) | in_phrases | frozenset(self.roles)
        self.listed = frozenset(self.strong) | frozenset(self.depending)
        content = self.listed | {w for w in in_phrases if len(w) > 4} | {w for w, r in self.roles.items() if len(w) > 3 and r & CONTENT}
        self.trie, self.long = Trie(sorted(content)), Trie(sorted(w for w in content if len(w) >= TWO_ERRORS))
        self.memo: dict[str, Reading | None] = {}

    def read(self, raw: str) -> Reading | None:
        """What a token may stand for; None for words of no interest."""
        if raw in self.memo:
            return self.memo[raw]
        if len(self.memo) > 500_000:
            self.memo.clear()
        got = self.memo[raw] = self._read(raw)
        return got

    def _read(self, raw: str) -> Reading | None:
        word = OUTER.sub("", raw)
        if not word:
            return None
        for end in ("", "'s", "s"):
            stem = word[: len(word) - len(end)]
            if (word in self.words if not end else word.endswith(end) and stem in self.listed):
                return self._reading({stem: 0}, False)
        letters = sum(c.isalpha() for c in word)
        if not self.fuzzy or letters < 2:
            return None
        parts = regex.split(r"['-]", word)
        masked = not all(p.isalpha() for p in parts) or bool(REPEATED.search(word)) or (len(parts) > 1 and not all(p in self.own for p in parts))
        if masked:
            if letters * 2 < len(word) or word.count("*") * 2 > len(word):
                return None
        elif word in self.own or len(word) < ONE_ERROR - 1 or not word.isalpha():
            return None
        spelled = Automaton(word, masked)
        near = spelled.words(self.trie, 1)
        if not near and len(word) >= TWO_ERRORS - 1:
            near = spelled.words(self.long, 2)
        near = [(e, w) for e, w in near if e == 0 or (len(w) >= ONE_ERROR and (e == 1 or len(w) >= TWO_ERRORS))]
        if not near:
            return None
        least = near[0][0]
        return self._reading({w: e for e, w in near if e == least}, masked)

    def _reading(self, words: dict[str, int], masked: bool) -> Reading:
        roles: dict[str, int] = {}
        for w, e in words.items():
            for r in self.roles.get(w, ()):
                roles[r] = min(e, roles.get(r, e))
        return Reading(words, roles, masked)

    def score(self, text: str) -> dict[str, tuple[float, bool]]:
        """Category to the highest score of a hit (0 to 1) and whether it stands as a quotation."""
        got: dict[str, tuple[float, bool]] = {}
        text = plain(text)
        if self.fuzzy and SPACED.search(text):
            text = SPACED.sub(self._unspaced, text)
        lines = [line.split() for line in text.split("\n")]
        raw = [token for line in lines for token in line]
        starts = set(accumulate(map(len, lines), initial=0))
        read = [self.read(token) for token in raw]
        sexual: list[int] = []
        for i, r in enumerate(read):
            if r is None:
                continue
            for word, errors in r.words.items():
                if word in self.strong:
                    self._strong(got, word, errors, r.masked, read, raw, i)
                if word in self.depending:
                    self._depending(got, word, errors, r.masked, read, raw, i)
                    if "sexual" in self.depending[word]:
                        sexual.append(i)
                for category, words in self.phrases.get(word, ()):
                    wrong = self._phrase(read, raw, i, words)
                    if wrong is not None:
                        self._put(got, category, 0.95 - ERROR * (wrong + errors), read, raw, i)
            for role, errors in r.roles.items():
                for category, score, steps in self.patterns.get(role, ()):
                    wrong = self._pattern(read, raw, i, steps)
                    if wrong is not None:
                        innocent = self._window(read, raw, i)[1]
                        self._put(got, category, score - ERROR * (wrong + errors) - 0.3 * min(innocent, 2), read, raw, i)
                if role == "kill" and (i in starts or STOP.search(raw[i - 1])):
                    for category, score, steps in self.patterns.get("^", ()):
                        wrong = self._pattern(read, raw, i, steps[1:])
                        if wrong is not None:
                            self._put(got, category, score - ERROR * (wrong + errors), read, raw, i)
            if "are" in r.roles or "like" in r.roles:
                self._group_before(got, read, raw, i)
        if len(sexual) > 1:
            self._wording(got, sexual, read, raw)
        return got

    def _unspaced(self, m) -> str:
        s = m.group().replace(" ", "")
        for k in range(min(3, len(s) - 2)):
            for n in range(len(s), k + 2, -1):
                r = self.read(s[k:n])
                if r and any(w in self.listed and e == 0 for w, e in r.words.items()):
                    return f"{s[:k]} {s[k]}.{s[k + 1:n]} {s[n:]}"  # a mark, as it was masked
        return m.group()

    def _strong(self, got, word: str, errors: int, masked: bool, read, raw, i: int) -> None:
        if not errors:
            self._put(got, self.strong[word], 1.0, read, raw, i)
            return
        towards, innocent = self._window(read, raw, i)
        self._put(got, self.strong[word], 0.4 + 0.3 * masked + 0.15 * min(towards, 2) + 0.2 * self._directed(read, raw, i) - 0.3 * min(innocent, 2), read, raw, i)

    def _depending(self, got, word: str, errors: int, masked: bool, read, raw, i: int) -> None:
        towards, innocent = self._window(read, raw, i)
        s = (0.9 if masked else 0.3) + 0.15 * min(towards, 3) + 0.2 * self._directed(read, raw, i) - 0.3 * min(innocent, 2) - ERROR * errors
        if s > 0 and "insult" in self.depending[word]:
            self._put(got, "insult", min(s, 1.0), read, raw, i)
        elif s > 0 and masked and not errors:
            self._put(got, "sexual", min(s, 1.0), read, raw, i)

    def _wording(self, got, at: list[int], read, raw) -> None:
        """Several sexual words of one sentence that speak of a person."""
        for i in at:
            lo, hi = self._ends(raw, i)
            own = {w for k in range(lo, hi + 1) if read[k] for w, e in read[k].words.items() if "sexual" in self.depending.get(w, ()) and not e}
            about = any(OUTER.sub("", raw[k]) in self.persons for k in range(lo, hi + 1))
            innocent = self._window(read, raw, i)[1]
            if len(own) > 1 and about:
                self._put(got, "sexual", 0.3 + 0.2 * min(len(own), 3) - 0.3 * min(innocent, 2), read, raw, i)

    def _group_before(self, got, read, raw, i: int) -> None:
        """Patterns of ``the`` and ``they``: a group is named in the plural, right before or earlier in the sentence."""
        lo, hi = self._ends(raw, i)
        words = [OUTER.sub("", raw[k]) for k in range(lo, i)]
        plural = any(a in ("the", "these", "those", "such", "all", "die", "les", "los", "эти") for a in words[-4:]) or any(w in ("they", "these", "those", "people", "sie", "они") for w in words[-4:])
        if not plural:
            return
        innocent = self._window(read, raw, i)[1]
        for name in ("the", "they"):
            for category, score, steps in self.patterns.get(name, ()):
                if steps[0][0] in read[i].roles:
                    wrong = self._pattern(read, raw, i, steps[1:])
                    if wrong is not None:
                        self._put(got, category, score - ERROR * wrong - 0.3 * min(innocent, 2), read, raw, i)

    def _pattern(self, read, raw, i: int, steps: list[tuple[str, int]]) -> int | None:
        """Errors of the words that follow in the roles of the steps; None where they don't."""
        if not steps:
            return 0
        role, gap = steps[0]
        if STOP.search(raw[i]):
            return None
        best = None
        for k in range(i + 1, min(len(read), i + 2 + gap)):
            r = read[k]
            if role == "the":
                fits = 0 if OUTER.sub("", raw[k]) in ("the", "these", "those", "all") else None
            else:
                fits = None if r is None else r.roles.get(role)
            if fits is not None and (rest := self._pattern(read, raw, k, steps[1:])) is not None:
                best = fits + rest if best is None else min(best, fits + rest)
            if STOP.search(raw[k]):
                break
        return best

    def _phrase(self, read, raw, i: int, words) -> int | None:
        at, wrong = i, 0
        for word, loose in words[1:]:
            for k in range(at + 1, min(len(read), at + 2 + (GAP if loose else 0))):
                r = read[k]
                if r is not None and word in r.words:
                    at = k
                    wrong += r.words[word]
                    break
            else:
                return None
        return wrong

    def _ends(self, raw, i: int) -> tuple[int, int]:
        lo, hi = i, i
        while lo > max(0, i - WINDOW) and not STOP.search(raw[lo - 1]):
            lo -= 1
        while hi < min(len(raw) - 1, i + WINDOW) and not STOP.search(raw[hi]):
            hi += 1
        return lo, hi

    def _window(self, read, raw, i: int) -> tuple[int, int]:
        lo, hi = self._ends(raw, i)
        own = {OUTER.sub("", raw[k]) for k in range(lo, hi + 1) if k != i}
        own |= {w for k in range(lo, hi + 1) if k != i and read[k] for w, e in read[k].words.items() if not e}
        return len(own & self.towards), len(own & self.innocent)

    def _directed(self, read, raw, i: int) -> bool:
        """You before it in the same run of words, or named so."""
        before = [OUTER.sub("", raw[k]) for k in range(max(0, i - 4), i)]
        return any(w in ("you", "your", "called", "tu", "du", "eres", "ты", "nothing") for w in before) or before[-2:] == ["what", "a"]

    def _put(self, got, category: str, s: float, read, raw, i: int) -> None:
        s = round(min(s, 1.0), 6)
        if s <= got.get(category, (0.0, False))[0]:
            return
        lo, hi = self._ends(raw, i)
        near = raw[max(0, lo - 6) : hi + 4]
        quoted = any(QUOTES.search(w) for w in near) and any(OUTER.sub("", raw[k]) in self.reporting for k in range(max(0, lo - 8), min(len(raw), hi + 8)))
        got[category] = (s, quoted)


@lru_cache(maxsize=1)
def scorer() -> Scorer:
    return Scorer()


def scores(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, score, insult, threat, hate, sexual and quoted of each row's whole text.

    score is the highest of the categories, 0 where nothing is found, as for
    null and empty texts; quoted is true where the highest hit is in a report
    of what somebody said. Repeated rows stay repeated; other columns drop out.
    """
    rows = df.select(F.col(f"`{key}`"), *(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = scorer()
        for frame in frames:
            found = [s.score(t) if t else {} for t in frame["__text"]]
            out = frame.drop(columns="__text")
            out["score"] = [max((v for v, _ in f.values()), default=0.0) for f in found]
            for c in CATEGORIES:
                out[c] = [f.get(c, (0.0, False))[0] for f in found]
            out["quoted"] = [max(f.values(), default=(0, False))[1] for f in found]
            yield out

    return rows.mapInPandas(run, f"{kinds}, score double, insult double, threat double, hate double, sexual double, quoted boolean")


def rates(scored: DataFrame, source: str, least: float = LEAST) -> DataFrame:
    """Per source (null is one of them): documents, abusive ones and their share, by category and of quotations."""
    hit = lambda c: F.sum((F.col(c) >= least).cast("bigint"))
    return scored.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_docs"), hit("score").alias("n_abusive"), (hit("score") / F.count(F.lit(1))).alias("rate"), *(hit(c).alias(f"n_{c}") for c in CATEGORIES),
        F.sum((F.col("quoted") & (F.col("score") >= least)).cast("bigint")).alias("n_quoted"),
    )


def agreement(scored: DataFrame, labels: DataFrame, key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """Per reviewer: judgements, agreements with the score and misses on either side; null judgements don't count."""
    own = labels.where("abusive is not null").select(key, "reviewer", "abusive").distinct()
    hit = F.col("score") >= least
    both = own.join(scored.select(key, "score"), key)
    count = lambda c: F.sum(c.cast("bigint"))
    return both.groupBy("reviewer").agg(F.count(F.lit(1)).alias("n"), count(hit == (F.col("abusive") == 1)).alias("n_agree"), count(~hit & (F.col("abusive") == 1)).alias("n_only_reviewer"), count(hit & (F.col("abusive") == 0)).alias("n_only_score"))
