"""An averaged-perceptron character editor for scanned text.

The editor gives each character one of the operations keep, delete, replace
(by one or two characters, alone or together with the next character) and
insert, and each line end keep or join. A word's edits are scored by the
perceptron over the characters around the place, how usual the letters are that
an edit takes away and makes, and whether a known word comes out; a word is
edited where an edit, or two, score higher than keeping it. That the result is a
known word is an exact check after that.

It is trained without labels: words of scans that are in no edited text are
paired with the one edited word that a single operation makes of them; those
that no operation mends and known words are kept. Line ends whose halves make
exactly one of "joined" or "hyphenated" a known word are their own labels; where
both are known, a plain hyphen is taken for the compound's own.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from random import Random

import regex

KEEP = ("keep",)
ROUNDS = 4
#: An operation must be seen this often in the pairs to be learned.
LEAST_SEEN = 3
LETTERS = "abcdefghijklmnopqrstuvwxyz"
MARKS = "-‐‑–—­¬"


class Perceptron:
    """Averaged perceptron over string features, of classes or of choices."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[tuple, float]] = {}
        self._sums: dict[tuple, float] = defaultdict(float)
        self._stamps: dict[tuple, int] = defaultdict(int)
        self._now = 0

    def scores(self, features: Iterable[str]) -> dict[tuple, float]:
        got: dict[tuple, float] = defaultdict(float)
        for f in features:
            for c, w in self.weights.get(f, {}).items():
                got[c] += w
        return got

    def score(self, features: Iterable[str]) -> float:
        """The score of one choice, where choices have features instead of classes."""
        get = self.weights.get
        return sum(own[()] for f in features if (own := get(f)))

    def rank(self, examples: list[tuple[list[list[str]], int]], rounds: int = ROUNDS, seed: int = 3) -> None:
        """Learn to put the right one of several choices first."""
        order = Random(seed)
        for _ in range(rounds):
            order.shuffle(examples)
            for choices, truth in examples:
                self._now += 1
                guess = max(range(len(choices)), key=lambda k: (self.score(choices[k]), k != truth))
                if guess != truth:
                    for f in choices[truth]:
                        self._add(f, (), 1.0)
                    for f in choices[guess]:
                        self._add(f, (), -1.0)
        self._average()

    def _add(self, f: str, c: tuple, by: float) -> None:
        own = self.weights.setdefault(f, {})
        self._sums[f, c] += (self._now - self._stamps[f, c]) * own.get(c, 0.0)
        self._stamps[f, c] = self._now
        own[c] = own.get(c, 0.0) + by

    def train(self, examples: list[tuple[list[str], tuple]], rounds: int = ROUNDS, seed: int = 3) -> None:
        order = Random(seed)
        for _ in range(rounds):
            order.shuffle(examples)
            for features, truth in examples:
                self._now += 1
                s = self.scores(features)
                guess = max(sorted(s), key=s.get, default=KEEP)
                if guess != truth:
                    for f in features:
                        self._add(f, truth, 1.0)
                        self._add(f, guess, -1.0)
        self._average()

    def _average(self) -> None:
        for f, own in self.weights.items():
            for c in own:
                own[c] = (self._sums[f, c] + (self._now - self._stamps[f, c]) * own[c]) / max(1, self._now)
        self._sums.clear()
        self._stamps.clear()


def context(word: str, i: int) -> list[str]:
    """Characters around i; ^ and $ are the ends."""
    at = lambda k: word[k] if 0 <= k < len(word) else ("^" if k < 0 else "$")
    a, b, c, d, e = at(i - 2), at(i - 1), at(i), at(i + 1), at(i + 2)
    return [f"c{c}", f"bc{b}{c}", f"cd{c}{d}", f"bcd{b}{c}{d}", f"abc{a}{b}{c}", f"cde{c}{d}{e}"]


class Letters:
    """How usual runs of three letters are in the known words."""

    def __init__(self, lexicon: dict[str, int]):
        self.counts: Counter = Counter()
        for word in lexicon:
            padded = f"^{word}$"
            self.counts.update(padded[k : k + 3] for k in range(len(padded) - 2))

    def least(self, word: str, i: int, j: int) -> int:
        """0 (unheard of) to 5: the least usual run that touches the characters i to j."""
        padded = f"^{word}$"
        runs = [self.counts.get(padded[k : k + 3], 0) for k in range(max(0, i - 1), min(len(padded) - 2, j + 2))]
        return min(5, min(runs, default=0).bit_length())


def apply(word: str, i: int, op: tuple) -> str:
    """The word after one operation at i."""
    match op:
        case ("delete",):
            return word[:i] + word[i + 1 :]
        case ("replace", what):
            return word[:i] + what + word[i + 1 :]
        case ("merge", _, what):  # this character and the next
            return word[:i] + what + word[i + 2 :]
        case ("insert", what):
            return word[: i + 1] + what + word[i + 1 :]
    return word


def one_operation(word: str, known: dict[str, int] | set[str]) -> list[tuple[int, tuple, str]]:
    """All (place, operation, result) that make a known word; two-for-one replacements only where nothing simpler does."""
    got = []
    for i in range(len(word)):
        if (w := word[:i] + word[i + 1 :]) in known and not word[i].isalpha():
            got.append((i, ("delete",), w))
        for x in LETTERS:
            if x != word[i] and (w := word[:i] + x + word[i + 1 :]) in known:
                got.append((i, ("replace", x), w))
    if not got:
        for i in range(len(word)):
            if (w := word[:i] + word[i + 1 :]) in known:
                got.append((i, ("delete",), w))
            for x in LETTERS:
                if i + 1 < len(word) and (w := word[:i] + x + word[i + 2 :]) in known:
                    got.append((i, ("merge", word[i : i + 2], x), w))
                if (w := word[: i + 1] + x + word[i + 1 :]) in known:
                    got.append((i, ("insert", x), w))
    if not got:
        for i in range(len(word)):
            for x in LETTERS:
                for y in LETTERS:
                    if (w := word[:i] + x + y + word[i + 1 :]) in known:
                        got.append((i, ("replace", x + y), w))
    return got


class Editor:
    """Repairs words against a lexicon; see the module."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon  # word to the number of documents with it
        self.letters = Letters(lexicon)
        self.model = Perceptron()
        self.classes: dict[str, list[tuple]] = {}
        self.joins = Perceptron()
        self._cache: dict[str, tuple[str, int] | None] = {}

    def train(self, odd: Counter, ends: Iterable[tuple[str, str, str]]) -> None:
        """``odd``: scan words outside the lexicon with their counts; ``ends``: (half, mark, next half) of line ends."""
        pairs, kept = [], []
        for word in sorted(odd):
            if len(word) < 4 or word.isdigit():
                continue
            found = one_operation(word, self.lexicon)
            if len({w for _, _, w in found}) == 1:
                pairs.append((word, found[0][0], found[0][1]))
            elif not found:
                kept.append(word)
        seen = Counter((op, word[i]) for word, i, op in pairs)
        pairs = [(w, i, op) for w, i, op in pairs if seen[op, w[i]] >= LEAST_SEEN]
        by = defaultdict(set)
        for w, i, op in pairs:
            by[w[i]].add(op)
        self.classes = {c: sorted(ops) for c, ops in by.items()}
        clean = sorted(self.lexicon, key=lambda w: (-self.lexicon[w], w))[: max(200, len(pairs) // 4)]
        random = Random(5)
        examples = [self._choices(w, (i, op), random) for w, i, op in pairs]
        examples += [self._choices(w, None, random) for w in (*kept[: len(pairs)], *clean)]
        self.model.rank(examples)
        self.joins.train([(self._end(*e), t) for e in ends if (t := self._sure(*e))])

    def _choices(self, word: str, truth: tuple[int, tuple] | None, random: Random, most: int = 6) -> tuple[list[list[str]], int]:
        """Features of the right choice, of keeping the word, and of some other edits; and which is right."""
        options = self._options(word)
        others = [o for o in options if o != truth]
        wrong = random.sample(others, min(most, len(others)))
        lists = [self._kept(word), *(self._edited(word, *o) for o in wrong)]
        return ([self._edited(word, *truth), *lists], 0) if truth else (lists, 0)

    def _kept(self, word: str) -> list[str]:
        known = word in self.lexicon
        return ["keep", f"keep letters{self.letters.least(word, 0, len(word))}", f"keep known{known}", f"keep long{min(len(word), 9)}", f"keep ascii{word.isascii()}", f"keep plain{word.isalpha()}"]

    def _edited(self, word: str, i: int, op: tuple) -> list[str]:
        made = apply(word, i, op)
        n = self.lexicon.get(made, 0)
        size = 2 if op[0] == "merge" else 1
        name = " ".join(op)
        before, after = self.letters.least(word, i, i + size - 1), self.letters.least(made, i, i + len(op[-1]) - 1 if len(op) > 1 else i)
        return [f"edit {op[0]}", f"edit letters{before}{after}", f"edit known{min(3, n.bit_length() // 3) if n else -1}", f"edit known{bool(n)} letters{before}", f"edit sign{not word[i].isalpha()}", name, *(f"{name} {f}" for f in context(word, i))]

    def _sure(self, a: str, mark: str, b: str) -> tuple | None:
        joined, hyphened = (a + b) in self.lexicon, f"{a}-{b}" in self.lexicon
        if joined and hyphened:
            return KEEP if mark in "-‐‑" else ("join",)
        return None if joined == hyphened else ("join",) if joined else KEEP

    def _end(self, a: str, mark: str, b: str) -> list[str]:
        lex = self.lexicon
        joined, hyphened = lex.get(a + b, 0), lex.get(f"{a}-{b}", 0)
        plain = mark in "-‐‑"
        seam = self.letters.least(a + b, len(a) - 1, len(a))
        known = f"{a in lex}{b in lex}"
        both = f"{joined > 0}{hyphened > 0}"
        return ["bias", f"mark{mark}", f"words{both}", f"words{both}{plain}", f"halves{known}", f"halves{known}{both}", f"seam{seam}", f"seam{seam}{known}", f"end{a[-2:]}", f"start{b[:2]}", f"sizes{min(len(a), 6)}{min(len(b), 6)}"]

    def joined(self, a: str, mark: str, b: str) -> bool:
        """Whether a line that ends in a and the mark goes on in b as one word."""
        s = self.joins.scores(self._end(a, mark, b))
        return s.get(("join",), 0.0) > s.get(KEEP, 0.0)

    def edit(self, word: str) -> tuple[str, int] | None:
        """(known word, place of the first edit) for a misread word; None where the editor keeps it."""
        if word in self._cache:
            return self._cache[word]
        if len(self._cache) > 500_000:
            self._cache.clear()
        got = self._cache[word] = self._edit(word)
        return got

    def _edit(self, word: str) -> tuple[str, int] | None:
        low = word.lower()
        flips = [i for i, c in enumerate(word) if c != low[i : i + 1]] if len(low) == len(word) else []
        if flips and low in self.lexicon:
            return low, flips[0]
        keep = self.model.score(self._kept(low))
        options = self._options(low)
        known = [(i, op, w) for i, op in options if (w := apply(low, i, op)) in self.lexicon]
        scored = sorted(((-self.model.score(self._edited(low, i, op)), i, w) for i, op, w in known))
        if scored:
            return (scored[0][2], scored[0][1]) if -scored[0][0] > keep else None
        best: tuple[float, str, int] | None = None
        if len(low) >= 6:
            for i, op in options:
                once = apply(low, i, op)
                first = None
                for k, op2 in self._options(once):
                    if (w := apply(once, k, op2)) in self.lexicon:
                        first = self.model.score(self._edited(low, i, op)) if first is None else first
                        total = first + self.model.score(self._edited(once, k, op2))
                        if best is None or total > best[0]:
                            best = (total, w, min(i, k))
        return (best[1], best[2]) if best and best[0] > keep else None

    def _options(self, word: str) -> list[tuple[int, tuple]]:
        """All (place, operation) that the pairs have shown for the characters of the word."""
        return [(i, op) for i, c in enumerate(word) for op in self.classes.get(c, ()) if op[0] != "merge" or word[i : i + 2] == op[1]]


END = regex.compile(rf"(?<![\p{{L}}\p{{N}}'’])(\p{{L}}[\p{{L}}'’^~|_·]*)([{MARKS}])[^\S\n]*$")
START = regex.compile(r"^[^\S\n]*(\p{Ll}[\p{L}'’^~|_·]*)")
