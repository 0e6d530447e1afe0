"""A Levenshtein automaton as bit masks, intersected with a trie of words.

State i of an error level is a bit: a prefix of the trie's word has been read
as the token's first i characters. One letter of the trie moves all states of
all levels at once. Characters that mask a letter cost nothing: signs of a like
look, marks put between letters, repeats of the letter before, and a star for
any letter; a wrong, missing or added letter and a swap of neighbours cost one.
"""

from __future__ import annotations

from collections.abc import Iterable

#: Signs and the letters they stand for; fixed values.
LEET = {"@": "a", "4": "a", "$": "s", "5": "s", "0": "o", "1": "il", "!": "il", "|": "il", "3": "e", "€": "e", "7": "t", "+": "t", "8": "b", "6": "g", "9": "g"}


class Trie:
    """Words as nested dicts; ``None`` holds the word that ends here."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[None] = word


class Automaton:
    """Accepts the words that a token may be a spelling of."""

    def __init__(self, token: str, masks: bool = True):
        self.n = len(token)
        self.on: dict[str, int] = {}
        self.any = 0
        self.free = 0  # characters that may be passed over at no cost
        for i, c in enumerate(token):
            bit = 1 << i
            if masks and c == "*":
                self.any |= bit
                self.free |= bit
                continue
            for x in (c, *(LEET.get(c, "") if masks else "")):
                self.on[x] = self.on.get(x, 0) | bit
            if masks and (not c.isalnum() or (i and (c == token[i - 1] or c in LEET and token[i - 1] in LEET[c]))):
                self.free |= bit

    def _closed(self, levels: list[int]) -> list[int]:
        """States reached without a letter of the trie: masks passed over, letters of the token that are too many."""
        got = []
        for e, r in enumerate(levels):
            if e:
                r |= got[e - 1] << 1
            while (more := r | (r & self.free) << 1) != r:
                r = more
            got.append(r & ((1 << self.n + 1) - 1))
        return got

    def words(self, trie: Trie, most: int) -> list[tuple[int, str]]:
        """(errors, word) of the trie's words within ``most`` errors, the nearest first."""
        if most == 1 and not self.free and not self.any:
            return self._one(trie)
        if most == 2 and not self.free and not self.any:
            return self._two(trie)
        found: dict[str, int] = {}
        none = [0] * (most + 1)
        todo = [(trie.root, self._closed([1, *none[1:]]), none)]
        end = 1 << self.n
        while todo:
            node, levels, swapped = todo.pop()
            for c, below in node.items():
                if c is None:
                    for e, r in enumerate(levels):
                        if r & end:
                            found[below] = min(e, found.get(below, e))
                            break
                    continue
                on = self.on.get(c, 0) | self.any
                moved = []
                for e in range(most + 1):
                    r = (levels[e] & on) << 1
                    if e:
                        r |= levels[e - 1] << 1 | levels[e - 1] | (swapped[e - 1] & on) << 2
                    moved.append(r)
                moved = self._closed(moved)
                if any(moved) or most and any(swapped):
                    half = [levels[e] & on >> 1 for e in range(most + 1)] if most else none
                    if any(moved) or any(half):
                        todo.append((below, moved, half))
        return sorted((e, w) for w, e in found.items())

    def _one(self, trie: Trie) -> list[tuple[int, str]]:
        """The same for one error and a token without masks: without a state that is free of errors only the token's own letters lead on."""
        found: dict[str, int] = {}
        on_, full, end = self.on, (1 << self.n + 1) - 1, 1 << self.n
        todo = [(trie.root, 1, 3 & full, 0)]
        while todo:
            node, r0, r1, swapped = todo.pop()
            for c in node if r0 else on_:
                below = node.get(c)
                if below is None or c is None:
                    continue
                on = on_.get(c, 0)
                m0 = (r0 & on) << 1
                m1 = ((r1 & on) << 1 | r0 << 1 | r0 | (swapped & on) << 2 | m0 << 1) & full
                half = r0 & on >> 1
                if m0 or m1 or half:
                    word = below.get(None)
                    if word is not None and (m0 | m1) & end:
                        found[word] = min(0 if m0 & end else 1, found.get(word, 1))
                    todo.append((below, m0, m1, half))
        return sorted((e, w) for w, e in found.items())

    def _two(self, trie: Trie) -> list[tuple[int, str]]:
        """The same for two errors."""
        found: dict[str, int] = {}
        on_, full, end = self.on, (1 << self.n + 1) - 1, 1 << self.n
        todo = [(trie.root, 1, 3 & full, 7 & full, 0, 0)]
        while todo:
            node, r0, r1, r2, s0, s1 = todo.pop()
            for c in node if r0 | r1 else on_:
                below = node.get(c)
                if below is None or c is None:
                    continue
                on = on_.get(c, 0)
                m0 = (r0 & on) << 1
                m1 = ((r1 & on) << 1 | r0 << 1 | r0 | (s0 & on) << 2 | m0 << 1) & full
                m2 = ((r2 & on) << 1 | r1 << 1 | r1 | (s1 & on) << 2 | m1 << 1) & full
                h0, h1 = r0 & on >> 1, r1 & on >> 1
                if m0 | m1 | m2 | h0 | h1:
                    word = below.get(None)
                    if word is not None and (m0 | m1 | m2) & end:
                        found[word] = min(0 if m0 & end else 1 if m1 & end else 2, found.get(word, 2))
                    todo.append((below, m0, m1, m2, h0, h1))
        return sorted((e, w) for w, e in found.items())
