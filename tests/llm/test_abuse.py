"""Abuse scores: the automaton against brute force, misspelled words on held-out noise, sentences outside the lists' templates."""

import random

import pytest

abuse = pytest.importorskip("archivolt.llm.abuse")
from archivolt.llm.automaton import Automaton, Trie


def edits(a, b):
    """Optimal string alignment."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_all_distances():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(300)})
    trie = Trie(words)
    for _ in range(200):
        token = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
        for most in (0, 1, 2):
            assert {w: e for e, w in Automaton(token, False).words(trie, most)} == {w: d for w in words if (d := edits(token, w)) <= most}, (token, most)


@pytest.mark.parametrize("token", ["wh*re", "w.h.o.r.e", "whhhore", "wh0re", "w-hore", "WHORE".lower()])
def test_masks_cost_nothing(token):
    assert (0, "whore") in Automaton(token).words(Trie(["whore", "where", "shore"]), 0)


def top(scorer, text):
    return max((v for v, _ in scorer.score(text).values()), default=0.0)


@pytest.fixture(scope="module")
def scorer():
    return abuse.Scorer()


@pytest.mark.parametrize(
    "text",
    ["I will murder you tomorrow", "I am going to stab you", "all of them should be shot", "you stupid jackass", "you worthless scumbag", "we must exterminate these people", "Ich werde dich umbringen", "They said: I'll cut your throat.", "Those people are vermin.", "You should hang yourself", "Je vais te tuer.", "Мы знаем, я убью тебя"],
)
def test_sentences_outside_the_idioms(scorer, text):
    assert top(scorer, text) >= abuse.LEAST


@pytest.mark.parametrize(
    "text",
    ["The editor decided to kill the story.", "He told the whole story and you count the money.", "The rifles were shot at a target.", "You must cut the costs and break with the old rules.", "The rats in the trap were vermin for the farmer.", "They should be paid.", "The bitch whelped a litter of four.", "The judge spoke of a murder and of threats.", "The drug will kill the pain.", "", " "],
)
def test_sober_sentences(scorer, text):
    assert top(scorer, text) < abuse.LEAST


def noisy(rng, word):
    i = rng.randrange(1, len(word) - 1)
    match rng.randrange(6):
        case 0:
            return word[:i] + rng.choice("bdfgkmnpvz") + word[i + 1 :]
        case 1:
            return word[:i] + word[i + 1 :]
        case 2:
            return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
        case 3:
            return word[:i] + rng.choice("*.-") + word[i:]
        case 4:
            return word[:i] + word[i] * 3 + word[i + 1 :]
        case _:
            return word[:i] + "*" + word[i + 1 :]


def test_held_out_noise_needs_the_automaton(scorer):
    """One listed word of each sentence is misspelled or masked at random; without the automaton most are lost."""
    rng = random.Random(11)
    frames = ["You are a {moron}.", "What a {bastard} you are.", "I told that {whore} to leave.", "I am going to {strangle} you.", "We must {exterminate} these people.", "They should be {gassed}.", "You stupid {idiot}, go home.", "He called him a {wanker}.", "I will {murder} you."]
    texts = []
    for _ in range(300):
        f = rng.choice(frames)
        word = f[f.index("{") + 1 : f.index("}")]
        texts.append(f.replace("{" + word + "}", noisy(rng, word)))
    off = abuse.Scorer(fuzzy=False)
    on, without = (sum(top(s, t) >= abuse.LEAST for t in texts) for s in (scorer, off))
    assert on >= 0.85 * len(texts) and without <= 0.9 * on, (on, without)
