"""Near-duplicates at exactly the share asked for, with seams, hot n-grams and texts too short for n-grams."""

import random
from collections import Counter

import numpy as np
import pytest

D = pytest.importorskip("archivolt.llm.neardup")


def words(rng, n, vocabulary=4000):
    return [rng.randrange(vocabulary) for _ in range(n)]


def linked(spark, texts, **more):
    df = spark.createDataFrame([(k, [int(x) for x in w]) for k, w in texts.items()], "key long, words array<int>")
    return {(r.a, r.b) for r in D.links(df, **more).collect()}


def alike(x, y, share=0.8):
    both = sum((Counter(x) & Counter(y)).values())
    return both >= share * max(len(x), len(y)) - 1e-9


def test_every_fifth_word_replaced_is_found(spark):
    rng = random.Random(5)
    texts = {}
    for i, n in enumerate((60, 75, 100, 240, 500)):
        a = words(rng, n)
        texts[2 * i] = a
        texts[2 * i + 1] = [w if k % 5 != 4 else 10_000 + 100 * i + k for k, w in enumerate(a)]
    assert all(alike(texts[2 * i], texts[2 * i + 1]) for i in range(5))
    assert linked(spark, texts) == {(2 * i, 2 * i + 1) for i in range(5)}


def test_seams_are_allowed(spark):
    rng = random.Random(6)
    texts, want = {}, set()
    for i, n in enumerate((120, 200, 400)):
        a = words(rng, n)
        cut = n // 3
        moved = a[cut : 2 * cut] + a[:cut] + a[2 * cut :]  # three seams, the ends among them
        texts[2 * i], texts[2 * i + 1] = a, [w if k % 6 else 20_000 + k + 1000 * i for k, w in enumerate(moved)]
        want.add((2 * i, 2 * i + 1))
    assert linked(spark, texts) == want


def test_against_all_pairs(spark):
    rng = random.Random(7)
    texts = {}
    phrase = words(rng, 12)  # a set phrase that a third of the texts has
    for i in range(60):
        a = words(rng, rng.choice((8, 20, 50, 90, 150)), 600)
        if i % 3 == 0:
            a = phrase + a
        texts[10 * i] = a
        for c in range(rng.randrange(3)):
            b = list(a)
            for k in rng.sample(range(len(b)), int(0.2 * len(b))):
                b[k] = 50_000 + rng.randrange(5000)
            texts[10 * i + c + 1] = b
    texts[9001] = [7] * 40
    texts[9002] = [7] * 41
    keys = sorted(texts)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if alike(texts[a], texts[b])}
    assert linked(spark, texts) == want and (9001, 9002) in want


def test_hot_tokens_are_split(spark):
    rng = random.Random(8)
    phrase = words(rng, 6)
    texts = {i: phrase + words(rng, 30, 10**6) for i in range(80)}
    texts[500] = texts[3][:-2] + [1, 2]
    df = spark.createDataFrame([(k, [int(x) for x in w]) for k, w in texts.items()], "key long, words array<int>")
    told = D.surveyed(df, 0.8, 0)
    assert told.where("what = 'frequent' and n >= 80").count() == 6
    got = {(r.a, r.b) for r in D.met(df, told, 0.8, 0, 0.0, hot=10).collect()}
    assert (3, 500) in got and got == {(r.a, r.b) for r in D.met(df, told, 0.8, 0, 0.0, hot=10**6).collect()}


def test_hot_tokens_inside_the_rare_part(spark):
    rng = random.Random(9)
    texts = {i: [rng.randrange(14) for _ in range(12)] for i in range(120)}
    df = spark.createDataFrame([(k, w) for k, w in texts.items()], "key long, words array<int>")
    told = D.surveyed(df, 0.8, 0)
    want = {(a, b) for a in texts for b in texts if a < b and alike(texts[a], texts[b])}
    for hot in (7, 10**6):
        got = [(r.a, r.b) for r in D.met(df, told, 0.8, 0, 0.0, hot=hot).collect()]
        assert want and want <= set(got) and len(got) == len(set(got))


def test_short_lists_of_words(spark):
    df = spark.createDataFrame([(1, [5]), (2, [5]), (3, [6])], "key long, words array<int>")
    assert {(r.a, r.b) for r in D.links(df).collect()} == {(1, 2)}
    assert D.links(df.limit(0)).count() == 0
    assert list(D.n_grams(np.array([1, 2, 3]), 4)) == [] and len(D.numbered_words(np.array([1, 1, 1, 2]))) == 4


def test_small_blocks_give_the_same_pairs(spark):
    rng = random.Random(10)
    texts = {}
    for i in range(50):
        a = words(rng, rng.choice((5, 9, 30, 31, 60, 120)), 500)
        texts[10 * i] = a
        for c in range(rng.randrange(3)):
            texts[10 * i + c + 1] = [w if rng.random() > 0.12 else 40_000 + rng.randrange(900) for w in a]
    texts[9001], texts[9002], texts[9003] = [7] * 40, [7] * 41, [7]
    keys = sorted(texts)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if alike(texts[a], texts[b])}
    assert len(want) > 20 and linked(spark, texts, block=7) == linked(spark, texts, block=3) == want


def test_no_pair_is_shuffled_before_its_words_are_compared(spark):
    df = spark.createDataFrame([(k, [k, k + 1, 5, 6, 7, 8, 9]) for k in range(30)], "key long, words array<int>")
    plan = D.links(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") <= 1
