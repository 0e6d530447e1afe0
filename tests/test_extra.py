"""Chunkers, lanes, window matches, dates and reading costs against plain versions."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from archivolt.functions import dates, distance
from archivolt.operators import chunking as C
from archivolt.operators import lanes as N
from archivolt.operators import review as V


def test_overlapping_blocks(spark):
    df = spark.createDataFrame([(1, "One two. Three four. Five six. Seven eight nine."), (2, ""), (3, None), (4, "x" * 50 + ".")], "k int, t string")
    got = [(r.k, r.ordinal, r.text) for r in C.overlapping(df, "k", "t", 22, 1).collect()]
    assert got == [(1, 0, "One two. Three four."), (1, 1, "Three four. Five six."), (1, 2, "Seven eight nine."), (4, 0, "x" * 50 + ".")]


def test_long_pages_are_filled_by_lines(spark):
    df = spark.createDataFrame([(1, "aa\nbb\ncc\ndd"), (2, " "), (3, None), (4, "short")], "k int, t string")
    got = [(r.k, r.ordinal, r.text) for r in C.by_page(df, "k", "t", 5).collect()]
    assert got == [(1, 0, "aa\nbb"), (1, 1, "cc\ndd"), (4, 0, "short")]


def test_window_matches(spark):
    chunks = spark.createDataFrame([(1, "saw edward logrilasek and edwrad logrilasek, john smith jones, john jones")], "chunk_id int, t string")
    aliases = spark.createDataFrame([("edward logrilasek",), ("john smith jones",), ("saw",)], "alias string")
    got = {(r.start, r.alias, r.kind, r.edits) for r in V.window_matches(chunks, aliases, F.col("t")).collect()}
    assert got == {(1, "saw", "exact", 0), (2, "edward logrilasek", "exact", 0), (5, "edward logrilasek", "fuzzy", 2), (7, "john smith jones", "exact", 0), (7, "john smith jones", "partial", 0), (8, "john smith jones", "partial", 0), (10, "john smith jones", "partial", 0)}
    assert V.window_matches(chunks.limit(0), aliases, F.col("t")).count() == 0


def test_rounds_of_lanes(spark):
    m = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 11), (2, 12), (2, 13), (3, 12), (3, 13), (9, 99)], "entity_id long, chunk_id long")
    got = {r.chunk_id: r["round"] for r in N.rounds(m, [1], 1, 4, 2).collect()}
    assert got == {10: 0, 11: 0, 12: 1, 13: 1}


def test_expanded_query():
    assert N.expanded_query("KGB agents", ["kgb", "Cheka", "State Security", "Cheka"]) == 'KGB agents OR Cheka OR "State Security"'
    assert N.expanded_query("x", []) == "x" and "ciphers" in N.rewrites("cipher-clerk")


@pytest.mark.parametrize(
    "text, want",
    [
        ("on 5 May 1944,", ("5 May 1944", date(1944, 5, 5), date(1944, 5, 5), "day")), ("on May 5th, 1944.", ("May 5th, 1944", date(1944, 5, 5), date(1944, 5, 5), "day")), ("5th Sept. 1944", ("5th Sept. 1944", date(1944, 9, 5), date(1944, 9, 5), "day")),
        ("at 12/31/1944", ("12/31/1944", date(1944, 12, 31), date(1944, 12, 31), "day")), ("31.12.44", ("31.12.44", date(1944, 12, 31), date(1944, 12, 31), "day")), ("1944-02-29", ("1944-02-29", date(1944, 2, 29), date(1944, 2, 29), "day")),
        ("(1941-1945)", ("1941-1945", date(1941, 1, 1), date(1945, 12, 31), "range")), ("Since 1944 he", ("Since 1944", date(1944, 1, 1), date(1944, 12, 31), "year")), ("February 1944", ("February 1944", date(1944, 2, 1), date(1944, 2, 29), "month")),
        ("31/12/1944", None), ("30 February 1944", None), ("1945-1941", None), ("No. 1944", None), ("", None), (None, None),
    ],
)
def test_dates(spark, text, want):
    got = [(r.surface, r.date_start, r.date_end, r.precision) for r in dates.date_mentions(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()]
    assert got == ([want] if want else [])


def test_reading_costs():
    d, n = distance.ocr_distance, distance.normalized_ocr_distance
    assert n("", "") == 0 and n("abc", "") == n("", "abc") == 1 and n("abc", "xyz") > 0.5 and n("test", "test") == 0
    assert d("file", "fi1e") < d("file", "fixe") and d("LOOK", "L00K") < d("LOOK", "LXXK") and d("a", "A") < 0.3
    assert d("modern", "modem") == pytest.approx(0.2) and d("o'neil", "oneil") == pytest.approx(0.1) and d("ab", "ba") == 2


def test_near_words_against_all_pairs(spark):
    rng = random.Random(12)
    words = {"".join(rng.choice("abc") for _ in range(n)) for n in (3, 4, 5, 6, 7, 22, 23, 24, 25, 26, 27, 40, 90) for _ in range(6)}
    for w in sorted(words):
        for _ in range(3):
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[: i // 2] + "c" + w[i // 2 : i] + w[i + 1 :], "x" + w[1:] + "y", "xy" + w, w[2:], w[: i // 2] + "a" + w[i // 2 :] + "q"]))
    words.add("z" * 5000)
    odd = spark.createDataFrame([(w,) for w in words if len(w) >= 5], "odd string")
    seen = spark.createDataFrame([(w,) for w in words if len(w) >= 3], "seen string")
    want = {(r.odd, r.seen, r.e) for r in odd.join(seen, F.col("odd") != F.col("seen")).withColumn("e", F.levenshtein("odd", "seen", 2)).where("e >= 0").collect()}
    got = [tuple(r) for r in V.near_words(odd, seen, 2).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_two_letters_for_one_are_looked_up_only_where_they_are_known(monkeypatch):
    """The distance asks for the cost of a pair of letters once, and looks up known costs of single letters in its memo."""
    asked = []
    monkeypatch.setattr(distance, "reading_cost", lambda a, b: asked.append((a, b)) or 1.0)
    distance.ocr_distance.cache_clear()
    assert distance.ocr_distance("barn clerk", "bam derk") == 0.5 and not asked
    distance.ocr_distance.cache_clear()
