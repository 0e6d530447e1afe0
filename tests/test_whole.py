"""Queries that cover whole tables, against brute force."""

import pytest
import regex
from pyspark.sql import functions as F

from archivolt.operators import facets, pipelines
from archivolt.operators.graph import components
from archivolt.queries.registry import QUERIES
from oracle import FOLDER, database


def least_of_each(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_stars_have_the_components_of_all_pairs(spark):
    rows = [(e, c) for c in range(30) for e in {7 * c % 41, 5 * c % 43 + 100 * (c % 3), c % 4 + 200}] + [(900, 77), (900, 77), (901, 78), (902, 78), (5, 999)]
    m, chunks = spark.createDataFrame(rows, "entity_id long, chunk_id long"), spark.createDataFrame([(c,) for c in (*range(30), 77, 78)], "chunk_id long")
    got = {r.node: r.component for r in components(facets.stars(m, chunks), "entity_id", "other_id").collect()}
    want = least_of_each([(a, b) for a, c in rows for b, k in rows if c == k and a < b and c != 999])
    assert got == want and 900 not in got and got[902] == 901


@pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")
def test_components_of_all_documents(spark):
    lines = database().execute("select distinct l_orderkey, l_partkey, l_suppkey + 10000000 from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey").fetchall()
    by_chunk = {}
    for c, *own in lines:
        by_chunk.setdefault(c, []).extend(own)
    want = least_of_each([(own[0], e) for own in by_chunk.values() for e in own])
    got = {r.entity_id: r.component for r in QUERIES["entity_components"](spark, str(FOLDER)).collect()}
    assert got == want


@pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")
def test_pool_of_all_documents(spark):
    rows = database().execute("select c_mktsegment, o_orderkey, year(o_orderdate) from orders join customer on c_custkey = o_custkey order by 1, 2").fetchall()
    want, seen = [(c, y) for _, c, y in rows[:3]], {y for *_, y in rows[:3]}
    for _, c, y in rows:
        if y not in seen:
            seen.add(y)
            want.append((c, y))
    assert sorted(map(tuple, QUERIES["candidate_pool"](spark, str(FOLDER)).collect())) == sorted(want)


@pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")
def test_pairs_and_degrees_of_all_mentions(spark):
    lines = database().execute("select l_orderkey, l_partkey, l_suppkey + 10000000, c_mktsegment from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey").fetchall()
    own, near, both = {}, {}, {}
    for c, part, place, segment in lines:
        own.setdefault((c, segment), set()).update((part, place))
    for (_, segment), of in own.items():
        for a in of:
            near.setdefault(a, set()).update(of - {a})
            for b in of:
                if segment == "BUILDING" and a < b:
                    both[a, b] = both.get((a, b), 0) + 1
    assert {r.entity_id: r.degree for r in QUERIES["undirected_neighbours"](spark, str(FOLDER)).collect()} == {a: len(n) for a, n in near.items() if n}
    assert {(r.entity_id, r.other_id): r.n_chunks for r in QUERIES["facet_co_mentions"](spark, str(FOLDER)).collect()} == {p: n for p, n in both.items() if n >= 2}


def test_alias_matches_of_any_length(spark):
    chunks = spark.createDataFrame([(1, "one two three four five six seven and three")], "chunk_id int, t string")
    aliases = spark.createDataFrame([("two three four five six seven",), ("three",), ("three four",)], "alias string")
    got = sorted((r.start, r.alias, r.words) for r in pipelines.alias_matches(chunks, aliases, F.col("t")).collect())
    assert got == [(2, "two three four five six seven", 6), (9, "three", 1)]
    assert pipelines.alias_matches(chunks, aliases.limit(0), F.col("t")).count() == 0


@pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")
def test_alias_matches_of_the_whole_dictionary(spark):
    con = database()
    names = {" ".join(a.split()).lower() for (a,) in con.execute("select alias_norm from alias_stats where alias_norm is not null").fetchall()} - {""}
    want = set()
    for chunk, body in con.execute("select chunk_id, coalesce(clean_text, text) from chunks").fetchall():
        words, i = regex.findall(r"[\p{L}\p{N}_]+", (body or "").lower()), 0
        while i < len(words):
            n = next((n for n in range(8, 0, -1) if i + n <= len(words) and " ".join(words[i : i + n]) in names), 0)
            if n:
                want.add((chunk, " ".join(words[i : i + n]), i + 1, n))
            i += n or 1
    got = [tuple(r) for r in QUERIES["alias_matches"](spark, str(FOLDER)).collect()]
    assert set(got) == want and len(got) == len(want) and any(n == 1 for *_, n in want)
