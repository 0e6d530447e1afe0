"""Core operators against brute force on small tables."""

import random
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.functions.dates import relative_range
from archivolt.functions.distance import ocr_distance
from archivolt.operators import evidence, pipelines
from archivolt.operators.graph import components
from archivolt.operators.retrieval import fused, search_filter
from archivolt.plans.compiler import Tables, scope
from archivolt.plans.primitives import Primitive, canonical, dumps, loads, parse_query, patch, plan_hash, websearch
from archivolt.plans.primitives import primitive as P
from archivolt.sources import io


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + [(None, 5)], "a int, b int")).collect()}
    want = {}
    for x in {n for e in edges for n in e}:
        want[x] = min(y for y in {n for e in edges for n in e} if find(y) == find(x))
    assert got == want
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_scalars(spark):
    one = spark.createDataFrame([("  The O'Connor-Smith, Ltd.  ", "re-\n port ﬁle", None)], "a string, b string, c string")
    r = one.select(X.normalize_surface("a").alias("s"), X.norm_key("a").alias("k"), X.normalize_fts("b").alias("f"), X.variant_key("a").alias("v"), X.acronym("a").alias("i"), X.normalize_surface("c").alias("n"), X.quality_class("c").alias("q"), X.trigram_similarity("a", "a").alias("t"), X.normalize_fts("b", "norm_v1").alias("f1")).first()
    assert (r.s, r.k, r.f, r.v, r.i, r.n, r.q, r.t) == ("the oconnorsmith ltd", "the o'connor smith ltd", "report file", "theoconnorsmithltd", "TOCSL", None, "unknown", 1.0)
    assert r.f1 == "re-\n port ﬁle"
    with pytest.raises(ValueError):
        X.normalize_fts("b", "norm_v9")


def test_words(spark):
    df = spark.createDataFrame([("alpha beta gamma beta delta",), ("",), (None,)], "t string").select(X.tokens("t").alias("w"))
    r = df.select(X.has_phrase("w", "beta gamma").alias("p"), X.has_phrase("w", "gamma delta").alias("q"), X.min_distance("w", "alpha", "delta").alias("d"), X.has_phrase("w", "").alias("e"), X.headline("w", "gamma", 1, 3).alias("h")).collect()
    assert [tuple(x) for x in r] == [(True, False, 4, False, "beta gamma beta"), (False, False, None, False, None), (None, None, None, False, None)]


def test_distance_of_scans():
    assert ocr_distance("rnodern", "modern") == pytest.approx(0.2)
    assert ocr_distance("l", "1") < 0.3 and ocr_distance("a", "z") == 1.0 and ocr_distance("", "ab") == 2.0


def test_relative_dates():
    now = date(1950, 3, 15)
    assert relative_range("last month", now) == (date(1950, 2, 1), date(1950, 2, 28))
    assert relative_range("2 years ago", now) == (date(1948, 3, 1), date(1948, 3, 31))
    assert relative_range("before 1944", now) == (None, date(1943, 12, 31))
    assert relative_range("the 1940s", now) == (date(1940, 1, 1), date(1949, 12, 31))
    assert relative_range("December 1944", now) == (date(1944, 12, 1), date(1944, 12, 31))
    assert relative_range("soon", now) is None


def test_primitives():
    plan = [P("TERM", value="b"), P("ENTITY", entity_id=3), P("TERM", value="a"), P("OR_GROUP", primitives=[P("TERM", value="x")])]
    assert loads(dumps(plan)) == plan
    assert plan_hash(plan) == plan_hash(plan[::-1] + plan[:1]) and canonical(plan)[0].value == "a"
    assert Primitive.from_json({"type": "CO_OCCURS_WITH", "entity_id": 1, "other_entity_id": 2}).entity_b == 2
    for bad in (("CO_OCCURS_WITH", {"entity_a": 1, "entity_b": 1}), ("ENTITY", {"entity_id": 0}), ("FIRST_CO_MENTION", {"entity_ids": [4]}), ("TERM", {}), ("TERM", {"value": "a", "more": 1}), ("NONE", {})):
        with pytest.raises(ValueError):
            Primitive(*bad)
    assert [p.kind for p in patch(plan, remove={"type": "TERM"}, add=[P("COUNT")])] == ["ENTITY", "OR_GROUP", "COUNT"]
    assert patch(plan, replace=[({"type": "ENTITY"}, P("ENTITY", entity_id=9))])[1].entity_id == 9
    q = parse_query('find("office NEAR clerk", window=7)')
    assert (q.op, q.terms, q.window) == ("near", ("office", "clerk"), 7)
    assert parse_query("plain words").terms == ("plain words",)
    with pytest.raises(ValueError):
        parse_query("  ")
    assert websearch('"a b" c OR d OR') == [[("phrase", "a b"), ("term", "c")], [("term", "d")]]


def test_result_set_scope(spark):
    meta = spark.createDataFrame([(i, i % 2, "c", None, None, ["q"] if i % 3 else ["a", "q"]) for i in range(6)], "chunk_id long, document_id int, collection_slug string, date_min date, date_max date, speaker_norms array<string>")
    sets = spark.createDataFrame([(1, [1, 2, None, 2]), (2, [3]), (3, [2])], "result_set_id int, chunk_ids array<long>")
    t = Tables(meta, result_sets=sets)
    ids = lambda *plan: sorted(r.chunk_id for r in scope(meta, list(plan), t).collect())
    assert ids(P("WITHIN_RESULT_SET", result_set_id=1), P("WITHIN_RESULT_SET", result_set_id=2)) == [1, 2, 3]
    assert ids(P("WITHIN_RESULT_SET", result_set_id=99)) == []
    assert ids(P("WITHIN_RESULT_SET", result_set_id=1), P("EXCLUDE_RESULT_SET", result_set_id=3)) == [1]
    assert ids(P("SPEAKER_FILTER", speakers=["a", "q"], mode="all")) == [0, 3]


def test_fusion_and_filter(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "chunk_id long, rank int")
    got = [(r.chunk_id, r.rank) for r in fused({"a": (a, 1.0), "b": (b, 1.0)}).collect()]
    assert got == [(2, 1), (1, 2), (3, 3)]
    assert fused({"a": (a, 1.0), "b": (b, 1.0)}, how="inner").count() == 1
    assert fused({"a": (a.limit(0), 1.0), "b": (b.limit(0), 1.0)}).count() == 0
    rows = spark.createDataFrame([(1, None), (2, "x")], "chunk_id long, collection_slug string")
    assert search_filter(rows, not_collections=["x"]).count() == 1 and search_filter(rows, collections=["x"]).count() == 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab \n", max_size=30), max_size=6))
def test_packing_keeps_everything(paragraphs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    text = "\n\n".join(paragraphs)
    got = [r.text for r in pipelines.packed(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", 40).orderBy("ordinal").collect()]
    import re

    parts = [p.strip(" ") for p in re.split(r"\n\s*\n", text)]
    want: list[str] = []
    for p in (p for p in parts if p):
        if want and len(want[-1]) + len(p) + 2 <= 40:
            want[-1] += "\n\n" + p
        else:
            want.append(p)
    assert got == want


def test_packing(spark):
    test_packing_keeps_everything()


def test_trigram_join_against_all_pairs(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    df = spark.createDataFrame([(n,) for n in [*names, None, ""]], "s string")
    got = {(r.a, r.b): r.similarity for r in pipelines.trigram_join(df, df, "s", "s", 0.4).collect()}
    x, y = df.where("s <> ''").distinct(), df.where("s <> ''").distinct().withColumnRenamed("s", "z")
    want = {(r.s, r.z): r.v for r in x.join(y, F.col("s") != F.col("z")).withColumn("v", X.trigram_similarity("s", "z")).where("v >= 0.4").collect()}
    assert got == want


def test_alias_matches_longest_leftmost(spark):
    chunks = spark.createDataFrame([(1, "the red army group met the red army and army"), (2, None), (3, "")], "chunk_id int, t string")
    aliases = spark.createDataFrame([("red army",), ("army group",), ("red army group",), ("army",)], "alias string")
    got = sorted((r.start, r.alias) for r in pipelines.alias_matches(chunks, aliases, F.col("t")).collect())
    assert got == [(2, "red army group"), (7, "red army"), (10, "army")]


def test_upsert_snapshot_and_junction(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (None, "m"), (2, "c")], "k int, v string")
    assert sorted(r.v for r in io.upserted(old, new, ["k"]).collect()) == ["b", "c", "m"]
    assert sorted(r.v for r in io.upserted(old, new, ["k"], "nothing").collect()) == ["a", "c", "n"]
    io.write_snapshot(old, str(tmp_path / "s"))
    with pytest.raises(Exception):
        io.write_snapshot(old, str(tmp_path / "s"))
    j = io.junction(spark.createDataFrame([(1, [5, None, 4, 5]), (2, []), (3, None)], "result_set_id int, chunk_ids array<int>"))
    assert [tuple(r) for r in j.select("result_set_id", "chunk_id", "rank").orderBy("rank").collect()] == [(1, 5, 1), (1, 4, 2)]
    io.append_log(spark, str(tmp_path / "log"), [{"run": 1, "config": {"k": 2}}], "run int, config string")
    assert spark.read.parquet(str(tmp_path / "log")).first().config == '{"k": 2}'
    assert io.head_tail_random(spark.range(100), "id", 9).count() == 9
    (tmp_path / "a.txt").write_text("one\ftwo")
    assert [r.raw_text for r in io.pages_of_files(spark, str(tmp_path / "a.txt")).orderBy("page_seq").collect()] == ["one", "two"]


def test_overrides_scoped_before_global(spark):
    c = spark.createDataFrame([("m", 1, 10, 0.9), ("m", 1, 11, 0.5), ("m", 2, 10, 0.9), ("z", 1, 12, 0.4)], "surface string, scope_id long, entity_id long, score double")
    o = spark.createDataFrame([("m", None, 50, None, False), ("m", 1, 51, None, False), ("z", None, None, None, True)], "surface string, scope_id long, forced_entity_id long, banned_entity_id long, banned boolean")
    got = sorted((r.surface, r.scope_id, r.entity_id, r.reason) for r in pipelines.overridden(c, o).collect())
    assert got == [("m", 1, 51, "forced"), ("m", 2, 50, "forced")]


def test_evidence(spark):
    chunks = spark.createDataFrame([(1, "No cipher here. The embassy had a cipher! Nothing."), (2, None)], "chunk_id int, body string")
    s = evidence.spans(chunks, "chunk_id", "body", ["cipher", "embassy"])
    assert [(r.sentence, r.n_hits) for r in s.orderBy("sentence").collect()] == [(0, 1), (1, 2)]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "k int, other int")
    assert sorted(r.k for r in evidence.expanded_until_stable(spark.createDataFrame([(1,)], "k int"), links, "k").collect()) == [1, 2, 3]
    assert pipelines.parse_page_list("3, 5–7; 12") == [3, 5, 6, 7, 12]


def test_metadata_sync_and_samples(spark):
    from archivolt.operators.mentions import one_metadata

    rows = spark.createDataFrame([(1, "v1", 5), (1, "v2", 9), (2, "v3", 1), (2, "v3", None)], "chunk_id int, version string, at int")
    assert sorted((r.chunk_id, r.version, r.at) for r in one_metadata(rows, "version", "v1", "at").collect()) == [(1, "v1", 5), (2, "v3", 1)]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "y")], "k int, v string")
    assert tuple(io.compared(a, b, "k").first()) == (1, 1, 1, 1)
    assert io.since(a, "k", 1).count() == 1 and io.since(a, "k", None).count() == 2
    assert io.sample_share(spark.range(1000), 30).count() == 30
    assert [r.ord for r in io.relation(spark, ["b", "a"], "name", "string").orderBy("ord").collect()] == [0, 1]


def test_gates_and_stores(spark):
    from archivolt.operators import resolution as Z

    one = spark.createDataFrame([(1, True, 0.1), (1, False, 0.9), (2, False, 0.9), (3, True, 1.0)], "tier int, known boolean, c double")
    assert [r[0] for r in one.select(Z.guarded(F.col("tier"), F.col("known"), F.col("c"))).collect()] == ["auto_link", "auto_create", "queue", "ignore"]
    decisions = spark.createDataFrame([("a", "merge", 7), ("b", "block", None), ("c", "new", None)], "cluster string, action string, entity_id int")
    members = spark.createDataFrame([("a", "a1"), ("b", "b1"), ("c", "c1")], "cluster string, member string")
    allowed, blocked, new = Z.adjudicated(decisions, members)
    assert [tuple(r) for r in allowed.collect()] == [("a1", 7)] and blocked.first().member == "b1" and new.first().cluster == "c"
    old, fresh = spark.createDataFrame([("x", 0.5), ("y", 0.9)], "k string, s double"), spark.createDataFrame([("x", 0.7), ("z", 0.1)], "k string, s double")
    assert [tuple(r) for r in evidence.kept(old, fresh, "k", "s", 2).collect()] == [("y", 0.9), ("x", 0.7)]
    spans = spark.createDataFrame([(str(i), float(i)) for i in range(6)], "span_hash string, v double")
    assert [r.band for r in evidence.banded(spans, F.col("v"), 2, 3).orderBy("place").collect()] == ["cite"] * 2 + ["harvest"] * 3
    assert evidence.uncited(spark.createDataFrame([(1,), (2,)], "claim_id int"), spark.createDataFrame([(2,)], "claim_id int")).count() == 1


def test_numbering_by_ranges(spark):
    from archivolt.operators.ranking import numbered

    got = [(r.id, r.rank) for r in numbered(spark.range(500).select((F.col("id") * 37 % 500).alias("id")), [F.asc("id")]).collect()]
    assert sorted(got) == [(i, i + 1) for i in range(500)]
    assert numbered(spark.range(0), [F.asc("id")]).count() == 0


def test_plans_run(spark):
    from oracle import FOLDER

    if not FOLDER.exists():
        return
    from archivolt.engine import Engine

    e = Engine(spark, str(FOLDER))
    assert e.run([P("COUNT")]).first().n_chunks == 1500
    assert e.run([P("RELATED_PLACES", entity_id=5)]).where("entity_type = 'place'").count() > 0
    assert e.run([P("DATE_RANGE_FILTER", start="1996-01-01")]).count() > 0
    assert e.hybrid(["cipher"], [0.1] * 64, 5).count() == 5


def test_trigram_join_in_many_cells(spark):
    rng = random.Random(4)
    names = [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3))) for _ in range(150)]
    left = spark.createDataFrame([(n,) for n in [*names, *names[:9], None, "", "...", "A  a-b", "𝒳yz ab"]], "s string")
    right = spark.createDataFrame([(n,) for n in [*names[:100], "a a b", "--", "𝒳yz abb"]], "s string")
    x, y = left.where("s <> ''").distinct(), right.where("s <> ''").distinct().withColumnRenamed("s", "z")
    for least in (0.3, 0.6):
        want = {(r.s, r.z): r.v for r in x.join(y, F.col("s") != F.col("z")).withColumn("v", X.trigram_similarity("s", "z")).where(F.col("v") >= least).collect()}
        got = [(r.a, r.b, r.similarity) for r in pipelines.trigram_join(left, right, "s", "s", least, block=40).collect()]
        assert {(a, b): v for a, b, v in got} == want and len(got) == len(want) > 30
    assert pipelines.trigram_join(left.limit(0), right, "s", "s", 0.3).count() == 0


def test_trigram_join_shuffles_texts_and_no_pairs(spark):
    """Names that all share a word: what is shuffled is in proportion to the names, not to the pairs that meet."""
    rng = random.Random(5)
    df = spark.createDataFrame([("leopold " + "".join(rng.choice("abcdefghijklmnop") for _ in range(12)),) for _ in range(400)], "s string")
    plan = pipelines.trigram_join(df, df, "s", "s", 0.6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4 and "Join" not in plan


def test_few_meetings_at_a_time_give_the_same_pairs():
    likeness = pytest.importorskip("archivolt.operators.likeness")
    rng = random.Random(6)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(2, 9))) for _ in range(80)]
    pairs = lambda **more: {(int(i), int(j), int(c)) for a, b, common, _ in likeness.like(words, words, 0.5, **more) for i, j, c in zip(a, b, common)}
    assert pairs(room=7) == pairs() == pairs(meet=1) and len(pairs()) > 80


def test_claims_are_grounded_with_their_mentions(spark):
    """Against pairs by hand: repeated mentions and chunks, chunks that are gone, texts that are null or have one name of two."""
    mentions = spark.createDataFrame([(c, s) for c in (1, 2, 3, 4) for s in ("ann", "bob", "cy", "ann")] + [(5, "bob"), (5, "dee"), (6, "dee"), (6, "bob"), (7, "x"), (None, "ann"), (8, None)], "chunk_id int, surface_norm string")
    chunks = spark.createDataFrame([(1, "Ann, Bob"), (1, "ANN saw b-ob"), (2, "ann"), (3, None), (7, "x")], "chunk_id int, body string")
    claims = {(r.subject, r.object): (r.support, r.claim_id) for r in evidence.co_mention_claims(mentions, 2).collect()}
    assert {k: n for k, (n, _) in claims.items()} == {("ann", "bob"): 4, ("ann", "cy"): 4, ("bob", "cy"): 4, ("bob", "dee"): 2}
    got = {r.claim_id: (r.support, r.n_refs, r.n_attested) for r in evidence.grounded_claims(mentions, chunks, 2).collect()}
    want = {("ann", "bob"): (4, 4, 2), ("ann", "cy"): (4, 4, 0), ("bob", "cy"): (4, 4, 0), ("bob", "dee"): (2, 0, 0)}
    assert got == {claims[k][1]: v for k, v in want.items()}


def test_a_frequent_name_is_grounded_without_a_join_of_its_mentions(spark, tmp_path):
    from archivolt.queries import registry

    for name, columns in (("mention_candidates", "chunk_id bigint, surface_norm string"), ("chunks", "chunk_id bigint, text string, clean_text string")):
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in ("claim_grounding", "uncited_claims"):
        plan = registry.QUERIES[query](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 1 and "Join LeftOuter" in plan
