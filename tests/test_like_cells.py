"""A cell of like names gives what its query needs of the pairs, not all of them."""

import random

import pytest
from pyspark.sql import functions as F

from archivolt.operators import pipelines, resolution
from archivolt.queries import registry

NAMES = [f"leopold kuznetsov {x}" for x in "abcdefghijklmnopqrstuvwxyz"] + ["anna petrova", "anna petrovna", "…", "bureau"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Names of which all but a few are like all others."""
    at = tmp_path_factory.mktemp("alike")
    spark.createDataFrame([(i, n) for i, n in enumerate([*NAMES, None, ""])], "document_id bigint, surface_norm string").withColumns({
        "raw_span": F.col("surface_norm"), "chunk_id": F.col("document_id"), "quality_score": F.lit(0.5), "created_at": F.lit("2020-01-01").cast("timestamp"), "has_hint_token": F.lit(False),
    }).write.parquet(str(at / "mention_candidates.parquet"))
    spark.createDataFrame([(n,) for n in [n + "x" for n in NAMES] + NAMES[:3] + [None, " "]], "alias_norm string").write.parquet(str(at / "alias_stats.parquet"))
    return str(at)


@pytest.mark.parametrize("query", ["cluster_review", "variant_clusters"])
def test_clusters_are_made_of_fewer_links_than_names(spark, folder, query, monkeypatch):
    links, components = [], pipelines.components
    monkeypatch.setattr(pipelines, "components", lambda pairs, *more: links.append(pairs.count()) or components(pairs, *more))
    got = registry.QUERIES[query](spark, folder).collect()
    assert links[0] < len(NAMES)
    if query == "cluster_review":
        assert {(r.cluster, r.n_members) for r in got} == {(NAMES[0], 26), ("anna petrova", 2)}
    else:
        assert {(r.member, r.cluster) for r in got} == {(n, NAMES[0]) for n in NAMES[:26]} | {("anna petrova", "anna petrova"), ("anna petrovna", "anna petrova")}


def test_components_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 7)], "a int, b int").mapInArrow(run, "a int, b int")
    assert {(r.node, r.component) for r in pipelines.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7)}
    assert made.value == 3


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_links_of_many_cells(spark, least):
    rng = random.Random(8)
    names = [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    df = spark.createDataFrame([(n,) for n in [*names, *names[:9], None, "", "...", "A  a-b", "a a b", "𝒳yz ab", "𝒳yz abb"]], "s string")
    of = lambda pairs: {(r.member, r.cluster) for r in pipelines.clusters(pairs).collect()}
    links = pipelines.trigram_links(df, "s", least, block=40)
    assert of(links) == of(pipelines.trigram_links(df, "s", least)) == of(pipelines.trigram_join(df, df, "s", "s", least)) and links.count() > 30
    assert pipelines.trigram_links(df.limit(0), "s", least).count() == 0


@pytest.mark.parametrize("top", [1, 3])
def test_first_pairs_of_many_cells(spark, top):
    """Few letters, so that many are equally like; cells of few names and of all."""
    rng = random.Random(9)
    names = [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(2)) for _ in range(150)]
    left, right = (spark.createDataFrame([(n,) for n in part], "s string") for part in (names, [*names[:100], "Ab ab", "𝒳 ab", "~ ab"]))

    def first(pairs):
        own = {}
        for a, b, v in pairs:
            own.setdefault(a, []).append((-v, b.encode(), b))
        return {a: sorted(x)[:top] for a, x in own.items()}

    whole = [tuple(r) for r in pipelines.trigram_join(left, right, "s", "s", 0.3).collect()]
    one, many = ([tuple(r) for r in pipelines.trigram_join(left, right, "s", "s", 0.3, block=n, top=top).collect()] for n in (1000, 30))
    assert first(one) == first(many) == first(whole) and len(one) == sum(map(len, first(whole).values())) < len(many) < len(whole)


def test_few_pairs_at_a_time_leave_the_same_first_ones():
    import numpy as np

    from archivolt.operators import likeness

    rng = random.Random(10)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(2, 9))) for _ in range(80)]
    order = np.argsort(np.argsort(words, kind="stable"), kind="stable")
    found = [next(likeness._first(likeness._gathered(likeness.like(words, words, 0.3), room), order, 4)) for room in (9, 10**6)]
    pairs = [sorted(zip(*(x.tolist() for x in part))) for part in found]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 80


def test_similarity_is_rounded_as_round_does_it(spark):
    import numpy as np

    from archivolt.operators import likeness

    pairs = [(c, c + n) for n in (7, 64, 128, 640, 1280, 3200) for c in range(1, n + 1)]
    c, t = map(np.array, zip(*pairs))
    got = (likeness.similarity(c, t) / 1e6).tolist()
    want = spark.createDataFrame(pairs, "c int, t int").select(F.round(F.col("c") / (F.col("t") - F.col("c")), 6)).toArrow().column(0).to_pylist()
    assert got == want


def test_entity_lookup_takes_two_pairs_of_a_surface(spark, folder, monkeypatch):
    taken, join = [], resolution.trigram_join
    monkeypatch.setattr(resolution, "trigram_join", lambda *args, **more: taken.append(join(*args, **more)) or taken[-1])
    got = registry.QUERIES["entity_lookup"](spark, folder)
    assert taken[0].groupBy("a").count().agg(F.max("count")).first()[0] == 2
    monkeypatch.setattr(resolution, "trigram_join", lambda *args, top: join(*args))
    assert sorted(got.collect()) == sorted(registry.QUERIES["entity_lookup"](spark, folder).collect()) and got.count() == 29


def test_resolve_surfaces_takes_eleven_pairs_of_a_surface(spark, folder, monkeypatch):
    taken, resolved = [], pipelines.resolved
    monkeypatch.setattr(pipelines, "resolved", lambda pairs: taken.append(pairs) or resolved(pairs))
    got = registry.QUERIES["resolve_surfaces"](spark, folder)
    assert taken[0].groupBy("a").count().agg(F.max("count")).first()[0] == 11
    whole = resolved(registry.QUERIES["trigram_join"](spark, folder)).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.withColumn("place", F.col("place").cast("bigint")).collect())) and got.count() > 260
