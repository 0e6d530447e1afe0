"""Plans of terms: scope, scores and controls; streams over several batches."""

import pytest
from pyspark.sql import functions as F

from archivolt.engine import Engine
from archivolt.plans.primitives import primitive as P
from archivolt.streaming import windows as S
from oracle import FOLDER

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, str(FOLDER))


def ids(df):
    return {r.chunk_id for r in df.collect()}


def test_a_scope_narrows_a_search(engine):
    whole = ids(engine.run([P("TERM", value="the")]))
    assert whole and not ids(engine.run([P("TERM", value="the"), P("FILTER_COLLECTION", slug="no such collection")]))
    slug = engine.chunks.where("collection_slug is not null").orderBy("chunk_id").first().collection_slug
    own = ids(engine.chunks.where(F.col("collection_slug") == slug))
    assert ids(engine.run([P("TERM", value="the"), P("FILTER_COLLECTION", slug=slug)])) == whole & own < whole


def test_phrases_and_groups_have_scores(engine):
    rows = engine.run([P("PHRASE", value="of the")]).collect()
    assert rows and all(r.score > 0 for r in rows)
    assert [r["rank"] for r in sorted(rows, key=lambda r: (-r.score, r.chunk_id))] == list(range(1, len(rows) + 1))
    assert all(r.score > 0 for r in engine.run([P("OR_GROUP", primitives=[P("TERM", value="the"), P("TERM", value="of")])]).collect())


def test_controls_act_or_refuse(engine):
    the = P("TERM", value="the")
    n = len(ids(engine.run([the])))
    assert engine.run([the, P("SET_QUERY_MODE", mode="count")]).first().n_chunks == n
    assert sum(r.n_chunks for r in engine.run([the, P("GROUP_BY", field="collection_slug")]).collect()) == n
    assert engine.run([the, P("SET_RETRIEVAL_MODE", mode="conversational")]).count() == min(n, 20)
    assert engine.run([the, P("SET_RETRIEVAL_MODE", mode="thorough")]).count() == n
    boosted = engine.run([the, P("SPEAKER_BOOST", speakers=["Q"], weight=2.0)])
    assert ids(boosted) == ids(engine.run([the]))
    for bad in ([the, P("SET_SEARCH_TYPE", search_type="vector")], [the, P("SET_QUERY_MODE", mode="guess")], [the, P("SET_SIMILARITY_THRESHOLD", threshold=0.5)], [the, P("REQUIRE_EVIDENCE", in_vector=True)], [P("ENTITY", entity_id=5), P("SPEAKER_BOOST", speakers=["Q"], weight=2.0)], [the, P("GROUP_BY", field="nothing")]):
        with pytest.raises(ValueError):
            engine.run(bad)


def test_similarity_threshold(engine):
    from archivolt.queries.search import _query_vector

    q = _query_vector(engine.spark, str(FOLDER))
    rows = engine.run([P("SET_SEARCH_TYPE", search_type="vector"), P("SET_SIMILARITY_THRESHOLD", threshold=0.3)], q).collect()
    assert rows and all(r.score >= 0.3 - 1e-6 for r in rows)


def test_updates_of_several_batches_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    first = [(i, i % 15, f"2024-01-01 00:00:{i:02d}") for i in range(15)]
    second = [(100 + i, i % 7, f"2024-01-02 00:00:{i:02d}") for i in range(7)]
    for part in (first, second):
        spark.createDataFrame(part, "event_id long, user_id long, at string").select("event_id", "user_id", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.user_id: r.n for r in S.finished(S.running_state(stream), "update", ["user_id"]).collect()}
    assert got == {u: 1 + (u < 7) for u in range(15)}
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    assert S.finished(S.deduplicated(stream, ["event_id"]), "append").count() == 22
    with pytest.raises(ValueError):
        S.finished(stream, "update")
