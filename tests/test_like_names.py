"""Queries over pairs of like names: no pair is shuffled before its names are compared."""

import random

import pytest
from pyspark.sql import functions as F

from archivolt.queries import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(3), tmp_path_factory.mktemp("names")
    names = ["leopold " + "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)]
    names += [n[:-2] + "ov" for n in names[:20]]
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "document_id bigint, surface_norm string").withColumns({
        "raw_span": F.col("surface_norm"), "chunk_id": F.col("document_id"), "quality_score": F.lit(0.5), "created_at": F.lit("2020-01-01").cast("timestamp"), "has_hint_token": F.lit(False),
    }).write.parquet(str(at / "mention_candidates.parquet"))
    spark.createDataFrame([(n,) for n in names[::2]], "alias_norm string").write.parquet(str(at / "alias_stats.parquet"))
    return str(at)


def compared_in_cells(spark, folder, query):
    df = registry.QUERIES[query](spark, folder)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "FlatMapGroupsInArrow" in plan and "explode(gb" not in plan and df.count() > 0


def test_entity_lookup(spark, folder):
    assert compared_in_cells(spark, folder, "entity_lookup")


def test_resolve_surfaces(spark, folder):
    assert compared_in_cells(spark, folder, "resolve_surfaces")


def test_text_ocr_distance(spark, folder):
    assert compared_in_cells(spark, folder, "text_ocr_distance")


@pytest.mark.parametrize("query", ["cluster_review", "variant_clusters"])
def test_clusters(spark, folder, query, monkeypatch):
    """Their pairs go to a checkpoint, so the plan of the pairs is asked for where it is made."""
    from archivolt.operators import pipelines

    plans, components = [], pipelines.components
    monkeypatch.setattr(pipelines, "components", lambda pairs, *more: plans.append(pairs._jdf.queryExecution().optimizedPlan().toString()) or components(pairs, *more))
    assert registry.QUERIES[query](spark, folder).count() > 0
    assert len(plans) == 1 and "FlatMapGroupsInArrow" in plans[0] and "Join" not in plans[0]
