"""References that lead nowhere, with nulls, repeats and clashing columns."""

from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from archivolt.operators.references import dangling, orphans, report


@pytest.fixture(scope="module")
def tables(spark):
    child = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", None, "x"), (3, None, None, "x"), (4, "b", 9, "x"), (5, "c", None, "x"), (1, "a", 1, "x")], "id int, k string, n int, extra string")
    parent = spark.createDataFrame([("a", 1, "p"), ("b", 2, "p"), (None, 3, "p")], "k string, n int, extra string")
    return child, parent


@pytest.mark.parametrize("rule, ids", [("simple", [4]), ("partial", [4, 5]), ("full", [2, 4, 5])])
def test_rules_of_partly_null_keys(tables, rule, ids):
    found = orphans(*tables, {"k": "k", "n": "n"}, rule)
    assert found.columns == ["id", "k", "n", "extra"]
    assert sorted(r.id for r in found.collect()) == ids


def test_repeats_stay_and_empty_tables(tables):
    child, parent = tables
    assert sorted(r.id for r in orphans(child, parent.limit(0), {"k": "k"}).collect()) == [1, 1, 2, 4, 5]
    assert orphans(child.limit(0), parent, {"k": "k"}).count() == 0
    with pytest.raises(ValueError):
        orphans(child, parent, {"k": "k"}, "other")


def test_kinds(spark):
    day = lambda d: T(2020, 1, d)
    refs = spark.createDataFrame([("f", 1, 10, day(5)), ("f", 1, 10, day(5)), ("f", 1, 11, day(5)), ("f", 1, 12, day(5)), ("f", 2, 13, day(5)), ("f", 3, 13, None), ("f", 4, None, day(5)), ("f", 5, 14, day(1))], "source_field string, record_id int, ref_id int, cited_at timestamp_ntz")
    target = spark.createDataFrame([(10, day(1)), (13, day(6)), (13, day(9)), (14, None), (12, day(5))], "ref_id int, made_at timestamp_ntz")
    removed = spark.createDataFrame([(11,), (11,), (10,), (None,)], "ref_id int")
    kinds = lambda df: sorted((r.record_id, r.ref_id, r.kind) for r in df.collect())
    assert kinds(dangling(refs, target, removed)) == [(1, 11, "deleted"), (2, 13, "late")]
    assert kinds(dangling(refs, target.where("ref_id <> 14"), None)) == [(1, 11, "missing"), (2, 13, "late"), (5, 14, "missing")]
    assert dangling(refs.limit(0), target, removed).count() == 0
    assert dangling(refs, target.limit(0), removed.limit(0)).where("kind = 'missing'").count() == 6
    told = report(dangling(refs, target, removed)).where("kind = 'late'").first()
    assert (told.month, told.n_refs, told.n_records) == ("2020-01", 1, 1)


def test_hot_key(spark):
    refs = spark.range(3000).select(F.lit("f").alias("source_field"), F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("ref_id"), F.lit(None).cast("timestamp_ntz").alias("cited_at"))
    target = spark.range(8, 5000).select(F.col("id").alias("ref_id"), F.lit(None).cast("timestamp_ntz").alias("made_at"))
    assert dangling(refs, target).where("ref_id = 7").count() == 1001


def test_kinds_of_references_with_keys_of_their_own(spark):
    day = lambda d: T(2020, 1, d)
    refs = spark.createDataFrame([("c", 1, None, 10, day(5)), ("c", 1, None, 11, day(5)), ("r", 2, 10, None, day(5)), ("r", 3, 12, None, day(1)), ("r", 4, None, None, day(1)), ("both", 5, 12, 10, day(5)), ("both", 6, 12, 11, day(5))], "source_field string, record_id int, run_id int, chunk_id int, cited_at timestamp_ntz")
    target = spark.createDataFrame([(None, 10, day(1)), (12, None, day(3)), (12, 10, day(3))], "run_id int, chunk_id int, made_at timestamp_ntz")
    removed = spark.createDataFrame([(None, 11)], "run_id int, chunk_id int")
    got = sorted((r.record_id, r.kind) for r in dangling(refs, target, removed, ("run_id", "chunk_id")).collect())
    assert got == [(1, "deleted"), (2, "missing"), (3, "late"), (6, "missing")]
