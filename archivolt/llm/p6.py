"""Queries of problem 6: variant spellings of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archivolt.catalog import table
from archivolt.llm.names import entities, variants
from archivolt.llm.terms import fold
from archivolt.shared import cut


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "mention_candidates").select(fold("surface_norm").alias("name")).unionAll(table(spark, folder, "alias_stats").select(fold("alias_norm").alias("name")))
    return entities(names.where("name <> ''").distinct())


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return variants(cut(p6_entities(spark, folder)))


QUERIES = {"p6_found": p6_found, "p6_entities": p6_entities}
SQL: dict[str, str] = {}
