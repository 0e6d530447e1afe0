"""Queries of problem 7: near-duplicate pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.catalog import table
from archivolt.llm.neardup import expanded, groups, near_duplicates


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = expanded(*near_duplicates(table(spark, folder, "pages"), "page_id", "raw_text"))
    return pairs.select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = groups(*near_duplicates(table(spark, folder, "pages"), "page_id", "raw_text"))
    return found.select(F.col("key").alias("page_id"), F.col("class").alias("class_id"), "n_links", "copies", F.col("group").alias("group_id"))


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}
SQL: dict[str, str] = {}
