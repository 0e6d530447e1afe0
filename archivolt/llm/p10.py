"""Queries of problem 10: abusive, hateful or sexual content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archivolt.catalog import table
from archivolt.llm.abuse import LEAST, agreement, rates, scores
from archivolt.shared import spread


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scores(spread(table(spark, folder, "documents").select("doc_id", "source", "text")), "doc_id", "text", ("source",))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_scores(spark, folder).where(f"score >= {LEAST}").select("doc_id").distinct()


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rates(p10_scores(spark, folder), "source")


def p10_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return agreement(p10_scores(spark, folder), table(spark, folder, "abuse_labels"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates, "p10_agreement": p10_agreement}
SQL: dict[str, str] = {}
