"""Queries of problem 8: token ids of the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archivolt.catalog import table
from archivolt.llm.tokens import encode
from archivolt.shared import spread


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
