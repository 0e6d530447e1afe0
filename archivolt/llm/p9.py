"""Queries of problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archivolt.catalog import table
from archivolt.llm.mixing import mix, shares
from archivolt.llm.tokens import count_tokens
from archivolt.shared import cut, spread


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "documents").where("source is not null").select("doc_id", "source", "text")
    return count_tokens(spread(listed), "doc_id", "text", keep=("source",))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_sizes(spark, folder), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    sizes, targets = cut(_sizes(spark, folder)), table(spark, folder, "mix_targets")
    return shares(mix(sizes, targets), targets, sizes=sizes)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
