"""Queries of problem 3: most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.catalog import table
from archivolt.llm.neighbours import nearest

K = 10
LEAST = 0.92


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "chunks"), "chunk_id", "embedding", K, LEAST)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    near = p3_neighbours(spark, folder)
    return near.select(F.least("a", "b").alias("chunk_id_a"), F.greatest("a", "b").alias("chunk_id_b")).distinct()


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}
_SQL = """
with v as (select chunk_id, embedding::double[] e from chunks where length(embedding) = 64 and length(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and length(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select a.chunk_id a, b.chunk_id b, round(list_cosine_similarity(a.e, b.e), 6) c from v a join v b on a.chunk_id <> b.chunk_id),
n as (select a, b from s qualify row_number() over (partition by a order by c desc, b) <= 10 and c >= 0.92)
"""
#: Brute force over all pairs, for small scales.
SQL = {"p3_found": _SQL + "select distinct least(a, b) chunk_id_a, greatest(a, b) chunk_id_b from n"}
