"""Queries of problem 2: frequency of every distinct term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.catalog import table
from archivolt.llm.terms import marked, term_counts


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    stats = table(spark, folder, "alias_stats")
    documents = stats.agg(F.countDistinct("document_id")).first()[0]
    return marked(term_counts(stats, "alias_norm", "document_id", "df_chunks", "updated_at"), documents).withColumnRenamed("term", "alias_norm")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    marks = F.filter(F.array(F.when(F.col("too_rare"), "too_rare"), F.when(F.col("too_common"), "too_common")), lambda m: m.isNotNull())
    return p2_terms(spark, folder).select("alias_norm", F.explode(marks).alias("mark"))


_TERMS = r"""
with folded as (select lower(trim(regexp_replace(alias_norm, '[\s\x{00a0}]+', ' ', 'g'))) t, * from alias_stats),
newest as (select t, document_id, row_number() over (partition by t, document_id order by updated_at desc nulls last, df_chunks desc nulls last) k, coalesce(df_chunks, 0) n from folded where t <> ''),
terms as (select t alias_norm, cast(sum(n) as bigint) n_chunks, count(document_id) n_docs, sum(n) <= 2 too_rare,
  count(document_id) > 0.25 * (select count(distinct document_id) from alias_stats) too_common from newest where k = 1 group by t)
"""

QUERIES = {"p2_found": p2_found, "p2_terms": p2_terms}
SQL = {
    "p2_terms": _TERMS + "select * from terms",
    "p2_found": _TERMS + "select alias_norm, 'too_rare' mark from terms where too_rare union all select alias_norm, 'too_common' from terms where too_common",
}
