"""Functions and views for use from SQL text."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession

#: Bodies of the temporary functions, in SQL.
FUNCTIONS = {
    "normalize_surface": ("s string", "string", r"trim(regexp_replace(regexp_replace(lower(s), '[^\\p{L}\\p{N}_\\s]', ''), '\\s+', ' '))"),
    "variant_key": ("s string", "string", "regexp_replace(lower(s), '[^a-z0-9]', '')"),
    "token_overlap_score": ("a string, b string", "double", "coalesce(size(array_intersect(split(lower(a), ' '), split(lower(b), ' '))) / nullif(size(array_union(split(lower(a), ' '), split(lower(b), ' '))), 0), 0.0)"),
    "is_proposable": ("s string, docs bigint", "boolean", "length(s) >= 3 and docs >= 2 and s rlike '[a-z]'"),
}
#: Views over the tables.
VIEWS = {
    "result_sets_with_run": "select s.*, r.query_text, r.search_type from result_sets s left join (select distinct retrieval_run_id, query_text, search_type from retrieval_runs) r using (retrieval_run_id)",
    "result_set_chunks": "select result_set_id, chunk_id, row_number() over (partition by result_set_id order by at) as rank from (select result_set_id, chunk_id, min(at) at from (select result_set_id, posexplode(chunk_ids) as (at, chunk_id) from result_sets) where chunk_id is not null group by 1, 2)",
    "chunk_quality": "select chunk_id, case when text is null then 'none' when text rlike '[~^|_]' then 'doubtful' else 'trusted' end as quality from chunks",
    "retrieval_chunks_current": "select * from (select c.*, row_number() over (partition by chunk_id order by created_at desc nulls last) as newest from chunks c) where newest = 1",
}


def register(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """Temporary views of a folder's tables and of the logical ones, and the functions above."""
    if names is None:
        names = [p.stem for p in Path(urlparse(folder).path).glob("*.parquet")]
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")
    for name, body in VIEWS.items():
        spark.sql(f"create or replace temporary view {name} as {body}")


def register_table_functions(spark: SparkSession) -> None:
    """SQL table functions with a parameter, over the registered views."""
    spark.sql(
        """create or replace temporary function top_surfaces(most int) returns table (surface_norm string, n_mentions bigint, n_docs bigint)
        return select surface_norm, n_mentions, n_docs from (
          select surface_norm, count(*) as n_mentions, count(distinct document_id) as n_docs, row_number() over (order by count(*) desc, surface_norm) as place
          from mention_candidates where surface_norm is not null group by surface_norm)
        where place <= top_surfaces.most"""
    )
