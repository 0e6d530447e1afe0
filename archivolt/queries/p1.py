"""Queries of problem 1: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.catalog import table
from archivolt.operators.references import dangling, report


def _all(spark: SparkSession, folder: str) -> DataFrame:
    """All references as one composite key of a run and a chunk, the part that a field doesn't cite null."""
    sets, runs, chunks = (table(spark, folder, n) for n in ("result_sets", "retrieval_runs", "chunks"))
    none = F.lit(None).cast("bigint")

    def cites(df: DataFrame, field: str, record: str, run, chunk) -> DataFrame:
        return df.select(F.lit(field).alias("source_field"), F.col(record).alias("record_id"), run.alias("run_id"), chunk.alias("chunk_id"), F.col("created_at").alias("cited_at"))

    refs = cites(sets, "result_sets.chunk_ids", "result_set_id", none, F.explode("chunk_ids"))
    refs = refs.unionAll(cites(runs, "retrieval_runs.returned_chunk_ids", "retrieval_run_id", none, F.explode("returned_chunk_ids")))
    refs = refs.unionAll(cites(sets, "result_sets.retrieval_run_id", "result_set_id", F.col("retrieval_run_id"), none))
    target = chunks.select(none.alias("run_id"), "chunk_id", F.col("created_at").alias("made_at")).unionAll(runs.select(F.col("retrieval_run_id").alias("run_id"), none.alias("chunk_id"), F.col("created_at").alias("made_at")))
    removed = table(spark, folder, "removed_chunks").select(none.alias("run_id"), "chunk_id")
    found = dangling(refs, target, removed, ("run_id", "chunk_id"))
    return found.select("source_field", "record_id", F.coalesce("chunk_id", "run_id").alias("ref_id"), "cited_at", "kind")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _all(spark, folder).select("source_field", "record_id", "ref_id", "kind").distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return report(_all(spark, folder))


_REFS = """
with refs as (
  select 'result_sets.chunk_ids' source_field, result_set_id record_id, unnest(chunk_ids) ref_id, created_at cited_at from result_sets
  union all select 'retrieval_runs.returned_chunk_ids', retrieval_run_id, unnest(returned_chunk_ids), created_at from retrieval_runs
  union all select 'result_sets.retrieval_run_id', result_set_id, retrieval_run_id, created_at from result_sets),
made as (select 'c' t, chunk_id id, min(created_at) made_at from chunks group by 2 union all select 'r', retrieval_run_id, min(created_at) from retrieval_runs group by 2),
told as (
  select r.*, case when m.id is not null then case when m.made_at > r.cited_at then 'late' end
    when r.source_field <> 'result_sets.retrieval_run_id' and r.ref_id in (select chunk_id from removed_chunks where chunk_id is not null) then 'deleted'
    else 'missing' end kind
  from refs r left join made m on m.id = r.ref_id and m.t = case when r.source_field = 'result_sets.retrieval_run_id' then 'r' else 'c' end
  where r.ref_id is not null),
bad as (select distinct * from told where kind is not null)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _REFS + "select distinct source_field, record_id, ref_id, kind from bad",
    "p1_report": _REFS + "select source_field, strftime(cited_at, '%Y-%m') as month, kind, count(*) n_refs, count(distinct record_id) n_records, count(distinct ref_id) n_targets from bad group by 1, 2, 3",
}
