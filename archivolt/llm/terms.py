"""Frequency of every distinct term over the whole collection.

Rows of one term and document are reduced to the newest inside each input
task, then spread by the hash of term and document, so a term that holds a third
of all rows is shared by all tasks; each task reports sums by term, and the
sums are added by the hash of the term. All three steps aggregate by radix
partitioning (radix.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.radix import LIMIT_BYTES, aggregator
from archivolt.shared import shared_dir

RARE_AT_MOST = 2
COMMON_SHARE = 0.25

_NEWEST = """select term, doc, arg_max(n, row(coalesce(epoch_us(newest), -9223372036854775807), n)) as n, max(newest) as newest from part group by term, doc"""


def fold(c: Column | str) -> Column:
    """Lower case, outer blanks removed, inner runs of blanks made one."""
    return F.lower(F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[\s ]+", " ")))


def term_counts(df: DataFrame, term: str, doc: str, count: str, at: str, limit: int = LIMIT_BYTES) -> DataFrame:
    """One row per folded term: term, n_chunks, n_docs.

    Null and blank terms drop out. Of several rows of a term and document the
    newest ``at`` counts (a null time is the oldest; at a tie the larger
    count); a null count is 0. A null document is one more document for
    n_chunks and none for n_docs. Other columns of ``df`` are not read. An
    empty table gives an empty result.
    """
    shared = shared_dir(df.sparkSession)
    rows = df.select(fold(F.col(f"`{term}`")).alias("term"), F.col(f"`{doc}`").cast("bigint").alias("doc"), F.coalesce(F.col(f"`{count}`").cast("bigint"), F.lit(0)).alias("n"), F.col(f"`{at}`").cast("timestamp_ntz").alias("newest")).where("term <> ''")
    keyed = lambda d, *k: d.withColumn("h", F.xxhash64(*k))
    kind = "term string, doc bigint, n bigint, newest timestamp_ntz"
    local = keyed(rows, "term", "doc").mapInArrow(aggregator(_NEWEST, shared, limit), kind)
    spread = keyed(local, "term", "doc").repartition(F.col("h"))
    by_doc = f"select term, cast(sum(n) as bigint) as n, count(doc) as docs from ({_NEWEST}) group by term"
    part = spread.mapInArrow(aggregator(by_doc, shared, limit), "term string, n bigint, docs bigint")
    total = "select term, cast(sum(n) as bigint) as n_chunks, cast(sum(docs) as bigint) as n_docs from part group by term"
    return keyed(part, "term").repartition(F.col("h")).mapInArrow(aggregator(total, shared, limit), "term string, n_chunks bigint, n_docs bigint")


def marked(counts: DataFrame, n_documents: int, rare: int = RARE_AT_MOST, common: float = COMMON_SHARE) -> DataFrame:
    """term_counts with the booleans too_rare and too_common."""
    return counts.withColumn("too_rare", F.col("n_chunks") <= rare).withColumn("too_common", F.col("n_docs") > F.lit(common) * F.lit(n_documents))
