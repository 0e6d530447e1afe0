"""Counts and facets over chunks, entities, dates and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(df: DataFrame, n: str, *keys: str, limit: int | None = None) -> DataFrame:
    """Most frequent first, ties by key."""
    df = df.orderBy(F.desc(n), *keys)
    return df.limit(limit) if limit else df


def count_by(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Distinct chunks per value of a column."""
    return top(df.groupBy(key).agg(F.countDistinct("chunk_id").alias("n_chunks")), "n_chunks", key, limit=limit)


def entity_facet(mentions: DataFrame, entities: DataFrame, chunks: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Mentions and chunks per entity inside a set of chunks."""
    e = entities if kind is None else entities.where(F.col("entity_type") == kind)
    found = mentions.join(chunks.select("chunk_id"), "chunk_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("chunk_id").alias("n_chunks"))
    return top(found.join(e.select("entity_id", "name", "entity_type"), "entity_id"), "n_mentions", "entity_id", limit=limit)


def date_facet(df: DataFrame, day: str, grain: str = "year") -> DataFrame:
    """Distinct chunks and rows per year or month."""
    keys = [F.year(day).cast("bigint").alias("year")] + ([F.month(day).cast("bigint").alias("month")] if grain == "month" else [])
    return df.where(F.col(day).isNotNull()).groupBy(*keys).agg(F.countDistinct("chunk_id").alias("n_chunks"), F.count(F.lit(1)).alias("n_rows"))


def pairs(mentions: DataFrame, chunks: DataFrame, least: int = 2, limit: int | None = None) -> DataFrame:
    """Pairs of entities in common chunks, each pair once, with a least number of them.

    The self-join is on the chunk; an entity counts once in a chunk.
    """
    m = mentions.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "entity_id").distinct()
    both = m.join(m.select("chunk_id", F.col("entity_id").alias("other_id")), "chunk_id").where("entity_id < other_id")
    return top(both.groupBy("entity_id", "other_id").agg(F.count(F.lit(1)).alias("n_chunks")).where(F.col("n_chunks") >= least), "n_chunks", "entity_id", "other_id", limit=limit)


def stars(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """entity_id, other_id: the least entity of each chunk with each of its others.

    Its components are those of all pairs in common chunks, in no more rows than there are mentions.
    """
    m = mentions.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "entity_id").distinct()
    least = m.groupBy("chunk_id").agg(F.min("entity_id").alias("least"))
    return m.join(least, "chunk_id").where("entity_id > least").select(F.col("least").alias("entity_id"), F.col("entity_id").alias("other_id")).distinct()


def frequency(mentions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Chunks and documents per entity."""
    m = mentions.select("entity_id", "chunk_id").distinct()
    return m.join(metadata.select("chunk_id", "document_id"), "chunk_id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("chunk_df"), F.countDistinct("document_id").alias("doc_df"))


def spread_of(df: DataFrame, n: str, share: Column | None = None) -> DataFrame:
    """Rows, median, 90th percentile and maximum of a count."""
    at = lambda p: F.percentile(n, F.lit(p)).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.round(at(0.5), 4).alias("median"), F.round(at(0.9), 4).alias("p90"), F.max(n).cast("bigint").alias("most"))


def surfaces(df: DataFrame) -> DataFrame:
    """Statistics of a surface form over mention candidates: counts, mean quality, first time, most common raw form, stability."""
    raw = df.groupBy("surface_norm", "raw_span").agg(F.count(F.lit(1)).alias("n"))
    best = raw.where("raw_span is not null").withColumn("k", F.row_number().over(Window.partitionBy("surface_norm").orderBy(F.desc("n"), "raw_span"))).where("k = 1").select("surface_norm", F.col("raw_span").alias("common_raw"), F.col("n").alias("n_common"))
    stats = df.groupBy("surface_norm").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("document_id").alias("n_docs"), F.countDistinct("chunk_id").alias("n_chunks"), F.round(F.avg("quality_score"), 6).alias("avg_quality"), F.min("created_at").alias("first_seen"),
        F.count(F.when(F.col("has_hint_token"), 1)).alias("n_hinted"),
    )
    return stats.join(best, "surface_norm", "left").withColumn("stable", F.col("n_common") * 2 > F.col("n_mentions"))


def tier(docs: str = "n_docs", quality: str = "avg_quality") -> Column:
    """1: in ten documents with good spans, 2: in three, else 3."""
    return F.when((F.col(docs) >= 10) & (F.col(quality) >= 0.6), 1).when((F.col(docs) >= 3) & (F.col(quality) >= 0.5), 2).otherwise(3)


def compare_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Overlap, rests, union, Jaccard, overlap coefficient and inclusions of two sets of keys, in one row."""
    x, y = a.select(key).dropna().distinct().withColumn("in_a", F.lit(1)), b.select(key).dropna().distinct().withColumn("in_b", F.lit(1))
    n = x.join(y, key, "full_outer").agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("n_both"), F.count(F.lit(1)).alias("n_union"))
    over = lambda p, q: F.round(F.coalesce(F.col(p) / F.nullif(q, F.lit(0)), F.lit(0.0)), 6)
    return n.select("n_a", "n_b", "n_both", "n_union", (F.col("n_a") - F.col("n_both")).alias("only_a"), (F.col("n_b") - F.col("n_both")).alias("only_b"), over("n_both", F.col("n_union")).alias("jaccard"), over("n_both", F.least("n_a", "n_b")).alias("overlap"), over("n_both", F.col("n_a")).alias("a_in_b"), over("n_both", F.col("n_b")).alias("b_in_a"))
