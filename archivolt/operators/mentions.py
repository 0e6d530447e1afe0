"""Index operators: where entities, dates and places are mentioned, in order of time.

Mentions of a chunk count once, by their first place in it; order is the
chunk's date with unknown dates last, then its place and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.operators.ranking import numbered


def chronology(*more: str) -> list[Column]:
    """Order keys: date, then further keys, unknown last, then the chunk."""
    return [F.col("date_min").asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in more), F.col("chunk_id").asc()]


def one_metadata(metadata: DataFrame, version: str, wanted: str, newest: str) -> DataFrame:
    """One metadata row per chunk: the wanted version first, then the newest."""
    w = Window.partitionBy("chunk_id").orderBy((F.col(version) == wanted).cast("int").desc_nulls_last(), F.col(newest).desc_nulls_last())
    return metadata.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def in_chunks(mentions: DataFrame, *entities: int) -> DataFrame:
    """chunk_id, start_char: the first mention of any of the entities in each chunk."""
    return mentions.where(F.col("entity_id").isin(*entities)).groupBy("chunk_id").agg(F.min("start_char").alias("start_char"))


def mentioned(mentions: DataFrame, metadata: DataFrame, entity: int, after_rank: int = 0, limit: int | None = None, order: str = "chronological") -> DataFrame:
    """Ranked chunks with the entity; a page of them goes on after a rank.

    A page is a distributed top-k that is then numbered; without a limit the
    whole list is numbered by ranges, however many chunks one entity has.
    """
    keys = chronology() if order == "chronological" else [F.col("document_id").asc_nulls_last(), F.col("chunk_id").asc()]
    found = in_chunks(mentions, entity).join(metadata, "chunk_id")
    if limit is None:
        return numbered(found, keys).where(F.col("rank") > after_rank)
    page = found.orderBy(*keys).limit(after_rank + limit)
    return page.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys))).where(F.col("rank") > after_rank)


def first_mention(mentions: DataFrame, metadata: DataFrame, entity: int) -> DataFrame:
    return in_chunks(mentions, entity).join(metadata, "chunk_id").orderBy(*chronology()).limit(1)


def all_of(mentions: DataFrame, entities: list[int]) -> DataFrame:
    """Chunks that mention every one of the entities (relational division)."""
    want = sorted(set(entities))
    return mentions.where(F.col("entity_id").isin(*want)).groupBy("chunk_id").agg(F.countDistinct("entity_id").alias("n")).where(F.col("n") == len(want)).select("chunk_id")


def first_co_mention(mentions: DataFrame, metadata: DataFrame, entities: list[int]) -> DataFrame:
    return all_of(mentions, entities).join(metadata, "chunk_id").orderBy(*chronology()).limit(1)


def dated(dates: DataFrame, metadata: DataFrame, start: str | None, end: str | None, basis: str = "mention") -> DataFrame:
    """Chunks whose named dates (or own dates, by ``basis``) lie in the range, with their first date and rank."""
    lo, hi = ("date_start", "date_end") if basis == "mention" else ("date_min", "date_max")
    rows = dates.join(metadata, "chunk_id") if basis == "mention" else metadata
    if start:
        rows = rows.where(F.col(lo) >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col(hi) <= F.lit(end).cast("date"))
    return rows.groupBy("chunk_id").agg(F.min(lo).alias("first_date"), F.count(F.lit(1)).alias("n_dates"))


def first_date(mentions: DataFrame, dates: DataFrame, entity: int) -> DataFrame:
    """The earliest dated chunk with the entity."""
    return dates.join(in_chunks(mentions, entity), "chunk_id").orderBy(F.col("date_start").asc_nulls_last(), "chunk_id").select("chunk_id", "date_start", "date_end").limit(1)


def related(mentions: DataFrame, metadata: DataFrame, entities: DataFrame, entity: int, kind: str | None = None, window: str = "chunk", top: int = 20) -> DataFrame:
    """Entities mentioned together with one, in its chunks or its documents, the most frequent first."""
    own = in_chunks(mentions, entity).select("chunk_id")
    if window == "document":
        doc = metadata.join(own, "chunk_id", "left_semi").select("document_id").distinct()
        own = metadata.join(doc, "document_id", "left_semi").select("chunk_id")
    found = mentions.where(F.col("entity_id") != entity).join(own, "chunk_id", "left_semi").groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    wanted = entities if kind is None else entities.where(F.col("entity_type") == kind)
    return found.join(wanted.select("entity_id", "name", "entity_type"), "entity_id").orderBy(F.desc("n_chunks"), "entity_id").limit(top)
