"""Queries of problem 4: noise in text from scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.catalog import table
from archivolt.llm.scans import furniture_of, lexicon, repair, trained
from archivolt.operators.pipelines import chunk_pages
from archivolt.shared import cut, spread


def _repaired(spark: SparkSession, folder: str, texts: bool) -> DataFrame:
    pages, chunks = table(spark, folder, "pages"), table(spark, folder, "chunks")
    known, english, rare = lexicon(table(spark, folder, "documents"), "text", "lang")
    editor = trained(pages, "page_id", "raw_text", known)
    furniture = cut(furniture_of(pages))
    on_page = pages.select("page_id", F.lit("pages").alias("item_table"), F.col("page_id").alias("item_id"), F.col("raw_text").alias("text")).join(furniture.select("page_id", "furniture"), "page_id", "left")
    # a chunk's furniture is that of the pages it was cut from
    spans = chunk_pages(chunks, pages).select("chunk_id", "page_id")
    of_chunk = spans.join(furniture.select("page_id", "furniture"), "page_id").groupBy("chunk_id").agg(F.array_distinct(F.flatten(F.collect_list("furniture"))).alias("furniture"))
    in_chunk = chunks.select("chunk_id", F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_id"), "text").join(of_chunk, "chunk_id", "left")
    made = [repair(spread(d.select("item_table", "item_id", "text", "furniture")), "furniture", editor, english, texts, rare, numbered) for d, numbered in ((on_page, True), (in_chunk, False))]
    return made[0].unionAll(made[1])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder, False).distinct()


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder, True)


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired}
SQL: dict[str, str] = {}
