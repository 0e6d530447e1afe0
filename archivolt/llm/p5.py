"""Queries of problem 5: splitting of oversized items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.catalog import table
from archivolt.llm.splitting import LIMIT, pieces
from archivolt.shared import cut


#: Pages of a document whose lengths one task sums up.
PAGES_A_BUCKET = 10_000


def placed(pages: DataFrame) -> DataFrame:
    """page_id, doc, page_seq, n (place in the document from 1), size and upto (characters up to its end) of every page.

    Running sums in two levels, over buckets of page_seq and inside them, so no
    document is one task's work; texts aren't moved.
    """
    own = pages.select("page_id", F.col("document_id").alias("doc"), "page_seq", F.coalesce(F.length("raw_text"), F.lit(0)).cast("bigint").alias("size"))
    own = own.where("doc is not null and page_seq is not null").withColumn("bucket", F.floor(F.col("page_seq") / PAGES_A_BUCKET))
    inside = Window.partitionBy("doc", "bucket").orderBy("page_seq", "page_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = own.groupBy("doc", "bucket").agg(F.sum("size").alias("all_size"), F.count(F.lit(1)).alias("all_n"))
    over = Window.partitionBy("doc").orderBy("bucket")
    before = sums.select("doc", "bucket", (F.sum("all_size").over(over) - F.col("all_size")).alias("size_before"), (F.sum("all_n").over(over) - F.col("all_n")).alias("n_before"))
    summed = own.withColumn("upto", F.sum("size").over(inside)).withColumn("n", F.count(F.lit(1)).over(inside)).join(before, ["doc", "bucket"])
    return summed.select("page_id", "doc", "page_seq", (F.col("n") + F.col("n_before")).alias("n"), "size", (F.col("upto") + F.col("size_before")).alias("upto"))


def spans(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Texts of page spans beyond the limit: item_id, text and the ends of its pages.

    A span's length is the difference of running sums at its two pages, so only
    spans beyond the limit gather texts, page by page in their document's order.
    """
    place = cut(placed(pages))
    rows = hits.where("first_page_id is not null").select(F.col("chunk_id").alias("item_id"), "first_page_id", F.coalesce("last_page_id", "first_page_id").alias("last_page_id")).distinct()
    end = lambda name, s: place.select(F.col("page_id").alias(name), F.col("doc").alias(f"doc_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("page_seq", "n", "size", "upto")))
    both = rows.join(end("first_page_id", "a"), "first_page_id").join(end("last_page_id", "b"), "last_page_id")
    forward = F.col("n_a") <= F.col("n_b")
    size = F.when(forward, F.col("upto_b") - F.col("upto_a") + F.col("size_a")).otherwise(F.col("upto_a") - F.col("upto_b") + F.col("size_b"))
    key = ["item_id", "first_page_id", "last_page_id"]
    over = both.where((F.col("doc_a") == F.col("doc_b")) & (size > LIMIT)).select(*key, F.col("doc_a").alias("doc"), F.explode(F.sequence(F.least("n_a", "n_b"), F.greatest("n_a", "n_b"))).alias("n"))
    # two pages of different documents: the first one's document, between their numbers
    apart = both.where("doc_a <> doc_b").select(*key, F.col("doc_a").alias("doc"), F.least("page_seq_a", "page_seq_b").alias("lo"), F.greatest("page_seq_a", "page_seq_b").alias("hi"))
    inside = apart.join(place, "doc").where("page_seq between lo and hi")
    far = inside.groupBy(*key).agg(F.sum("size").alias("size")).where(F.col("size") > LIMIT).select(*key)
    over = over.unionByName(inside.join(far, key, "left_semi").select(*key, "doc", "n"))
    wanted = over.join(place.select("page_id", "doc", "n"), ["doc", "n"]).select(*key, "n", "page_id")
    texts = wanted.join(pages.select("page_id", F.coalesce("raw_text", F.lit("")).alias("t")), "page_id")
    whole = texts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("pages"))
    ends = F.aggregate("pages", F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(p["t"]))))
    return whole.select("item_id", F.array_join(F.transform("pages", lambda p: p["t"]), "").alias("text"), ends.alias("bounds"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    pages, chunks = table(spark, folder, "pages"), table(spark, folder, "chunks")
    none = F.array().cast("array<int>").alias("bounds")
    made = {
        "pages": pages.select(F.col("page_id").alias("item_id"), F.col("raw_text").alias("text"), none),
        "chunks": chunks.select(F.col("chunk_id").alias("item_id"), "text", none),
        "oppenheimer_initial_search": spans(table(spark, folder, "oppenheimer_initial_search"), pages),
    }
    return reduce(DataFrame.unionAll, (pieces(d.select(F.lit(n).alias("item_table"), "item_id", "text", "bounds"), ["item_table", "item_id"], "text", "bounds") for n, d in made.items()))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).where("piece_no = 1").select("item_table", "item_id").distinct()


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
SQL = {
    "p5_found": """
select 'pages' item_table, page_id item_id from pages where length(raw_text) > 4000
union select 'chunks', chunk_id from chunks where length(text) > 4000
union select 'oppenheimer_initial_search', chunk_id from (
  select o.chunk_id, sum(length(p.raw_text)) n from (select distinct chunk_id, first_page_id, coalesce(last_page_id, first_page_id) l from oppenheimer_initial_search) o
  join pages a on a.page_id = o.first_page_id join pages b on b.page_id = o.l
  join pages p on p.document_id = a.document_id and p.page_seq between least(a.page_seq, b.page_seq) and greatest(a.page_seq, b.page_seq)
  group by o.chunk_id, o.first_page_id, o.l) where n > 4000"""
}
