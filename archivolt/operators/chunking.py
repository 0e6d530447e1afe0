"""Cutting documents into chunks: by page, by marker, by paragraph, by overlapping blocks, by turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.functions import text as T


def filled(parts: Column, most: int, joiner: str, overlap: int = 0) -> Column:
    """Parts of an array put together greedily to texts of at most ``most`` characters; a longer part stands alone.

    The last ``overlap`` parts of a text come again at the start of the next one, as
    far as they leave room for a new part.
    """
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"))
    size = lambda a: F.length(F.array_join(a, joiner))

    def add(acc, p):
        longer = F.concat(acc["open"], F.array(p))
        kept = F.slice(acc["open"], F.greatest(F.size(acc["open"]) - overlap + 1, F.lit(1)), F.lit(overlap)) if overlap else F.array().cast("array<string>")
        again = F.concat(kept, F.array(p))
        start = F.when(size(again) <= most, again).otherwise(F.array(p)) if overlap else F.array(p)
        return F.when((F.size(acc["open"]) == 0) | (size(longer) <= most), F.struct(acc["done"].alias("done"), longer.alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(F.array_join(acc["open"], joiner))).alias("done"), start.alias("open"))
        )

    return F.aggregate(parts, zero, add, lambda acc: F.when(F.size(acc["open"]) == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.array_join(acc["open"], joiner)))))


def by_page(pages: DataFrame, key: str, text: str, most: int = 4000) -> DataFrame:
    """key, ordinal, text: a chunk for each page that isn't blank; a longer one is filled up line by line."""
    own = pages.where(F.trim(F.col(text)) != "")
    return own.select(F.col(key), F.posexplode(F.when(F.length(F.col(text)) <= most, F.array(F.col(text))).otherwise(filled(F.split(F.col(text), "\n"), most, "\n"))).alias("ordinal", "text"))


def by_marker(pages: DataFrame, marker: str, document: str = "document_id", order: str = "page_seq", text: str = "raw_text") -> DataFrame:
    """document, unit (from 0), first and last page, n_lines, text: a document's lines up to the next line that the marker matches.

    Unit 0 is what stands before the first marker. Lines are numbered inside a
    document; only a unit is put together in one place.
    """
    line = pages.where(F.col(text).isNotNull()).select(F.col(document), F.col(order), F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    over = Window.partitionBy(document).orderBy(order, "n").rowsBetween(Window.unboundedPreceding, 0)
    unit = line.withColumn("unit", F.sum(F.col("line").rlike(marker).cast("bigint")).over(over))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "n", "line"))), lambda x: x["line"]), "\n")
    return unit.groupBy(document, "unit").agg(F.min(order).alias("first_page"), F.max(order).alias("last_page"), F.count(F.lit(1)).alias("n_lines"), said.alias("text"))


def overlapping(df: DataFrame, key: str, text: str, most: int = 1000, overlap: int = 1) -> DataFrame:
    """key, ordinal, text: sentences filled up to blocks, the last ``overlap`` of one block repeated in the next."""
    return df.select(F.col(key), F.posexplode(filled(T.sentences(text), most, " ", overlap)).alias("ordinal", "text"))


def turn_windows(turns: DataFrame, key: str, size: int = 6, overlap: int = 1) -> DataFrame:
    """key, chunk (from 0), first and last turn, speakers, text: ``size`` turns each, ``overlap`` of them shared with the one before."""
    step = size - overlap
    last = F.floor((F.col("turn") - 1) / step).cast("bigint")
    first = F.greatest(F.lit(0), F.ceil((F.col("turn") - size) / step)).cast("bigint")
    each = turns.select(key, "turn", "speaker", "text", F.explode(F.sequence(first, last)).alias("chunk"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    own = each.groupBy(key, "chunk").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_join(F.array_sort(F.collect_set("speaker")), "; ").alias("speakers"), said.alias("text"))
    # a window that only repeats the end of the one before is none of its own
    return own.where((F.col("chunk") == 0) | (F.col("last_turn") > F.col("chunk") * step + overlap))
