"""The logical model of retrieval over a data folder.

Entities are parts (organisations and persons by type) and suppliers (places);
an order is a chunk of text with its customer as document and market segment as
collection; order lines mention a part and a supplier and a date. Chunks with
texts, vectors and pages are tables of their own (catalog.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.catalog import table

PLACES_FROM = 10_000_000


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """entity_id, chunk_id, start_char; an entity may stand several times in a chunk."""
    lines = table(spark, d, "lineitem")
    one = lambda e: lines.select(e.cast("bigint").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("start_char"))
    return one(F.col("l_partkey")).unionAll(one(F.col("l_suppkey") + PLACES_FROM))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, document_id, collection_slug, date_min, date_max."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    day = F.to_date("o_orderdate")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.col("c_mktsegment").alias("collection_slug"), day.alias("date_min"), F.date_add(day, F.pmod("o_orderkey", F.lit(30)).cast("int")).alias("date_max")
    )


def dates(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, date_start, date_end of the dates named in chunks."""
    start = F.to_date("l_shipdate")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), start.alias("date_start"), F.date_add(start, F.col("l_linenumber")).alias("date_end"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """entity_id, name, entity_type and, for places, city, region, country, lat, lng."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") <= 25, "person").otherwise("org").alias("entity_type"), *none("string", "city", "region", "country"), *none("double", "lat", "lng"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    places = s.select((key + PLACES_FROM).alias("entity_id"), F.col("s_name").alias("name"), F.lit("place").alias("entity_type"), F.col("s_name").alias("city"), F.col("r_name").alias("region"), F.col("n_name").alias("country"), (F.pmod(key * 37, F.lit(180)) - 90).cast("double").alias("lat"), (F.pmod(key * 91, F.lit(360)) - 180).cast("double").alias("lng"))
    return parts.unionByName(places)


#: The same tables for the SQL side.
SQL = """
mentions as (select l_partkey::bigint entity_id, l_orderkey chunk_id, l_linenumber start_char from lineitem union all select l_suppkey + 10000000, l_orderkey, l_linenumber from lineitem),
meta as (select o_orderkey chunk_id, o_custkey document_id, c_mktsegment collection_slug, cast(o_orderdate as date) date_min, cast(o_orderdate as date) + cast(o_orderkey % 30 as integer) date_max from orders join customer on o_custkey = c_custkey),
dates as (select l_orderkey chunk_id, cast(l_shipdate as date) date_start, cast(l_shipdate as date) + cast(l_linenumber as integer) date_end from lineitem),
entities as (select p_partkey entity_id, p_name "name", case when p_size <= 25 then 'person' else 'org' end entity_type, null::varchar city, null::varchar region, null::varchar country, null::double lat, null::double lng from part
  union all select s_suppkey + 10000000, s_name, 'place', s_name, r_name, n_name, ((s_suppkey * 37) % 180 - 90)::double, ((s_suppkey * 91) % 360 - 180)::double from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
"""
