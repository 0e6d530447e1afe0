"""Queries over mentions, dates and places: scope predicates, index operators, joins and facets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt import model
from archivolt.catalog import table
from archivolt.functions.scores import box, hubness, priority
from archivolt.operators import facets, mentions as M
from archivolt.operators.graph import components
from archivolt.plans.compiler import Tables, scope
from archivolt.plans.primitives import primitive as P

A, B, PLACE, PLACE_2 = 5, 17, 10_000_003, 10_000_007
START, END = "1996-01-01", "1997-12-31"


def _tables(spark, d) -> Tables:
    return Tables(model.metadata(spark, d), model.mentions(spark, d), model.entities(spark, d), model.dates(spark, d))


def _scoped(*plan):
    def run(spark, d):
        t = _tables(spark, d)
        return scope(t.metadata, list(plan), t).select("chunk_id", "document_id", "collection_slug")

    return run


QUERIES, SQL = {}, {}


def _add(name, query, sql):
    QUERIES[name] = query
    SQL[name] = f"with {model.SQL}{sql}"


def _has(*ids: int, c: str = "m.chunk_id") -> str:
    return f"{c} in (select x.chunk_id from mentions x where x.entity_id in ({', '.join(map(str, ids))}))"


_META = "select m.chunk_id, m.document_id, m.collection_slug from meta m where "
_add("scope_entity", _scoped(P("ENTITY", entity_id=A), P("ENTITY", entity_id=B)), _META + _has(A, B))
_add("scope_collection_date", _scoped(P("FILTER_COLLECTION", slug="BUILDING"), P("FILTER_DATE_RANGE", start=START, end=END)), _META + f"m.collection_slug = 'BUILDING' and (exists (select 1 from dates x where x.chunk_id = m.chunk_id and x.date_end >= date '{START}' and x.date_start <= date '{END}') or (m.date_max >= date '{START}' and m.date_min <= date '{END}'))")
_add("scope_open_date", _scoped(P("FILTER_DATE_RANGE", start=END)), _META + f"exists (select 1 from dates x where x.chunk_id = m.chunk_id and x.date_end >= date '{END}') or m.date_max >= date '{END}'")
_add("scope_document", _scoped(P("FILTER_DOCUMENT", document_id=7)), _META + "m.document_id = 7")
_add("scope_co_occurs_document", _scoped(P("CO_OCCURS_WITH", entity_a=A, entity_b=PLACE, window="document")), _META + f"m.document_id in (select y.document_id from meta y where {_has(A, c='y.chunk_id')}) and m.document_id in (select y.document_id from meta y where {_has(PLACE, c='y.chunk_id')})")
_add("scope_co_occurs_chunk", _scoped(P("CO_OCCURS_WITH", entity_a=PLACE, entity_b=PLACE_2)), _META + _has(PLACE) + " and " + _has(PLACE_2))
_add("scope_relation_evidence", _scoped(P("RELATION_EVIDENCE", entity_a=PLACE, entity_b=PLACE_2), P("NOT_ENTITY", entity_id=A)), _META + _has(PLACE) + " and " + _has(PLACE_2) + " and not " + _has(A))
_add("scope_except_entities", _scoped(P("ENTITY", entity_id=PLACE), P("EXCEPT_ENTITIES", entity_ids=[A, B, PLACE_2])), _META + _has(PLACE) + " and not " + _has(A, B, PLACE_2))
_add("scope_role", _scoped(P("ENTITY_ROLE", role="org")), _META + "m.chunk_id in (select x.chunk_id from mentions x join entities e on e.entity_id = x.entity_id where e.entity_type = 'org')")
_place = lambda c: _META + f"m.chunk_id in (select x.chunk_id from mentions x join entities e on e.entity_id = x.entity_id where e.entity_type = 'place' and {c})"
_add("scope_city", _scoped(P("FILTER_CITY", city="supplier#%1", country=None)), _place("e.city ilike 'supplier#%1'"))
_add("scope_region", _scoped(P("FILTER_REGION", region="asia"), P("ENTITY", entity_id=A)), _place("e.region ilike 'asia'") + " and " + _has(A))
_add("scope_country", _scoped(P("FILTER_COUNTRY", country="nation_3")), _place("e.country ilike 'nation_3'"))
_s, _n, _w, _e = box(10.0, 20.0, 4000.0)
_add("scope_coordinates", _scoped(P("FILTER_COORDINATES", lat=10.0, lng=20.0, radius_km=4000.0)), _place(f"e.lat between {_s!r} and {_n!r} and e.lng between {_w!r} and {_e!r}"))
_add(
    "scope_date_windows", _scoped(P("INTERSECT_DATE_WINDOWS", entity_a=A, entity_b=B), P("FILTER_COLLECTION", slug="MACHINERY")),
    f", w as (select max(lo) lo, min(hi) hi from (select min(date_min) lo, max(date_max) hi from meta m where {_has(A)} union all select min(date_min), max(date_max) from meta m where {_has(B)})) select m.chunk_id, m.document_id, m.collection_slug from meta m, w where w.lo <= w.hi and m.date_max >= w.lo and m.date_min <= w.hi and m.collection_slug = 'MACHINERY'",
)

_RANKED = "select m.chunk_id, m.document_id, m.date_min, x.start_char, row_number() over (order by m.date_min nulls last, m.chunk_id) as \"rank\" from meta m join (select chunk_id, min(start_char) start_char from mentions where entity_id = {e} group by 1) x using (chunk_id)"


def _cols(df):
    return df.select("chunk_id", "document_id", "date_min", F.col("start_char").cast("bigint").alias("start_char"), F.col("rank").cast("bigint").alias("rank"))


_rank_sql = lambda e: f"select chunk_id, document_id, date_min, start_char::bigint start_char, \"rank\"::bigint as \"rank\" from ({_RANKED.format(e=e)})"
_add("mentions_all", lambda s, d: _cols(M.mentioned(model.mentions(s, d), model.metadata(s, d), PLACE)), " " + _rank_sql(PLACE))
_add("mentions_page", lambda s, d: _cols(M.mentioned(model.mentions(s, d), model.metadata(s, d), PLACE, 10, 20)), " " + _rank_sql(PLACE) + ' where "rank" > 10 and "rank" <= 30')
_add(
    "mentions_document_order", lambda s, d: _cols(M.mentioned(model.mentions(s, d), model.metadata(s, d), PLACE, order="document_order")),
    " " + _rank_sql(PLACE).replace("order by m.date_min nulls last, m.chunk_id", "order by m.document_id nulls last, m.chunk_id"),
)
_first = "select m.chunk_id, m.document_id, m.date_min from meta m where {w} order by m.date_min nulls last, m.chunk_id limit 1"
_add("first_mention", lambda s, d: M.first_mention(model.mentions(s, d), model.metadata(s, d), A).select("chunk_id", "document_id", "date_min"), " " + _first.format(w=_has(A)))
_add("first_co_mention", lambda s, d: M.first_co_mention(model.mentions(s, d), model.metadata(s, d), [PLACE, PLACE_2]).select("chunk_id", "document_id", "date_min"), " " + _first.format(w=_has(PLACE) + " and " + _has(PLACE_2)))
_add("chunks_with_all", lambda s, d: M.all_of(model.mentions(s, d), [PLACE, PLACE_2]), f" select chunk_id from mentions where entity_id in ({PLACE}, {PLACE_2}) group by 1 having count(distinct entity_id) = 2")
_add(
    "date_range_mentions", lambda s, d: M.dated(model.dates(s, d), model.metadata(s, d), START, END),
    f" select chunk_id, min(date_start) first_date, count(*) n_dates from dates join meta using (chunk_id) where date_start >= date '{START}' and date_end <= date '{END}' group by 1",
)
_add(
    "date_range_documents", lambda s, d: M.dated(model.dates(s, d), model.metadata(s, d), START, None, "document"),
    f" select chunk_id, min(date_min) first_date, count(*) n_dates from meta where date_min >= date '{START}' group by 1",
)
_add("first_date_mention", lambda s, d: M.first_date(model.mentions(s, d), model.dates(s, d).distinct(), A), f" select chunk_id, date_start, date_end from dates m where {_has(A)} order by date_start, chunk_id limit 1")
_add(
    "related_places", lambda s, d: M.related(model.mentions(s, d), model.metadata(s, d), model.entities(s, d), A, "place"),
    f" select y.entity_id, e.name, e.entity_type, count(distinct y.chunk_id) n_chunks from mentions y join entities e using (entity_id) where y.entity_id <> {A} and e.entity_type = 'place' and {_has(A, c='y.chunk_id')} group by all order by n_chunks desc, entity_id limit 20",
)
_add(
    "related_entities_document", lambda s, d: M.related(model.mentions(s, d), model.metadata(s, d), model.entities(s, d), A, None, "document"),
    f" select x.entity_id, e.name, e.entity_type, count(distinct x.chunk_id) n_chunks from mentions x join entities e using (entity_id) where x.entity_id <> {A} and x.chunk_id in (select chunk_id from meta where document_id in (select document_id from meta m where {_has(A)})) group by all order by n_chunks desc, entity_id limit 20",
)

# counts and facets
_inside = lambda s, d: scope(model.metadata(s, d), [P("FILTER_COLLECTION", slug="BUILDING")], _tables(s, d))
_IN = "select chunk_id from meta where collection_slug = 'BUILDING'"
_add("count_total", lambda s, d: _inside(s, d).agg(F.countDistinct("chunk_id").alias("n_chunks")), f" select count(distinct chunk_id) n_chunks from ({_IN})")
_add("count_by_collection", lambda s, d: facets.count_by(model.metadata(s, d), "collection_slug"), " select collection_slug, count(distinct chunk_id) n_chunks from meta group by 1")
_add("count_by_document", lambda s, d: facets.count_by(model.metadata(s, d), "document_id", 50), " select document_id, count(distinct chunk_id) n_chunks from meta group by 1 order by 2 desc, 1 limit 50")
_add(
    "count_by_country", lambda s, d: facets.count_by(model.mentions(s, d).join(model.entities(s, d).where("country is not null").select("entity_id", "country"), "entity_id"), "country"),
    " select country, count(distinct chunk_id) n_chunks from mentions join entities using (entity_id) where country is not null group by 1",
)
_add(
    "global_stats", lambda s, d: model.entities(s, d).select("entity_id").join(model.mentions(s, d).select("entity_id", "chunk_id"), "entity_id", "left").groupBy("entity_id").agg(F.count("chunk_id").alias("n_mentions")),
    " select e.entity_id, count(m.chunk_id) n_mentions from entities e left join mentions m using (entity_id) group by 1",
)
_add(
    "facet_entities", lambda s, d: facets.entity_facet(model.mentions(s, d), model.entities(s, d), _inside(s, d), "place"),
    f" select entity_id, name, entity_type, count(*) n_mentions, count(distinct chunk_id) n_chunks from mentions join entities using (entity_id) where entity_type = 'place' and chunk_id in ({_IN}) group by all order by n_mentions desc, entity_id limit 50",
)
_add(
    "facet_co_mentions", lambda s, d: facets.pairs(model.mentions(s, d), _inside(s, d), 2),
    f", m as (select distinct chunk_id, entity_id from mentions where chunk_id in ({_IN})) select a.entity_id, b.entity_id other_id, count(*) n_chunks from m a join m b on a.chunk_id = b.chunk_id and a.entity_id < b.entity_id group by 1, 2 having count(*) >= 2",
)
_add(
    "facet_dates_month", lambda s, d: facets.date_facet(model.dates(s, d).join(_inside(s, d).select("chunk_id"), "chunk_id", "left_semi"), "date_start", "month"),
    f" select year(date_start) as \"year\", month(date_start) as \"month\", count(distinct chunk_id) n_chunks, count(*) n_rows from dates where chunk_id in ({_IN}) group by 1, 2",
)
_add("facet_dates_year", lambda s, d: facets.date_facet(model.metadata(s, d), "date_min"), ' select year(date_min) as "year", count(distinct chunk_id) n_chunks, count(*) n_rows from meta group by 1')
_add("entity_frequency", lambda s, d: facets.frequency(model.mentions(s, d), model.metadata(s, d)), " select entity_id, count(distinct chunk_id) chunk_df, count(distinct document_id) doc_df from mentions join meta using (chunk_id) group by 1")
_add(
    "hubness_stats", lambda s, d: facets.spread_of(facets.frequency(model.mentions(s, d), model.metadata(s, d)), "chunk_df"),
    " select count(*) n_rows, round(quantile_cont(n, 0.5), 4)::double median, round(quantile_cont(n, 0.9), 4)::double p90, max(n)::bigint most from (select entity_id, count(distinct chunk_id) n from mentions join meta using (chunk_id) group by 1)",
)
_add(
    "hubness_scores",
    lambda s, d: facets.frequency(model.mentions(s, d), model.metadata(s, d)).join(model.mentions(s, d).join(_inside(s, d).select("chunk_id"), "chunk_id", "left_semi").groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("focus")), "entity_id").select("entity_id", hubness(F.lit(1.0), F.col("focus"), F.col("chunk_df")).alias("score")),
    f" select entity_id, round(1 + 0.3 * greatest(least(ln((focus + 1)::double / (n + 1)), 2), -2), 6) score from (select entity_id, count(distinct chunk_id) n, count(distinct case when chunk_id in ({_IN}) then chunk_id end) focus from mentions join meta using (chunk_id) group by 1) where focus > 0",
)
_add(
    "priority_scores", lambda s, d: facets.frequency(model.mentions(s, d), model.metadata(s, d)).select("entity_id", priority(F.col("doc_df"), F.col("chunk_df"), F.lit(0.5), F.col("doc_df") > 10, F.col("chunk_df") > 1000).alias("score")),
    " select entity_id, round(10 * ln(d + 1) + 5 * ln(c + 1) + 10 + case when d > 10 then 30 else 0 end - case when c > 1000 then 20 else 0 end, 6) score from (select entity_id, count(distinct chunk_id) c, count(distinct document_id) d from mentions join meta using (chunk_id) group by 1)",
)
_add(
    "set_comparison", lambda s, d: facets.compare_sets(M.in_chunks(model.mentions(s, d), PLACE), M.in_chunks(model.mentions(s, d), PLACE_2), "chunk_id"),
    f", a as (select distinct chunk_id from mentions where entity_id = {PLACE}), b as (select distinct chunk_id from mentions where entity_id = {PLACE_2}), n as (select (select count(*) from a) n_a, (select count(*) from b) n_b, (select count(*) from a join b using (chunk_id)) n_both) select n_a, n_b, n_both, n_a + n_b - n_both n_union, n_a - n_both only_a, n_b - n_both only_b, round(coalesce(n_both::double / nullif(n_a + n_b - n_both, 0), 0), 6) jaccard, round(coalesce(n_both::double / nullif(least(n_a, n_b), 0), 0), 6) overlap, round(coalesce(n_both::double / nullif(n_a, 0), 0), 6) a_in_b, round(coalesce(n_both::double / nullif(n_b, 0), 0), 6) b_in_a from n",
)

# sets, joins and pages of results
_chunks = lambda s, d, e: M.in_chunks(model.mentions(s, d), e).select("chunk_id")
_of = lambda e: f"select distinct chunk_id from mentions where entity_id = {e}"
_add("set_union", lambda s, d: _chunks(s, d, A).union(_chunks(s, d, B)).distinct(), f" {_of(A)} union {_of(B)}")
_add("set_union_all", lambda s, d: _chunks(s, d, A).unionByName(_chunks(s, d, B)), f" {_of(A)} union all {_of(B)}")
_add("set_intersect", lambda s, d: _chunks(s, d, PLACE).intersect(_chunks(s, d, PLACE_2)), f" {_of(PLACE)} intersect {_of(PLACE_2)}")
_add("set_difference", lambda s, d: _chunks(s, d, PLACE).join(_chunks(s, d, PLACE_2), "chunk_id", "left_anti"), f" {_of(PLACE)} except {_of(PLACE_2)}")
_add("offset_page", lambda s, d: model.metadata(s, d).orderBy(*M.chronology()).offset(20).limit(11).select("chunk_id", "date_min"), " select chunk_id, date_min from meta order by date_min nulls last, chunk_id limit 11 offset 20")
_add(
    "best_chunk_per_year", lambda s, d: model.metadata(s, d).withColumn("year", F.year("date_min").cast("bigint")).withColumn("k", F.row_number().over(Window.partitionBy("year", "collection_slug").orderBy(*M.chronology()))).where("k <= 2").select("year", "collection_slug", "chunk_id"),
    ' select year(date_min) as "year", collection_slug, chunk_id from meta qualify row_number() over (partition by year(date_min), collection_slug order by date_min nulls last, chunk_id) <= 2',
)
_add(
    "interval_join", lambda s, d: model.metadata(s, d).alias("m").join(model.dates(s, d).alias("t"), (F.col("m.chunk_id") == F.col("t.chunk_id")) & (F.col("t.date_start") <= F.col("m.date_max")) & (F.col("t.date_end") >= F.col("m.date_min"))).groupBy("m.chunk_id").agg(F.count(F.lit(1)).alias("n_dates")),
    " select m.chunk_id, count(*) n_dates from meta m join dates t on m.chunk_id = t.chunk_id and t.date_start <= m.date_max and t.date_end >= m.date_min group by 1",
)
_add(
    "full_outer_join", lambda s, d: _chunks(s, d, PLACE).withColumn("a", F.lit(1)).join(_chunks(s, d, PLACE_2).withColumn("b", F.lit(1)), "chunk_id", "full_outer").select("chunk_id", F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b")),
    f" select coalesce(x.chunk_id, y.chunk_id) chunk_id, x.chunk_id is not null in_a, y.chunk_id is not null in_b from ({_of(PLACE)}) x full join ({_of(PLACE_2)}) y on x.chunk_id = y.chunk_id",
)
_add(
    "undirected_neighbours",
    lambda s, d: (lambda e: e.select("entity_id", "other_id").unionAll(e.select(F.col("other_id").alias("entity_id"), F.col("entity_id").alias("other_id"))).groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree")))(facets.pairs(model.mentions(s, d), model.metadata(s, d), 1)),
    ", m as (select distinct chunk_id, entity_id from mentions where chunk_id in (select chunk_id from meta)), e as (select distinct a.entity_id x, b.entity_id y from m a join m b on a.chunk_id = b.chunk_id and a.entity_id <> b.entity_id) select x entity_id, count(*) degree from e group by 1",
)
_add(
    "duplicate_names", lambda s, d: model.entities(s, d).groupBy(F.lower("name").alias("name_key")).agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("survivor")).where("n > 1"),
    " select lower(name) name_key, count(*) n, min(entity_id) survivor from entities group by 1 having count(*) > 1",
)
_add(
    "entity_merge",
    lambda s, d: (lambda e: model.mentions(s, d).join(e, "entity_id").select(F.col("winner").alias("entity_id"), "chunk_id", "start_char").groupBy("entity_id", "chunk_id").agg(F.min("start_char").cast("bigint").alias("start_char")))(
        model.entities(s, d).select("entity_id", F.min("entity_id").over(Window.partitionBy(F.lower("name"))).alias("winner"))
    ),
    ", e as (select entity_id, min(entity_id) over (partition by lower(name)) winner from entities) select winner entity_id, chunk_id, min(start_char)::bigint start_char from mentions join e using (entity_id) group by 1, 2",
)
_add("zero_mentions", lambda s, d: model.entities(s, d).join(model.mentions(s, d), "entity_id", "left_anti").select("entity_id", "name"), " select entity_id, name from entities e where not exists (select 1 from mentions m where m.entity_id = e.entity_id)")
# over all chunks; a recursive SQL is too slow there, so a test holds it
QUERIES["entity_components"] = lambda s, d: components(facets.stars(model.mentions(s, d), model.metadata(s, d)), "entity_id", "other_id").select(F.col("node").alias("entity_id"), F.col("component"))
