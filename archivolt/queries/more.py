"""Queries over resolution, audits, coverage, plans and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt import model
from archivolt.catalog import table as t
from archivolt.engine import Engine
from archivolt.functions import sql as registered
from archivolt.functions import text as T
from archivolt.operators import facets, pipelines as L
from archivolt.operators import resolution as Z
from archivolt.operators import retrieval as R
from archivolt.plans.primitives import primitive as P
from archivolt.queries.index import A, PLACE, START
from archivolt.queries.pipeline import _ALIAS, _CP, _STATS, _TIER, _aliases, _surfaces
from archivolt.queries.search import _VEC
from archivolt.queries.text import SURFACE, grams_sql, jaccard_sql, words_sql
from archivolt.sources.io import junction

QUERIES, SQL = {}, {}
BODY = "coalesce(clean_text, text)"


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _names(s, d):
    aliases = t(s, d, "part").select(F.col("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_brand", "p_name").alias("alias"))
    return Z.names_of(model.entities(s, d), aliases)


_NAMES = f"with {model.SQL}, al as (select p_partkey entity_id, p_brand || ' ' || p_name alias from part), nm as (select entity_id, name from entities union select entity_id, alias from al)"


def concordance(s, d):
    first = t(s, d, "part").agg(F.min("p_name")).first()[0]
    return Z.expanded_terms(_names(s, d), first, 12)


_add("concordance_expand", concordance, f"{_NAMES} select lower(name) term, min(entity_id) entity_id from nm where entity_id in (select entity_id from nm where lower(name) = lower((select min(p_name) from part))) group by 1 order by length(term), term limit 12")
_add(
    "entity_lookup", lambda s, d: Z.looked_up(_surfaces(s, d).select(F.col("surface_norm").alias("surface")), _aliases(s, d).select(F.hash("alias").cast("bigint").alias("entity_id"), F.col("alias").alias("name"))).select("surface", "similarity", "method", "ambiguous"),
    f"""with n as (select distinct surface_norm a from mention_candidates where surface_norm <> ''), {_ALIAS}, k as (select distinct {SURFACE.format(x='b')} b from al), g as (select a, {grams_sql('a')} ga from n where a not in (select b from k)), h as (select b, {grams_sql('b')} gb from k),
p as (select a, b, {jaccard_sql('ga', 'gb')} similarity from g, h), q as (select *, lead(similarity) over w nx, row_number() over w k from p where similarity >= 0.5 window w as (partition by a order by similarity desc, b))
select a surface, 1.0::double similarity, 'exact' "method", false ambiguous from n where a in (select b from k) union all select a, similarity, 'fuzzy', coalesce(nx = similarity, false) from q where k = 1""",
)
_flag = lambda ws: f"length(list_intersect(list_slice(w, greatest(p - 4, 1), greatest(p - 4, 1) + 8), [{', '.join(repr(x) for x in ws)}])) > 0"
_add(
    "context_hints", lambda s, d: t(s, d, "chunks").select("chunk_id", T.tokens(R.body()).alias("w")).where(T.has_term("w", "directorate")).select("chunk_id", *Z.hints("w", "directorate")),
    f"select chunk_id, {_flag(Z.TITLES)} titled, {_flag(Z.ORGANISATIONS)} organised, {_flag(Z.PLACES)} placed from (select chunk_id, w, list_position(w, 'directorate') p from (select chunk_id, {words_sql(BODY)} w from chunks)) where p > 0",
)
_banned = lambda s: s.createDataFrame([("ibid",), ("the said",), ("page two",)], "surface_norm string")
_add("proposals", lambda s, d: Z.proposable(_surfaces(s, d), _aliases(s, d), _banned(s)).select("surface_norm", "n_docs"), f"with {_STATS}, {_ALIAS} select surface_norm, n_docs from x where n_docs >= 2 and surface_norm not in (select b from al) and surface_norm not in ('ibid', 'the said', 'page two')")


def guardrails(s, d):
    x = _surfaces(s, d).join(_aliases(s, d).select(F.col("alias").alias("surface_norm"), F.lit(True).alias("known")), "surface_norm", "left")
    return x.select("surface_norm", Z.guarded(facets.tier(), F.col("known").isNotNull(), F.coalesce(F.col("n_common") / F.col("n_mentions"), F.lit(0.0))).alias("action"))


_add("guardrails", guardrails, f"with {_STATS}, {_ALIAS}, y as (select *, {_TIER} tier, surface_norm in (select b from al) known from x) select surface_norm, case when known and tier = 1 then 'auto_link' when not known and tier = 1 and coalesce(n_common::double / n_mentions, 0) >= 0.8 then 'auto_create' when tier <= 2 then 'queue' else 'ignore' end \"action\" from y")


def citations(s, d):
    pages = t(s, d, "pages")
    cites = pages.select("document_id").distinct().select((F.col("document_id") % 97).alias("entity_id"), "document_id", F.array(*map(F.lit, L.parse_page_list("2, 4-5"))).alias("pages"))
    return Z.cited_chunks(cites, pages, L.chunk_pages(t(s, d, "chunks"), pages))


_add("citation_chunks", citations, f"with {_CP} select distinct p.document_id % 97 entity_id, chunk_id from cp join pages p using (page_id) where p.page_seq in (2, 4, 5)")
_add(
    "index_health", lambda s, d: t(s, d, "chunks").select("chunk_id").join(t(s, d, "mention_candidates").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")), "chunk_id", "left").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("n").alias("n_covered"), F.round(F.count("n") / F.count(F.lit(1)), 6).alias("coverage"), F.coalesce(F.max("n"), F.lit(0)).alias("most")),
    "select count(*) n_chunks, count(n) n_covered, round(count(n)::double / count(*), 6) coverage, coalesce(max(n), 0) most from chunks left join (select chunk_id, count(*) n from mention_candidates group by 1) using (chunk_id)",
)
_has = lambda ws: f"length(list_intersect(w, [{', '.join(repr(x) for x in ws)}])) > 0"
_add(
    "type_audit", lambda s, d: _surfaces(s, d).select("surface_norm", Z.kind_of("surface_norm").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("surface_norm").alias("example")),
    f"select case when {_has(Z.ORGANISATIONS)} then 'org' when {_has(Z.TITLES)} then 'person' when length(w) between 2 and 4 then 'person?' else 'unknown' end kind, count(*) n, min(s) example from (select distinct surface_norm s, {words_sql('surface_norm')} w from mention_candidates where surface_norm is not null) group by 1",
)
_add(
    "constraint_scores", lambda s, d: t(s, d, "chunks").select("chunk_id", T.lexemes(R.body()).alias("w")).select("chunk_id", Z.weighted({"org": (T.has_term("w", "bureau"), 0.5), "place": (T.has_term("w", "embassy"), 0.4), "role": (T.has_term("w", "courier") | T.has_term("w", "agent"), 0.3)}).alias("score")).where("score > 0"),
    f"select * from (select chunk_id, round(least(case when list_contains(w, 'bureau') then 0.5 else 0 end + case when list_contains(w, 'embassy') then 0.4 else 0 end + case when list_contains(w, 'courier') or list_contains(w, 'agent') then 0.3 else 0 end, 1), 6)::double score from (select chunk_id, {words_sql(BODY)} w from chunks)) where score > 0",
)
_add(
    "anchor_coverage", lambda s, d: t(s, d, "chunks").select(F.lower(R.body()).alias("b")).agg(*(F.round(F.avg(F.contains("b", F.lit(w)).cast("int")), 6).alias(f"share_{w}") for w in ("cipher", "embassy", "bureau")), F.round(F.percentile(F.length("b"), F.lit(0.5)), 2).alias("median_length")),
    f"select {', '.join(f'''round(avg(contains(b, '{w}')::int), 6) share_{w}''' for w in ('cipher', 'embassy', 'bureau'))}, round(quantile_cont(length(b), 0.5), 2) median_length from (select lower({BODY}) b from chunks)",
)
_add(
    "coverage_by_set", lambda s, d: junction(t(s, d, "result_sets"), t(s, d, "chunks")).groupBy("result_set_id").agg(F.countDistinct("document_id").alias("n_docs"), F.count_if(F.col("document_id").isNull()).alias("n_unknown"), F.count(F.lit(1)).alias("n_chunks")),
    "with j as (select distinct result_set_id, unnest(chunk_ids) chunk_id from result_sets) select result_set_id, count(distinct document_id) n_docs, count(*) filter (document_id is null) n_unknown, count(*) n_chunks from j left join chunks using (chunk_id) where j.chunk_id is not null group by 1",
)
_add(
    "candidate_pool", lambda s, d: Z.pool(model.metadata(s, d).withColumn("year", F.year("date_min").cast("bigint")), 3, [F.asc("collection_slug"), F.asc("chunk_id")], "year").select("chunk_id", "year"),
    f'with {model.SQL}, y as (select *, year(date_min) as "year" from meta), f as (select * from y order by collection_slug, chunk_id limit 3) select chunk_id, "year" from f union all select chunk_id, "year" from (select * from y where "year" not in (select "year" from f) qualify row_number() over (partition by "year" order by collection_slug, chunk_id) = 1)',
)
_add(
    "line_context", lambda s, d: Z.line_context(t(s, d, "pages"), "page_id", "raw_text", "cipher").select("page_id", F.col("line_no").cast("bigint").alias("line_no"), "line", "above", "below"),
    "with l as (select page_id, unnest(range(length(x))) line_no, unnest(x) line from (select page_id, string_split(raw_text, chr(10)) x from pages where raw_text is not null)), w as (select *, lag(line) over v above, lead(line) over v below from l window v as (partition by page_id order by line_no)) select * from w where contains(lower(line), 'cipher')",
)
_add(
    "code_names", lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("“([A-Z][a-z]+)”"), F.lit(1)))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_docs")),
    "select name, count(*) n_docs from (select distinct doc_id, unnest(regexp_extract_all(text, '“([A-Z][a-z]+)”', 1)) name from documents where text is not null) group by 1",
)
_add(
    "unique_surnames", lambda s, d: _surfaces(s, d).select("surface_norm", T.surname("surface_norm").alias("last")).groupBy("last").agg(F.count(F.lit(1)).alias("n"), F.min("surface_norm").alias("surface_norm")).where("n = 1").select("last", "surface_norm"),
    f"select last, min(s) surface_norm from (select s, w[-1] last from (select distinct surface_norm s, {words_sql('surface_norm')} w from mention_candidates where surface_norm is not null)) group by 1 having count(*) = 1",
)
_add(
    "red_flags", lambda s, d: t(s, d, "mention_candidates").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("surface_norm").isNull()).alias("n_no_surface"), F.count_if(F.col("page_id").isNull()).alias("n_no_page"), (F.count("candidate_id") - F.countDistinct("candidate_id")).alias("n_repeated")).withColumn("flag", F.when(F.col("n_repeated") > 0, "repeats").when(F.col("n_no_surface") > 0, "gaps").otherwise("none")),
    "select *, case when n_repeated > 0 then 'repeats' when n_no_surface > 0 then 'gaps' else 'none' end flag from (select count(*) n, count(*) filter (surface_norm is null) n_no_surface, count(*) filter (page_id is null) n_no_page, count(candidate_id) - count(distinct candidate_id) n_repeated from mention_candidates)",
)
_add(
    "run_trace", lambda s, d: t(s, d, "retrieval_runs").distinct().select("retrieval_run_id", F.to_json(F.struct("search_type", "top_k")).alias("trace")),
    "select distinct retrieval_run_id, '{\"search_type\":\"' || search_type || '\",\"top_k\":' || top_k || '}' trace from retrieval_runs",
)

# plans and SQL functions


def _two_sets(s, d) -> list[int]:
    """The first two result sets that aren't empty."""
    return [r[0] for r in t(s, d, "result_sets").where(F.size("chunk_ids") > 0).orderBy("result_set_id").select("result_set_id").limit(2).collect()]


_plan = lambda *plan: lambda s, d: Engine(s, d).run(list(plan))
_M = f"with {model.SQL}"
_add("plan_count_by_collection", _plan(P("ENTITY", entity_id=PLACE), P("COUNT", group_by="collection")), f"{_M} select collection_slug, count(distinct chunk_id) n_chunks from meta where chunk_id in (select chunk_id from mentions where entity_id = {PLACE}) group by 1")
_add("plan_count_by_date", _plan(P("ENTITY", entity_id=PLACE), P("COUNT", group_by="date")), f'{_M} select year(date_min) as "year", count(distinct chunk_id) n_chunks, count(*) n_rows from meta where chunk_id in (select chunk_id from mentions where entity_id = {PLACE}) group by 1')
_add(
    "plan_mentions", lambda s, d: _plan(P("MENTIONS", entity_id=PLACE, limit=25), P("FILTER_COLLECTION", slug="BUILDING"), P("FILTER_DATE_RANGE", start=START))(s, d).select("chunk_id", F.col("rank").cast("bigint").alias("rank")),
    f"{_M} select chunk_id, row_number() over (order by date_min nulls last, chunk_id) as \"rank\" from meta m where collection_slug = 'BUILDING' and chunk_id in (select chunk_id from mentions where entity_id = {PLACE}) and (date_max >= date '{START}' or exists (select 1 from dates x where x.chunk_id = m.chunk_id and x.date_end >= date '{START}')) order by 2 limit 25",
)
_add("plan_first_mention", lambda s, d: _plan(P("FIRST_MENTION", entity_id=A))(s, d).select("chunk_id", "date_min"), f"{_M} select chunk_id, date_min from meta where chunk_id in (select chunk_id from mentions where entity_id = {A}) order by date_min nulls last, chunk_id limit 1")
_add("plan_terms", lambda s, d: _plan(P("TERM", value="cipher"), P("TERM", value="embassy"), P("SET_TERM_MODE", mode="OR"), P("EXCLUDE_TERM", value="hotel"), P("SET_TOP_K", k=30))(s, d).select("chunk_id", "score"), f"select chunk_id, round((length(list_filter(w, lambda t: t = 'cipher')) + length(list_filter(w, lambda t: t = 'embassy')))::double / (1 + ln(1 + length(w))), 6) score from (select chunk_id, {words_sql(BODY)} w from chunks) where (list_contains(w, 'cipher') or list_contains(w, 'embassy')) and not list_contains(w, 'hotel') order by score desc, chunk_id limit 30")


def _score(*phrases: str) -> str:
    """Occurrences of words and phrases over the damped length, over the words w."""
    one = lambda p: f"length(list_filter(range(1, length(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()!r}))"
    return f"round(({' + '.join(map(one, phrases))})::double / (1 + ln(1 + length(w))), 6)"


_TW = f"tw as (select chunk_id, document_id, collection_slug, {words_sql(BODY)} w from chunks)"
_has_phrase = lambda p: f"contains(' ' || array_to_string(w, ' ') || ' ', ' {p} ')"
_scored = lambda *plan: lambda s, d: _plan(*plan)(s, d).select("chunk_id", "score")
_add("plan_terms_in_collection", _scored(P("TERM", value="cipher"), P("FILTER_COLLECTION", slug="hearings")), f"with {_TW} select chunk_id, {_score('cipher')} score from tw where list_contains(w, 'cipher') and collection_slug = 'hearings'")
_DATED = f"""{_CP}, pm as (select page_id, cable_date from (select distinct * from page_metadata) qualify row_number() over (partition by page_id order by extracted_at desc, page_metadata_id desc) = 1),
cd as (select chunk_id, min(cable_date) a, max(cable_date) b from cp left join pm using (page_id) group by 1), td as (select tw.*, coalesce(a, doc_date) lo, coalesce(b, doc_date) hi from tw left join cd using (chunk_id) left join documents on doc_id = document_id)"""
_add("plan_phrase_in_dates", _scored(P("PHRASE", value="it is requested"), P("FILTER_DATE_RANGE", start="1940-01-01", end="1945-12-31")), f"with {_TW}, {_DATED} select chunk_id, {_score('it is requested')} score from td where {_has_phrase('it is requested')} and hi >= date '1940-01-01' and lo <= date '1945-12-31'")
_add(
    "plan_terms_in_result_set", lambda s, d: _scored(P("TERM", value="the"), *(P("WITHIN_RESULT_SET", result_set_id=r) for r in _two_sets(s, d)))(s, d),
    f"with {_TW}, two as (select result_set_id, chunk_ids from result_sets where length(chunk_ids) > 0 order by result_set_id limit 2) select chunk_id, {_score('the')} score from tw where list_contains(w, 'the') and chunk_id in (select unnest(chunk_ids) from two)",
)
_add(
    "plan_terms_excluded_set", lambda s, d: _scored(P("OR_GROUP", primitives=[P("TERM", value="cipher"), P("PHRASE", value="field office")]), P("EXCLUDE_RESULT_SET", result_set_id=_two_sets(s, d)[0]))(s, d),
    f"with {_TW}, two as (select result_set_id, chunk_ids from result_sets where length(chunk_ids) > 0 order by result_set_id limit 1) select chunk_id, {_score('cipher', 'field office')} score from tw where (list_contains(w, 'cipher') or {_has_phrase('field office')}) and chunk_id not in (select x from (select unnest(chunk_ids) x from two) where x is not null)",
)
_add("plan_terms_with_entity", _scored(P("TERM", value="the"), P("ENTITY", entity_id=PLACE)), f"with {model.SQL}, {_TW} select chunk_id, {_score('the')} score from tw where list_contains(w, 'the') and chunk_id in (select chunk_id from mentions where entity_id = {PLACE})")
_add("plan_terms_counted", _plan(P("TERM", value="cipher"), P("SET_QUERY_MODE", mode="aggregate")), f"with {_TW} select count(distinct chunk_id) n_chunks, count(distinct document_id) n_documents, count(distinct collection_slug) n_collections from tw where list_contains(w, 'cipher')")
_add("plan_terms_grouped", _plan(P("TERM", value="cipher"), P("GROUP_BY", field="collection_slug")), f"with {_TW} select collection_slug, count(distinct chunk_id) n_chunks from tw where list_contains(w, 'cipher') group by 1")
_add("plan_terms_thorough", lambda s, d: _plan(P("TERM", value="cipher"), P("SET_RETRIEVAL_MODE", mode="thorough"))(s, d).select("chunk_id", F.col("rank").cast("bigint").alias("rank")), f'with {_TW} select chunk_id, row_number() over (order by document_id nulls last, chunk_id) as "rank" from tw where list_contains(w, \'cipher\')')
_add("plan_co_located", lambda s, d: _plan(P("CO_LOCATED", entity_a=PLACE, entity_b=PLACE + 4, scope="document"), P("COUNT"))(s, d), f"with {model.SQL} select count(distinct chunk_id) n_chunks from meta where document_id in (select document_id from meta where chunk_id in (select chunk_id from mentions where entity_id = {PLACE})) and document_id in (select document_id from meta where chunk_id in (select chunk_id from mentions where entity_id = {PLACE + 4}))")
_add("plan_count_by_entity", _plan(P("FILTER_COLLECTION", slug="BUILDING"), P("COUNT", group_by="entity")), f"with {model.SQL} select entity_id, count(distinct chunk_id) n_chunks from mentions where chunk_id in (select chunk_id from meta where collection_slug = 'BUILDING') group by 1 order by 2 desc, 1 limit 50")


def plan_hybrid(s, d):
    """Terms and the first usable vector, fused; only chunks that both lists hold."""
    from archivolt.queries.search import _query_vector

    plan = [P("TERM", value="cipher"), P("SET_SEARCH_TYPE", search_type="hybrid"), P("REQUIRE_EVIDENCE", in_lexical=True, in_vector=True), P("SET_SIMILARITY_THRESHOLD", threshold=0.1)]
    return Engine(s, d).run(plan, _query_vector(s, d)).select("chunk_id", "score")


_add(
    "plan_hybrid", plan_hybrid,
    f"with {_TW}, {_VEC}, l as (select chunk_id, row_number() over (order by {_score('cipher')} desc, chunk_id) r from tw where list_contains(w, 'cipher')), x as (select chunk_id, row_number() over (order by round(1 - distance, 6) desc, chunk_id) r from v where distance <= 0.9) select l.chunk_id, round(1.0::double / (60 + l.r) + 1.0::double / (60 + x.r), 9) score from l join x using (chunk_id)",
)


def sql_functions(s, d):
    registered.register(s, d, ["mention_candidates", "result_sets", "retrieval_runs", "chunks"])
    return s.sql("select distinct normalize_surface(raw_span) as surface, variant_key(raw_span) as variant, is_proposable(surface_norm, 2) as fit from mention_candidates where raw_span is not null")


_add("sql_functions", sql_functions, rf"select distinct {SURFACE.format(x='raw_span')} surface, regexp_replace(lower(raw_span), '[^a-z0-9]', '', 'g') variant, length(surface_norm) >= 3 and regexp_matches(surface_norm, '[a-z]') fit from mention_candidates where raw_span is not null")


def sql_views(s, d):
    registered.register(s, d, ["mention_candidates", "result_sets", "retrieval_runs", "chunks"])
    return s.sql("select r.result_set_id, r.search_type, count(c.chunk_id) as n, count_if(q.quality = 'doubtful') as n_doubtful from result_sets_with_run r left join result_set_chunks c using (result_set_id) left join chunk_quality q using (chunk_id) group by all")


_add("sql_views", sql_views, "with j as (select distinct result_set_id, chunk_id from (select result_set_id, unnest(chunk_ids) chunk_id from result_sets) where chunk_id is not null) select s.result_set_id, r.search_type, count(j.chunk_id) n, count(*) filter (regexp_matches(c.text, '[~^|_]')) n_doubtful from result_sets s left join (select distinct retrieval_run_id, search_type from retrieval_runs) r using (retrieval_run_id) left join j on j.result_set_id = s.result_set_id left join chunks c on c.chunk_id = j.chunk_id group by 1, 2")
