"""Queries over pipelines, runs, result sets, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.catalog import table
from archivolt.functions import dates as D
from archivolt.functions import text as T
from archivolt.functions.scores import decision
from archivolt.operators import evidence as E
from archivolt.operators import facets, pipelines as L
from archivolt.operators import retrieval as R
from archivolt.queries.text import SURFACE, grams_sql, jaccard_sql, words_sql
from archivolt.shared import scratch
from archivolt.sources import io
from archivolt.streaming import windows as S

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


t = table
_big = lambda *names: [F.col(n).cast("bigint").alias(n) for n in names]

# surfaces and tiers
_RAW = "r as (select surface_norm, raw_span, count(*) n from mention_candidates group by 1, 2), b as (select surface_norm, raw_span common_raw, n n_common from r where raw_span is not null qualify row_number() over (partition by surface_norm order by n desc, raw_span) = 1)"
_STATS = f"""{_RAW}, s as (select m.surface_norm, count(*) n_mentions, count(distinct document_id) n_docs, count(distinct chunk_id) n_chunks, round(avg(quality_score) filter (not isnan(quality_score)), 6) avg_quality, min(created_at) first_seen, count(*) filter (has_hint_token) n_hinted from mention_candidates m where m.surface_norm is not null group by 1),
x as (select s.*, common_raw, n_common, n_common * 2 > n_mentions stable from s left join b using (surface_norm))"""


def _surfaces(s, d):
    m = t(s, d, "mention_candidates").where("surface_norm is not null").withColumn("quality_score", F.when(~F.isnan("quality_score"), F.col("quality_score")))
    return facets.surfaces(m)


_TIER = "case when n_docs >= 10 and avg_quality >= 0.6 then 1 when n_docs >= 3 and avg_quality >= 0.5 then 2 else 3 end"
_add("surface_stats", _surfaces, f"with {_STATS} select * from x")
_add("surface_tiers", lambda s, d: _surfaces(s, d).select("surface_norm", facets.tier().cast("bigint").alias("tier")), f"with {_STATS} select surface_norm, ({_TIER})::bigint tier from x")
_add(
    "tier_summary", lambda s, d: _surfaces(s, d).withColumn("tier", facets.tier().cast("bigint")).groupBy("tier").agg(F.count(F.lit(1)).alias("n_surfaces"), F.sum("n_mentions").alias("n_mentions"), F.round(F.avg("n_docs"), 6).alias("avg_docs")),
    f"with {_STATS} select ({_TIER})::bigint tier, count(*) n_surfaces, sum(n_mentions)::bigint n_mentions, round(avg(n_docs), 6) avg_docs from x group by 1",
)
_add(
    "surface_labels",
    lambda s, d: t(s, d, "mention_candidates").where("surface_norm is not null and doc_quality is not null").groupBy("surface_norm", "doc_quality").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("docs")).groupBy("surface_norm").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("doc_quality", "n"))))).alias("labels"), F.round(F.max("n") / F.sum("n"), 6).alias("consistency")
    ),
    "select surface_norm, '{' || string_agg('\"' || doc_quality || '\":' || n, ',' order by doc_quality) || '}' labels, round(max(n)::double / sum(n), 6) consistency from (select surface_norm, doc_quality, count(*) n from mention_candidates where surface_norm is not null and doc_quality is not null group by 1, 2) group by 1",
)
_add(
    "junk_patterns", lambda s, d: t(s, d, "mention_candidates").where("surface_norm is not null").groupBy("surface_norm").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("resolution_status") == "ignored", 1)).alias("n_ignored")).where("n >= 5 and n_ignored * 2 > n"),
    "select surface_norm, count(*) n, count(*) filter (resolution_status = 'ignored') n_ignored from mention_candidates where surface_norm is not null group by 1 having count(*) >= 5 and n_ignored * 2 > count(*)",
)
_add(
    "calibration_bands", lambda s, d: t(s, d, "mention_candidates").where("quality_score is not null and not isnan(quality_score)").groupBy(F.floor(F.col("quality_score") * 10).cast("bigint").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.coalesce(F.col("resolution_status"), F.lit("")) == "resolved").cast("double")), 6).alias("share_resolved")),
    "select floor(quality_score * 10)::bigint band, count(*) n, round(avg((coalesce(resolution_status, '') = 'resolved')::int), 6) share_resolved from mention_candidates where quality_score is not null and not isnan(quality_score) group by 1",
)
_add(
    "review_groups", lambda s, d: t(s, d, "mention_candidates").where("resolution_status = 'queue' or resolution_status = 'queued'").dropDuplicates(["candidate_id"]).groupBy(F.md5(F.coalesce("surface_norm", F.lit("")).cast("binary")).alias("group_key")).agg(F.count(F.lit(1)).alias("n")),
    "select md5(coalesce(surface_norm, '')) group_key, count(*) n from (select distinct candidate_id, surface_norm from mention_candidates where resolution_status in ('queue', 'queued')) group by 1",
)
_add(
    "top_per_document", lambda s, d: t(s, d, "mention_candidates").where("surface_norm is not null").groupBy("document_id", "surface_norm").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("n"), "surface_norm"))).where("k <= 3").select("document_id", "surface_norm", "n"),
    "select document_id, surface_norm, count(*) n from mention_candidates where surface_norm is not null group by 1, 2 qualify row_number() over (partition by document_id order by count(*) desc, surface_norm) <= 3",
)
_add("primary_surface", lambda s, d: L.majority(t(s, d, "mention_candidates").where("surface_norm is not null"), "chunk_id", "surface_norm"), "select chunk_id, surface_norm, count(*) n from mention_candidates where surface_norm is not null group by 1, 2 qualify row_number() over (partition by chunk_id order by count(*) desc, surface_norm) = 1")
_add(
    "unique_words", lambda s, d: t(s, d, "mention_candidates").where("surface_norm is not null").select("surface_norm").distinct().select("surface_norm", F.explode(F.array_distinct(F.split("surface_norm", " "))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("surface_norm").alias("surface")).where("n = 1").select("word", "surface"),
    "select word, min(surface_norm) surface from (select distinct surface_norm, unnest(string_split(surface_norm, ' ')) word from mention_candidates where surface_norm is not null) group by 1 having count(*) = 1",
)

# matching, resolution, clustering
_NAMES = "n as (select distinct surface_norm a from mention_candidates where surface_norm <> '')"
_ALIAS = rf"al as (select distinct lower(trim(regexp_replace(alias_norm, '\s+', ' ', 'g'))) b from alias_stats where trim(alias_norm) <> '')"
_names = lambda s, d: t(s, d, "mention_candidates").select("surface_norm").where("surface_norm <> ''").distinct()
_aliases = lambda s, d: t(s, d, "alias_stats").select(F.lower(T.collapse("alias_norm")).alias("alias")).where("alias <> ''").distinct()
_SIM = f"with {_NAMES}, {_ALIAS}, g as (select a, {grams_sql('a')} ga from n), h as (select b, {grams_sql('b')} gb from al), j as (select a, b, {jaccard_sql('ga', 'gb')} similarity from g, h where a <> b), p as (select * from j where similarity >= 0.5)"
_pairs = lambda s, d, **more: L.trigram_join(_names(s, d), _aliases(s, d), "surface_norm", "alias", 0.5, **more)
_add("trigram_join", _pairs, f"{_SIM} select * from p")
_add(
    "resolve_surfaces", lambda s, d: L.resolved(_pairs(s, d, top=11)).select("a", "b", "similarity", *_big("place"), "margin", "decision"),
    f"""{_SIM} select a, b, similarity, place::bigint place, margin, case when place > 1 then 'candidate' when similarity >= 0.75 and coalesce(margin, 1) >= 0.15 then 'resolved' when similarity >= 0.5 then 'queue' else 'ignore' end decision
from (select *, row_number() over w place, round(similarity - lead(similarity) over w, 6) margin from p window w as (partition by a order by similarity desc, b)) where place <= 10""",
)
_SELF = f"with recursive {_NAMES}, g as (select a, {grams_sql('a')} ga from n), e as (select x.a x, y.a y from g x, g y where x.a <> y.a and {jaccard_sql('x.ga', 'y.ga')} >= 0.6), w(root, node) as (select distinct x, x from e union select w.root, e.y from w join e on e.x = w.node)"
_add("variant_clusters", lambda s, d: L.clusters(L.trigram_links(_names(s, d), "surface_norm", 0.6)), f"{_SELF} select node as member, min(root) as \"cluster\" from w group by 1")
_add("greedy_variants", lambda s, d: L.merged_variants(_surfaces(s, d), "surface_norm", "n_mentions", F.left(T.surname("surface_norm"), F.lit(5))))
_add(
    "alias_matches", lambda s, d: L.alias_matches(t(s, d, "chunks"), _aliases(s, d), R.body()).select("chunk_id", "alias", *_big("start", "words")),
)
_add(
    "alias_frequency",
    lambda s, d: L.alias_hits(t(s, d, "chunks"), _aliases(s, d), R.body()).select("chunk_id", "alias").distinct().join(t(s, d, "chunks").select("chunk_id", "document_id"), "chunk_id").groupBy("alias", "document_id").agg(F.count(F.lit(1)).alias("df_chunks")),
    rf"with {_ALIAS}, w as (select chunk_id, document_id, ' ' || array_to_string({words_sql('coalesce(clean_text, text)')}, ' ') || ' ' body from chunks) select b alias, document_id, count(*) df_chunks from w join al on contains(body, ' ' || b || ' ') where regexp_full_match(b, '[\p{{L}}\p{{N}}_]+( [\p{{L}}\p{{N}}_]+)*') group by 1, 2",
)
_OVER = [("edward logrilasek", None, None, None, True), ("ibid", None, None, None, True), ("the said", 74, 99, None, False), ("the said", None, 98, None, False), ("page two", None, None, 1, False)]


def overrides(s, d):
    c = t(s, d, "mention_candidates").where("surface_norm is not null").select(F.col("surface_norm").alias("surface"), F.col("document_id").alias("scope_id")).distinct()
    both = c.select("surface", "scope_id", F.explode(F.array(F.struct(F.lit(1).cast("bigint").alias("entity_id"), F.lit(0.9).alias("score")), F.struct(F.lit(2).cast("bigint").alias("entity_id"), F.lit(0.5).alias("score")))).alias("x")).select("surface", "scope_id", "x.*")
    o = s.createDataFrame(_OVER, "surface string, scope_id bigint, forced_entity_id bigint, banned_entity_id bigint, banned boolean")
    return L.overridden(both, o)


_add(
    "overrides", overrides,
    """with o(surface, scope_id, forced, banned_entity, banned) as (values ('edward logrilasek', null, null, null, true), ('ibid', null, null, null, true), ('the said', 74, 99, null, false), ('the said', null, 98, null, false), ('page two', null, null, 1, false)),
c as (select distinct surface_norm surface, document_id scope_id from mention_candidates where surface_norm is not null), e as (select * from c, (values (1, 0.9), (2, 0.5)) v(entity_id, score)),
k as (select * from e where not exists (select 1 from o where o.surface = e.surface and (o.scope_id is null or o.scope_id = e.scope_id) and (o.banned or o.banned_entity = e.entity_id))),
f as (select k.*, o.forced, o.scope_id fs from k left join o on o.surface = k.surface and (o.scope_id is null or o.scope_id = k.scope_id) and o.forced is not null)
select surface, scope_id, coalesce(forced, entity_id)::bigint entity_id, case when forced is not null then 'forced' else 'best' end reason from f qualify row_number() over (partition by surface, scope_id order by (forced is null)::int, (fs is null)::int, score desc, entity_id) = 1""",
)

# texts to relations
_PACK = r"""with recursive p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(x, ' ')), lambda x: x <> '') p from documents where text is not null),
w as (select doc_id, p, 1 i, 0 ordinal, length(p[1]) n from p where length(p) > 0
  union all select doc_id, p, i + 1, case when n + length(p[i + 1]) + 2 <= 1000 then ordinal else ordinal + 1 end, case when n + length(p[i + 1]) + 2 <= 1000 then n + length(p[i + 1]) + 2 else length(p[i + 1]) end from w where i < length(p))
select doc_id, ordinal::bigint ordinal, max(n)::bigint n_chars from w group by 1, 2"""
_add("pack_paragraphs", lambda s, d: L.packed(t(s, d, "documents").where("text is not null"), "doc_id", "text", 1000).select("doc_id", *_big("ordinal"), F.length("text").cast("bigint").alias("n_chars")), _PACK)
_TURN = r"with l as (select doc_id, i n, p[i] line from (select doc_id, string_split(text, chr(10)) p from documents where text is not null), lateral (select unnest(range(1, length(p) + 1)) i)), s as (select *, regexp_extract(line, '^((?:The CHAIRMAN|Q|A|(?:Mr|Mrs|Dr|Col|Senator)\.? [A-Z][a-z]+))\. ', 1) speaker from l), u as (select *, sum((speaker <> '')::int) over (partition by doc_id order by n) turn from s), tt as (select doc_id, turn::bigint turn, max(speaker) speaker, count(*) n_lines, string_agg(line, chr(10) order by n) text from u where turn > 0 group by 1, 2)"
_turns = lambda s, d: L.turns(t(s, d, "documents").where("text is not null"), "doc_id", "text")
_add("transcript_turns", _turns, f"{_TURN} select * from tt")
_add(
    "speaker_runs", lambda s, d: L.islands(_turns(s, d), "doc_id", ["turn"], "speaker"),
    f"{_TURN}, n as (select *, row_number() over w n, case when lag(speaker) over w = speaker then 0 else 1 end c from tt window w as (partition by doc_id order by turn)), r as (select *, sum(c) over (partition by doc_id order by n) run from n) select doc_id, run::bigint run, speaker, min(n) first_row, max(n) last_row, count(*) length from r group by 1, 2, 3",
)
_add(
    "event_runs", lambda s, d: L.islands(t(s, d, "events"), "user_id", ["ts", "event_id"], "event_type"),
    "with n as (select *, row_number() over w n, case when lag(event_type) over w = event_type then 0 else 1 end c from events window w as (partition by user_id order by ts, event_id)), r as (select *, sum(c) over (partition by user_id order by n) run from n) select user_id, run::bigint run, event_type, min(n) first_row, max(n) last_row, count(*) length from r group by 1, 2, 3",
)
_FORM = "case " + " ".join(f"when regexp_full_match(surface, '{p}') then '{n}'" for p, n, _ in D.FORMS) + " end"
_SURE = "case form " + " ".join(f"when '{n}' then {c}" for _, n, c in D.FORMS) + " end"
_ymd = lambda y, m, d: f"try_strptime(printf('%04d-%02d-%02d', {y}, {m}, {d}), '%Y-%m-%d')::date"
_full = "case when n3 < 100 then n3 + 1900 else n3 end"
_add(
    "date_mentions", lambda s, d: D.date_mentions(t(s, d, "documents").where("text is not null"), "doc_id", "text"),
    rf"""with e as (select distinct doc_id, unnest(regexp_extract_all(text, '{D.ANY}', 1)) surface from documents where text is not null),
n as (select *, {_FORM} form, list_transform(regexp_extract_all(surface, '(\d+)', 1), lambda x: x::int) k, (instr('{D.SHORT}', lower(left(regexp_extract(surface, '([A-Z][a-z]+)', 1), 3))) + 2) // 3 m from e),
x as (select *, k[1] n1, k[2] n2, k[3] n3 from n),
y as (select *, case when form in ('range', 'year') then {_ymd('n1', 1, 1)} when form = 'iso' then {_ymd('n1', 'n2', 'n3')} when form in ('day first', 'month first') then {_ymd('n2', 'm', 'n1')} when form = 'slashes' then {_ymd(_full, 'n1', 'n2')} when form = 'dots' then {_ymd(_full, 'n2', 'n1')} else {_ymd('n1', 'm', 1)} end date_start from x),
z as (select *, case form when 'range' then {_ymd('n2', 12, 31)} when 'year' then {_ymd('n1', 12, 31)} when 'month' then last_day(date_start) else date_start end date_end from y)
select doc_id, surface, date_start, date_end, case when form in ('range', 'year', 'month') then form else 'day' end "precision", ({_SURE})::double confidence from z where date_start is not null and date_end >= date_start""",
)
_add("chunk_pages", lambda s, d: L.chunk_pages(t(s, d, "chunks"), t(s, d, "pages")).select("chunk_id", "page_id", *_big("span_order")), "select c.chunk_id, p.page_id, (p.page_seq - least(a.page_seq, b.page_seq) + 1)::bigint span_order from chunks c join pages a on a.page_id = c.first_page_id join pages b on b.page_id = coalesce(c.last_page_id, c.first_page_id) join pages p on p.document_id = a.document_id and p.page_seq between least(a.page_seq, b.page_seq) and greatest(a.page_seq, b.page_seq)")
_CP = "cp as (select c.chunk_id, p.page_id, p.page_seq - least(a.page_seq, b.page_seq) + 1 o from chunks c join pages a on a.page_id = c.first_page_id join pages b on b.page_id = coalesce(c.last_page_id, c.first_page_id) join pages p on p.document_id = a.document_id and p.page_seq between least(a.page_seq, b.page_seq) and greatest(a.page_seq, b.page_seq))"
_add(
    "chunk_metadata", lambda s, d: L.chunk_metadata(L.chunk_pages(t(s, d, "chunks"), t(s, d, "pages")), t(s, d, "page_metadata").distinct()),
    f"""with {_CP}, m as (select * from (select distinct * from page_metadata) qualify row_number() over (partition by page_id order by extracted_at desc, page_metadata_id desc) = 1)
select chunk_id, arg_min(page_id, o) first_page_id, arg_max(page_id, o) last_page_id, string_agg(page_id::varchar, ',' order by o) page_ids, min(cable_date) date_min, max(cable_date) date_max, coalesce(array_to_string(list_sort(list(distinct sender) filter (sender is not null)), '; '), '') senders, coalesce(array_to_string(list_sort(list(distinct recipient) filter (recipient is not null)), '; '), '') recipients, bool_or(is_extract) any_extract
from cp left join m using (page_id) group by 1""",
)
_add(
    "boilerplate_lines", lambda s, d: L.boilerplate(t(s, d, "pages")),
    """with l as (select document_id, page_id, string_split(raw_text, chr(10)) l from pages where raw_text is not null), e as (select distinct document_id, page_id, unnest(list_concat(list_slice(l, 1, 4), list_slice(l, greatest(length(l) - 3, 1), length(l)))) line from l), x as (select document_id, trim(line, ' ') line, count(distinct page_id) n_pages from e where trim(line, ' ') <> '' group by 1, 2), n as (select document_id, count(*) n from l group by 1)
select document_id, line, n_pages from x join n using (document_id) where n >= 3 and n_pages >= 0.3 * n""",
)
_add(
    "corpus_validation",
    lambda s, d: (lambda docs, pages, chunks: docs.join(pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"), (F.max("page_seq") - F.min("page_seq") + 1 - F.countDistinct("page_seq")).cast("bigint").alias("seq_gaps")), F.col("doc_id") == F.col("document_id"), "left").drop("document_id").join(chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks")), F.col("doc_id") == F.col("document_id"), "left").select("doc_id", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("seq_gaps", F.lit(0)).alias("seq_gaps"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")))(t(s, d, "documents").select("doc_id"), t(s, d, "pages"), t(s, d, "chunks")),
    "select doc_id, coalesce(n_pages, 0) n_pages, coalesce(seq_gaps, 0) seq_gaps, coalesce(n_chunks, 0) n_chunks from documents left join (select document_id, count(*) n_pages, (max(page_seq) - min(page_seq) + 1 - count(distinct page_seq))::bigint seq_gaps from pages group by 1) p on p.document_id = doc_id left join (select document_id, count(*) n_chunks from chunks group by 1) c on c.document_id = doc_id",
)
_add(
    "collection_tree", lambda s, d: t(s, d, "documents").select("doc_id", F.coalesce("collection_slug", F.lit("(none)")).alias("slug")).join(t(s, d, "chunks").select("document_id", "chunk_id"), F.col("doc_id") == F.col("document_id"), "left").groupBy("slug").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("chunk_id").alias("n_chunks")),
    "select coalesce(d.collection_slug, '(none)') slug, count(distinct doc_id) n_docs, count(distinct chunk_id) n_chunks from documents d left join chunks c on c.document_id = doc_id group by 1",
)

# runs, result sets and their comparison
_add("result_set_junction", lambda s, d: io.junction(t(s, d, "result_sets"), t(s, d, "chunks")).select("result_set_id", "chunk_id", *_big("rank"), "document_id"), "with j as (select result_set_id, chunk_id, min(i) i from (select result_set_id, unnest(chunk_ids) chunk_id, unnest(range(length(chunk_ids))) i from result_sets) where chunk_id is not null group by 1, 2) select result_set_id, chunk_id, row_number() over (partition by result_set_id order by i) as \"rank\", document_id from j left join chunks using (chunk_id)")
_add(
    "result_sets_with_run", lambda s, d: t(s, d, "result_sets").select("result_set_id", "set_name", "retrieval_run_id").join(t(s, d, "retrieval_runs").select("retrieval_run_id", "query_text", "search_type").distinct(), "retrieval_run_id", "left"),
    "select retrieval_run_id, result_set_id, set_name, query_text, search_type from result_sets left join (select distinct retrieval_run_id, query_text, search_type from retrieval_runs) using (retrieval_run_id)",
)
_add("latest_run_per_query", lambda s, d: t(s, d, "retrieval_runs").withColumn("k", F.row_number().over(Window.partitionBy("query_text").orderBy(F.desc_nulls_last("created_at"), F.desc("retrieval_run_id")))).where("k = 1").select("query_text", "retrieval_run_id"), "select query_text, retrieval_run_id from retrieval_runs qualify row_number() over (partition by query_text order by created_at desc nulls last, retrieval_run_id desc) = 1")
_add(
    "run_stats", lambda s, d: t(s, d, "retrieval_runs").distinct().groupBy("search_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size("returned_chunk_ids")), 6).alias("avg_returned"), F.count_if(F.size("returned_chunk_ids") < 3).alias("n_low"), F.max("top_k").cast("bigint").alias("max_k")),
    "select search_type, count(*) n, round(avg(length(returned_chunk_ids)), 6) avg_returned, count(*) filter (length(returned_chunk_ids) < 3) n_low, max(top_k)::bigint max_k from (select distinct * from retrieval_runs) group by 1",
)
_add(
    "set_stability", lambda s, d: t(s, d, "result_sets").select("result_set_id", F.array_distinct(F.array_compact("chunk_ids")).alias("ids")).withColumn("before", F.lag("ids").over(Window.partitionBy(F.pmod("result_set_id", F.lit(7))).orderBy("result_set_id"))).where("before is not null").select("result_set_id", T.jaccard("ids", "before").alias("jaccard"), F.size(F.array_except("ids", "before")).cast("bigint").alias("n_new")),
    f"select result_set_id, {jaccard_sql('ids', 'before')} jaccard, length(list_filter(ids, lambda x: not list_contains(before, x)))::bigint n_new from (select result_set_id, ids, lag(ids) over (partition by result_set_id % 7 order by result_set_id) before from (select result_set_id, list_distinct(list_filter(chunk_ids, lambda x: x is not null)) ids from result_sets)) where before is not null",
)
_add(
    "result_set_facet", lambda s, d: io.junction(t(s, d, "result_sets"), t(s, d, "chunks")).groupBy("result_set_id", "document_id").agg(F.count(F.lit(1)).alias("n")),
    "with j as (select distinct result_set_id, unnest(chunk_ids) chunk_id from result_sets) select result_set_id, document_id, count(*) n from j left join chunks using (chunk_id) where chunk_id is not null group by 1, 2",
)
_add(
    "run_contribution",
    lambda s, d: (lambda r: r.groupBy("retrieval_run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(1 / (60 + F.col("at") + 1)), 6).alias("mass"), F.count_if(F.col("at") < 10).alias("n_first")))(t(s, d, "retrieval_runs").select("retrieval_run_id", "returned_chunk_ids").distinct().select("retrieval_run_id", F.posexplode("returned_chunk_ids").alias("at", "chunk_id")).where("chunk_id is not null")),
    "select retrieval_run_id, count(*) n, round(sum(1.0::double / (60 + i + 1)), 6) mass, count(*) filter (i < 10) n_first from (select retrieval_run_id, unnest(returned_chunk_ids) chunk_id, unnest(range(length(returned_chunk_ids))) i from (select distinct retrieval_run_id, returned_chunk_ids from retrieval_runs)) where chunk_id is not null group by 1",
)

# aggregates and windows
_add(
    "event_percentiles", lambda s, d: t(s, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"), F.count_if(F.col("value") > 20).alias("n_high"), F.min_by("user_id", F.struct("ts", "event_id")).alias("first_user")),
    "select event_type, round(quantile_cont(value, 0.5), 6) median, round(quantile_cont(value, 0.9), 6) p90, count(*) filter (value > 20) n_high, arg_min(user_id, row(ts, event_id)) first_user from events group by 1",
)
_add(
    "sales_rollup", lambda s, d: t(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")),
    "select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) qty from lineitem group by rollup (l_returnflag, l_linestatus)",
)
_add(
    "moving_sum", lambda s, d: t(s, d, "events").select("event_id", F.round(F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)), 4).alias("last_four"), F.ntile(4).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("fourth"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("bigint").alias("type_rank")),
    "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 3 preceding and current row), 4) last_four, ntile(4) over (partition by user_id order by ts, event_id) as fourth, dense_rank() over (partition by user_id order by event_type) type_rank from events",
)
_add("json_props", lambda s, d: t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k is not null"), "select event_id, json_extract_string(props, '$.k')::bigint k from events where json_extract_string(props, '$.k') is not null")
_add("null_safe_join", lambda s, d: t(s, d, "chunks").select("chunk_id", "collection_slug").alias("a").join(t(s, d, "chunks").select("collection_slug").distinct().alias("b"), F.col("a.collection_slug").eqNullSafe(F.col("b.collection_slug"))).select("chunk_id", "a.collection_slug"), "select a.chunk_id, a.collection_slug from chunks a join (select distinct collection_slug from chunks) b on a.collection_slug is not distinct from b.collection_slug")
_add(
    "candidate_pool_quota", lambda s, d: L.within_quota(t(s, d, "mention_candidates").where("quality_score is not null and not isnan(quality_score)").dropDuplicates(["candidate_id"]), [F.desc("quality_score"), F.asc("candidate_id")], {"chunk_id": 1, "document_id": 2}, 100).select("candidate_id", "document_id"),
    "with a as (select * from (select distinct * from mention_candidates) where quality_score is not null and not isnan(quality_score)), b as (select * from a qualify row_number() over (partition by chunk_id order by quality_score desc, candidate_id) <= 1), c as (select * from b qualify row_number() over (partition by document_id order by quality_score desc, candidate_id) <= 2) select candidate_id, document_id from c order by quality_score desc, candidate_id limit 100",
)


def diverse_selection(s, d):
    sets = io.junction(t(s, d, "result_sets"), t(s, d, "chunks").select("chunk_id", "document_id", "first_page_id"))
    scored = sets.withColumn("score", 1 / (60 + F.col("rank"))).join(t(s, d, "chunks").select("chunk_id", "first_page_id"), "chunk_id", "left").withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("document_id", "first_page_id")})
    return L.diverse(scored, "result_set_id", "score", {"document_id": 0.004, "first_page_id": 0.002}, 5)


_add("diverse_selection", diverse_selection)

# evidence
_SENT = r"list_filter(list_transform(string_split(regexp_replace(coalesce(clean_text, text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_SPANS = f"select chunk_id, i - 1 sentence, length(list_intersect(list_distinct({words_sql('s[i]')}), ['cipher', 'embassy']))::bigint n_hits, sha256({SURFACE.format(x='s[i]')}) span_hash from (select chunk_id, {_SENT} s from chunks), lateral (select unnest(range(1, length(s) + 1)) i) where length(list_intersect({words_sql('s[i]')}, ['cipher', 'embassy'])) > 0"
_spans = lambda s, d: E.spans(t(s, d, "chunks").select("chunk_id", "document_id", R.body().alias("body")), "chunk_id", "body", ["cipher", "embassy"])
_add("evidence_spans", lambda s, d: _spans(s, d).select("chunk_id", *_big("sentence"), "n_hits", "span_hash"), _SPANS)
_add("claims", lambda s, d: E.co_mention_claims(t(s, d, "mention_candidates"), 2), "with m as (select distinct chunk_id, surface_norm s from mention_candidates where surface_norm is not null and chunk_id is not null) select a.s subject, b.s object, sha1(a.s || '|' || b.s) claim_id, count(*) support from m a join m b on a.chunk_id = b.chunk_id and a.s < b.s group by 1, 2 having count(*) >= 2")
_add(
    "claim_grounding", lambda s, d: E.grounded_claims(t(s, d, "mention_candidates"), t(s, d, "chunks").select("chunk_id", R.body().alias("body")), 2).where("n_refs > 0").select("claim_id", "n_refs", "n_attested"),
    f"""with m as (select distinct chunk_id, surface_norm s from mention_candidates where surface_norm is not null and chunk_id is not null), c as (select a.s subject, b.s object, sha1(a.s || '|' || b.s) claim_id from m a join m b on a.chunk_id = b.chunk_id and a.s < b.s group by 1, 2 having count(*) >= 2),
r as (select claim_id, subject, object, a.chunk_id from c join m a on a.s = subject join m b on b.s = object and b.chunk_id = a.chunk_id)
select claim_id, count(*) n_refs, count(*) filter (contains({SURFACE.format(x='coalesce(clean_text, text)')}, subject) and contains({SURFACE.format(x='coalesce(clean_text, text)')}, object)) n_attested from r join chunks using (chunk_id) group by 1""",
)

# sinks and streams


def csv_round_trip(s, d):
    path = scratch(s, "export") + "/hits.csv"
    io.to_csv(t(s, d, "oppenheimer_initial_search").distinct(), path, "chunk_id")
    return io.read(s, path, "chunk_id bigint, document_id bigint, collection_slug string, first_page_id bigint, last_page_id bigint, snippet string, matched_terms string, match_type string, highlight string").select("chunk_id", "snippet", "match_type")


_add("csv_round_trip", csv_round_trip, "select distinct chunk_id, snippet, match_type from (select distinct * from oppenheimer_initial_search)")
_add(
    "upsert_update", lambda s, d: io.upserted(t(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("seen").alias("status")).where("o_orderkey % 3 = 0").distinct(), ["o_orderkey"]),
    "select o_orderkey, case when o_orderkey % 3 = 0 and exists (select 1 from lineitem where l_orderkey = o_orderkey) then 'seen' else o_orderstatus end status from orders",
)
_add("upsert_nothing", lambda s, d: io.upserted(t(s, d, "removed_chunks").groupBy("chunk_id").agg(F.lit("old").alias("why")), t(s, d, "chunks").select("chunk_id", F.lit("new").alias("why")), ["chunk_id"], "nothing"), "select chunk_id, case when chunk_id in (select chunk_id from removed_chunks) then 'old' else 'new' end why from (select chunk_id from chunks union select chunk_id from removed_chunks)")
_add("table_comparison", lambda s, d: io.compared(t(s, d, "chunks").select("chunk_id", "document_id"), t(s, d, "chunks").where("chunk_id % 5 <> 0").select("chunk_id", F.when(F.col("chunk_id") % 7 == 0, -1).otherwise(F.col("document_id")).cast("bigint").alias("document_id")), "chunk_id"), "select count(*) filter (chunk_id % 5 <> 0) in_both, count(*) filter (chunk_id % 5 = 0) only_a, 0::bigint only_b, count(*) filter (chunk_id % 5 <> 0 and chunk_id % 7 = 0 and document_id is distinct from -1) changed from chunks")
_add("incremental_batch", lambda s, d: S.incremental(t(s, d, "chunks"), t(s, d, "mention_candidates").where("chunk_id is not null and quality_score > 0.9"), "chunk_id", lambda x: x.select("chunk_id", F.size(T.tokens(R.body())).cast("bigint").alias("n"))), f"select chunk_id, length({words_sql('coalesce(clean_text, text)')})::bigint n from chunks where chunk_id not in (select chunk_id from mention_candidates where chunk_id is not null and quality_score > 0.9)")
_add("stream_tumbling", lambda s, d: S.finished(S.tumbling(S.event_stream(s, d), "1 day")), "select time_bucket(interval 1 day, ts) as \"start\", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
_add("stream_sliding", lambda s, d: S.finished(S.tumbling(S.event_stream(s, d), "2 days", slide="1 day")), "select b - interval (k) day as \"start\", event_type, count(*) n, round(sum(value), 4) total from (select *, time_bucket(interval 1 day, ts) b from events), (values (0), (1)) v(k) group by 1, 2")
_add(
    "stream_sessions", lambda s, d: S.finished(S.sessions(S.event_stream(s, d), "12 hours")),
    "with x as (select user_id, ts, case when ts - lag(ts) over w < interval 12 hour then 0 else 1 end c from events window w as (partition by user_id order by ts, event_id)), y as (select *, sum(c) over (partition by user_id order by ts) g from x) select min(ts) as \"start\", max(ts) + interval 12 hour as \"end\", user_id, count(*) n from y group by user_id, g",
)
_add("stream_state", lambda s, d: S.finished(S.running_state(S.event_stream(s, d)), "update", ["user_id"]), "select user_id, count(*) n, max(epoch_us(ts)) last_us from events group by 1")
_add("stream_deduplicated", lambda s, d: S.finished(S.deduplicated(S.event_stream(s, d), ["event_id"]), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "select event_type, count(*) n from (select distinct event_id, event_type from events) group by 1")
