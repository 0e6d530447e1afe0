"""Queries over chunkers, lanes, review and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt import model
from archivolt.catalog import table as t
from archivolt.engine import Engine
from archivolt.functions import dates as D
from archivolt.functions import sql as registered
from archivolt.functions import text as T
from archivolt.operators import chunking as C
from archivolt.operators import evidence as E
from archivolt.operators import lanes as N
from archivolt.operators import mentions as M
from archivolt.operators import pipelines as L
from archivolt.operators import resolution as Z
from archivolt.operators import retrieval as R
from archivolt.operators import review as V
from archivolt.plans.primitives import patch
from archivolt.plans.primitives import primitive as P
from archivolt.queries.index import A, PLACE
from archivolt.queries.pipeline import _ALIAS, _SELF, _SPANS, _TURN, _aliases, _names, _surfaces, _turns
from archivolt.queries.pipeline import SQL as SQL_OF
from archivolt.queries.search import _ANY, _LEX, _SCORE, TERMS, _any
from archivolt.queries.text import SURFACE, words_sql
from archivolt.shared import scratch
from archivolt.sources import io

QUERIES, SQL = {}, {}
BODY = "coalesce(clean_text, text)"


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_big = lambda *names: [F.col(n).cast("bigint").alias(n) for n in names]
_pages = lambda s, d: t(s, d, "pages")
MARKER = r"^p\. ?\d+"

# chunkers
_add("chunks_by_page", lambda s, d: C.by_page(_pages(s, d).where("raw_text is not null"), "page_id", "raw_text", 10**9).select("page_id", *_big("ordinal"), F.length("text").cast("bigint").alias("n_chars")), "select page_id, 0::bigint ordinal, length(raw_text)::bigint n_chars from pages where trim(raw_text, ' ') <> ''")
_add("chunks_by_page_split", lambda s, d: C.by_page(_pages(s, d).where("raw_text is not null"), "page_id", "raw_text", 1000).select("page_id", *_big("ordinal"), F.length("text").cast("bigint").alias("n_chars")))
_add(
    "chunks_by_marker", lambda s, d: C.by_marker(_pages(s, d), MARKER).select("document_id", "unit", *_big("first_page", "last_page"), "n_lines", F.length("text").cast("bigint").alias("n_chars")),
    rf"with l as (select document_id, page_seq, unnest(range(length(p))) n, unnest(p) line from (select document_id, page_seq, string_split(raw_text, chr(10)) p from pages where raw_text is not null)), u as (select *, (sum(regexp_matches(line, '{MARKER}')::int) over (partition by document_id order by page_seq, n))::bigint unit from l) select document_id, unit, min(page_seq)::bigint first_page, max(page_seq)::bigint last_page, count(*) n_lines, (sum(length(line) + 1) - 1)::bigint n_chars from u group by 1, 2",
)
_add("chunks_overlapping", lambda s, d: C.overlapping(t(s, d, "documents").where("text is not null"), "doc_id", "text", 600, 1).select("doc_id", *_big("ordinal"), F.length("text").cast("bigint").alias("n_chars")))
_add(
    "chunks_by_turns", lambda s, d: C.turn_windows(_turns(s, d), "doc_id", 4, 1).select("doc_id", "chunk", "first_turn", "last_turn", "speakers"),
    f"{_TURN}, c as (select doc_id, turn, speaker, unnest(range(greatest(0, ceil((turn - 4) / 3.0))::bigint, floor((turn - 1) / 3.0)::bigint + 1)) chunk from tt), g as (select doc_id, chunk, min(turn) first_turn, max(turn) last_turn, array_to_string(list_sort(list(distinct speaker)), '; ') speakers from c group by 1, 2) select * from g where chunk = 0 or last_turn > chunk * 3 + 1",
)

# lanes
_add("lane_entity", lambda s, d: N.entity_lane(model.mentions(s, d), [A, PLACE]), f"with {model.SQL} select distinct chunk_id, 1.0::double score from mentions where entity_id in ({A}, {PLACE})")
_PRE = "length(list_filter(w, lambda x: starts_with(x, 'gyro') or starts_with(x, 'uran')))"
_add("lane_must_hit", lambda s, d: N.must_hit_lane(t(s, d, "chunks"), ["gyro", "Uran"], 50).select("chunk_id", "score", *_big("rank")), f"with h as (select chunk_id, round({_PRE}::double / (1 + ln(1 + length(w))), 6) score from (select chunk_id, {words_sql(BODY)} w from chunks) where {_PRE} > 0) select chunk_id, score, row_number() over (order by score desc, chunk_id) as \"rank\" from h order by score desc, chunk_id limit 50")
_add("lane_co_mention", lambda s, d: N.co_mention_lane(model.mentions(s, d), model.entities(s, d), PLACE, "person"), f"with {model.SQL} select distinct chunk_id, 0.9::double score from mentions where entity_id = {PLACE} and chunk_id in (select chunk_id from mentions join entities using (entity_id) where entity_type = 'person')")
_REW = [w for w in N.rewrites("cipher-clerks") if " " not in w]
_add("lane_ephemeral", lambda s, d: N.ephemeral_lane(t(s, d, "chunks"), "cipher-clerks", k=None).select("chunk_id"), f"with w as (select chunk_id, {words_sql(BODY)} w from chunks), r as (select unnest({_REW!r}) r), g as (select r from r where (select count(*) from w where list_contains(w, r)) between 1 and 0.5 * (select count(*) from w)) select distinct chunk_id from w join g on list_contains(w, r)")
_add("lane_rounds", lambda s, d: N.rounds(model.mentions(s, d), [A], 2, 2).select("chunk_id", *_big("round")))
_add("lanes_merged", lambda s, d: R.merged_lanes({"entity": N.entity_lane(model.mentions(s, d), [PLACE]), "co": N.co_mention_lane(model.mentions(s, d), model.entities(s, d), PLACE, "org")}), f"with {model.SQL}, e as (select distinct chunk_id, 1.0::double score, 'entity' lane from mentions where entity_id = {PLACE}), c as (select distinct chunk_id, 0.9::double score, 'co' lane from mentions where entity_id = {PLACE} and chunk_id in (select chunk_id from mentions join entities using (entity_id) where entity_type = 'org')) select chunk_id, max(score) score, array_to_string(list_sort(list(distinct lane)), ',') lanes from (select * from e union all select * from c) group by 1")

# review
_add(
    "collisions", lambda s, d: V.collisions(model.entities(s, d), model.mentions(s, d)).select("name_key", "entity_id", "n_mentions", "n_chunks", *_big("place"), "share"),
    f"with {model.SQL}, n as (select distinct lower(name) name_key, entity_id from entities), m as (select entity_id, count(*) n_mentions, count(distinct chunk_id) n_chunks from mentions group by 1), o as (select name_key, entity_id, coalesce(n_mentions, 0) n_mentions, coalesce(n_chunks, 0) n_chunks from n left join m using (entity_id) where name_key in (select name_key from n group by 1 having count(*) > 1)) select *, row_number() over (partition by name_key order by n_mentions desc, entity_id) place, round(coalesce(n_mentions::double / nullif(sum(n_mentions) over (partition by name_key), 0), 0), 6) share from o",
)
_add(
    "cluster_review", lambda s, d: V.classified(L.clusters(L.trigram_links(_names(s, d), "surface_norm", 0.6)), _surfaces(s, d), _aliases(s, d)),
    f"{_SELF}, {_ALIAS}, k as (select node as member, min(root) as c from w group by 1), st as (select surface_norm, count(distinct document_id) n_docs from mention_candidates where surface_norm is not null group by 1), j as (select c, count(*) n_members, sum(n_docs)::bigint n_docs, bool_or(member in (select b from al)) known from k join st on surface_norm = member group by 1) select c as \"cluster\", n_members, n_docs, known, case when round(coalesce(length(regexp_replace(c, '[^\\p{{L}}\\s]', '', 'g'))::double / nullif(length(c), 0), 0), 6) < 0.6 or n_docs < 1 then 'junk' when known then 'confirm' when n_docs >= 3 and n_members >= 2 then 'new entity' else 'look' end \"class\" from j",
)
_add(
    "cover_names", lambda s, d: V.cover_names(t(s, d, "documents"), t(s, d, "mention_candidates"), 1),
    "with q as (select distinct doc_id document_id, unnest(regexp_extract_all(text, '“([A-Z][a-z]+)”', 1)) cover_name from documents where text is not null), m as (select distinct document_id, surface_norm from mention_candidates where surface_norm is not null and document_id is not null), n as (select cover_name, surface_norm, count(*) n_docs from q join m using (document_id) group by 1, 2), b as (select *, max(n_docs) over (partition by cover_name) most from n) select cover_name, min(surface_norm) surface_norm, max(n_docs) n_docs from b where n_docs = most group by 1 having count(*) = 1",
)
_SENT = r"list_filter(list_transform(string_split(regexp_replace(coalesce(clean_text, text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_add(
    "summary_bundles", lambda s, d: V.bundles(_any(s, d, 40), t(s, d, "chunks"), "cipher", R.body()).select("chunk_id", *_big("rank"), "pages", "quote", "signature"),
    f"with {_LEX(_ANY, TERMS, 40)}, q as (select l.chunk_id, \"rank\", concat_ws('-', first_page_id::varchar, case when last_page_id <> first_page_id then last_page_id::varchar end) pages, left(trim(regexp_replace(coalesce(list_filter({_SENT}, lambda x: contains(lower(x), 'cipher'))[1], {BODY}), '\\s+', ' ', 'g'), ' '), 160) quote from l join chunks using (chunk_id)) select *, sha256(chunk_id || '|cipher|' || quote) signature from q",
)
_add(
    "ocr_candidates", lambda s, d: V.name_spans(_pages(s, d).where("raw_text is not null"), "page_id", "raw_text"),
    r"with x as (select distinct page_id, unnest(regexp_extract_all(raw_text, '(\p{Lu}[\p{L}~^|''’]+\.?(?: \p{Lu}[\p{L}~^|''’]+\.?){1,5})', 1)) span from pages where raw_text is not null) select page_id, span, length(string_split(span, ' '))::bigint n_words, round(coalesce(length(regexp_replace(span, '[^\p{L}]', '', 'g'))::double / nullif(length(span), 0), 0), 6) quality from x",
)
_add("tournament", lambda s, d: V.tournament(R.lexical(t(s, d, "chunks"), T.has_term("words", "cipher") | T.has_term("words", "embassy"), TERMS, None), "chunk_id", "score", 16).select("chunk_id", "score", *_big("place")), f"with l as (select chunk_id, {_SCORE(TERMS)} score from (select chunk_id, {words_sql(BODY)} w from chunks) where {_ANY}) select chunk_id, score, row_number() over (order by score desc, chunk_id) place from l order by score desc, chunk_id limit 16")
_add("window_matches", lambda s, d: V.window_matches(t(s, d, "chunks"), _aliases(s, d), R.body()).select("chunk_id", *_big("start"), "alias", "kind", *_big("edits")))


def table_functions(s, d):
    registered.register(s, d, ["mention_candidates", "result_sets", "retrieval_runs", "chunks"])
    registered.register_table_functions(s)
    return s.sql("select * from top_surfaces(25)")


_add("table_functions", table_functions, "select surface_norm, count(*) n_mentions, count(distinct document_id) n_docs from mention_candidates where surface_norm is not null group by 1 order by 2 desc, 1 limit 25")


# operators on small settings, samples and logs


def inline_relation(s, d):
    """A client's list of ids, in its order, with what the chunks say of them."""
    return io.relation(s, [12, 3, 12, 999_999_999], "chunk_id", "bigint").join(t(s, d, "chunks").select("chunk_id", "document_id"), "chunk_id", "left").select(*_big("ord"), "chunk_id", "document_id")


_add("inline_relation", inline_relation, "select o::bigint ord, v.chunk_id, document_id from (values (0, 12), (1, 3), (2, 12), (3, 999999999)) v(o, chunk_id) left join chunks using (chunk_id)")


def run_log(s, d):
    path = scratch(s, "log")
    for n, settings in enumerate(({"k": 5, "a": 1}, {"k": 7})):
        io.append_log(s, path, [{"run": n, "settings": settings}], "run bigint, settings string")
    return s.read.parquet(path)


_add("run_log", run_log, """select * from (values (0::bigint, '{"a": 1, "k": 5}'), (1::bigint, '{"k": 7}')) v(run, settings)""")


def snapshot(s, d):
    path = scratch(s, "snapshot")
    io.write_snapshot(io.junction(t(s, d, "result_sets")).select("result_set_id", "chunk_id"), path)
    return s.read.parquet(path)


_add("snapshot", snapshot, "select distinct result_set_id, chunk_id from (select result_set_id, unnest(chunk_ids) chunk_id from result_sets) where chunk_id is not null")
_add("sample_ends", lambda s, d: io.head_tail_random(t(s, d, "chunks").select("chunk_id"), "chunk_id", 30).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("n_ids"), F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last")), "select least(30, n) n, least(30, n) n_ids, a as \"first\", b as \"last\" from (select count(*) n, min(chunk_id) a, max(chunk_id) b from chunks)")
_add("sample_share", lambda s, d: io.sample_share(t(s, d, "chunks").select("chunk_id"), 25).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("n_ids")), "select least(25, count(*)) n, least(25, count(*)) n_ids from chunks")
_add(
    "one_metadata_row", lambda s, d: M.one_metadata(t(s, d, "page_metadata").distinct().select(F.col("page_id").alias("chunk_id"), "page_metadata_id", "pipeline_version", F.struct("extracted_at", "page_metadata_id").alias("newest")), "pipeline_version", "meta_v2", "newest").select(F.col("chunk_id").alias("page_id"), "page_metadata_id"),
    "select page_id, page_metadata_id from (select distinct * from page_metadata) qualify row_number() over (partition by page_id order by coalesce((pipeline_version = 'meta_v2')::int, -1) desc, extracted_at desc nulls last, page_metadata_id desc) = 1",
)

# evidence
_ev = lambda s, d: E.spans(t(s, d, "chunks").select("chunk_id", R.body().alias("body")), "chunk_id", "body", ["cipher", "embassy"]).groupBy("span_hash").agg(F.max("n_hits").alias("n_hits"), F.count(F.lit(1)).alias("n"))
_EV = f"ev as (select span_hash, max(n_hits) n_hits, count(*) n from ({_SPANS}) group by 1)"
_add("span_bands", lambda s, d: E.banded(_ev(s, d), F.col("n_hits") + F.col("n") / 100, 5, 15).select("span_hash", "band", *_big("place")), f"with {_EV}, r as (select span_hash, row_number() over (order by n_hits + n / 100 desc, span_hash) place from ev) select span_hash, case when place <= 5 then 'cite' else 'harvest' end band, place from r where place <= 20")
_add("evidence_store", lambda s, d: E.kept(_ev(s, d).where("n_hits = 1").withColumn("score", F.col("n").cast("double")), _ev(s, d).withColumn("score", F.col("n_hits").cast("double")), "span_hash", "score", 30), f"with {_EV} select span_hash, max(score) score from (select span_hash, n::double score from ev where n_hits = 1 union all select span_hash, n_hits::double from ev) group by 1 order by 2 desc, 1 limit 30")


def uncited_claims(s, d):
    claims = E.grounded_claims(t(s, d, "mention_candidates"), t(s, d, "chunks").select("chunk_id", R.body().alias("body")), 2)
    return claims.where("n_attested = 0").select("claim_id", "support")


_add("uncited_claims", uncited_claims, SQL_OF["claim_grounding"].rsplit("select claim_id, count(*) n_refs", 1)[0].replace("c as (select", "c0 as (select a.s || '|' || b.s k, count(*) support from m a join m b on a.chunk_id = b.chunk_id and a.s < b.s group by 1 having count(*) >= 2), c as (select", 1) + f", g as (select claim_id from r join chunks using (chunk_id) where contains({SURFACE.format(x=BODY)}, subject) and contains({SURFACE.format(x=BODY)}, object)) select sha1(k) claim_id, support from c0 where sha1(k) not in (select claim_id from g)")
_add("reached", lambda s, d: E.expanded_until_stable(t(s, d, "nation").select(F.col("n_regionkey").alias("k")).where("k < 2"), t(s, d, "nation").select(F.col("n_regionkey").alias("k"), (F.col("n_nationkey") % 5).alias("other")), "k", 10), "with recursive e as (select n_regionkey k, n_nationkey % 5 o from nation), w(k) as (select distinct n_regionkey from nation where n_regionkey < 2 union select e.o from w join e using (k)) select distinct k from w")
_DECIDED = [(0, "merge", 7), (1, "block", None), (2, "new", None)]


def adjudicated(s, d):
    variants = _names(s, d).select(F.col("surface_norm").alias("member"), F.pmod(F.length("surface_norm"), F.lit(4)).cast("int").alias("cluster"))
    allowed, blocked, new = Z.adjudicated(s.createDataFrame(_DECIDED, "cluster int, action string, entity_id bigint"), variants)
    return allowed.select("member", "entity_id", F.lit("merge").alias("action")).unionByName(blocked.select("member", F.lit(None).cast("bigint").alias("entity_id"), F.lit("block").alias("action")))


_add("adjudicated", adjudicated, "with n as (select distinct surface_norm m from mention_candidates where surface_norm <> '') select m as \"member\", case when length(m) % 4 = 0 then 7::bigint end entity_id, case when length(m) % 4 = 0 then 'merge' else 'block' end \"action\" from n where length(m) % 4 in (0, 1)")
_PLAN = [P("TERM", value="cipher"), P("FILTER_COLLECTION", slug="hearings")]
_add("plan_patched", lambda s, d: Engine(s, d).run(patch(_PLAN, remove={"type": "FILTER_COLLECTION"}, add=[P("EXCLUDE_TERM", value="hotel")], replace=[({"type": "TERM", "value": "cipher"}, P("TERM", value="embassy"))])).select("chunk_id"), f"select chunk_id from (select chunk_id, {words_sql(BODY)} w from chunks) where list_contains(w, 'embassy') and not list_contains(w, 'hotel')")
_add("scope_within_country", lambda s, d: Engine(s, d).run([P("WITHIN_COUNTRY", country="nation_3"), P("FILTER_COLLECTION", slug="BUILDING")]).select("chunk_id"), f"with {model.SQL} select chunk_id from meta where collection_slug = 'BUILDING' and chunk_id in (select chunk_id from mentions join entities using (entity_id) where country ilike 'nation_3')")
_add("boilerplate_removed", lambda s, d: L.without_boilerplate(t(s, d, "pages"), L.boilerplate(t(s, d, "pages"))).select("page_id", F.length("text").cast("bigint").alias("n_chars")), SQL_OF["boilerplate_lines"].rsplit("select document_id, line, n_pages", 1)[0] + ", b as (select document_id, line from x join n using (document_id) where n >= 3 and n_pages >= 0.3 * n), k as (select p.page_id, length(array_to_string(list_filter(string_split(raw_text, chr(10)), lambda v: trim(v, ' ') = '' or not list_contains(coalesce(bb, []), trim(v, ' '))), chr(10))) n from pages p left join (select document_id, list(line) bb from b group by 1) q on q.document_id = p.document_id where raw_text is not null) select page_id, n::bigint n_chars from k")


def relative_dates(s, d):
    """Phrases of questions as ranges of days, told from a fixed day."""
    from datetime import date

    phrases = ["last month", "3 years ago", "before 1944", "the 1940s", "May 1944", "1950", "since 1941"]
    rows = [(p, *D.relative_range(p, date(1955, 3, 31))) for p in phrases]
    return s.createDataFrame(rows, "phrase string, lo date, hi date")


_add("relative_dates", relative_dates, "select phrase, lo::date lo, hi::date hi from (values ('last month', '1955-02-01', '1955-02-28'), ('3 years ago', '1952-03-01', '1952-03-31'), ('before 1944', null, '1943-12-31'), ('the 1940s', '1940-01-01', '1949-12-31'), ('May 1944', '1944-05-01', '1944-05-31'), ('1950', '1950-01-01', '1950-12-31'), ('since 1941', '1941-01-01', null)) v(phrase, lo, hi)")
