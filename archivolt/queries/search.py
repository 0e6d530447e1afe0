"""Queries over chunks: lexical, vector and hybrid retrieval, dictionary and expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.catalog import table
from archivolt.functions import text as T
from archivolt.operators import retrieval as R
from archivolt.plans.compiler import term_predicate, websearch_predicate
from archivolt.plans.primitives import parse_query
from archivolt.plans.primitives import primitive as P
from archivolt.queries.text import grams_sql, jaccard_sql, words_sql
from archivolt.shared import scratch


def _chunks(s, d):
    return table(s, d, "chunks")


def _query_vector(s, d) -> list[float]:
    """The vector of the first chunk with a usable one stands for the query's."""
    return list(_chunks(s, d).where(R.usable()).orderBy("chunk_id").select("embedding").first()[0])


BODY = "coalesce(clean_text, text)"
USABLE = "length(embedding) = 64 and length(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and length(list_filter(embedding, lambda x: x <> 0)) > 0"
_Q = f"(select embedding::double[] from chunks where {USABLE} order by chunk_id limit 1)"
_VEC = f"v as (select chunk_id, round(1 - list_cosine_similarity(embedding::double[], {_Q}), 6) distance from chunks where {USABLE})"
_HITS = lambda terms: " + ".join(f"length(list_filter(w, lambda t: t = '{t}'))" for t in terms)
_SCORE = lambda terms: f"round(({_HITS(terms)})::double / (1 + ln(1 + length(w))), 6)"
_LEX = lambda cond, terms, k=200: f"l as (select chunk_id, score, row_number() over (order by score desc, chunk_id) as \"rank\" from (select chunk_id, {_SCORE(terms)} score from (select chunk_id, {words_sql(BODY)} w from chunks) where {cond}) order by score desc, chunk_id limit {k})"
_W = f"(select chunk_id, document_id, first_page_id, {words_sql(BODY)} w from chunks)"
TERMS = ["cipher", "embassy"]
_ANY = "(list_contains(w, 'cipher') or list_contains(w, 'embassy'))"

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _any(s, d, k=200):
    return R.lexical(_chunks(s, d), T.has_term("words", "cipher") | T.has_term("words", "embassy"), TERMS, k)


_add("lex_exact", lambda s, d: R.containing(_chunks(s, d), ["Cipher"]).select("chunk_id", T.preview(R.body(), 80).alias("preview")), f"select chunk_id, left(trim(regexp_replace({BODY}, '\\s+', ' ', 'g')), 80) preview from chunks where contains(lower({BODY}), 'cipher')")
_add("lex_exact_cased_top", lambda s, d: R.containing(_chunks(s, d), ["Bureau"], True, 50).select("chunk_id", "document_id"), f"select chunk_id, document_id from chunks where contains({BODY}, 'Bureau') order by document_id nulls last, first_page_id nulls last, chunk_id limit 50")
_add("lex_and", lambda s, d: R.containing(_chunks(s, d), ["cipher", "station"]).select("chunk_id"), f"select chunk_id from chunks where contains(lower({BODY}), 'cipher') and contains(lower({BODY}), 'station')")


def lex_near(s, d):
    q = parse_query('find("foreign NEAR embassy", window=12)')
    return R.near(_chunks(s, d), *q.terms, q.window).select("chunk_id", F.col("distance").cast("bigint").alias("distance"))


_add(
    "lex_near", lex_near,
    f"select chunk_id, distance from (select c.chunk_id, min(abs(a.i - b.i)) distance from {_W} c, lateral (select unnest(list_filter(range(1, length(w) + 1), lambda i: w[i] = 'foreign')) i) a, lateral (select unnest(list_filter(range(1, length(w) + 1), lambda i: w[i] = 'embassy')) i) b group by 1) where distance <= 12",
)
_add("lex_ranked", lambda s, d: _any(s, d).select("chunk_id", "score", F.col("rank").cast("bigint").alias("rank")), f"with {_LEX(_ANY, TERMS)} select * from l")
_add(
    "lex_phrase", lambda s, d: _chunks(s, d).select("chunk_id", T.tokens(R.body()).alias("tokens")).where(term_predicate([P("PHRASE", value="it is requested"), P("OR_GROUP", primitives=[P("TERM", value="cipher"), P("TERM", value="embassy")]), P("EXCLUDE_TERM", value="hotel")])).select("chunk_id"),
    f"select chunk_id from {_W} where contains(' ' || array_to_string(w, ' ') || ' ', ' it is requested ') and {_ANY} and not list_contains(w, 'hotel')",
)
_add(
    "lex_websearch", lambda s, d: _chunks(s, d).select("chunk_id", T.tokens(R.body()).alias("tokens")).where(websearch_predicate('"legal attache" secret OR gyroscope foreign')).select("chunk_id"),
    f"select chunk_id from {_W} where (contains(' ' || array_to_string(w, ' ') || ' ', ' legal attache ') and list_contains(w, 'secret')) or (list_contains(w, 'gyroscope') and list_contains(w, 'foreign'))",
)
_add("lex_prefix", lambda s, d: _chunks(s, d).where(T.has_prefix(T.tokens(R.body()), "gyro")).select("chunk_id"), f"select chunk_id from {_W} where length(list_filter(w, lambda t: starts_with(t, 'gyro'))) > 0")
_add(
    "lex_headline", lambda s, d: _chunks(s, d).select("chunk_id", T.headline(T.tokens(R.body()), "gyroscope").alias("headline")).where("headline is not null"),
    f"select chunk_id, array_to_string(list_slice(w, greatest(p - 7, 1), greatest(p - 7, 1) + 14), ' ') headline from (select chunk_id, w, list_position(w, 'gyroscope') p from {_W}) where p > 0",
)
_add(
    "soft_lexical", lambda s, d: R.soft_lexical(_chunks(s, d), ["gyroscop", "ciphre"], 0.5, None).select("chunk_id", "score"),
    f"select * from (select chunk_id, list_max(list_transform(list_distinct(w), lambda x: greatest({jaccard_sql(grams_sql(chr(39) + 'gyroscop' + chr(39)), grams_sql('x'))}, {jaccard_sql(grams_sql(chr(39) + 'ciphre' + chr(39)), grams_sql('x'))}))) score from {_W}) where score >= 0.5",
)
_DICT = f"d as (select lexeme, count(*) chunk_freq from (select distinct chunk_id, unnest(w) lexeme from {_W}) group by 1)"
_add("dictionary", lambda s, d: R.dictionary(_chunks(s, d)), f"with {_DICT} select * from d")
_add(
    "fuzzy_expansion", lambda s, d: R.fuzzy_expansion(R.dictionary(_chunks(s, d)), TERMS).select("term", "lexeme", "chunk_freq", "similarity"),
    f"with {_DICT}, q as (select unnest(['cipher', 'embassy']) term) select term, lexeme, chunk_freq, similarity from (select *, {jaccard_sql(grams_sql('lexeme'), grams_sql('term'))} similarity from d, q) where similarity >= 0.4 qualify row_number() over (partition by term order by chunk_freq desc, similarity desc, lexeme) <= 5",
)
_add(
    "related_terms", lambda s, d: R.related_terms(_chunks(s, d), "cipher"),
    f"with n as (select lexeme, count(*) n from (select distinct chunk_id, unnest(w) lexeme from {_W} where list_contains(w, 'cipher')) where length(lexeme) > 3 and lexeme <> 'cipher' group by 1 order by 2 desc, 1 limit 20) select lexeme, n, round(n::double / max(n) over (), 6) share from n",
)
_add("vector_search", lambda s, d: R.vector(_chunks(s, d), _query_vector(s, d), 50).select("chunk_id", "distance", F.col("rank").cast("bigint").alias("rank")), f'with {_VEC} select chunk_id, distance, row_number() over (order by distance, chunk_id) as "rank" from v order by distance, chunk_id limit 50')
_add("vector_threshold", lambda s, d: R.vector(_chunks(s, d), _query_vector(s, d), None, 0.7).select("chunk_id", "distance"), f"with {_VEC} select * from v where distance <= 0.7")
_add("vector_l2", lambda s, d: R.vector(_chunks(s, d), _query_vector(s, d), 20, metric="l2").select("chunk_id", "distance"), f"select chunk_id, round(list_distance(embedding::double[], {_Q}), 5) distance from chunks where {USABLE} order by distance, chunk_id limit 20")
_add("vector_inner_product", lambda s, d: R.vector(_chunks(s, d), _query_vector(s, d), 20, metric="inner_product").select("chunk_id", "distance"), f"select chunk_id, round(-list_inner_product(embedding::double[], {_Q}), 5) distance from chunks where {USABLE} order by distance, chunk_id limit 20")


def _hybrid(s, d, **more):
    lists = {"lex": (_any(s, d), 1.0), "vec": (R.vector(_chunks(s, d), _query_vector(s, d), 200), 1.0)}
    return R.fused(lists, **more)


def _long(df):
    return df.select("chunk_id", F.col("r_lex").cast("bigint").alias("r_lex"), F.col("r_vec").cast("bigint").alias("r_vec"), "score", F.col("rank").cast("bigint").alias("rank"))


_LISTS = f'with {_LEX(_ANY, TERMS)}, {_VEC}, vv as (select chunk_id, row_number() over (order by distance, chunk_id) as "rank" from v order by distance, chunk_id limit 200)'
_FUSE = lambda how, part: f'{_LISTS}, f as (select coalesce(l.chunk_id, vv.chunk_id) chunk_id, l."rank" r_lex, vv."rank" r_vec, round({part}, 9) score from l {how} join vv on l.chunk_id = vv.chunk_id)'
_ZERO = 'coalesce(1.0::double / (60 + l."rank"), 0) + coalesce(1.0::double / (60 + vv."rank"), 0)'
_FAR = '1.0::double / (60 + coalesce(l."rank", 100000)) + 1.0::double / (60 + coalesce(vv."rank", 100000))'
_TOP = ' select chunk_id, r_lex, r_vec, score, row_number() over (order by score desc, chunk_id) as "rank" from f order by score desc, chunk_id limit 50'
_add("hybrid_rrf", lambda s, d: _long(_hybrid(s, d)), _FUSE("full", _ZERO) + _TOP)
_add("hybrid_rrf_far", lambda s, d: _long(_hybrid(s, d, missing=R.MISSING_RANK)), _FUSE("full", _FAR) + _TOP)
_add("hybrid_rrf_intersection", lambda s, d: _long(_hybrid(s, d, how="inner")), _FUSE("inner", _ZERO) + _TOP)
_add(
    "match_traces", lambda s, d: R.traced(_hybrid(s, d), lexical="r_lex", vector="r_vec").select("chunk_id", "in_lexical", "in_vector", "match_type"),
    _FUSE("full", _ZERO) + " select chunk_id, r_lex is not null in_lexical, r_vec is not null in_vector, case when r_lex is not null and r_vec is not null then 'both' when r_lex is not null then 'lexical' else 'vector' end match_type from f order by score desc, chunk_id limit 50",
)
_add(
    "retrieval_quality", lambda s, d: R.quality_at(_hybrid(s, d), R.containing(_chunks(s, d), ["cipher", "embassy"]), 20),
    _FUSE("full", _ZERO) + f", t as (select chunk_id from f order by score desc, chunk_id limit 20), r as (select chunk_id from chunks where contains(lower({BODY}), 'cipher') and contains(lower({BODY}), 'embassy')), n as (select (select count(*) from t) n_found, (select count(*) from r) n_relevant, (select count(*) from t join r using (chunk_id)) n_hit) select *, round(coalesce(n_hit::double / nullif(n_relevant, 0), 0), 6) recall, round(coalesce(n_hit::double / nullif(n_found, 0), 0), 6) \"precision\" from n",
)
_add(
    "neighbours", lambda s, d: R.neighbours(_chunks(s, d), 20, 2, 2).select("chunk_id", F.col("offset").cast("bigint").alias("at")),
    "select chunk_id, n - s as at from (select chunk_id, n, max(case when chunk_id = 20 then n end) over () s from (select chunk_id, row_number() over (order by first_page_id nulls last, chunk_id) n from chunks where document_id = (select document_id from chunks where chunk_id = 20))) where n - s between -2 and 2".replace(" as at", ' as "at"'),
)
_add("document_chunks", lambda s, d: _chunks(s, d).where("document_id = 22").orderBy(*R.place()).select("chunk_id", "first_page_id", "last_page_id"), "select chunk_id, first_page_id, last_page_id from chunks where document_id = 22")
_add("thorough_rank", lambda s, d: R.document_order(_hybrid(s, d).join(_chunks(s, d).select("chunk_id", "document_id"), "chunk_id")).select("chunk_id", F.col("document_rank").cast("bigint").alias("document_rank")), _FUSE("full", _ZERO) + ", t as (select chunk_id from f order by score desc, chunk_id limit 50) select chunk_id, row_number() over (order by document_id nulls last, chunk_id) document_rank from t join chunks using (chunk_id)")
_add(
    "merged_lanes", lambda s, d: R.merged_lanes({"lexical": _any(s, d), "exact": R.containing(_chunks(s, d), ["embassy"]).select("chunk_id", F.lit(1.0).alias("score"))}),
    f"with {_LEX(_ANY, TERMS)} select chunk_id, max(score)::double score, array_to_string(list_sort(list(distinct lane)), ',') lanes from (select chunk_id, score, 'lexical' lane from l union all select chunk_id, 1.0, 'exact' from chunks where contains(lower({BODY}), 'embassy')) group by 1",
)
_add("hit_test", lambda s, d: R.hit_test(_chunks(s, d), ["cipher", "Uranium", "nowhereword"]), f"select term, count(distinct chunk_id) n_chunks, count(distinct document_id) n_docs from (select unnest(['cipher', 'uranium', 'nowhereword']) term) left join {_W} on list_contains(w, term) group by 1")
_add("acronym_share", lambda s, d: R.acronym_share(_chunks(s, d), "no", "reply"), f"select n, n_both, coalesce(n_both::double / nullif(n, 0) >= 0.2, false) passes from (select count(*) n, count(*) filter (list_contains(w, 'reply')) n_both from {_W} where list_contains(w, 'no'))")
_add(
    "search_filter", lambda s, d: R.search_filter(_chunks(s, d), versions=["chunk_v1_paragraph", "chunk_v0_document"], not_collections=["hearings"], not_documents=[10, 22], not_chunks=[5]).select("chunk_id"),
    "select chunk_id from chunks where pipeline_version in ('chunk_v1_paragraph', 'chunk_v0_document') and (collection_slug is null or collection_slug <> 'hearings') and (document_id is null or document_id not in (10, 22)) and (chunk_id is null or chunk_id <> 5)",
)
_add("index_search", lambda s, d: R.search_postings(R.postings(_chunks(s, d)), TERMS).select("chunk_id", "score", F.col("rank").cast("bigint").alias("rank")), f"with {_LEX(_ANY, TERMS)} select * from l")
_add("index_search_every", lambda s, d: R.search_postings(R.postings(_chunks(s, d)), TERMS, True, None).select("chunk_id", "score"), f"select chunk_id, {_SCORE(TERMS)} score from (select chunk_id, {words_sql(BODY)} w from chunks) where list_contains(w, 'cipher') and list_contains(w, 'embassy')")


def index_on_disk(s, d):
    path = scratch(s, "postings")
    R.write_postings(_chunks(s, d), path)
    return R.search_postings(R.read_postings(s, path, ["gyroscope", "uranium"]), ["gyroscope", "uranium"], k=None).select("chunk_id", "score")


_add("index_on_disk", index_on_disk, f"select chunk_id, {_SCORE(['gyroscope', 'uranium'])} score from (select chunk_id, {words_sql(BODY)} w from chunks) where list_contains(w, 'gyroscope') or list_contains(w, 'uranium')")
