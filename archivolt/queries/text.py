"""Queries over scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.catalog import table
from archivolt.functions import scores as S
from archivolt.functions import text as T
from archivolt.functions.distance import normalized_ocr_edit_distance, ocr_edit_distance, sequence_ratio
from archivolt.operators.pipelines import trigram_join

WORDS = r"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')"
SURFACE = r"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def words_sql(x: str) -> str:
    return WORDS.format(x=x)


def grams_sql(x: str) -> str:
    """Trigram array of an expression in DuckDB."""
    return f"list_distinct(flatten(list_transform({words_sql(x)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def jaccard_sql(a: str, b: str) -> str:
    both = f"length(list_intersect({a}, {b}))"
    return f"round(coalesce({both}::double / nullif(length({a}) + length({b}) - {both}, 0), 0), 6)"


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


def _names(spark, d):
    return table(spark, d, "mention_candidates").where("surface_norm is not null and raw_span is not null")


def text_normalize(spark, d):
    return _names(spark, d).select("candidate_id", T.normalize_surface("raw_span").alias("surface"), T.variant_key("raw_span").alias("variant"), T.norm_key("raw_span").alias("key")).distinct()


def text_normalize_fts(spark, d):
    return table(spark, d, "pages").where("raw_text is not null").select("page_id", T.normalize_fts("raw_text").alias("norm"))


def text_lexemes(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.tokens("text")).cast("bigint").alias("n_tokens"), F.size(T.lexemes("text")).cast("bigint").alias("n_lexemes"))


def text_similarity(spark, d):
    pairs = _names(spark, d).select("candidate_id", "surface_norm", T.normalize_surface("raw_span").alias("raw")).distinct()
    return pairs.select("candidate_id", T.trigram_similarity("surface_norm", "raw").alias("trigram"), T.token_overlap("surface_norm", "raw").alias("overlap"), F.levenshtein("surface_norm", "raw").cast("bigint").alias("edits"))


def text_quality(spark, d):
    q = T.quality("raw_text")
    return table(spark, d, "pages").where("raw_text is not null").select("page_id", *(q[c].alias(c) for c in ("letters", "vowels", "capitals", "digits")), T.quality_class("raw_text").alias("class"))


def text_names(spark, d):
    return _names(spark, d).select("candidate_id", T.acronym("surface_norm").alias("acronym"), T.surname("surface_norm").alias("surname"), T.name_key("surface_norm").alias("name_key"), T.valid_surface("surface_norm").alias("valid")).distinct()


def text_hash(spark, d):
    sets = table(spark, d, "result_sets").select("result_set_id", T.set_hash(F.array_compact("chunk_ids")).alias("ids_hash"), T.canonical_hash("set_name").alias("name_hash"))
    return sets


def text_hygiene(spark, d):
    return table(spark, d, "pages").where("raw_text is not null").select("page_id", F.size(T.lines("raw_text")).cast("bigint").alias("n_lines"), F.length(T.clean_lines("raw_text")).cast("bigint").alias("kept_chars"))


def text_keywords(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.keywords("text"), "|").alias("keywords"))


def text_contexts(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.contexts("text", "cipher", 20)).alias("n", "context")).select("doc_id", F.col("n").cast("bigint").alias("n"), "context")


def text_ocr_distance(spark, d):
    """Surfaces that share half their trigrams, compared two by two."""
    names = table(spark, d, "mention_candidates").select("surface_norm").where("surface_norm <> ''").distinct()
    pairs = trigram_join(names, names, "surface_norm", "surface_norm", 0.5).where("a < b")
    return pairs.select("a", "b", ocr_edit_distance("a", "b").alias("ocr_distance"), normalized_ocr_edit_distance("a", "b").alias("normalized"), sequence_ratio("a", "b").alias("ratio"))


def text_scores(spark, d):
    pairs = text_similarity(spark, d).withColumn("edit", F.round(1 / (1 + F.col("edits")), 6))
    return pairs.select("candidate_id", S.combined(F.col("trigram"), F.col("overlap"), F.col("edit"), F.lit(1.0)).alias("score")).withColumn("decision", S.decision(F.col("score"), F.lit(None).cast("double")))


_SIM = f"""select distinct candidate_id, {jaccard_sql(grams_sql('surface_norm'), grams_sql('raw'))} trigram,
  {jaccard_sql('list_distinct(' + words_sql('surface_norm') + ')', 'list_distinct(' + words_sql('raw') + ')')} overlap, cast(levenshtein(surface_norm, raw) as bigint) edits
from (select candidate_id, surface_norm, {SURFACE.format(x='raw_span')} raw from mention_candidates where surface_norm is not null and raw_span is not null)"""
_RATIO = "round(coalesce(length(regexp_replace({x}, '[^{k}]', '', 'g'))::double / nullif(length({x}), 0), 0), 6)"

QUERIES = {
    f.__name__: f
    for f in (text_normalize, text_normalize_fts, text_lexemes, text_similarity, text_quality, text_names, text_hash, text_hygiene, text_keywords, text_contexts, text_ocr_distance, text_scores)
}
SQL = {
    "text_normalize": rf"""select distinct candidate_id, {SURFACE.format(x='raw_span')} surface, regexp_replace(lower(raw_span), '[^a-z0-9]', '', 'g') variant,
  regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(raw_span), '.', ''), '[^\p{{L}}\p{{N}}_''\s]', ' ', 'g'), '\s+', ' ', 'g')), ' u$', ' us') "key"
from mention_candidates where surface_norm is not null and raw_span is not null""",
    "text_normalize_fts": r"""select page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(raw_text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st'),
  '([\p{L}\p{N}_])-\s*\r?\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '\s+', ' ', 'g')) norm from pages where raw_text is not null""",
    "text_lexemes": f"select doc_id, cast(length(w) as bigint) n_tokens, cast(length(list_distinct(w)) as bigint) n_lexemes from (select doc_id, {words_sql('text')} w from documents where text is not null)",
    "text_similarity": _SIM,
    "text_quality": f"""select page_id, {_RATIO.format(x='raw_text', k='A-Za-z')} letters, {_RATIO.format(x='raw_text', k='AEIOUaeiou')} vowels, {_RATIO.format(x='raw_text', k='A-Z')} capitals, {_RATIO.format(x='raw_text', k='0-9')} digits,
  case when length(raw_text) < 40 then 'unknown' when {_RATIO.format(x='raw_text', k='A-Za-z')} >= 0.7 and not regexp_matches(raw_text, '[~^|_·]') then 'clean' else 'ocr' end "class" from pages where raw_text is not null""",
    "text_names": f"""select distinct candidate_id, upper(coalesce(array_to_string(list_transform(w, lambda x: left(x, 1)), ''), '')) acronym, w[-1] surname,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x not in ('mr', 'mrs', 'dr', 'prof', 'col', 'capt', 'lt', 'comrade', 'the', 'of')))), ' '), '') name_key,
  length(surface_norm) >= 3 and regexp_matches(surface_norm, '\\p{{L}}') and lower(surface_norm) not in ('the', 'and', 'for', 'with') "valid"
from (select *, {words_sql('surface_norm')} w from mention_candidates where surface_norm is not null and raw_span is not null)""".replace("\\\\p", "\\p"),
    "text_hash": f"""select result_set_id, md5(array_to_string(list_sort(list_distinct(list_filter(chunk_ids, lambda x: x is not null))), '|')) ids_hash, sha256({SURFACE.format(x='set_name')}) name_hash from result_sets""",
    "text_hygiene": r"""select page_id, cast(length(l) as bigint) n_lines, cast(coalesce(length(array_to_string(list_filter(l, lambda x: round(coalesce(length(regexp_replace(x, '[^\p{L}\s]', '', 'g'))::double / nullif(length(x), 0), 0), 6) >= 0.5), chr(10))), 0) as bigint) kept_chars
from (select page_id, string_split(raw_text, chr(10)) l from pages where raw_text is not null)""",
    "text_keywords": "select doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '([A-Z][a-z]{3,})', 1))), '|'), '') keywords from documents where text is not null",
    "text_contexts": "select doc_id, cast(i - 1 as bigint) n, c[i] context from (select doc_id, regexp_extract_all(text, '(?s)(.{0,20}cipher.{0,20})', 1) c from documents where text is not null), lateral (select unnest(range(1, length(c) + 1)) i)",
    "text_scores": f"""select candidate_id, score, case when score >= 0.75 then 'resolved' when score >= 0.5 then 'queue' else 'ignore' end decision from (
  select candidate_id, round(0.45 * trigram + 0.25 * overlap + 0.20 * round(1.0::double / (1 + edits), 6) + 0.10, 6) score from ({_SIM}))""",
}
