"""Plans of primitives to lazy DataFrames.

Scope is applied below ranking: semi and anti joins first, then candidates.
Several ENTITY or WITHIN_RESULT_SET primitives widen each other, all else narrows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions import text as T
from archivolt.functions.scores import box
from archivolt.plans.primitives import Primitive, websearch


@dataclass
class Tables:
    """What plans run on; result_sets and tokens may be left out where no primitive needs them."""

    metadata: DataFrame
    mentions: DataFrame | None = None
    entities: DataFrame | None = None
    dates: DataFrame | None = None
    result_sets: DataFrame | None = None
    speakers: DataFrame | None = None


#: Kinds that narrow what is searched.
SCOPES = frozenset({"ENTITY", "WITHIN_RESULT_SET", "EXCLUDE_RESULT_SET", "FILTER_COLLECTION", "FILTER_DOCUMENT", "CO_OCCURS_WITH", "CO_LOCATED", "RELATION_EVIDENCE", "EXCEPT_ENTITIES", "NOT_ENTITY", "ENTITY_ROLE", "FILTER_DATE_RANGE", "FILTER_CITY", "FILTER_REGION", "FILTER_COUNTRY", "WITHIN_COUNTRY", "FILTER_COORDINATES", "INTERSECT_DATE_WINDOWS", "SPEAKER_FILTER"})


@dataclass
class Controls:
    """What the control primitives of a plan ask for; None where they say nothing."""

    k: int | None = None
    search_type: str | None = None
    mode: str = "retrieve"
    retrieval_mode: str | None = None
    threshold: float | None = None
    in_lexical: bool | None = None
    in_vector: bool | None = None
    group_by: str | None = None
    expand: bool = False
    quotes: bool = False
    boosts: tuple[tuple[list[str], float], ...] = ()
    candidates: int | None = None

    @classmethod
    def of(cls, plan: list[Primitive]) -> Controls:
        got = cls()
        for p in plan:
            match p.kind:
                case "SET_TOP_K":
                    got.k = p.k
                case "SET_SEARCH_TYPE":
                    got.search_type = p.search_type
                case "SET_QUERY_MODE":
                    got.mode = p.mode
                case "SET_RETRIEVAL_MODE":
                    got.retrieval_mode = p.mode
                case "SET_SIMILARITY_THRESHOLD":
                    got.threshold = p.threshold
                case "REQUIRE_EVIDENCE":
                    got.in_lexical, got.in_vector = p.in_lexical, p.in_vector
                case "GROUP_BY":
                    got.group_by = p.field
                case "TOGGLE_CONCORDANCE_EXPANSION":
                    got.expand = bool(p.enabled)
                case "QUOTE_ATTRIBUTION_MODE":
                    got.quotes = bool(p.enabled)
                case "SPEAKER_BOOST":
                    got.boosts += ((p.speakers, p.weight),)
        if got.mode not in ("retrieve", "count", "aggregate"):
            raise ValueError(f"unknown query mode {got.mode!r}")
        if got.retrieval_mode not in (None, "conversational", "thorough"):
            raise ValueError(f"unknown retrieval mode {got.retrieval_mode!r}")
        return got


def plan_score(plan: list[Primitive], words: str = "tokens") -> Column:
    """Occurrences of the plan's terms and phrases, those in groups too, damped by the logarithm of the text's words."""
    wanted: list[str] = []

    def collect(ps: list[Primitive]) -> None:
        for p in ps:
            if p.kind in ("TERM", "PHRASE"):
                wanted.append(p.value)
            elif p.kind == "OR_GROUP":
                collect(p.primitives)

    collect(plan)
    hits = reduce(Column.__add__, (T.count_phrase(words, v) for v in dict.fromkeys(w.lower() for w in wanted)), F.lit(0))
    return F.round(hits / (1 + F.log(1 + F.size(F.col(words)))), 6)


def term_predicate(plan: list[Primitive], words: str = "tokens") -> Column:
    """The lexical condition of a plan over an array of words; no term at all matches nothing."""
    terms = [_one(p, words) for p in plan if p.kind in ("TERM", "PHRASE", "OR_GROUP")]
    either = any(p.kind == "SET_TERM_MODE" and p.mode == "OR" for p in plan)
    if not terms:
        return F.lit(False)
    found = reduce(Column.__or__ if either else Column.__and__, terms)
    for p in plan:
        if p.kind == "EXCLUDE_TERM":
            found &= ~T.has_term(words, p.value)
        elif p.kind == "EXCLUDE_PHRASE":
            found &= ~T.has_phrase(words, p.value)
    return found


def _one(p: Primitive, words: str) -> Column:
    if p.kind == "TERM":
        return T.has_term(words, p.value)
    if p.kind == "PHRASE":
        return T.has_phrase(words, p.value)
    return reduce(Column.__or__, (_one(x, words) for x in p.primitives), F.lit(False))


def websearch_predicate(text: str, words: str = "tokens") -> Column:
    """The condition of a web-style query; an empty one matches nothing."""
    groups = [reduce(Column.__and__, (T.has_phrase(words, v) if k == "phrase" else T.has_term(words, v) for k, v in g)) for g in websearch(text)]
    return reduce(Column.__or__, groups, F.lit(False))


def _chunks_of(mentions: DataFrame, *ids: int) -> DataFrame:
    return mentions.where(F.col("entity_id").isin(*ids)).select("chunk_id").distinct()


def scope(df: DataFrame, plan: list[Primitive], t: Tables) -> DataFrame:
    """Rows of ``df`` (with chunk_id, document_id, collection_slug, date_min, date_max) inside the plan's scope."""
    widening: dict[str, list[int]] = {}
    for p in plan:
        m = t.mentions
        match p.kind:
            case "ENTITY":
                widening.setdefault("ENTITY", []).append(p.entity_id)
            case "WITHIN_RESULT_SET":
                widening.setdefault("SET", []).append(p.result_set_id)
            case "EXCLUDE_RESULT_SET":
                own = t.result_sets.where(F.col("result_set_id") == p.result_set_id).select(F.explode("chunk_ids").alias("chunk_id")).distinct()
                df = df.join(own, "chunk_id", "left_anti")
            case "FILTER_COLLECTION":
                df = df.where(F.col("collection_slug") == p.slug)
            case "FILTER_DOCUMENT":
                df = df.where(F.col("document_id") == p.document_id)
            case "CO_OCCURS_WITH" | "CO_LOCATED" | "RELATION_EVIDENCE":
                by_document = p.args.get("window", p.args.get("scope")) == "document"
                for e in (p.entity_a, p.entity_b):
                    own = _chunks_of(m, e)
                    if by_document:
                        df = df.join(t.metadata.join(own, "chunk_id", "left_semi").select("document_id").distinct(), "document_id", "left_semi")
                    else:
                        df = df.join(own, "chunk_id", "left_semi")
            case "EXCEPT_ENTITIES" | "NOT_ENTITY":
                ids = p.entity_ids if p.kind == "EXCEPT_ENTITIES" else [p.entity_id]
                df = df.join(_chunks_of(m, *ids), "chunk_id", "left_anti")
            case "ENTITY_ROLE":
                e = t.entities.where(F.col("entity_type") == p.role)
                if p.entity_id is not None:
                    e = e.where(F.col("entity_id") == p.entity_id)
                df = df.join(m.join(e.select("entity_id"), "entity_id", "left_semi").select("chunk_id").distinct(), "chunk_id", "left_semi")
            case "FILTER_DATE_RANGE":
                df = _dated(df, p, t)
            case "FILTER_CITY" | "FILTER_REGION" | "FILTER_COUNTRY" | "WITHIN_COUNTRY" | "FILTER_COORDINATES":
                e = t.entities.where(_place(p)).select("entity_id")
                df = df.join(m.join(e, "entity_id", "left_semi").select("chunk_id").distinct(), "chunk_id", "left_semi")
            case "INTERSECT_DATE_WINDOWS":
                df = _windows(df, p, t)
            case "SPEAKER_FILTER":
                want = F.array(*(F.lit(s.lower()) for s in p.speakers))
                if t.speakers is not None:
                    df = df.join(t.speakers, "chunk_id", "left")
                if p.mode == "exclude":
                    df = df.where(~F.coalesce(F.arrays_overlap("speaker_norms", want), F.lit(False)))
                    df = df.drop("speaker_norms") if t.speakers is not None else df
                    continue
                fits = F.size(F.array_intersect("speaker_norms", want)) == len(set(p.speakers)) if p.mode == "all" else F.arrays_overlap("speaker_norms", want)
                df = df.where(fits)
                df = df.drop("speaker_norms") if t.speakers is not None else df
    if ids := widening.get("ENTITY"):
        df = df.join(_chunks_of(t.mentions, *ids), "chunk_id", "left_semi")
    if ids := widening.get("SET"):
        own = t.result_sets.where(F.col("result_set_id").isin(*ids)).select(F.explode("chunk_ids").alias("chunk_id")).distinct()
        df = df.join(own, "chunk_id", "left_semi")
    return df


def _dated(df: DataFrame, p: Primitive, t: Tables) -> DataFrame:
    """Overlap of a date named in the chunk, or of the chunk's own dates; open bounds are open."""
    lo = F.lit(p.start).cast("date") if p.start else None
    hi = F.lit(p.end).cast("date") if p.end else None
    both = lambda a, b: reduce(Column.__and__, ([F.col(b) >= lo] if lo is not None else []) + ([F.col(a) <= hi] if hi is not None else []), F.lit(True))
    if t.dates is None:
        return df.where(F.coalesce(both("date_min", "date_max"), F.lit(False)))
    named = t.dates.where(both("date_start", "date_end")).select("chunk_id").distinct().withColumn("__named", F.lit(True))
    return df.join(named, "chunk_id", "left").where(F.col("__named").isNotNull() | F.coalesce(both("date_min", "date_max"), F.lit(False))).drop("__named")


def _place(p: Primitive) -> Column:
    is_place = F.col("entity_type") == "place"
    if p.kind == "FILTER_COORDINATES":
        south, north, west, east = box(p.lat, p.lng, p.radius_km)
        return is_place & F.col("lat").between(south, north) & F.col("lng").between(west, east)
    if p.kind in ("FILTER_COUNTRY", "WITHIN_COUNTRY"):
        return is_place & F.col("country").ilike(p.country)
    own = F.col("city").ilike(p.city) if p.kind == "FILTER_CITY" else F.col("region").ilike(p.region)
    return is_place & own & (F.col("country").ilike(p.country) if p.country else F.lit(True))


def _windows(df: DataFrame, p: Primitive, t: Tables) -> DataFrame:
    """Chunks inside the time in which both entities occur."""
    of = lambda e: t.metadata.join(_chunks_of(t.mentions, e), "chunk_id", "left_semi").agg(F.min("date_min").alias("lo"), F.max("date_max").alias("hi"))
    span = of(p.entity_a).unionAll(of(p.entity_b)).agg(F.max("lo").alias("__lo"), F.min("hi").alias("__hi"), F.count("lo").alias("__n"))
    one = F.lit(1)
    return df.withColumn("__one", one).join(span.where("__n = 2 and __lo <= __hi").withColumn("__one", one), "__one").where("date_max >= __lo and date_min <= __hi").drop("__one", "__lo", "__hi", "__n")
