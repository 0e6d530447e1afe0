"""The engine as one object: tools over a data folder, and plans of primitives run on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import model
from archivolt.catalog import table
from archivolt.functions import text as T
from archivolt.operators import facets, mentions, pipelines, resolution, retrieval
from archivolt.plans.compiler import SCOPES, Controls, Tables, plan_score, scope, term_predicate
from archivolt.plans.primitives import Primitive, canonical, primitive

#: Rows of a conversational search without a SET_TOP_K.
CONVERSATIONAL_K = 20
#: Controls that only a search can follow.
NEEDS_SEARCH = frozenset({"REQUIRE_EVIDENCE", "SPEAKER_BOOST", "QUOTE_ATTRIBUTION_MODE", "SET_SEARCH_TYPE", "SET_SIMILARITY_THRESHOLD", "TOGGLE_CONCORDANCE_EXPANSION", "SPEAKER_FILTER"})


class Engine:
    """Everything returned is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.chunks = table(spark, folder, "chunks")
        self.tables = Tables(model.metadata(spark, folder), model.mentions(spark, folder), model.entities(spark, folder), model.dates(spark, folder), table(spark, folder, "result_sets"))

    # tools
    def exact(self, text: str, k: int | None = 50) -> DataFrame:
        return retrieval.containing(self.chunks, [text], k=k)

    def lexical(self, terms: list[str], k: int = 50) -> DataFrame:
        condition = F.arrays_overlap("words", F.array(*(F.lit(t.lower()) for t in terms)))
        return retrieval.lexical(self.chunks, condition, terms, k)

    def vector(self, query: list[float], k: int = 50) -> DataFrame:
        return retrieval.vector(self.chunks, query, k)

    def hybrid(self, terms: list[str], query: list[float], k: int = 50, candidates: int = 200) -> DataFrame:
        return retrieval.fused({"lex": (self.lexical(terms, candidates), 1.0), "vec": (self.vector(query, candidates), 1.0)}, k)

    def neighbours(self, chunk: int, before: int = 1, after: int = 1) -> DataFrame:
        return retrieval.neighbours(self.chunks, chunk, before, after)

    def document_chunks(self, document: int) -> DataFrame:
        return self.chunks.where(F.col("document_id") == document).orderBy(*retrieval.place())

    def entity_lookup(self, name: str) -> DataFrame:
        return self.tables.entities.where(T.norm_key("name") == T.norm_key(F.lit(name)))

    def entity_mentions(self, entity: int, after: int = 0, limit: int | None = 50) -> DataFrame:
        return mentions.mentioned(self.tables.mentions, self.tables.metadata, entity, after, limit)

    def first_mention(self, entity: int) -> DataFrame:
        return mentions.first_mention(self.tables.mentions, self.tables.metadata, entity)

    def co_mentions(self, entity: int, top: int = 20) -> DataFrame:
        return mentions.related(self.tables.mentions, self.tables.metadata, self.tables.entities, entity, top=top)

    # plans
    def text_tables(self, plan: list[Primitive]) -> Tables:
        """What plans of terms run on: the text chunks with their documents and collections; dates and speakers only where the plan asks for them."""
        own = self.chunks.select("chunk_id", "document_id", "collection_slug")
        kinds = {p.kind for p in plan}
        if kinds & {"FILTER_DATE_RANGE", "INTERSECT_DATE_WINDOWS"}:
            pages, told = table(self.spark, self.folder, "pages"), table(self.spark, self.folder, "page_metadata")
            dated = pipelines.chunk_metadata(pipelines.chunk_pages(self.chunks, pages), told).select("chunk_id", "date_min", "date_max")
            days = table(self.spark, self.folder, "documents").select(F.col("doc_id").alias("document_id"), "doc_date")
            own = own.join(dated, "chunk_id", "left").join(days, "document_id", "left")
            own = own.select("chunk_id", "document_id", "collection_slug", F.coalesce("date_min", "doc_date").alias("date_min"), F.coalesce("date_max", "doc_date").alias("date_max"))
        speakers = None
        if kinds & {"SPEAKER_FILTER", "SPEAKER_BOOST", "QUOTE_ATTRIBUTION_MODE"}:
            said = pipelines.turns(self.chunks.withColumn("body", retrieval.body()), "chunk_id", "body")
            speakers = said.groupBy("chunk_id").agg(F.sort_array(F.collect_set(F.lower("speaker"))).alias("speaker_norms"))
        return Tables(own, self.tables.mentions, self.tables.entities, None, self.tables.result_sets, speakers)

    def run(self, plan: list[Primitive], query: list[float] | None = None) -> DataFrame:
        """A plan's rows: an index primitive or COUNT decides what they are, scope primitives what they come from.

        Plans with terms search the text chunks inside the scope (see ``search``);
        ``query`` is the query's vector for searches by vector.
        """
        plan = canonical(plan)
        controls = Controls.of(plan)
        if any(p.kind in ("TERM", "PHRASE", "OR_GROUP") for p in plan) or query is not None:
            return self.search(plan, controls, query)
        for p in plan:
            if p.kind in NEEDS_SEARCH:
                raise ValueError(f"{p.kind} needs a plan with terms or a vector")
        inside = scope(self.tables.metadata, plan, self.tables)
        m = self.tables.mentions
        for p in plan:
            match p.kind:
                case "COUNT":
                    keys = {"document": "document_id", "collection": "collection_slug"}
                    if p.group_by == "entity":
                        return facets.top(m.join(inside.select("chunk_id"), "chunk_id", "left_semi").groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("n_chunks")), "n_chunks", "entity_id", limit=50)
                    if p.group_by == "date":
                        return facets.date_facet(inside, "date_min")
                    if p.group_by:
                        return facets.count_by(inside, keys[p.group_by], None if p.group_by == "collection" else 50)
                    return inside.agg(F.countDistinct("chunk_id").alias("n_chunks"))
                case "MENTIONS" | "PLACE_MENTIONS":
                    return mentions.mentioned(m, inside, p.entity_id, p.args.get("after_rank") or 0, p.args.get("limit"))
                case "FIRST_MENTION":
                    return mentions.first_mention(m, inside, p.entity_id)
                case "FIRST_CO_MENTION":
                    return mentions.first_co_mention(m, inside, p.entity_ids)
                case "DATE_RANGE_FILTER" | "DATE_MENTIONS":
                    return mentions.dated(self.tables.dates, inside, p.start, p.end, p.args.get("time_basis") or "mention")
                case "FIRST_DATE_MENTION":
                    return mentions.first_date(m, self.tables.dates.join(inside.select("chunk_id"), "chunk_id", "left_semi"), p.entity_id)
                case "RELATED_PLACES" | "RELATED_ENTITIES":
                    kind = "place" if p.kind == "RELATED_PLACES" else None
                    return mentions.related(m.join(inside.select("chunk_id"), "chunk_id", "left_semi"), inside, self.tables.entities, p.entity_id, kind, p.args.get("window") or "chunk")
        return self._reduced(inside, inside, controls)

    def search(self, plan: list[Primitive], controls: Controls, query: list[float] | None = None) -> DataFrame:
        """chunk_id, score and rank of the text chunks inside the plan's scope that match its terms, its vector, or both fused.

        The scope is joined below the search, so nothing outside it is scored. What
        the controls say is done or refused: a search by vector without a vector,
        evidence of a list that isn't searched, and unknown modes raise an error.
        """
        t = self.text_tables(plan)
        scoped = any(p.kind in SCOPES for p in plan)
        inside = scope(t.metadata, plan, t)
        own = self.chunks.join(inside.select("chunk_id"), "chunk_id", "left_semi") if scoped else self.chunks
        kind = controls.search_type or ("hybrid" if query is not None else "lex")
        if kind not in ("lex", "vector", "hybrid"):
            raise ValueError(f"unknown search type {kind!r}")
        if kind != "lex" and query is None:
            raise ValueError(f"a {kind} search needs the query's vector")
        if controls.threshold is not None and kind == "lex":
            raise ValueError("a similarity threshold needs a search by vector")
        if controls.expand:
            plan = [self._expanded(p) for p in plan]
        lists: dict[str, DataFrame] = {}
        if kind != "vector":
            words = own.select("chunk_id", T.tokens(retrieval.body()).alias("tokens")).where(term_predicate(plan))
            lists["lex"] = words.select("chunk_id", plan_score(plan).alias("score"))
        if kind != "lex":
            lists["vec"] = retrieval.near_by_vector(own, query, None if controls.threshold is None else 1 - controls.threshold)
        for name, wanted in (("lex", controls.in_lexical), ("vec", controls.in_vector)):
            if wanted and name not in lists:
                raise ValueError(f"evidence of the {name} list is asked for, which a {kind} search doesn't have")
        if len(lists) == 2:
            ranks = {n: retrieval.ranked(d, F.col("score"), controls.candidates) for n, d in lists.items()}
            found = retrieval.fused({n: (d, 1.0) for n, d in ranks.items()}, None)
            for name, wanted in (("r_lex", controls.in_lexical), ("r_vec", controls.in_vector)):
                if wanted is not None:
                    found = found.where(F.col(name).isNotNull() if wanted else F.col(name).isNull())
            found = found.select("chunk_id", "score")
        else:
            found = next(iter(lists.values()))
        if controls.boosts:
            found = found.join(t.speakers, "chunk_id", "left")
            for names, weight in controls.boosts:
                hit = F.coalesce(F.arrays_overlap("speaker_norms", F.array(*(F.lit(n.lower()) for n in names))), F.lit(False))
                found = found.withColumn("score", F.round(F.col("score") * F.when(hit, float(weight)).otherwise(1.0), 6))
            found = found.select("chunk_id", "score")
        if controls.mode in ("count", "aggregate") or controls.group_by:
            return self._reduced(found, t.metadata, controls)
        if controls.retrieval_mode == "thorough":
            placed = found.join(self.chunks.select("chunk_id", "document_id"), "chunk_id")
            got = retrieval.document_order(placed).select("chunk_id", "score", F.col("document_rank").alias("rank"))
            got = got if controls.k is None else got.where(F.col("rank") <= controls.k)
        else:
            k = controls.k if controls.k is not None or controls.retrieval_mode is None else CONVERSATIONAL_K
            got = retrieval.ranked(found, F.col("score"), k).select("chunk_id", "score", "rank")
        if controls.quotes:
            got = got.join(t.speakers, "chunk_id", "left")
        return got

    def _expanded(self, p: Primitive) -> Primitive:
        """The primitive or any other name of an entity it names (a dozen at most)."""
        if p.kind not in ("TERM", "PHRASE"):
            return p
        names = self.tables.entities.select("entity_id", "name").where("name is not null")
        others = [r.term for r in resolution.expanded_terms(names, p.value).select("term").collect()]
        return primitive("OR_GROUP", primitives=[p, *(primitive("PHRASE", value=o) for o in others if o != p.value.lower())])

    def _reduced(self, found: DataFrame, metadata: DataFrame, controls: Controls) -> DataFrame:
        """Found chunks as they are, counted, summed up, or counted by a field."""
        if controls.group_by:
            if controls.group_by not in ("document_id", "collection_slug"):
                raise ValueError(f"can't group by {controls.group_by!r}")
            own = found if controls.group_by in found.columns else found.join(metadata.select("chunk_id", controls.group_by), "chunk_id")
            return facets.count_by(own, controls.group_by)
        if controls.mode == "count":
            return found.agg(F.countDistinct("chunk_id").alias("n_chunks"))
        if controls.mode == "aggregate":
            own = found if "document_id" in found.columns else found.join(metadata.select("chunk_id", "document_id", "collection_slug"), "chunk_id")
            return own.agg(F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("document_id").alias("n_documents"), F.countDistinct("collection_slug").alias("n_collections"))
        return found
