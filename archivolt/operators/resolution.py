"""Look-up and resolution of entities, gates for proposals, citations, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.functions import text as T
from archivolt.operators.pipelines import trigram_join

#: Words near a name that say what it is; fixed values.
TITLES = ("mr", "mrs", "dr", "col", "capt", "senator", "comrade", "prof")
ORGANISATIONS = ("committee", "bureau", "institute", "company", "corporation", "department", "society", "office")
PLACES = ("in", "at", "near", "from", "embassy", "consulate", "station")


def names_of(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entity_id, name, canonical: canonical names and aliases in one list."""
    return entities.select("entity_id", "name", F.lit(True).alias("canonical")).unionByName(aliases.select("entity_id", F.col("alias").alias("name"), F.lit(False).alias("canonical"))).where("name is not null").distinct()


def expanded_terms(names: DataFrame, text: str, most: int = 12, least: float | None = None) -> DataFrame:
    """All names of the entities that a text names, by key or, with ``least``, by likeness; the shortest first."""
    key = T.norm_key(F.lit(text))
    hit = T.norm_key("name") == key if least is None else T.trigram_similarity("name", F.lit(text)) >= least
    found = names.join(names.where(hit).select("entity_id").distinct(), "entity_id", "left_semi")
    return found.groupBy(F.lower("name").alias("term")).agg(F.min("entity_id").alias("entity_id")).orderBy(F.length("term"), "term").limit(most)


def looked_up(surfaces: DataFrame, names: DataFrame, least: float = 0.5) -> DataFrame:
    """surface, entity_id, similarity, method, ambiguous: the exact name where there is one, else the most similar.

    Only surfaces without an exact name go into the fuzzy join.
    """
    s = surfaces.select(F.col("surface")).where("surface <> ''").distinct()
    n = names.select("entity_id", T.normalize_surface("name").alias("key")).distinct()
    exact = s.join(n, F.col("surface") == F.col("key")).groupBy("surface").agg(F.min("entity_id").alias("entity_id"), (F.count(F.lit(1)) > 1).alias("ambiguous")).withColumn("similarity", F.lit(1.0)).withColumn("method", F.lit("exact"))
    rest = s.join(exact.select("surface"), "surface", "left_anti")
    like = trigram_join(rest, n, "surface", "key", least, top=2)  # the best and whether another is as good
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    best = like.withColumn("next", F.lead("similarity").over(w)).withColumn("k", F.row_number().over(w)).where("k = 1")
    fuzzy = best.join(n.groupBy("key").agg(F.min("entity_id").alias("entity_id")), F.col("b") == F.col("key")).select(F.col("a").alias("surface"), "entity_id", F.coalesce(F.col("next") == F.col("similarity"), F.lit(False)).alias("ambiguous"), "similarity", F.lit("fuzzy").alias("method"))
    return exact.unionByName(fuzzy)


def hints(words: Column | str, term: str, window: int = 4) -> list[Column]:
    """Whether a title, an organisation or a place stands near the first occurrence of a word."""
    w = F.col(words) if isinstance(words, str) else words
    at = F.array_position(w, term)
    near = F.slice(w, F.greatest(at - window, F.lit(1)).cast("int"), F.lit(2 * window + 1))
    has = lambda those: F.arrays_overlap(near, F.array(*map(F.lit, those)))
    return [F.when(at > 0, has(v)).alias(n) for n, v in (("titled", TITLES), ("organised", ORGANISATIONS), ("placed", PLACES))]


def proposable(stats: DataFrame, aliases: DataFrame, banned: DataFrame, least_docs: int = 2) -> DataFrame:
    """Surfaces fit to be proposed as entities: often enough, no alias yet, not banned."""
    return stats.where(F.col("n_docs") >= least_docs).join(aliases.select(F.col("alias").alias("surface_norm")), "surface_norm", "left_anti").join(banned.select("surface_norm"), "surface_norm", "left_anti")


def guarded(tier: Column, known: Column, consistency: Column) -> Column:
    """What may be done with a surface without a human: link, create, or queue it."""
    return F.when(known & (tier == 1), "auto_link").when(~known & (tier == 1) & (consistency >= 0.8), "auto_create").when(tier <= 2, "queue").otherwise("ignore")


def cited_chunks(citations: DataFrame, pages: DataFrame, spans: DataFrame) -> DataFrame:
    """entity_id, chunk_id of citations (entity_id, document_id, pages: array of page numbers) through the pages' chunks."""
    each = citations.select("entity_id", "document_id", F.explode("pages").alias("page_seq"))
    return each.join(pages.select("document_id", "page_seq", "page_id"), ["document_id", "page_seq"]).join(spans.select("page_id", "chunk_id"), "page_id").select("entity_id", "chunk_id").distinct()


def kind_of(name: Column | str) -> Column:
    """A guess of an entity's kind from the words of its name."""
    w = T.tokens(name)
    has = lambda those: F.arrays_overlap(w, F.array(*map(F.lit, those)))
    return F.when(has(ORGANISATIONS), "org").when(has(TITLES), "person").when(F.size(w).between(2, 4), "person?").otherwise("unknown")


def adjudicated(decisions: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Allowed variants with their entity, blocked variants, and clusters that make a new entity, from decisions (cluster, action, entity_id)."""
    both = variants.join(decisions, "cluster")
    return both.where("action = 'merge'").select("member", "entity_id"), both.where("action = 'block'").select("member"), decisions.where("action = 'new'").select("cluster")


def weighted(flags: dict[str, tuple[Column, float]], most: float = 1.0) -> Column:
    """A capped weighted sum of conditions."""
    return F.round(F.least(reduce(Column.__add__, (F.when(c, w).otherwise(0.0) for c, w in flags.values())), F.lit(most)), 6)


def pool(df: DataFrame, n: int, order: list[Column], year: str) -> DataFrame:
    """The first n rows in order and the best row of each year that they leave out."""
    first = df.orderBy(*order).limit(n)
    rest = df.join(first.select(year).distinct(), year, "left_anti").withColumn("__k", F.row_number().over(Window.partitionBy(year).orderBy(*order))).where("__k = 1").drop("__k")
    return first.unionByName(rest)


def line_context(df: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """key, line_no (from 0), line and the lines before and after it, for lines with a term."""
    lines = F.split(F.col(text), "\n")
    told = F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.when(i > 0, F.try_element_at(lines, i)).alias("above"), F.try_element_at(lines, i + 2).alias("below")))
    return df.select(F.col(key), F.inline(F.filter(told, lambda x: F.contains(F.lower(x["line"]), F.lit(term.lower())))))
