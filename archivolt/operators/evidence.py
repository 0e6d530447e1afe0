"""Evidence: spans of texts, claims from mentions, and their grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.functions import text as T


def spans(chunks: DataFrame, key: str, body: str, terms: list[str]) -> DataFrame:
    """Sentences with any of the terms: key, sentence (from 0), text, n_hits (different terms) and a hash that equal spans share."""
    each = chunks.select(key, F.posexplode(T.sentences(body)).alias("sentence", "text")).withColumn("words", T.lexemes("text"))
    hits = F.size(F.array_intersect("words", F.array(*(F.lit(t.lower()) for t in terms))))
    return each.withColumn("n_hits", hits.cast("bigint")).where("n_hits > 0").withColumn("span_hash", T.canonical_hash("text")).drop("words")


def banded(df: DataFrame, score: Column, cite: int = 10, harvest: int = 30) -> DataFrame:
    """The best spans to cite, the next to harvest from; the rest drops out."""
    top = df.withColumn("score", score).orderBy(F.desc("score"), "span_hash").limit(cite + harvest)
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "span_hash"))
    return top.withColumn("place", n).withColumn("band", F.when(F.col("place") <= cite, "cite").otherwise("harvest"))


def kept(old: DataFrame, new: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """A bounded store after new evidence: the best n of both, a key once with its best score."""
    both = old.select(key, score).unionByName(new.select(key, score))
    return both.groupBy(key).agg(F.max(score).alias(score)).orderBy(F.desc(score), key).limit(n)


def co_mention_claims(mentions: DataFrame, least: int = 2) -> DataFrame:
    """Claims that two surfaces are related, from common chunks: subject, object, claim_id, support."""
    m = mentions.where("surface_norm is not null and chunk_id is not null").select("chunk_id", F.col("surface_norm").alias("subject")).distinct()
    both = m.join(m.withColumnRenamed("subject", "object"), "chunk_id").where("subject < object")
    n = both.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)
    return n.withColumn("claim_id", F.sha1(F.concat_ws("|", "subject", "object").cast("binary")))


def co_mentions(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """subject, object (subject < object), support, n_refs, n_attested: common chunks of two surfaces, the rows of ``chunks`` they have, and those whose text has both names.

    Each text is searched once for the names of its chunk, so neither texts nor
    claims meet the mentions of a frequent name.
    """
    m = mentions.where("surface_norm is not null and chunk_id is not null")
    names = m.groupBy("chunk_id").agg(F.array_sort(F.collect_set("surface_norm")).alias("names"))
    told = names.join(chunks.select("chunk_id", T.normalize_surface("body").alias("body"), F.lit(True).alias("there")), "chunk_id", "left")
    has = F.when(F.col("there"), F.transform("names", lambda s: F.coalesce(F.contains(F.col("body"), s), F.lit(False))))
    each = told.select("chunk_id", "names", has.alias("has")).groupBy("chunk_id").agg(F.first("names").alias("names"), F.collect_list("has").alias("rows"))
    # one end after the other, so no row holds all pairs of a chunk
    one = each.select("names", "rows", F.posexplode("names").alias("i", "subject")).where("i + 1 < size(names)")
    both = one.select("names", "rows", "i", "subject", F.explode(F.sequence(F.col("i") + 1, F.size("names") - 1)).alias("j"))
    attested = F.size(F.filter("rows", lambda r: F.get(r, F.col("i")) & F.get(r, F.col("j"))))
    pairs = both.select("subject", F.get("names", F.col("j")).alias("object"), F.size("rows").alias("refs"), attested.alias("attested"))
    return pairs.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("support"), F.sum("refs").alias("n_refs"), F.sum("attested").alias("n_attested"))


def grounded_claims(mentions: DataFrame, chunks: DataFrame, least: int = 2) -> DataFrame:
    """The claims of co_mention_claims with their grounding: claim_id, support, n_refs, n_attested; n_refs is 0 where no chunk is left."""
    return co_mentions(mentions, chunks).where(F.col("support") >= least).select(F.sha1(F.concat_ws("|", "subject", "object").cast("binary")).alias("claim_id"), "support", "n_refs", "n_attested")


def uncited(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """Claims without a reference, which a stop gate waits for."""
    return claims.join(refs.select("claim_id").distinct(), "claim_id", "left_anti")


def expanded_until_stable(seeds: DataFrame, links: DataFrame, key: str, most_rounds: int = 5) -> DataFrame:
    """Keys reached from the seeds over links (key, other), round by round until no new one comes."""
    from archivolt.shared import cut

    found = cut(seeds.select(key).distinct())
    edge = found
    for _ in range(most_rounds):
        new = edge.join(links, key).select(F.col("other").alias(key)).distinct().join(found, key, "left_anti")
        edge = cut(new)
        if edge.isEmpty():
            break
        found = cut(found.unionByName(edge))
    return found
