"""Lanes of a search, the expansion of queries, and rounds of lanes until nothing new is found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions import text as T
from archivolt.operators import retrieval
from archivolt.shared import cut

#: Score of a chunk that a seed shares with another entity; fixed value.
CO_MENTION_SCORE = 0.9


def expanded_query(query: str, names: list[str], most: int = 12) -> str:
    """The query with up to ``most`` other names as an OR group; names it already has are left out."""
    low = query.lower()
    own = [n for n in dict.fromkeys(names) if n and n.lower() not in low][:most]
    return query if not own else f"{query} OR " + " OR ".join(f'"{n}"' if " " in n else n for n in own)


def entity_lane(mentions: DataFrame, ids: list[int]) -> DataFrame:
    """chunk_id, score 1: chunks that mention any of the entities."""
    return mentions.where(F.col("entity_id").isin(ids)).select("chunk_id").distinct().withColumn("score", F.lit(1.0))


def must_hit_lane(chunks: DataFrame, prefixes: list[str], k: int | None = 200) -> DataFrame:
    """chunk_id, score, rank: chunks with a word that starts with any of the prefixes, by how many of their words do."""
    words = chunks.select("chunk_id", T.tokens(retrieval.body()).alias("w"))
    starts = lambda w: reduce(Column.__or__, (F.startswith(w, F.lit(p.lower())) for p in prefixes))
    hits = words.select("chunk_id", F.size(F.filter("w", starts)).alias("hits"), F.size("w").alias("n")).where("hits > 0")
    return retrieval.ranked(hits, F.round(F.col("hits") / (1 + F.log(1 + F.col("n"))), 6), k).select("chunk_id", "score", "rank")


def co_mention_lane(mentions: DataFrame, entities: DataFrame, seed: int, kind: str) -> DataFrame:
    """chunk_id, score: chunks of the seed that also mention another entity of a kind."""
    other = mentions.join(entities.where((F.col("entity_type") == kind) & (F.col("entity_id") != seed)).select("entity_id"), "entity_id", "left_semi")
    own = mentions.where(F.col("entity_id") == seed).select("chunk_id").distinct()
    return own.join(other.select("chunk_id"), "chunk_id", "left_semi").withColumn("score", F.lit(CO_MENTION_SCORE))


def rewrites(concept: str) -> list[str]:
    """Other spellings of a phrase: its words, joined, singular and plural, without a hyphen."""
    low = " ".join(concept.lower().replace("-", " ").split())
    words = low.split()
    got = [low, low.replace(" ", ""), *(w for w in words if len(w) > 3), *(w[:-1] if w.endswith("s") else w + "s" for w in words if len(w) > 3)]
    return list(dict.fromkeys(w for w in got if w))


def ephemeral_lane(chunks: DataFrame, concept: str, least: int = 1, most_share: float = 0.5, k: int | None = 200) -> DataFrame:
    """chunk_id, score, rank of a search for the rewrites of a concept that are told to be of use by their hits.

    One aggregate counts the chunks of each rewrite (a handful, so its rows come
    to the driver); those found nowhere or in too many chunks are dropped.
    """
    words = chunks.select("chunk_id", T.lexemes(retrieval.body()).alias("w"))
    single = [r for r in rewrites(concept) if " " not in r]
    counts = words.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(T.has_term("w", r)).alias(f"r{i}") for i, r in enumerate(single))).first()
    good = [r for i, r in enumerate(single) if least <= counts[f"r{i}"] <= most_share * counts["n"]]
    condition = F.arrays_overlap("words", F.array(*map(F.lit, good)).cast("array<string>")) if good else F.lit(False)
    return retrieval.lexical(chunks, condition, good or [concept], k)


def rounds(mentions: DataFrame, seeds: list[int], per_round: int = 3, most_rounds: int = 4, least: int = 2) -> DataFrame:
    """chunk_id, round: chunks of the seeds, then of the entities most often with them, round by round until nothing is new.

    Each round adds at most ``per_round`` entities that share at least ``least``
    chunks with those known; only their ids come to the driver.
    """
    known = sorted(set(seeds))
    found = cut(entity_lane(mentions, known).select("chunk_id", F.lit(0).alias("round")))
    for n in range(1, most_rounds + 1):
        near = mentions.join(found.select("chunk_id"), "chunk_id", "left_semi").where(~F.col("entity_id").isin(known))
        new = [r.entity_id for r in near.groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "entity_id").limit(per_round).collect()]
        if not new:
            break
        known = sorted({*known, *new})
        more = entity_lane(mentions, new).select("chunk_id", F.lit(n).alias("round")).join(found.select("chunk_id"), "chunk_id", "left_anti")
        found = cut(found.unionByName(more))
    return found
