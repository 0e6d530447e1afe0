"""Scores, threshold transforms and geography as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def combined(trigram: Column, token: Column, edit: Column, tier: Column) -> Column:
    """Weighted score of a candidate match."""
    return F.round(0.45 * trigram + 0.25 * token + 0.20 * edit + 0.10 * tier, 6)


def priority(docs: Column, mentions: Column, quality: Column, tiered: Column, danger: Column) -> Column:
    return F.round(10 * F.log(docs + 1) + 5 * F.log(mentions + 1) + 20 * quality + F.when(tiered, 30).otherwise(0) - F.when(danger, 20).otherwise(0), 6)


def hubness(support: Column, in_focus: Column, overall: Column) -> Column:
    """Support plus how much more frequent something is in focus than overall, clipped."""
    return F.round(support + 0.3 * F.greatest(F.least(F.log((in_focus + 1) / (overall + 1)), F.lit(2.0)), F.lit(-2.0)), 6)


def decision(score: Column, margin: Column, accept: float = 0.75, review: float = 0.5, least_margin: float = 0.15) -> Column:
    """resolved, queue or ignore; a narrow margin sends a good match to review."""
    return F.when((score >= accept) & (F.coalesce(margin, F.lit(1.0)) >= least_margin), "resolved").when(score >= review, "queue").otherwise("ignore")


def similarity_to_distance(similarity: float, metric: str = "cosine") -> float:
    """The distance bound of a similarity threshold."""
    match metric:
        case "cosine":
            return 1.0 - similarity
        case "l2":
            return 1.0 / similarity - 1.0 if similarity > 0 else math.inf
        case "inner_product":
            return -similarity
    raise ValueError(metric)


def box(lat: float, lng: float, radius_km: float) -> tuple[float, float, float, float]:
    """South, north, west and east of a radius, with 111 km a degree and the cosine held above 0.1."""
    up, across = radius_km / 111.0, radius_km / (111.0 * max(0.1, math.cos(math.radians(lat))))
    return lat - up, lat + up, lng - across, lng + across
