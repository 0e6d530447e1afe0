"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.shared import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node of an edge.

    Large-star and small-star rounds: every edge points to a smaller node, and
    rounds end when nothing changes, after about the logarithm of the number of
    nodes. Each round is written to the shared folder; nothing but two numbers
    comes to the driver. Loops count as nodes, null ends drop out.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    e = cut(e.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())  # what makes the edges runs once
    nodes = e.select(F.col("x").alias("node")).unionAll(e.select(F.col("y").alias("node"))).distinct()
    links = e.where("x <> y")
    state = None
    for _ in range(most_rounds):
        both = links.unionAll(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(down, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionAll(down.select("x", F.col("m").alias("y"))).distinct()
        links = cut(small)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(links.select(F.col("x").alias("node"), F.col("y").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
