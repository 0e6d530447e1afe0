"""Mixing of sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash. A document's virtual finish
time is the source's cumulative size up to it divided by the source's weight;
sorted by that time, every prefix of the mix holds each source at its weight.
A repeated pass over a source adds the source's whole size. The running sums are
taken in two levels, over hash buckets and inside them, so no source is one
task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.shared import cut

SEED = 20
ROWS_PER_BUCKET = 20_000


EVEN = "even"


def plan(totals: DataFrame, targets: DataFrame, budget: float | str | None = None) -> tuple[list[dict], float, float]:
    """Weights and passes of the listed sources, the budget, and the virtual time at which it is used up.

    Weights are the target shares of the sources that have any tokens, made to
    sum to 1. The default budget is the size of all listed text, so nothing is left
    out for the sake of a scarce source: one that runs out of its allowed repeats
    falls short, and the others go on until the budget is full. With EVEN it is the
    largest budget at which every source still reaches its weight. The targets
    table is a setting with a row per source; its rows and one total for each come
    to the driver.
    """
    t = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    rows = [r.asDict() for r in t.join(totals, "source", "left").orderBy("source").collect()]
    live = [r for r in rows if (r["total"] or 0) > 0 and r["cap"] > 0]
    whole = sum(r["share"] for r in live)
    for r in rows:
        r["weight"] = r["share"] / whole if r in live else 0.0
        r["most"] = r["cap"] * r["total"] if r in live else 0
    if budget == EVEN:
        end = min((r["most"] / r["weight"] for r in live), default=0.0)
        return rows, end, end
    budget = float(sum(r["total"] for r in live) if budget is None else budget)
    left, weight, end = budget, 1.0, 0.0
    for r in sorted(live, key=lambda r: (r["most"] / r["weight"], r["source"])):  # the source that runs out first
        step = r["most"] / r["weight"]
        if (step - end) * weight >= left:
            break
        left -= (step - end) * weight
        weight -= r["weight"]
        end = step
    else:
        return rows, budget, end
    return rows, budget, end + left / weight


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", budget: float | str | None = None, seed: int = SEED) -> DataFrame:
    """source, key, copy_no (from 0), n_tokens and virtual_finish, range-sorted by virtual_finish.

    ``sizes``: key, source, n_tokens; ``targets``: source, target_share,
    max_repeats. Taken is what finishes within the budget (see ``plan``), so the
    total never exceeds it. Null and unlisted sources stay out; a null max_repeats
    is 1; of several target rows of a source the largest values count. Repeated
    keys are separate documents, ties in the shuffle go by key, documents of no
    tokens are taken with those around them. Empty tables give an empty mix.
    """
    spark = sizes.sparkSession
    listed = targets.where("source is not null and target_share > 0").select("source").distinct()
    docs = cut(sizes.select(F.col(key), "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")).join(listed, "source", "left_semi"))
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("n"))
    rows, _, end = plan(totals, targets, budget)
    weights = [(r["source"], float(r["weight"]), int(r["cap"]), int(r["total"])) for r in rows if r["weight"] > 0]
    buckets = max(64, max((r["n"] or 0 for r in rows), default=0) // ROWS_PER_BUCKET)
    w = spark.createDataFrame(weights, "source string, weight double, cap int, total bigint")
    placed = docs.withColumn("shuffled", F.xxhash64(F.lit(seed), key)).withColumn("bucket", F.pmod(F.shiftright("shuffled", 16), F.lit(buckets)).cast("int"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("size"))
    offsets = sums.withColumn("offset", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")).drop("size")
    inside = Window.partitionBy("source", "bucket").orderBy("shuffled", key).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("inside", F.sum("n_tokens").over(inside)).join(offsets, ["source", "bucket"]).withColumn("upto", F.col("inside") + F.col("offset"))
    reach = F.lit(end * (1 + 1e-12)) * F.col("weight")
    passes = F.least(F.col("cap"), F.floor((reach - F.col("upto")) / F.col("total")).cast("int") + 1)
    return (
        summed.join(F.broadcast(w), "source")  # a row per source of the targets
        .where(F.col("upto") <= reach)
        .withColumn("copy_no", F.explode(F.sequence(F.lit(0), passes - 1)))
        .withColumn("virtual_finish", (F.col("copy_no") * F.col("total") + F.col("upto")) / F.col("weight"))
        .select("source", key, "copy_no", "n_tokens", "virtual_finish")
        .orderBy("virtual_finish", "source", key, "copy_no")
    )


def shares(mixed: DataFrame, targets: DataFrame, key: str = "doc_id", sizes: DataFrame | None = None, budget: float | str | None = None) -> DataFrame:
    """The shares really reached: a row per listed source, those without documents too.

    With ``sizes`` also what there is (n_available), how much of it isn't in the
    mix at all (n_left_out), how many tokens a source is short of its target share
    of the mix (shortfall), and the budget.
    """
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_taken"), F.countDistinct(key).alias("n_docs"), (F.max("copy_no") + 1).alias("passes"), F.sum(F.when(F.col("copy_no") == 0, F.col("n_tokens"))).alias("n_used"))
    whole = Window.partitionBy(F.lit(1))  # over a row per source
    listed = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    all_ = F.sum("n_tokens").over(whole)
    told = listed.join(got, "source", "left").select("source", "target_share", *map(zero, ("n_tokens", "n_taken", "n_docs", "passes", "n_used"))).withColumn("actual_share", F.col("n_tokens") / F.nullif(all_, F.lit(0)))
    if sizes is None:
        return told.drop("n_used")
    totals = sizes.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("n_tokens", F.lit(0))).cast("bigint").alias("total"))
    own = told.join(totals, "source", "left").withColumn("n_available", F.coalesce("total", F.lit(0)).cast("bigint"))
    own = own.withColumn("n_left_out", F.col("n_available") - F.col("n_used")).withColumn("shortfall", F.greatest(F.lit(0), F.ceil(F.col("target_share") * all_ - F.col("n_tokens") - 1e-6)).cast("bigint"))
    return own.withColumn("budget", F.lit(int(plan(totals, targets, budget)[1])).cast("bigint")).drop("total", "n_used")
