"""References to records that do not exist.

A reference may be composite and partly null. References are grouped by their
null mask, and each mask is anti-joined on its non-null columns only, under a
declared match rule:

``simple``   a reference with any null refers to nothing and is never an orphan;
``partial``  the non-null columns must occur together in one parent row;
``full``     all columns null refers to nothing, some null is always an orphan.

Before a shuffle the references are reduced to distinct keys with the earliest
citing time, so a key cited by a third of all rows is one row per map task.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("simple", "partial", "full")


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str], rule: str = "simple") -> DataFrame:
    """Rows of ``child`` whose key has no row in ``parent``; ``keys`` maps child to parent columns.

    All columns and repeats of ``child`` are kept; names that occur on both
    sides can't clash, as the parent's are renamed. Null keys follow ``rule``
    (see the module). An empty parent makes every non-null reference an orphan,
    an empty child gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    names = list(keys)
    side = parent.select(*(F.col(f"`{p}`").alias(f"__p{i}") for i, p in enumerate(keys.values())))
    parts: list[DataFrame] = []
    for nulls in product((False, True), repeat=len(names)):
        own = child.where(reduce(Column.__and__, (F.col(f"`{n}`").isNull() if x else F.col(f"`{n}`").isNotNull() for n, x in zip(names, nulls))))
        held = [i for i, x in enumerate(nulls) if not x]
        if not held or (any(nulls) and rule == "simple"):
            continue
        if any(nulls) and rule == "full":
            parts.append(own)
            continue
        there = side.select(*(f"__p{i}" for i in held)).dropna().distinct()
        parts.append(own.join(there, reduce(Column.__and__, (own[f"`{names[i]}`"] == there[f"__p{i}"] for i in held)), "left_anti"))
    return reduce(DataFrame.unionAll, parts) if parts else child.limit(0)


def dangling(refs: DataFrame, target: DataFrame, removed: DataFrame | None = None, keys: tuple[str, ...] = ("ref_id",)) -> DataFrame:
    """References that lead nowhere, were removed, or lead to later records.

    ``refs``: source_field, record_id, the ``keys`` and cited_at. ``target``: the
    keys and made_at. ``removed``: the keys. A reference holds what its non-null
    keys hold together in one target row (rule ``partial``), so references of
    several kinds, each with a key column of its own, go through one call; all
    keys null is no reference. Returns distinct source_field, record_id, the keys,
    cited_at, kind with kind ``missing``, ``deleted`` or ``late``. A null cited_at
    or made_at is never late. Of several rows of one target the earliest made_at
    counts; a repeated citing row gives one row.
    """
    cols = list(keys)
    some = reduce(Column.__or__, (F.col(c).isNotNull() for c in cols))
    same = reduce(Column.__and__, (F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in cols))
    own = [F.col(f"a.`{c}`").alias(c) for c in cols]
    join = lambda a, b, how="inner": a.alias("a").join(b.alias("b"), same, how)
    refs = refs.select("source_field", "record_id", *cols, "cited_at").where(some)
    cited = refs.groupBy(*cols).agg(F.min("cited_at").alias("first_cited"))
    there = target.where(some).groupBy(*cols).agg(F.min("made_at").alias("made_at"))
    gone = orphans(cited, there, {c: c for c in cols}, "partial").select(*cols)
    if removed is None:
        gone = gone.withColumn("bad", F.lit("missing"))
    else:
        listed = removed.select(*cols).where(some).distinct().withColumn("listed", F.lit(True))
        gone = join(gone, listed, "left").select(*own, F.when(F.col("listed"), "deleted").otherwise("missing").alias("bad"))
    late = join(cited, there).where("made_at > first_cited").select(*own, F.lit("late").alias("bad"), F.col("made_at").cast("timestamp_ntz").alias("made_at"))
    bad = gone.select(*cols, "bad", F.lit(None).cast("timestamp_ntz").alias("made_at")).unionByName(late)
    told = join(refs, bad).where((F.col("bad") != "late") | (F.col("made_at") > F.col("cited_at").cast("timestamp_ntz")))
    return told.select("source_field", "record_id", *own, "cited_at", F.col("bad").alias("kind")).distinct()


def report(found: DataFrame) -> DataFrame:
    """Counts of dangling references per field, month of the citing row (null where unknown) and kind."""
    return found.groupBy("source_field", F.date_format("cited_at", "yyyy-MM").alias("month"), "kind").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("record_id").alias("n_records"), F.countDistinct("ref_id").alias("n_targets")
    )
