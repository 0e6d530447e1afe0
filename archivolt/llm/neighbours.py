"""The k most similar vectors of every vector by cosine.

Equal directions are collapsed to one class first. A forest (forest.py) fitted
on a bounded sample sends every class to several leaves. The sample bounds how
many leaves it can have, so a leaf that gets more than LEAF_MOST rows is split
by a tree fitted on a sample of its own rows, and again, until none is larger;
what one task compares is bounded at every size of the collection. All members
of a leaf are compared exactly, block by block, and the best k of all leaves are
merged. Both sides of a pair are spread over leaves, so a pair is found where any
two of their leaves meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.llm.forest import Forest, fit
from archivolt.shared import cut

#: Rows the forest is fitted on, about; every row is indexed.
SAMPLE = 20_000
TREES = 8
#: Leaves a vector is sent to: one of each tree and the nearest others.
LEAVES = 12
LEAF_ROWS = 256
#: No leaf that is compared has more rows; larger ones are split.
LEAF_MOST = 2048
#: Sample rows a leaf's own tree is fitted on, at most, and the leaves of it a row goes to.
SPLIT_SAMPLE = 16_384
SPLIT_LEAVES = 2
#: Rows of a leaf that one task routes through the leaf's own tree.
SPLIT_BLOCK = 20_000
BLOCK = 1024
STEP = 2048
ROUND = 1e5


def _units(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of an Arrow list column whose lists have the right length, and which of them are usable."""
    values = column.flatten()
    x = values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size)
    scale = np.abs(x).max(1, keepdims=True, initial=0)
    good = np.isfinite(x).all(1) & (scale[:, 0] > 0)
    with np.errstate(all="ignore"):
        x = x / scale  # lengths of very large or small entries neither overflow nor vanish
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return x.astype(np.float32), good & np.isfinite(x).all(1)


def unit_vectors(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """key, vec (float32 bytes of the unit vector) and two hashes of its direction, for usable vectors.

    Null vectors and keys, other lengths, all-zero vectors and entries that are
    null, NaN or infinite take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, good = _units(batch.column(1), size)
            ids = batch.column(0).filter(pa.array(good))
            x = x[good]
            cells = np.round(x * ROUND).astype(np.int32) + 0
            hashes = [[xxhash.xxh64_intdigest(c, s) - (1 << 63) for c in map(bytes, cells)] for s in (1, 2)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in x], pa.binary()), *(pa.array(h, pa.int64()) for h in hashes)], names=["key", "vec", "h1", "h2"])

    usable = df.where(F.col(f"`{key}`").isNotNull() & (F.size(F.col(f"`{vector}`")) == size)).select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{vector}`").alias("v"))
    return usable.mapInArrow(run, "key bigint, vec binary, h1 bigint, h2 bigint")


def _best(x: np.ndarray, keys: np.ndarray, k: int, least: float) -> pa.Table:
    """The best k partners of each row inside one leaf, and those that tie with the last of them, compared in blocks."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(x), BLOCK):
        rows = slice(at, min(at + BLOCK, len(x)))
        s = x[rows] @ x.T
        s[np.arange(s.shape[0]), np.arange(rows.start, rows.stop)] = -2
        floor = np.full(len(s), max(least, -1.5), s.dtype)
        if s.shape[1] > k:
            many = np.nonzero((s >= floor[:, None]).sum(1) > k)[0]
            if len(many):
                floor[many] = np.maximum(floor[many], -np.partition(-s[many], k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(s >= floor[:, None])
        found.append((keys[rows][i], keys[j], s[i, j]))
    a, b, c = (np.concatenate(z) for z in zip(*found))
    return pa.table({"a": a, "b": b, "cosine": c.astype(np.float64)})


def _points(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, size)


def bounded_leaves(rows: DataFrame, size: int, most: int = LEAF_MOST, rounds: int = 12) -> DataFrame:
    """leaf, key, vec with no leaf of more than ``most`` rows.

    In each round the leaves that are too large are fitted a tree of their own on
    a share of their rows (by hash, about 16 for each leaf wanted) and their rows
    are routed through it in blocks, each to its nearest two leaves. Rows that no
    plane parts (equal to 1e-6) are dealt out by their keys. Sizes, samples and
    trees stay tables; nothing comes to the driver.
    """
    done: list[DataFrame] = []
    for n in range(rounds):
        sizes = cut(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
        if sizes.isEmpty():
            break
        done.append(rows.join(sizes, "leaf", "left_anti"))
        large = rows.join(sizes, "leaf")
        wanted = F.least(F.ceil(4 * F.col("n") / most), F.lit(SPLIT_SAMPLE // 16))
        share = F.least(F.lit(1.0), 16 * wanted / F.col("n"))
        sample = large.where(F.pmod(F.xxhash64("key", F.lit(n)), F.lit(1 << 30)) < F.lit(1 << 30) * share).select("leaf", "vec", wanted.cast("int").alias("wanted"))

        def grow(key: tuple, t: pa.Table) -> pa.Table:
            forest = fit(_points(t.column("vec"), size), t.column("wanted")[0].as_py(), 1, abs(key[0].as_py()) % (1 << 32))
            return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([forest.dumps()], pa.binary())})

        trees = cut(sample.groupBy("leaf").applyInArrow(grow, "leaf bigint, tree binary"))
        blocks = F.ceil(F.col("n") / SPLIT_BLOCK).cast("int")
        own = large.select("leaf", "key", "vec", F.pmod(F.xxhash64(F.lit(-1), "key"), blocks).cast("int").alias("block"))
        each = trees.join(sizes, "leaf").select("leaf", "tree", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))

        def split(key: tuple, mine: pa.Table, tree: pa.Table) -> pa.Table:
            kind = pa.schema([("leaf", pa.int64()), ("key", pa.int64()), ("vec", pa.binary())])
            if not mine.num_rows:
                return kind.empty_table()
            forest = Forest.loads(tree.column("tree")[0].as_py()) if tree.num_rows else None
            keys = mine.column("key").combine_chunks()
            if forest is None or forest.leaves == 1:
                got = (np.abs(keys.to_numpy()) % 16)[:, None]
            else:
                got = forest.search(_points(mine.column("vec"), size), SPLIT_LEAVES)
            row, col = np.nonzero(got >= 0)
            names = [xxhash.xxh64_intdigest(f"{key[0].as_py()}/{g}") - (1 << 63) for g in range(int(got.max()) + 1)]
            return pa.Table.from_arrays([pa.array(np.array(names, np.int64)[got[row, col]]), keys.take(pa.array(row)), mine.column("vec").combine_chunks().take(pa.array(row))], schema=kind)

        rows = cut(own.groupBy("leaf", "block").cogroup(each.groupBy("leaf", "block")).applyInArrow(split, "leaf bigint, key bigint, vec binary"))
    return reduce(DataFrame.unionAll, [*done, rows]) if done else rows


def class_neighbours(vectors: DataFrame, k: int, least: float, trees: int, leaves: int, leaf_rows: int, sample: int, size: int, leaf_most: int = LEAF_MOST) -> DataFrame:
    """a, b, cosine, place: the best k of every row of ``vectors`` (key, vec), at least ``least``."""
    spark = vectors.sparkSession
    n = vectors.count()
    # a share of the hash values picks about ``sample`` rows, wherever they are; no task sends more than its part of them
    chosen = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1)))
    picked = vectors.where(chosen).orderBy("key").select("vec").toArrow().column("vec").to_pylist()
    if not picked:
        return spark.createDataFrame([], "a bigint, b bigint, cosine double, place int")
    points = np.frombuffer(b"".join(picked), np.float32).reshape(-1, size)
    forest = spark.sparkContext.broadcast(fit(points, max(1, n // leaf_rows), trees))  # bounded by the sample

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                got = forest.value.search(_points(part.column("vec"), size), leaves)
                row, col = np.nonzero(got >= 0)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(got[row, col], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("vec"), lists], names=["key", "vec", "leaves"])

    def compare(table: pa.Table) -> pa.Table:
        return _best(_points(table.column("vec"), size), table.column("key").to_numpy(), k, least)

    placed = cut(vectors.select("key", "vec").mapInArrow(route, "key bigint, vec binary, leaves array<bigint>"))
    routed = bounded_leaves(placed.select(F.explode("leaves").alias("leaf"), "key", "vec"), size, leaf_most)
    pairs = routed.groupBy("leaf").applyInArrow(compare, "a bigint, b bigint, cosine double").where("a <> b")
    once = pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return once.withColumn("place", place).where(F.col("place") <= k)


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, least: float = -1.0, size: int = 64, trees: int = TREES, leaves: int = LEAVES, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, leaf_most: int = LEAF_MOST) -> DataFrame:
    """a, b, cosine: for every usable vector a, at most k most similar others with a cosine of at least ``least``.

    Ties go to the smaller key. Vectors of equal direction (to 1e-5 an entry)
    are one class: its members are each other's first neighbours by key at
    cosine 1, and a class that is near stands for its first members by key. Of
    repeated keys each row takes part, a key never pairs with itself. An empty
    table gives an empty result; other columns aren't read.
    """
    rows = cut(unit_vectors(df, key, vector, size))
    classes = rows.groupBy("h1", "h2").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("n"))
    many = cut(classes.where("n > 1"))
    member = rows.select("key", "h1", "h2").join(many.select("h1", "h2", "class"), ["h1", "h2"]).select("key", "class").distinct()
    later = member.where(F.col("key") != F.col("class")).select("key")
    singles = rows.select("key", "vec").join(later, "key", "left_anti").dropDuplicates(["key"]) if many.limit(1).count() else rows.select("key", "vec")
    near = class_neighbours(singles, k, least, trees, leaves, leaf_rows, sample, size, leaf_most)
    if not many.limit(1).count():
        return near.select("a", "b", "cosine")
    # the first k+1 members of each class, by a salted and then a final ranking
    salted = Window.partitionBy("class", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy("key")
    first = member.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    heads = first.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("key"))).where(F.col("r") <= k + 1)
    heads = heads.groupBy("class").agg(F.sort_array(F.collect_list("key")).alias("heads"))
    own = lambda c: F.transform(c, lambda x: F.struct(F.lit(1.0).alias("cosine"), x.alias("b")))
    side = near.join(heads.withColumnRenamed("class", "b"), "b", "left").withColumn("bs", F.coalesce("heads", F.array("b")))
    others = side.groupBy("a").agg(F.flatten(F.collect_list(F.transform("bs", lambda x: F.struct(F.col("cosine"), x.alias("b"))))).alias("others"))
    ranked = heads.select(F.col("class").alias("a"), "heads").join(others, "a", "full_outer").select(
        F.col("a").alias("class"), F.concat(F.coalesce(own(F.col("heads")), F.array()), F.coalesce("others", F.array())).alias("list")
    )
    everyone = member.unionAll(rows.select("key", F.col("key").alias("class")).join(member.select("key"), "key", "left_anti")).distinct()
    order = lambda x, y: F.when(x["cosine"] > y["cosine"], -1).when(x["cosine"] < y["cosine"], 1).when(x["b"] < y["b"], -1).when(x["b"] > y["b"], 1).otherwise(0)
    sorted_ = ranked.withColumn("list", F.slice(F.array_sort("list", order), 1, k + 1))
    kept = everyone.join(sorted_, "class").withColumn("list", F.slice(F.filter("list", lambda x: x["b"] != F.col("key")), 1, k))
    return kept.select(F.col("key").alias("a"), F.inline("list")).select("a", "b", "cosine")
