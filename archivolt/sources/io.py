"""Sources and sinks: tables, files, upserts, snapshots, samples and logs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, JSON (lines or documents) or parquet by the file's ending; JDBC by its URL scheme is read with read_table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith(".csv"):
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if path.endswith((".json", ".jsonl")):
        return reader.option("multiLine", path.endswith(".json")).json(path)
    if path.endswith(".xlsx"):
        raise ValueError("spreadsheets have to be saved as CSV first")
    return reader.parquet(path)


def read_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in parallel by ranges of a key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def relation(spark: SparkSession, values: list, column: str, kind: str) -> DataFrame:
    """A client's list as a table with its order."""
    return spark.createDataFrame(list(enumerate(values)), f"ord int, {column} {kind}")


def to_csv(df: DataFrame, path: str, *order: str) -> None:
    """Ordered CSV with a header; quotes are doubled, so texts with line breaks come back whole."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], on_conflict: str = "update") -> DataFrame:
    """Rows after an insert by key: a conflict updates the old row, or does nothing. Keys are compared null-safe."""
    if on_conflict not in ("update", "nothing"):
        raise ValueError(on_conflict)
    first, second = (new, old) if on_conflict == "update" else (old, new)
    same = [F.col(f"s.`{k}`").eqNullSafe(F.col(f"f.`{k}`")) for k in keys]
    rest = second.alias("s").join(first.select(*keys).distinct().alias("f"), same, "left_anti")
    return first.unionByName(rest, allowMissingColumns=True)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write once; a second write fails."""
    df.write.mode("errorifexists").parquet(path)


def append_log(spark: SparkSession, path: str, rows: list[dict], schema: str) -> None:
    """Append run records; their settings are JSON texts."""
    plain = [{k: json.dumps(v, sort_keys=True) if isinstance(v, dict) else v for k, v in r.items()} for r in rows]
    spark.createDataFrame(plain, schema).write.mode("append").parquet(path)


def junction(sets: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """result_set_id, chunk_id, rank and, with ``chunks``, document_id: the rows of stored id arrays in order; null ids drop out, a repeated id keeps its first place."""
    rows = sets.select("result_set_id", F.posexplode("chunk_ids").alias("at", "chunk_id")).where("chunk_id is not null")
    rows = rows.groupBy("result_set_id", "chunk_id").agg(F.min("at").alias("at"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("result_set_id").orderBy("at"))).drop("at")
    return rows if chunks is None else rows.join(chunks.select("chunk_id", "document_id"), "chunk_id", "left")


def sample_share(df: DataFrame, n: int, shares: tuple[float, ...] = (0.01, 0.05, 0.2, 1.0), seed: int = 1) -> DataFrame:
    """About n random rows: the sampled share grows until there are enough."""
    for share in shares:
        part = df.sample(share, seed) if share < 1 else df
        if share == shares[-1] or part.limit(n).count() >= n:
            return part.limit(n)
    return df.limit(n)


def head_tail_random(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """The first, the last and random rows by key, a third each, none twice."""
    k = max(1, n // 3)
    first, last = df.orderBy(F.asc(key)).limit(k), df.orderBy(F.desc(key)).limit(k)
    ends = first.unionByName(last).dropDuplicates([key])
    rest = df.join(ends.select(key), key, "left_anti").orderBy(F.rand(seed)).limit(k)
    return ends.unionByName(rest)


def compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of keys in both tables, in either alone, and of rows that differ, in one row."""
    h = lambda df, n: df.select(key, F.xxhash64(*sorted(df.columns)).alias(n))
    both = h(a, "x").join(h(b, "y"), key, "full_outer")
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    x, y = F.col("x"), F.col("y")
    return both.agg(count(x.isNotNull() & y.isNotNull(), "in_both"), count(y.isNull(), "only_a"), count(x.isNull(), "only_b"), count(x.isNotNull() & y.isNotNull() & (x != y), "changed"))


def since(df: DataFrame, key: str, last: int | None) -> DataFrame:
    """Rows beyond the last key synced; all of them at first."""
    return df if last is None else df.where(F.col(key) > last)


def pages_of_files(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """path, sha256, page_seq, raw_text of plain text files cut at form feeds; files already ingested (sha256) are left out.

    Files of other kinds need a reader of their own in place of the decoding here.
    """
    files = spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))
    if done is not None:
        files = files.join(done.select("sha256").distinct(), "sha256", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, s, i + 1, t) for p, s, c in zip(frame["path"], frame["sha256"], frame["content"]) for i, t in enumerate(bytes(c).decode("utf-8", "replace").split("\f"))]
            yield pd.DataFrame(rows, columns=["path", "sha256", "page_seq", "raw_text"])

    return files.select("path", "sha256", "content").mapInPandas(run, "path string, sha256 string, page_seq int, raw_text string")
