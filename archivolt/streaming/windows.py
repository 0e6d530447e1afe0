"""Windows, late data and increments over streams of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.shared import scratch


def event_stream(spark: SparkSession, folder: str, name: str = "events", time: str = "ts") -> DataFrame:
    """The table as a stream of files; its times become instants."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/{name}.parquet*")
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and their value per type and window; with ``slide`` windows overlap."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_state(events: DataFrame) -> DataFrame:
    """user_id, n, last_ts after every batch: state that a session keeps for each user."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        for frame in frames:
            n += len(frame)
            last = max(last, int(frame["us"].max()))
        state.update((n, last))
        yield pd.DataFrame([(key[0], n, last)], columns=["user_id", "n", "last_us"])

    own = events.select("user_id", F.unix_micros("ts").alias("us"))
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, last_us bigint", "n bigint, last bigint", "update", GroupStateTimeout.NoTimeout)


def finished(stream: DataFrame, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result as a table in the shared folder.

    In ``complete`` mode the last batch is the result; in ``append`` all batches
    are. In ``update`` mode a batch holds only what has changed, so of all batches'
    rows the newest of each of ``keys`` counts. A batch that is written again after
    a failure replaces itself.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys that rows replace each other by")
    spark = stream.sparkSession
    out, marks = scratch(spark, "stream"), scratch(spark, "stream-marks")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/__batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "complete":
        return spark.read.parquet(out)
    rows = spark.read.parquet(out)
    if mode == "append":
        return rows.drop("__batch")
    rest = [c for c in rows.columns if c not in (*keys, "__batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__last")).select(*keys, "__last.*")


def incremental(new: DataFrame, done: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Work on the rows whose key isn't done yet; running it again adds nothing."""
    return work(new.join(done.select(key).distinct(), key, "left_anti"))
