"""Tables of a data folder as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; columns are pruned by the plan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def timestamps(df: DataFrame, *names: str) -> DataFrame:
    """Read zone-less times as UTC instants, for watermarks and time windows."""
    return df.withColumns({n: F.col(n).cast("timestamp") for n in names})
