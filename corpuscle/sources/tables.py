"""Reading the engine's tables from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.session import plain_unions


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder`` (a file or a folder of files)."""
    plain_unions(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
