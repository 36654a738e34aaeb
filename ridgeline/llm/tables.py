"""Reading the tables of a data folder by Spark's readers alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``; workers are told of the package first."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
