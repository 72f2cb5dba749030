"""Reading the parquet tables of a data folder through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder or store path `sf_dir`."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
