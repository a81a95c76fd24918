"""Sources and sinks: Parquet tables in, fitted models and scores out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def save_model(fits: DataFrame, path: str) -> None:
    """Writes a table of memberships; a model is small, so it is one file."""
    fits.coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
