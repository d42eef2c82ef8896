"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table `name`, narrowed to `columns` where given, so that the scan reads only those."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*[f"`{c}`" for c in columns]) if columns else df
