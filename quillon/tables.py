"""Loading the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def events(spark: SparkSession, base: str) -> DataFrame:
    """Events with a zoned timestamp, which watermarks ask for."""
    df = load(spark, base, "events")
    return df.withColumn("ts", df["ts"].cast("timestamp"))
