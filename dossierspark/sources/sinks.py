"""Writers: JSON lines, summary files with fixed columns, and vector collections with a model check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierspark.session import scratch_path


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_summary(df: DataFrame, path: str, columns) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def collection_model(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select("model", F.size("embedding").alias("dimension")).distinct()
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return None
        raise


def replace_collection(df: DataFrame, path: str, model: str, dimension: int, force: bool = False) -> None:
    """Rebuild a collection; refuses vectors of another dimension, or another model unless forced."""
    spark = df.sparkSession
    if df.filter(F.size("embedding") != dimension).limit(1).count():
        raise ValueError(f"vectors of another dimension than {dimension}")
    stored = None if force else collection_model(spark, path)
    if stored is not None and stored.filter((F.col("model") != model) | (F.col("dimension") != dimension)).limit(1).count():
        raise ValueError(f"collection at {path} holds vectors of another model")
    staged = scratch_path(spark, "collection")
    df.withColumn("model", F.lit(model)).write.parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").parquet(path)
