"""Tables of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import drop, shared_dir, stored

__all__ = ["documents", "drop", "numbered_columns", "partitions", "shared_dir", "stored"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with columns c0, c1 and so on: Arrow maps can't take every name (dots)."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
