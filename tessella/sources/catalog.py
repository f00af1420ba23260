"""Catalog tables from parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators.ranks import dense_ids
from tessella.operators.validate import require_columns


def catalog(df: DataFrame, y: str, object_id: str | None = None) -> DataFrame:
    """``(object_id long, y double, <features>)``; without an id column a dense row counter is made."""
    require_columns(df, [y] + ([object_id] if object_id else []))
    rest = [c for c in df.columns if c not in (y, object_id)]
    if object_id is None:
        df = dense_ids(df, "object_id", df.columns)
        object_id = "object_id"
    return df.select(F.col(object_id).cast("long").alias("object_id"), F.col(y).cast("double").alias("y"), *rest)


def typed(df: DataFrame, floats: Sequence[str], y: str, object_id: str) -> DataFrame:
    """Only the named columns, typed: the scan reads no other column."""
    return df.select(F.col(object_id).cast("long").alias("object_id"), F.col(y).cast("double").alias("y"),
                     *[F.col(c).cast("float").alias(c) for c in floats])


def tagged_union(train: DataFrame, test: DataFrame) -> DataFrame:
    """Two files as one table with a source tag (0 train, 1 test)."""
    return train.withColumn("source", F.lit(0).cast("byte")).unionByName(test.withColumn("source", F.lit(1).cast("byte")))


def load(spark: SparkSession, path: str, floats: Sequence[str], y: str, object_id: str) -> DataFrame:
    return typed(spark.read.parquet(path), floats, y, object_id)
