"""Storage of paths and models: Parquet for tables, JSON for the few numbers of a model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_paths(events: DataFrame, path: str, by: str | None = None) -> None:
    """Sorted by path and time within each file, so that reads by path prune row groups."""
    rows = events.repartition("path_id").sortWithinPartitions("path_id", "t")
    (rows.write.partitionBy(by) if by else rows.write).mode("errorifexists").parquet(path)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_model(spark: SparkSession, model: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def read_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])
