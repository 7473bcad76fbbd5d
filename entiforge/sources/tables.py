"""Readers of the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of ``folder``; Parquet gives schema, column pruning and filter pushdown."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """``signature`` with one row per ``signature_id``: of second deliveries the one with an affiliation wins, then
    the first received, then the smallest text (a total order, so the result does not depend on partitioning)."""
    s = table(spark, folder, "signature")
    rank = F.struct(
        (F.coalesce(F.length("author_affiliation"), F.lit(0)) == 0).alias("bare"),
        F.col("received_at"),
        F.col("author_affiliation"),
        F.col("author_name"),
        F.col("publication_id"),
    )
    return s.groupBy("signature_id").agg(F.min(rank).alias("r")).select("signature_id", "r.author_name", "r.author_affiliation", "r.publication_id", "r.received_at")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``pub_record`` without its exact repeats (one row per publication)."""
    return table(spark, folder, "pub_record").dropDuplicates(["publication_id"])


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """``metric_labels`` with one row per ``row_id`` (repeats are exact)."""
    return table(spark, folder, "metric_labels").groupBy("row_id").agg(F.max("labels_true").alias("labels_true"), F.max("labels_pred").alias("labels_pred"))
