"""Incremental block clustering over micro-batches.

State is a durable table ``(row_id, block, label)`` in versions: a batch re-labels only the blocks it touches, and
their old rows of the table join the batch, so no block forgets what it held.  Labels are always relative to the
table, never to a batch.  A batch that is replayed after a failure writes the same version again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BlockStore:
    """Versioned Parquet table of the state; version ``n`` holds the state after batch ``n``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def at(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def put(self, df: DataFrame, version: int) -> None:
        """Writes a version; the one before stays, for a replayed batch reads it, older ones are deleted."""
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        sc = self.spark.sparkContext
        old = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={version - 2}")
        old.getFileSystem(sc._jsc.hadoopConfiguration()).delete(old, True)


def partial_fit(batch: DataFrame, state: DataFrame, cluster: Callable[[DataFrame], DataFrame], block: str = "block", row_id: str = "row_id") -> DataFrame:
    """New state: ``cluster(rows)`` gives ``rows`` with a label for the touched blocks, other blocks stay as they are.
    A row delivered again replaces itself; rows without a block are left out."""
    columns = [c for c in state.columns if c != "label"]
    fresh = batch.where(F.col(block).isNotNull()).select(*columns).dropDuplicates([row_id])
    old = state.join(fresh.select(row_id), row_id, "left_anti")
    touched = fresh.select(block).distinct()
    again = old.join(touched, block, "left_semi").select(*columns).unionByName(fresh)
    return old.join(touched, block, "left_anti").select(*state.columns).unionByName(cluster(again).select(*state.columns))


def run_stream(source: DataFrame, store: BlockStore, cluster: Callable[[DataFrame], DataFrame], checkpoint: str, block: str = "block", row_id: str = "row_id"):
    """Starts a query that folds each micro-batch of ``source`` into ``store``; process what is there, then stop."""

    def fold(batch: DataFrame, version: int) -> None:
        store.put(partial_fit(batch, store.at(version - 1), cluster, block, row_id), version)

    return source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
