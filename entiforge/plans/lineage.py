"""Cutting lineage with tables written to the shared folder, so that lost executors cost no more than their tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only where that is unset (tests on one machine) an own temporary
    folder is set; on a cluster the setting must name a folder all executors reach."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("entiforge.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="entiforge-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("entiforge.shared.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read again: it is computed exactly once, its
    plan is forgotten, and any executor can read any part again after a loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables made by :func:`cut` that no plan reads any more; anything else is left alone."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
