"""JSON, CSV and NPZ sources and sinks of the application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = "signature_id bigint, author_name string, author_affiliation string, publication_id bigint"
RECORD = "publication_id bigint, title string, journal string, abstract string, pub_year int, authors array<string>, keywords array<string>, topics array<string>, collaborations array<string>, reference_ids array<bigint>"


def _keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A JSON document that is a list of objects, or an object of them; the last of a repeated key wins in a list."""
    text = spark.read.text(path, wholetext=True).select("value")
    as_list = text.where(F.ltrim("value").startswith("[")).select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("pos", "x"))
    as_map = text.where(F.ltrim("value").startswith("{")).select(F.explode(F.from_json("value", f"map<string,struct<{schema}>>")).alias("k", "x")).select(F.lit(0).alias("pos"), "x")
    rows = as_list.unionByName(as_map)
    return rows.groupBy(F.col(f"x.{key}").alias("__key")).agg(F.max_by("x", "pos").alias("x")).select("x.*")


def _lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One object a line, in any number of files, each split over tasks; of a repeated key the greatest object stays
    (lines of several files have no order)."""
    rows = spark.read.schema(schema).json(path)
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max(whole).alias("x")).select("x.*")


def load_signatures(spark: SparkSession, signature_file: str, record_file: str, lines: bool = False) -> DataFrame:
    """Signatures with their record as the nested column ``publication``; a missing record raises.  A JSON document is
    one value and is parsed in one task; ``lines`` reads the form that is split."""
    read = _lines if lines else _keyed
    return attach_records(read(spark, signature_file, SIGNATURE, "signature_id"), read(spark, record_file, RECORD, "publication_id"))


def read_train_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id)`` of the distinct ids in a JSON array of ids, or of objects with ``signature_id``."""
    text = spark.read.text(path, wholetext=True).select("value")
    plain = text.select(F.explode(F.from_json("value", "array<bigint>")).alias("row_id"))
    keyed = text.select(F.explode(F.from_json("value", "array<struct<signature_id bigint>>")).alias("x")).select(F.col("x.signature_id").alias("row_id"))
    return plain.unionByName(keyed).where("row_id IS NOT NULL").distinct()


def attach_records(signatures: DataFrame, records: DataFrame) -> DataFrame:
    nested = records.select(F.col("publication_id"), F.struct(*records.columns).alias("publication"))
    j = signatures.join(nested, "publication_id", "left")
    missing = F.raise_error(F.concat(F.lit("no record for publication "), F.col("publication_id").cast("string")))
    return j.withColumn("publication", F.when(F.col("publication").isNull(), missing.cast(nested.schema["publication"].dataType)).otherwise(F.col("publication")))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``(label, signature_id)`` from ``{label: [ids]}``."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("label", "ids")).select("label", F.explode("ids").alias("signature_id"))


def cluster_lists(members: DataFrame, label: str = "label", row_id: str = "signature_id") -> DataFrame:
    """``(label, ids)`` with sorted ids, ready for a JSON-lines sink."""
    return members.groupBy(label).agg(F.sort_array(F.collect_list(row_id)).alias("ids"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(l_id, r_id, target)`` from an array of triples."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<array<bigint>>")).alias("t")).select(F.col("t")[0].alias("l_id"), F.col("t")[1].alias("r_id"), F.col("t")[2].cast("int").alias("target"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id, features, y)`` of the arrays ``X`` and ``y`` of NPZ files; arrays of objects are refused.  Files are
    read by the tasks, one after the other in a task, and never by the driver; ``row_id`` counts within a file."""

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    x, y = z["X"], z["y"]
                for at in range(0, len(y), 10_000):
                    part = x[at : at + 10_000]
                    yield pd.DataFrame({"row_id": np.arange(at, at + len(part)), "features": list(np.atleast_2d(part.reshape(len(part), -1)).astype("float64")), "y": y[at : at + 10_000].astype("int64")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row_id bigint, features array<double>, y bigint")
