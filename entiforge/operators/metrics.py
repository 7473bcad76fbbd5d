"""Clustering metrics as aggregates over the contingency table of true and predicted labels.

Errors: an empty input or a null label raises when the scores are asked for; a repeated row counts again.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    """``(t, p, n_ij, n_i, n_j)``: cell counts with their row and column totals.

    One partial aggregation of the rows, then joins of the far smaller cell table with its own marginals (a window
    would bring each label's cells into one task).
    """
    cells = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n_ij"))
    rows = cells.groupBy("t").agg(F.sum("n_ij").alias("n_i"))
    cols = cells.groupBy("p").agg(F.sum("n_ij").alias("n_j"))
    return cells.join(rows, cells["t"].eqNullSafe(rows["t"])).drop(rows["t"]).join(cols, cells["p"].eqNullSafe(cols["p"])).drop(cols["p"])


def _checked(total: Column, nulls: Column, value: Column) -> Column:
    return F.when(total == 0, F.raise_error(F.lit("no labels to score")).cast("double")).when(nulls > 0, F.raise_error(F.lit("a label is null")).cast("double")).otherwise(value)


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1).cast("double") / 2


def b3_precision_recall_fscore(df: DataFrame, true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    """One row ``(precision, recall, f_score)``."""
    c = contingency(df, true, pred)
    sums = c.agg(
        F.coalesce(F.sum("n_ij"), F.lit(0)).alias("total"),
        F.sum((F.col("t").isNull() | F.col("p").isNull()).cast("int")).alias("nulls"),
        F.sum(F.col("n_ij").cast("double") * F.col("n_ij") / F.col("n_j")).alias("sp"),
        F.sum(F.col("n_ij").cast("double") * F.col("n_ij") / F.col("n_i")).alias("sr"),
    )
    pr = sums.select(_checked(F.col("total"), F.col("nulls"), F.col("sp") / F.col("total")).alias("precision"), (F.col("sr") / F.col("total")).alias("recall"))
    return pr.withColumn("f_score", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def paired_precision_recall_fscore(df: DataFrame, true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    """One row ``(precision, recall, f_score)`` over pairs of rows; no predicted (true) pair gives precision
    (recall) 1, both 0 give an f-score of 0."""
    cells = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(F.sum(_pairs(F.col("n"))).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.sum((F.col("t").isNull() | F.col("p").isNull()).cast("int")).alias("nulls"))
    truth = cells.groupBy("t").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("tt"))
    found = cells.groupBy("p").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("pp"))
    one = both.withColumn("tt", truth.scalar()).withColumn("pp", found.scalar())
    pr = one.select(
        _checked(F.col("total"), F.col("nulls"), F.when(F.col("pp") == 0, 1.0).otherwise(F.col("tp") / F.nullif("pp", F.lit(0.0)))).alias("precision"),
        F.when(F.col("tt") == 0, 1.0).otherwise(F.col("tp") / F.nullif("tt", F.lit(0.0))).alias("recall"),
    )
    total = F.col("precision") + F.col("recall")
    return pr.withColumn("f_score", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))))


def unit_merge_distance(df: DataFrame, true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    """One row ``(merge_distance)``: splits and merges from one clustering to the other, each costing one."""
    cells = df.select(F.col(true).alias("t"), F.col(pred).alias("p")).distinct()
    return cells.agg((2 * F.count(F.lit(1)) - F.count_distinct("t") - F.count_distinct("p")).cast("bigint").alias("merge_distance"))


def merge_distance(df: DataFrame, split_cost: Callable[[int, int], float], merge_cost: Callable[[int, int], float], true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    """One row ``(merge_distance)`` under any costs of two part sizes.

    Each predicted cluster is taken apart, and each true cluster put together, part by part in the order of the label
    of the parts; that is one small computation per cluster over its cells, not over its rows.
    """
    cells = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))

    def taken(key: str, order: str, cost: Callable[[int, int], float], splitting: bool) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            sizes = pdf.sort_values(order)["n"].tolist()
            total, rest, held = 0.0, sum(sizes), 0
            for k, n in enumerate(sizes):
                if splitting and k < len(sizes) - 1:
                    total += cost(n, rest - n)
                    rest -= n
                if not splitting:
                    if k:
                        total += cost(n, held)
                    held += n
            return pd.DataFrame({"cost": [total]})

        return cells.groupBy(key).applyInPandas(run, "cost double")

    return taken("p", "t", split_cost, True).unionByName(taken("t", "p", merge_cost, False)).agg(F.sum("cost").alias("merge_distance"))


def silhouette(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``(silhouette)`` from ``distances(i, j, dist)`` with each unordered pair once and ``labels(id, label)``;
    -1 unless the number of clusters lies between 1 and the number of rows; singletons, and rows without a distance to
    another cluster, count 0."""
    both = distances.select("i", "j", "dist").unionByName(distances.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    per = both.join(labels.select(F.col("id").alias("j"), F.col("label").alias("other")), "j").groupBy("i", "other").agg(F.avg("dist").alias("mean"))
    own = per.join(labels.select(F.col("id").alias("i"), "label"), "i")
    ab = own.groupBy("i").agg(F.max(F.when(F.col("other") == F.col("label"), F.col("mean"))).alias("a"), F.min(F.when(F.col("other") != F.col("label"), F.col("mean"))).alias("b"))
    each = labels.join(ab, labels["id"] == ab["i"], "left").select("label", F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))).alias("s"))
    return each.agg(F.avg("s").alias("s"), F.count_distinct("label").alias("k"), F.count(F.lit(1)).alias("n")).select(F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), F.col("s")).otherwise(-1.0).alias("silhouette"))


def silhouette_cosine(vectors: DataFrame) -> DataFrame:
    """One row ``(silhouette)`` under cosine distance from ``vectors(id, label, v)``, without making pairs.

    The mean distance of a row to a cluster is linear in the cluster's sum of unit vectors, so one sum per cluster and
    dimension stands for all of its rows.  Same rules as :func:`silhouette`; a vector without length is at distance 1
    from everything.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    long = vectors.select("id", "label", F.posexplode("v").alias("pos", "x"), norm.alias("norm")).select("id", "label", "pos", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0).alias("x"))
    sums = long.groupBy(F.col("label").alias("other"), "pos").agg(F.sum("x").alias("sx"))
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    met = long.join(sums, "pos").groupBy("id", "label", "other").agg(F.sum(F.col("x") * F.col("sx")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("own"))
    sized = met.join(sizes.withColumnRenamed("label", "other"), "other")
    same = F.col("other") == F.col("label")
    near = F.when(same & (F.col("size") > 1), (F.col("size") - 1 - (F.col("dot") - F.col("own"))) / (F.col("size") - 1))
    far = F.when(~same, 1 - F.col("dot") / F.col("size"))
    each = sized.groupBy("id", "label").agg(F.max(near).alias("a"), F.min(far).alias("b"))
    top = F.greatest("a", "b")
    s = F.when(F.col("a").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(top, F.lit(0.0)))
    return each.agg(F.avg(s).alias("s"), F.count_distinct("label").alias("k"), F.count(F.lit(1)).alias("n")).select(F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), F.col("s")).otherwise(-1.0).alias("silhouette"))
