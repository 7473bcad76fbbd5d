"""Clustering within blocks, distributed over the blocks.

Distances are made before, as rows ``(block, i, j, dist)`` with i < j.  With a fixed threshold ``t`` single, complete,
average, weighted and Ward linkage never join rows of two components of the graph of pairs within ``t``, so
components - not blocks - are what goes to a task; single linkage is the components themselves and never leaves the
JVM.  For the first four the height of a merge is at least the smallest distance between the two clusters.  For Ward
let ``A`` and ``B`` lie in two components and be made of merges up to ``t``: the squared height is
``2ab / (a + b) * (mean AB - mean AA / 2 - mean BB / 2)`` over squared distances, where ``mean AB > t^2`` and
``mean AA <= (a - 1) / a * t^2`` (it is the sum of the squared heights inside, over ``a``), which leaves more than
``t^2``.  Centroid and median linkage have no such bound, as clusters can come nearer than any pair of their rows: they
are refused here and need the whole block, as does a threshold chosen from a block's own tree.

Defined results: null blocks are not clustered; single rows have label 0; pairs that are not given count as infinitely
far; repeated pairs count once (the smallest distance).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entiforge.operators import linkage as lk
from entiforge.operators.components import connected_components
from entiforge.operators.hotkeys import hot_keys, salted
from entiforge.plans.lineage import cut

#: Rows and pairs of blocks fitted in one call of Python, where no single block has more.
PER_CALL = 200_000
TREE = "array<struct<left:bigint,right:bigint,height:double,size:bigint>>"


def _square(ids: np.ndarray, i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Distances between ``ids`` (sorted)."""
    d = np.full((len(ids), len(ids)), np.inf)
    np.fill_diagonal(d, 0)
    if len(i):
        a, b = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (i, j))
        if (ids[a] != i).any() or (ids[b] != j).any():
            raise KeyError("a distance to a row that is not in the block")
        d[a, b] = d[b, a] = dist
    finite = np.isfinite(d)
    return np.where(finite, d, 2 * d[finite].max(initial=0.0) + 1e6)


def _matrix(ids: np.ndarray, pairs: pd.DataFrame) -> np.ndarray:
    return _square(ids, pairs["i"].to_numpy(), pairs["j"].to_numpy(), pairs["dist"].to_numpy())


def cluster_threshold(rows: DataFrame, distances: DataFrame, threshold: float, method: str = "single", block: str = "block", row_id: str = "row_id") -> DataFrame:
    """``(row_id, block, cluster)`` at a fixed threshold; ``cluster`` is the smallest row id of its cluster."""
    if method not in lk.METHODS or method in ("centroid", "median"):
        raise ValueError(f"{method!r} linkage cannot be cut by components: use fit_blocks")
    d = distances.where(F.col(block).isNotNull()).groupBy(block, "i", "j").agg(F.min("dist").alias("dist"))
    near = d.where(F.col("dist") <= threshold)
    comps = connected_components(near.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    known = rows.where(F.col(block).isNotNull()).select(row_id, block)
    marked = known.join(comps, known[row_id] == comps["vertex"], "left").select(row_id, block, F.coalesce("component", row_id).alias("component"))
    if method == "single":
        return marked.select(row_id, block, F.col("component").alias("cluster"))
    marked = cut(marked, "components")
    c = marked.select(F.col(row_id).alias("i"), "component").join(d, "i").join(marked.select(F.col(row_id).alias("j"), F.col("component").alias("other")), "j").where("component = other").select(F.col("component").alias("pair_component"), "i", "j", "dist")
    busy = c.select(F.col("pair_component").alias("component")).distinct()
    members = marked.join(busy, "component")

    def run(key: tuple, mine: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(mine[row_id].to_numpy())
        labels = lk.cut(lk.linkage(_matrix(ids, pairs), method), threshold)
        lead = pd.Series(ids).groupby(labels).min()
        return pd.DataFrame({row_id: ids, block: mine[block].iloc[0], "cluster": lead[labels].to_numpy()})

    schema = T.StructType([known.schema[row_id], known.schema[block], T.StructField("cluster", known.schema[row_id].dataType)])
    grouped = members.groupBy("component").cogroup(c.groupBy("pair_component")).applyInPandas(run, schema)
    alone = marked.join(busy, "component", "left_anti").select(row_id, block, F.col("component").alias("cluster"))
    return grouped.unionByName(alone)


def fit_blocks(
    rows: DataFrame,
    distances: DataFrame,
    method: str = "average",
    threshold: float | None = None,
    supervised: Callable[[np.ndarray, np.ndarray], float] | None = None,
    unsupervised: Callable[[np.ndarray, np.ndarray], float] | None = None,
    max_block_rows: int = 5000,
    block: str = "block",
    row_id: str = "row_id",
    label: str = "label",
) -> DataFrame:
    """Model table ``(block, ids, tree, threshold)``: each block's tree and the threshold its cut defaults to.

    ``supervised(true, pred)`` is used in blocks with a label (not -1) on the labelled rows, else
    ``unsupervised(distances, pred)``, else the given threshold stands, or one cluster.  A block above
    ``max_block_rows`` raises: split its key (:func:`entiforge.operators.blocking.split_blocks`) or use
    :func:`cluster_threshold`, which has no such limit.  Blocks of one row get an empty tree without Python.
    """
    has_label = label in rows.columns
    known = rows.where(F.col(block).isNotNull()).select(block, row_id, *([label] if has_label else []))
    sizes = known.groupBy(block).agg(F.count(F.lit(1)).alias("__n"))
    limit = F.when(F.col("__n") > max_block_rows, F.raise_error(F.concat(F.lit("block too large to hold in one task: "), F.col(block).cast("string"))).cast("bigint")).otherwise(F.col("__n"))
    sized = known.join(sizes.withColumn("__n", limit), block)
    singles = sized.where("__n = 1").select(block, F.array(row_id).alias("ids"), F.array().cast(TREE).alias("tree"), F.lit(threshold).cast("double").alias("threshold"))

    def fit(d: np.ndarray, labels: np.ndarray | None) -> tuple[list[dict], float]:
        z = lk.linkage(d, method)
        labelled = labels is not None and bool((labels != -1).any())
        score = None
        if supervised is lk.b3_f_score and labelled:
            t = lk.best_b3_threshold(z, labels)
        else:
            if supervised is not None and labelled:
                at = labels != -1
                score = lambda pred: supervised(labels[at], pred[at])
            elif unsupervised is not None:
                score = lambda pred: unsupervised(d, pred)
            t = lk.best_threshold(z, score, threshold)
        return [{"left": int(a), "right": int(b), "height": h, "size": int(n)} for a, b, h, n in z.tolist()], t

    def run(key: tuple, mine: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values([block, row_id], kind="stable")
        pairs = pairs.groupby(["__block", "i", "j"], as_index=False)["dist"].min()
        ids, i, j, dist = mine[row_id].to_numpy(), *(pairs[c].to_numpy() for c in ("i", "j", "dist"))
        labels = mine[label].to_numpy() if has_label else None
        blocks, starts = np.unique(mine[block].to_numpy(), return_index=True)
        ends = np.r_[starts[1:], len(mine)]
        far_blocks = pairs["__block"].to_numpy()
        low, high = np.searchsorted(far_blocks, blocks), np.searchsorted(far_blocks, blocks, "right")
        out = []
        for b, s, e, lo, hi in zip(blocks.tolist(), starts.tolist(), ends.tolist(), low.tolist(), high.tolist()):
            tree, t = fit(_square(ids[s:e], i[lo:hi], j[lo:hi], dist[lo:hi]), None if labels is None else labels[s:e])
            out.append((b, ids[s:e].tolist(), tree, t))
        return pd.DataFrame(out, columns=[block, "ids", "tree", "threshold"])

    btype, itype = known.schema[block].dataType.simpleString(), known.schema[row_id].dataType.simpleString()
    # many small blocks share one call of Python, which costs more than most of them; a call holds about PER_CALL rows
    # and pairs, or one larger block
    total = sizes.where("__n > 1").agg(F.coalesce(F.sum(F.col("__n") * (F.col("__n") + 1) / 2), F.lit(0))).first()[0]
    calls = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // PER_CALL + 1)
    call = lambda c: F.pmod(F.xxhash64(c), F.lit(calls)).alias("__call")
    several = sized.where("__n > 1").drop("__n").select("*", call(block))
    # renamed, as distances are often derived from the rows and would share their column ids
    far = distances.where(F.col(block).isNotNull()).select(F.col(block).alias("__block"), F.col("i").alias("i"), F.col("j").alias("j"), F.col("dist").alias("dist"), call(block))
    done = several.groupBy("__call").cogroup(far.groupBy("__call")).applyInPandas(run, f"`{block}` {btype}, ids array<{itype}>, tree {TREE}, threshold double")
    return done.unionByName(singles)


def cut_blocks(model: DataFrame, threshold: float | None = None, n_clusters: int | None = None, criterion: str = "distance", depth: int = 2, block: str = "block") -> DataFrame:
    """``(row_id, block, label)``: flat labels 0..k-1 of each block, cut anew from the stored trees; without arguments
    at each block's own threshold."""
    fields = {f.name: f.dataType for f in model.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, blocks, labels = [], [], []
            for b, ids, tree, own in zip(pdf[block], pdf["ids"], pdf["tree"], pdf["threshold"]):
                if len(tree):
                    z = np.array([(n["left"], n["right"], n["height"], n["size"]) for n in tree])
                    t = threshold if threshold is not None else (None if pd.isna(own) else float(own))
                    labels += lk.cut(z, t, n_clusters, criterion, depth).tolist()
                else:
                    labels.append(0)
                rows += list(ids)
                blocks += [b] * len(ids)
            if rows:
                yield pd.DataFrame({"row_id": rows, block: blocks, "label": labels})

    itype = fields["ids"].elementType.simpleString()
    return model.mapInPandas(run, f"row_id {itype}, `{block}` {fields[block].simpleString()}, label bigint")


def prefix_sums(df: DataFrame, order: str, value: str, out: str = "offset", partitions: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it by ``order`` (unique): tasks sum up their own range,
    and one number a task is passed on."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, order).sortWithinPartitions(order)
    schema = T.StructType([*df.schema.fields, T.StructField("__pid", T.IntegerType()), T.StructField("__run", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, total = TaskContext.get().partitionId(), 0
        for pdf in batches:
            sums = pdf[value].cumsum() + total
            yield pdf.assign(__pid=pid, __run=(sums - pdf[value]).astype("int64"))
            if len(pdf):
                total = int(sums.iloc[-1])

    part = cut(ranged.mapInPandas(run, schema), "prefix")
    totals = part.groupBy("__pid").agg(F.sum(value).alias("__t"))
    per = {r["__pid"]: int(r["__t"]) for r in totals.collect()}  # one row a task
    base, acc = [], 0
    for pid in sorted(per):
        base.append((pid, acc))
        acc += per[pid]
    offsets = df.sparkSession.createDataFrame(base, "__pid int, __base bigint")
    return part.join(F.broadcast(offsets), "__pid").select(*df.columns, (F.col("__run") + F.col("__base")).alias(out))


def global_labels(labelled: DataFrame, block: str = "block", label: str = "label") -> DataFrame:
    """``labelled`` with ``global_label``: labels of a block start after those of all smaller block keys (sorted, so
    the numbers do not depend on the order of execution)."""
    widths = labelled.groupBy(block).agg((F.max(label) + 1).alias("__k"))
    offsets = prefix_sums(widths, block, "__k", "__offset").drop("__k")
    return salted(labelled.where(F.col(block).isNotNull()), offsets, block, hot_keys(labelled, block)).withColumn("global_label", F.col(label) + F.col("__offset")).drop("__offset")


def predict_blocks(rows: DataFrame, model_labels: DataFrame, block: str = "block", row_id: str = "row_id") -> DataFrame:
    """``(row_id, block, label)``: the labels a model table holds, offset over the blocks present; rows of unknown
    blocks, or not in the table, get -1."""
    present = model_labels.join(rows.select(block).distinct(), block)
    held = global_labels(present, block).select(F.col("row_id").alias(row_id), block, F.col("global_label").alias("label"))
    return rows.select(row_id, block).join(held, [row_id, block], "left").select(row_id, block, F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"))
