"""Estimator-style front ends of the clustering operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiforge.operators import cluster as cl
from entiforge.operators import linkage as lk
from entiforge.operators.blocking import with_block
from entiforge.operators.pairs import block_pairs
from entiforge.plans.lineage import cut

METRICS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "euclidean": lambda x: np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)),
    "cityblock": lambda x: np.abs(x[:, None] - x[None]).sum(-1),
    "chebyshev": lambda x: np.abs(x[:, None] - x[None]).max(-1),
    "cosine": lambda x: 1 - (x @ x.T) / np.maximum(np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)), 1e-300),
}


def square(distances: np.ndarray) -> np.ndarray:
    """A square matrix from a square or a condensed (upper triangle, by rows) one."""
    d = np.asarray(distances, dtype="float64")
    if d.ndim == 2:
        return d
    n = int(round((1 + np.sqrt(1 + 8 * len(d))) / 2))
    if n * (n - 1) // 2 != len(d):
        raise ValueError("not a condensed distance matrix")
    out = np.zeros((n, n))
    out[np.triu_indices(n, 1)] = d
    return out + out.T


class HierarchicalClustering:
    """One block's clusterer for data that fits one task.

    ``affinity`` is ``"precomputed"``, a metric's name or a function of the data.  Scores decide the threshold when
    they are given: ``supervised_scoring`` over the labelled rows when there are any, else ``unsupervised_scoring``;
    ``scoring_data`` says what they see first - ``"raw"`` rows, the ``"affinity"`` matrix, or nothing.  A found
    threshold goes before a given one unless ``best_threshold_precedence`` is off; ``n_clusters`` goes before both.
    ``labels_`` is cut from the stored tree whenever it is asked for.
    """

    def __init__(self, method="single", affinity="euclidean", threshold=None, n_clusters=None, criterion="distance", depth=2, monocrit=None, supervised_scoring=None, unsupervised_scoring=None, scoring_data=None, best_threshold_precedence=True):
        if scoring_data not in (None, "raw", "affinity"):
            raise ValueError(f"unknown scoring_data {scoring_data!r}")
        self.method, self.affinity, self.threshold, self.n_clusters = method, affinity, threshold, n_clusters
        self.criterion, self.depth, self.monocrit = criterion, depth, monocrit
        self.supervised_scoring, self.unsupervised_scoring = supervised_scoring, unsupervised_scoring
        self.scoring_data, self.best_threshold_precedence = scoring_data, best_threshold_precedence

    def fit(self, x: np.ndarray, y: np.ndarray | None = None) -> HierarchicalClustering:
        x = np.asarray(x)
        if self.affinity == "precomputed":
            d = square(x)
        elif callable(self.affinity):
            d = square(self.affinity(x))
        elif self.affinity in METRICS:
            d = METRICS[self.affinity](x.astype("float64"))
        else:
            raise ValueError(f"unknown affinity {self.affinity!r}")
        self.linkage_ = lk.linkage(d, self.method)
        at = np.flatnonzero(np.asarray(y) != -1) if y is not None else np.zeros(0, dtype=int)
        data = {"raw": x, "affinity": d, None: None}[self.scoring_data]

        def seen(rows: np.ndarray | slice) -> tuple:
            if data is None:
                return ()
            part = data[rows]
            return (part[:, rows],) if self.scoring_data == "affinity" else (part,)

        score = None
        if self.supervised_scoring is not None and len(at):
            true = np.asarray(y)[at]
            score = lambda pred: self.supervised_scoring(*seen(at), true, pred[at])
        elif self.unsupervised_scoring is not None:
            score = lambda pred: self.unsupervised_scoring(*seen(slice(None)), pred)
        self.best_threshold_ = lk.best_threshold(self.linkage_, score, self.threshold)
        return self

    @property
    def labels_(self) -> np.ndarray:
        t = self.best_threshold_ if self.best_threshold_precedence or self.threshold is None else self.threshold
        return lk.cut(self.linkage_, t, self.n_clusters, self.criterion, self.depth, self.monocrit)

    def fit_predict(self, x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        return self.fit(x, y).labels_


class BlockClustering:
    """Clustering per block of a DataFrame with ``row_id``.

    ``affinity(pairs) -> (block, i, j, dist)`` turns the block pairs (``l_row_id, r_row_id`` and both rows'
    ``columns``) into distances, distributed, before any block is grouped; ``"precomputed"`` takes such a table in
    ``fit``.  ``blocking`` is any scheme of :func:`entiforge.operators.blocking.with_block` or ``"precomputed"`` for a
    ``block`` column.  Fitting again replaces the model; ``partial_fit`` re-clusters the touched blocks with all of
    their rows.
    """

    def __init__(self, affinity="precomputed", blocking="precomputed", columns=(), method="average", threshold=None, supervised=None, unsupervised=None, max_block_rows=5000, block_threshold=1000):
        if blocking not in ("precomputed", "single", "phonetic", "last_name_first_initial") and not callable(blocking):
            raise ValueError(f"unknown blocking {blocking!r}")
        self.affinity, self.blocking, self.columns, self.method, self.threshold = affinity, blocking, list(columns), method, threshold
        self.supervised, self.unsupervised, self.max_block_rows, self.block_threshold = supervised, unsupervised, max_block_rows, block_threshold
        self.rows_: DataFrame | None = None
        self.model_: DataFrame | None = None

    def _blocked(self, rows: DataFrame) -> DataFrame:
        if self.blocking == "precomputed":
            if "block" not in rows.columns:
                raise ValueError("precomputed blocks need a column 'block'")
            return rows
        return with_block(rows, self.blocking, threshold=self.block_threshold)

    def _model(self, rows: DataFrame, distances: DataFrame | None) -> DataFrame:
        if self.affinity == "precomputed":
            if distances is None:
                raise ValueError("a precomputed affinity needs distances")
        else:
            distances = self.affinity(block_pairs(rows, "block", "row_id", self.columns))
        fitted = cl.fit_blocks(rows, distances, self.method, self.threshold, self.supervised, self.unsupervised, self.max_block_rows)
        return cut(fitted, "model")

    def fit(self, rows: DataFrame, distances: DataFrame | None = None) -> BlockClustering:
        self.rows_ = cut(self._blocked(rows), "rows")
        self.model_ = self._model(self.rows_, distances)
        return self

    def partial_fit(self, rows: DataFrame, distances: DataFrame | None = None) -> BlockClustering:
        if self.rows_ is None or self.model_ is None:
            return self.fit(rows, distances)
        fresh = self._blocked(rows).select(*self.rows_.columns)
        everything = cut(self.rows_.join(fresh.select("row_id"), "row_id", "left_anti").select(*fresh.columns).unionByName(fresh), "rows")
        touched = fresh.select("block").distinct()
        again = self._model(everything.join(touched, "block", "left_semi"), distances)
        self.model_ = cut(self.model_.join(touched, "block", "left_anti").select(*again.columns).unionByName(again), "model")
        self.rows_ = everything
        return self

    def labels(self, threshold: float | None = None, n_clusters: int | None = None) -> DataFrame:
        """``(row_id, block, label, global_label)``, cut anew from the stored trees."""
        return cl.global_labels(cl.cut_blocks(self.model_, threshold, n_clusters))

    def predict(self, rows: DataFrame) -> DataFrame:
        return cl.predict_blocks(self._blocked(rows), cl.cut_blocks(self.model_).select("row_id", "block", "label"))

    def blocks(self) -> DataFrame:
        return self.rows_.groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"))
