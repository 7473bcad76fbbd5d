import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from entiforge.operators.estimators import BlockClustering, HierarchicalClustering, square
from entiforge.operators.linkage import b3_f_score, silhouette_score
from tests.test_cluster import blobs


@pytest.mark.parametrize("affinity", ["euclidean", "precomputed", "callable"])
@pytest.mark.parametrize("data", [None, "raw", "affinity"])
def test_threshold_search(affinity, data):
    x, y = blobs(40)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    given = d if affinity == "precomputed" else x
    how = (lambda v: np.linalg.norm(v[:, None] - v[None], axis=2)[np.triu_indices(len(v), 1)]) if affinity == "callable" else affinity
    masked = np.where(np.arange(40) % 2, y, -1)
    sizes = []

    def supervised(*a):
        if data == "affinity":
            assert a[0].shape == (20, 20)
        sizes.append(len(a))
        return b3_f_score(a[-2], a[-1])

    c = HierarchicalClustering(affinity=how, supervised_scoring=supervised, scoring_data=data).fit(given, masked)
    assert sorted(np.bincount(c.labels_)) == [10] * 4 and set(sizes) == {2 if data is None else 3}
    if data == "affinity":
        c = HierarchicalClustering(affinity=how, unsupervised_scoring=silhouette_score, scoring_data=data).fit(given)
        assert sorted(np.bincount(c.labels_)) == [10] * 4


def test_precedence_and_errors():
    x, y = blobs(40)
    c = HierarchicalClustering(threshold=1.0).fit(x)
    assert len(set(c.labels_)) == 4
    c.n_clusters = 2
    assert len(set(c.labels_)) <= 2
    assert len(set(HierarchicalClustering().fit_predict(x))) == 1
    found = HierarchicalClustering(threshold=100.0, supervised_scoring=b3_f_score, best_threshold_precedence=False).fit(x, y)
    assert len(set(found.labels_)) == 1
    for bad in ({"affinity": "other"}, {"method": "other"}):
        with pytest.raises(ValueError):
            HierarchicalClustering(**bad).fit(x)
    with pytest.raises(ValueError):
        HierarchicalClustering(scoring_data="other")
    with pytest.raises(ValueError):
        _ = HierarchicalClustering(n_clusters=41).fit(x).labels_
    with pytest.raises(ValueError):
        square(np.zeros(4))


def test_block_clustering(spark):
    x, y = blobs(40)
    rows = spark.createDataFrame([(i, "a" if y[i] <= 1 else "b", [float(v) for v in x[i]]) for i in range(40)], "row_id bigint, block string, v array<double>")

    def affinity(pairs):
        gap = F.aggregate(F.zip_with("l_v", "r_v", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z)
        return pairs.select("block", F.col("l_row_id").alias("i"), F.col("r_row_id").alias("j"), F.sqrt(gap).alias("dist"))

    c = BlockClustering(affinity, columns=["v"], threshold=1.0).fit(rows.where("block = 'a'"))
    assert c.labels().select("global_label").distinct().count() == 2
    assert {r.label for r in c.predict(rows.where("block = 'b'")).collect()} == {-1}
    c.partial_fit(rows.where("block = 'b' AND row_id < 25")).partial_fit(rows.where("block = 'b' AND row_id >= 25"))
    got = {r.row_id: r.global_label for r in c.labels().collect()}
    assert all((got[i] == got[j]) == (y[i] == y[j]) for i, j in itertools.combinations(range(40), 2))
    assert {r.block: r.n_rows for r in c.blocks().collect()} == {"a": 20, "b": 20}
    assert c.labels(n_clusters=1).select("block", "label").distinct().count() == 2
    with pytest.raises(ValueError):
        BlockClustering(blocking="other")
    with pytest.raises(ValueError):
        BlockClustering().fit(rows)
    with pytest.raises(ValueError):
        BlockClustering(affinity).fit(rows.drop("block"))
