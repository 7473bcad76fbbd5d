import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from entiforge.operators import cluster as cl
from entiforge.operators import linkage as lk


def blobs(n=100, seed=42):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10]])
    y = np.repeat(np.arange(4), n // 4)
    return centres[y] + rng.normal(0, 0.01, (n, 2)), y


def naive(d, method):
    """Every merge by looking at all pairs of clusters."""
    groups = [[i] for i in range(len(d))]
    heights = []
    agg = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    while len(groups) > 1:
        h, a, b = min((float(agg(d[np.ix_(p, q)])), i, j) for (i, p), (j, q) in itertools.combinations(enumerate(groups), 2))
        heights.append(h)
        groups[a] += groups.pop(b)
    return heights


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_linkage_against_naive(method):
    rng = np.random.default_rng(3)
    for _ in range(10):
        x = rng.random((12, 2))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        z = lk.linkage(d, method)
        assert np.allclose(z[:, 2], naive(d, method))
        assert z[-1, 3] == 12


@pytest.mark.parametrize("method", lk.METHODS)
def test_blobs(method):
    x, y = blobs()
    z = lk.linkage(np.linalg.norm(x[:, None] - x[None], axis=2), method)
    for labels in (lk.cut(z, 1.0), lk.cut(z, n_clusters=4)):
        assert sorted(np.bincount(labels)) == [25] * 4 and all(len(set(labels[y == k])) == 1 for k in range(4))
    assert len(set(lk.cut(z, n_clusters=10))) <= 10
    assert set(lk.cut(z)) == {0}
    for bad in (0, 101):
        with pytest.raises(ValueError):
            lk.cut(z, n_clusters=bad)
    with pytest.raises(ValueError):
        lk.cut(z, 1.0, criterion="other")
    with pytest.raises(ValueError):
        lk.linkage(np.zeros((2, 2)), "other")


def test_cuts_are_nested():
    x, _ = blobs(40)
    z = lk.linkage(np.linalg.norm(x[:, None] - x[None], axis=2), "average")
    counts = [len(set(lk.cut(z, t))) for t in sorted(lk.threshold_candidates(z))]
    assert counts == sorted(counts, reverse=True)
    assert len(set(lk.cut(z, 1e9, criterion="inconsistent"))) == 1
    assert len(set(lk.cut(z, -1.0, criterion="monocrit", monocrit=np.zeros(39)))) == 40


@pytest.fixture(scope="module")
def tables(spark):
    x, y = blobs()
    rows = spark.createDataFrame([(i, "a" if y[i] <= 1 else "b", int(y[i]) if i % 2 else -1) for i in range(100)] + [(100, "c", -1), (101, None, -1)], "row_id bigint, block string, label bigint")
    d = [(("a" if y[i] <= 1 else "b"), i, j, float(np.linalg.norm(x[i] - x[j]))) for i, j in itertools.combinations(range(100), 2) if (y[i] <= 1) == (y[j] <= 1)]
    return rows, spark.createDataFrame(d, "block string, i bigint, j bigint, dist double"), y


@pytest.mark.parametrize("how", [{"threshold": 1.0}, {"supervised": lk.b3_f_score}, {"unsupervised": lk.silhouette_score}])
def test_fit_blocks(tables, how):
    rows, dist, y = tables
    if "supervised" in how:
        how = {"supervised": lambda t, p: lk.b3_f_score(t, p)}
    model = cl.fit_blocks(rows, dist, "average", **how)
    got = {r.row_id: r.global_label for r in cl.global_labels(cl.cut_blocks(model)).collect()}
    assert set(got) == set(range(101))
    assert sorted(np.bincount([got[i] for i in range(100)])) == [25] * 4
    assert all(len({got[i] for i in np.flatnonzero(y == k)}) == 1 for k in range(4))
    assert {got[i] for i in range(50)} == {0, 1} and got[100] == 4
    recut = cl.cut_blocks(model.where("block <> 'c'"), n_clusters=1)
    assert recut.select("label").distinct().count() == 1


def test_limit_and_components(tables):
    rows, dist, _ = tables
    with pytest.raises(Exception, match="too large"):
        cl.fit_blocks(rows, dist, "average", max_block_rows=10).collect()
    for method in ("single", "complete", "average", "ward"):
        got = cl.cluster_threshold(rows, dist, 1.0, method).groupBy("cluster").count().collect()
        assert sorted(r["count"] for r in got) == [1, 25, 25, 25, 25]
    assert cl.cluster_threshold(rows.where("row_id < 0"), dist.where("i < 0"), 1.0).count() == 0


def test_threshold_components_equal_whole_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.random((30, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    rows = spark.createDataFrame([(i, "b") for i in range(30)], "row_id bigint, block string")
    dist = spark.createDataFrame([("b", i, j, float(d[i, j])) for i, j in itertools.combinations(range(30), 2)], "block string, i bigint, j bigint, dist double")
    for method in ("single", "complete", "average"):
        want = lk.cut(lk.linkage(d, method), 0.2)
        got = {r.row_id: r.cluster for r in cl.cluster_threshold(rows, dist, 0.2, method).collect()}
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in itertools.combinations(range(30), 2))


def test_predict(spark):
    model = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 0)], "row_id bigint, block string, label bigint")
    rows = spark.createDataFrame([(1, "a"), (3, "b"), (9, "z"), (8, "a")], "row_id bigint, block string")
    assert {r.row_id: r.label for r in cl.predict_blocks(rows, model).collect()} == {1: 0, 3: 2, 9: -1, 8: -1}
    # only blocks that are present shift the labels
    assert {r.row_id: r.label for r in cl.predict_blocks(rows.where("block <> 'a'"), model).collect()} == {3: 0, 9: -1}


def test_prefix_sums(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 5).alias("v"))
    got = {r.k: r.offset for r in cl.prefix_sums(df, "k", "v", partitions=6).collect()}
    assert got == {k: sum(i % 5 for i in range(k)) for k in range(50)}


@pytest.mark.parametrize("method", ["single", "average", "ward"])
def test_fixed_threshold_has_no_block_limit(spark, method):
    from entiforge.plans import pipeline as pl

    x = np.random.default_rng(8).normal(size=(60, 2))
    block = np.arange(60) % 2
    rows = spark.createDataFrame([(i, f"b{block[i]}") for i in range(60)] + [(60, "c"), (61, None)], "row_id bigint, block string")
    at = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, a double, b double")

    def near(pairs):
        j = pairs.join(at.selectExpr("id l_row_id", "a la", "b lb"), "l_row_id").join(at.selectExpr("id r_row_id", "a ra", "b rb"), "r_row_id")
        return j.selectExpr("block", "l_row_id i", "r_row_id j", "sqrt(pow(la - ra, 2) + pow(lb - rb, 2)) dist")

    got = {r.row_id: r for r in pl.cluster_signatures(rows, near, method, 0.6, max_block_rows=10).collect()}
    assert sorted(got) == list(range(61)) and got[60].label == 0
    end = 0
    for b in (0, 1):
        ids = np.flatnonzero(block == b)
        want = lk.cut(lk.linkage(np.linalg.norm(x[ids][:, None] - x[ids][None], axis=2), method), 0.6)
        label = np.array([got[i].label for i in ids])
        assert len(set(zip(want, label))) == len(set(want)) == len(set(label)) == label.max() + 1
        assert all(got[i].global_label == got[i].label + end for i in ids)
        end += label.max() + 1


def test_b3_threshold_in_one_walk():
    rng = np.random.default_rng(4)
    for method in lk.METHODS:
        for _ in range(15):
            n = int(rng.integers(2, 25))
            x = rng.normal(size=(n, 2))
            z = lk.linkage(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), method)
            labels = rng.integers(-1, 4, n)
            if not (labels != -1).any():
                continue
            at = labels != -1
            assert lk.best_b3_threshold(z, labels) == pytest.approx(lk.best_threshold(z, lambda pred: round(lk.b3_f_score(labels[at], pred[at]), 10), None))


def test_methods_that_components_cannot_cut(spark):
    rows = spark.createDataFrame([("b", 1), ("b", 2), ("b", 3)], "block string, row_id bigint")
    d = spark.createDataFrame([("b", 1, 2, 0.9), ("b", 1, 3, 1.0), ("b", 2, 3, 1.0)], "block string, i bigint, j bigint, dist double")
    for method in ("centroid", "median"):
        with pytest.raises(ValueError):
            cl.cluster_threshold(rows, d, 0.95, method)
    # the whole tree joins all three below the smallest distance to the third
    labels = cl.cut_blocks(cl.fit_blocks(rows, d, "centroid"), 0.95).collect()
    assert len({r.label for r in labels}) == 1


def test_ward_by_components_equals_the_tree(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 3)) + 3 * rng.integers(0, 3, (30, 1))
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    rows = spark.createDataFrame([("b", i) for i in range(30)], "block string, row_id bigint")
    d = spark.createDataFrame([("b", i, j, float(dist[i, j])) for i in range(30) for j in range(i + 1, 30)], "block string, i bigint, j bigint, dist double")
    for t in (0.8, 1.5, 3.0):
        got = {r.row_id: r.cluster for r in cl.cluster_threshold(rows, d, t, "ward").collect()}
        want = lk.cut(lk.linkage(dist, "ward"), t)
        assert len(set(got.values())) == len(set(want)) == len({(got[i], int(want[i])) for i in range(30)})


def test_small_blocks_share_calls(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n, blocks = 120, 40
    block = [f"b{k % blocks:02d}" for k in range(n)]
    rows = [(k, block[k], int(rng.integers(-1, 2))) for k in range(n)] + [(n, "alone", 0)]
    d = [(block[a], a, b, float(rng.random())) for a, b in itertools.combinations(range(n), 2) if block[a] == block[b]]
    fitted = cl.fit_blocks(spark.createDataFrame(rows, "row_id bigint, block string, label bigint"), spark.createDataFrame(d, "block string, i bigint, j bigint, dist double"), "average", 0.6, supervised=lk.b3_f_score)
    plan = fitted._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "__call" in plan  # not one call of Python a block
    models = {r.block: r for r in fitted.collect()}
    got = {r.row_id: r.label for r in cl.cut_blocks(fitted).collect()}
    assert len(models) == blocks + 1 and sorted(got) == list(range(n + 1)) and got[n] == 0
    for name in set(block):
        ids = [k for k in range(n) if block[k] == name]
        m = np.zeros((len(ids), len(ids)))
        for b, i, j, x in d:
            if b == name:
                m[ids.index(i), ids.index(j)] = m[ids.index(j), ids.index(i)] = x
        z, labels = lk.linkage(m, "average"), np.array([rows[k][2] for k in ids])
        t = lk.best_b3_threshold(z, labels) if (labels != -1).any() else 0.6
        assert models[name].ids == ids and models[name].threshold == pytest.approx(t)
        assert [got[k] for k in ids] == lk.cut(z, t).tolist()
    with pytest.raises(Exception, match="not in the block"):
        cl.fit_blocks(spark.createDataFrame(rows, "row_id bigint, block string, label bigint"), spark.createDataFrame([*d, ("b00", 0, 999, 0.1)], "block string, i bigint, j bigint, dist double"), "average", 0.6).collect()
