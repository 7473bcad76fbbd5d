import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from entiforge.operators import linkage as lk
from entiforge.operators import metrics as mt


def labelled(spark, true, pred):
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip(true, pred))], "row_id bigint, label_true bigint, label_pred bigint")


CASES = [
    ([1, 1, 2, 2, 3, 4, 5], [1, 2, 2, 2, 3, 4, 5], Fraction(17, 21), Fraction(6, 7), Fraction(1, 3), Fraction(1, 2)),
    ([1, 1, 1, 4, 5, 5, 0, 4], [1, 1, 1, 1, 5, 5, 6, 7], Fraction(13, 16), Fraction(7, 8), Fraction(4, 7), Fraction(4, 5)),
    ([1, 2, 1, 3, 2, 4, 5, 4], [1, 1, 2, 2, 3, 3, 4, 4], None, None, Fraction(0), Fraction(0)),
]


@pytest.mark.parametrize(("true", "pred", "bp", "br", "pp", "prr"), CASES)
def test_scores(spark, true, pred, bp, br, pp, prr):
    df = labelled(spark, true, pred)
    b, p = mt.b3_precision_recall_fscore(df).first(), mt.paired_precision_recall_fscore(df).first()
    if bp is not None:
        assert b.precision == pytest.approx(float(bp)) and b.recall == pytest.approx(float(br))
        assert lk.b3_f_score(np.array(true), np.array(pred)) == pytest.approx(b.f_score)
    assert p.precision == pytest.approx(float(pp)) and p.recall == pytest.approx(float(prr))
    if pp == 0:
        assert p.f_score == 0


def test_perfect_and_invariant(spark):
    df = labelled(spark, [1, 1, 2, 2], [1, 2, 3, 4])
    r = mt.b3_precision_recall_fscore(df).first()
    assert (r.precision, r.recall) == (1, 0.5) and r.f_score == pytest.approx(2 / 3)
    p = mt.paired_precision_recall_fscore(df).first()
    assert p.precision == 1 and p.recall == 0
    same = labelled(spark, [7, 7, 9, 9], [5, 6, 1, 2])
    assert mt.b3_precision_recall_fscore(same).first() == r


def test_errors(spark):
    for df in (labelled(spark, [1], [1]).where("row_id < 0"), labelled(spark, [1, None], [1, 2])):
        for f in (mt.b3_precision_recall_fscore, mt.paired_precision_recall_fscore):
            with pytest.raises(Exception):  # noqa: B017
                f(df).collect()


def test_merge_distance(spark):
    df = labelled(spark, [1, 2, 1, 2, 1, 2], [1, 1, 1, 2, 2, 2])
    assert mt.unit_merge_distance(df).first().merge_distance == 4
    one, zero = (lambda a, b: 1.0), (lambda a, b: 0.0)
    assert mt.merge_distance(df, one, one).first().merge_distance == 4
    assert mt.merge_distance(df, zero, zero).first().merge_distance == 0


def test_silhouette(spark):
    rnd = random.Random(1)
    points = [(rnd.random(), rnd.random()) for _ in range(14)]
    labels = [rnd.choice([0, 1, 2]) for _ in points[:-1]] + [9]
    d = np.array([[np.hypot(a[0] - b[0], a[1] - b[1]) for b in points] for a in points])
    dist = spark.createDataFrame([(i, j, float(d[i, j])) for i, j in itertools.combinations(range(14), 2)], "i bigint, j bigint, dist double")
    lab = spark.createDataFrame(list(enumerate(labels)), "id bigint, label bigint")
    assert mt.silhouette(dist, lab).first().silhouette == pytest.approx(lk.silhouette_score(d, np.array(labels)))
    assert mt.silhouette(dist, lab.selectExpr("id", "id AS label")).first().silhouette == -1
    assert lk.silhouette_score(d, np.zeros(14)) == -1


def test_silhouette_cosine(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(20, 5))
    v[3] = 0
    labels = [i % 3 for i in range(19)] + [9]
    u = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    d = 1 - u @ u.T
    np.fill_diagonal(d, 0)
    df = spark.createDataFrame([(i, int(labels[i]), [float(x) for x in v[i]]) for i in range(20)], "id bigint, label bigint, v array<double>")
    assert mt.silhouette_cosine(df).first().silhouette == pytest.approx(lk.silhouette_score(d, np.array(labels)))
    assert mt.silhouette_cosine(df.withColumn("label", F.lit(1))).first().silhouette == -1
