import random
from collections import Counter

import pandas as pd
import pytest

from entiforge.operators import hotkeys as hk
from entiforge.operators.components import connected_components


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "warm", None, "", f"k{rnd.randint(0, 300)}"]), rnd.choice(["a", "b", "c", None])) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "id bigint, key string, item string").repartition(5)


def test_heavy_hitters(skewed, spark):
    rows, df = skewed
    c = Counter(k for _, k, _ in rows)
    for share in (0.3, 0.05, 0.001):
        want = {k: n for k, n in c.items() if k is not None and n > share * len(rows)}
        assert {r.hot_key: r.n for r in hk.heavy_hitters(df, "key", share).collect()} == want
    assert hk.heavy_hitters(df.where("id < 0"), "key", 0.1).count() == 0
    with pytest.raises(ValueError):
        hk.heavy_hitters(df, "key", 0)


def test_key_profile(skewed):
    rows, df = skewed
    got = {r["key"]: (r.n_rows, r.n_items, r.top_item, r.top_rows) for r in hk.key_profile(df, "key", "item", share=0.05).collect()}
    for key in {k for _, k, _ in rows}:
        items = [i for _, k, i in rows if k == key]
        c = Counter(i for i in items if i is not None)
        top = min(c.items(), key=lambda x: (-x[1], x[0])) if c else (None, 0)
        assert got[key] == (len(items), len(c), *top)


@pytest.mark.parametrize("unique", [True, False])
def test_skew_join(skewed, spark, unique):
    rows, df = skewed
    right = [("hot", 1), ("warm", 2), ("k7", 3), ("none", 4)] + ([] if unique else [("hot", 5), ("k7", 6)])
    j = hk.skew_join(df, spark.createDataFrame(right, "key string, v int"), "key", share=0.05, salts=3, right_unique=unique)
    want = Counter((i, k, v) for i, k, _ in rows for kk, v in right if k == kk)
    assert Counter((r.id, r.key, r.v) for r in j.collect()) == want


def test_rank_within(skewed):
    rows, df = skewed
    got = {r.id: r.rank_in_key for r in hk.rank_within(df, "key", ["id"], partitions=7).collect()}
    seen = Counter()
    for i, k, _ in sorted(rows):
        seen[k] += 1
        assert got[i] == seen[k]


def test_components(spark):
    rnd = random.Random(5)
    for n, m in ((60, 40), (200, 150)):
        edges = [(f"v{rnd.randint(0, n)}", f"v{rnd.randint(0, n)}") for _ in range(m)] + [("v0", None), ("p00", "p01")]
        chain = [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)]
        df = spark.createDataFrame(edges + chain, "src string, dst string")
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges + chain:
            if b is not None:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
        assert {r.vertex: r.component for r in connected_components(df).collect()} == {v: find(v) for v in list(parent)}
    assert connected_components(df.where("src = 'x'")).count() == 0


def test_empty_rank(spark):
    df = spark.createDataFrame(pd.DataFrame({"key": ["a"], "id": [1]})).where("id > 1")
    assert hk.rank_within(df, "key", ["id"]).count() == 0


def test_salted_join_spreads_a_hot_key(spark):
    many = spark.range(6000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 500) END AS k")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4), ("other", 5)], "k string, v int")
    hot = hk.hot_keys(many, "k", 0.1)
    assert [r[0] for r in hot.collect()] == ["hot"]
    got = hk.salted(many, few, "k", hot, salts=8)
    want = many.join(few, "k")
    assert sorted(map(tuple, got.select("id", "v").collect())) == sorted(map(tuple, want.select("id", "v").collect()))
    spread = [len(p) for p in hk.salted(many, few, "k", hot, salts=8).rdd.glom().collect()]
    assert sum(spread) == want.count() and max(spread) < want.count()
    assert hk.salted(many.where("id < 0"), few, "k", hk.hot_keys(many.where("id < 0"), "k")).count() == 0
