import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from entiforge.operators import features as ft
from entiforge.operators import pairs as pr
from entiforge.operators import sampling as sp
from entiforge.sources import jsonio
from entiforge.streaming.incremental import BlockStore, partial_fit, run_stream


def vectors(spark, rows):
    return spark.createDataFrame([(i, r[: len(r) // 2], r[len(r) // 2 :]) for i, r in enumerate([[float(x) for x in r] for r in rows])], "i int, l array<double>, r array<double>").orderBy("i")


def test_vector_operators(spark):
    df = vectors(spark, [[1, 0, 0, 0, 0, 0], [1, 0, 1, 1, 0, 0], [1, 0, 0, 1, 0, 0], [0] * 6, [1] * 6])
    assert [r[0] for r in df.select(pr.cosine_similarity(F.col("l"), F.col("r"))).collect()] == pytest.approx([0, 2**-0.5, 1, 0, 1])
    df = vectors(spark, [[0, 0, 0, 0], [0, 1, 1, 0], [1, 1, 1, 1], [1, 0, 0, 1]])
    assert [r[0] for r in df.select(pr.absolute_difference(F.col("l"), F.col("r"))).collect()] == [[0, 0], [1, 1], [0, 0], [1, 1]]
    df = vectors(spark, [[1, 1, 1, 2], [0.5, 1, 1, 0.5], [2.5, 0.2, 10, 2]])
    assert [r[0] for r in df.select(pr.element_product(F.col("l"), F.col("r"))).collect()] == [[1, 2], [0.5, 0.5], [25, 0.4]]
    df = vectors(spark, [[0, 0, -1, 2, 0, 0], [1, 1, 0, 0, 1, 1], [1, 1, 1, 1, 1, 1]])
    assert [r[0] for r in df.select(pr.jaccard_vectors(F.col("l"), F.col("r"))).collect()] == pytest.approx([0, 1 / 3, 1])


def test_scalars(spark):
    df = spark.createDataFrame([(0.5,), (0.7,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(pr.threshold(F.col("x"), 0.5)).collect()] == [0.0, 1.0, 0.0, None]
    assert df.select(pr.expit(F.lit(0.0))).first()[0] == 0.5
    s = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (None, [])], "a array<string>, b array<string>")
    assert [r[0] for r in s.select(pr.jaccard_sets(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0, None]
    a = spark.createDataFrame([([[1, 2, 3], [4, 5, 6]],)], "m array<array<int>>")
    assert a.select(pr.reshape(F.col("m"), 6, 1)).first()[0] == [[1], [2], [3], [4], [5], [6]]
    assert a.select(pr.reshape(F.col("m"), 6, 1, "F")).first()[0] == [[1], [4], [2], [5], [3], [6]]
    v = spark.createDataFrame([([1, 2],)], "v array<int>")
    assert v.select(pr.func_transformer(F.col("v"), lambda x: x + 1)).first()[0] == [2, 3]
    assert v.select(pr.func_transformer(F.col("v"), lambda x: x + 1, "double")).first()[0] == [2.0, 3.0]


def test_block_pairs_and_apply(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "q"), (5, None, "q")], "id bigint, block string, t string")
    p = pr.block_pairs(df, "block", "id", ["t"])
    assert [(r.l_id, r.r_id, r.l_t, r.r_t) for r in p.collect()] == [(1, 2, "x", "y")]
    calls = []

    def transform(e):
        calls.append(e.count())
        return e.withColumn("n", F.length("t"))

    q = spark.createDataFrame([("x", "yy"), ("yy", "x"), ("x", "x")], "l_t string, r_t string")
    got = pr.pair_apply(q, [("l_", []), ("r_", [])], transform, ["t"], ["n"])
    assert sorted((r.l_n, r.r_n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)] and calls == [2]


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "big cat"), (2, "cat cat dog"), (3, ""), (4, "big cat")], "id bigint, t string")
    w = {(r.id, r.term): r.weight for r in ft.tfidf(df, "id", "t").collect()}
    idf = {"big": math.log(5 / 3) + 1, "cat": math.log(5 / 4) + 1, "dog": math.log(5 / 2) + 1}
    n = math.hypot(2 * idf["cat"], idf["dog"])
    assert w[2, "cat"] == pytest.approx(2 * idf["cat"] / n) and (3, "cat") not in w
    p = spark.createDataFrame([(1, 4), (1, 2), (1, 3)], "l bigint, r bigint")
    c = {r.r: r.cosine for r in ft.sparse_cosine(p, "l", "r", ft.tfidf(df, "id", "t"), "id").collect()}
    assert c[4] == pytest.approx(1) and c[3] == 0 and 0 < c[2] < 1
    g = spark.createDataFrame([("Ab c",)], "t string").select(ft.char_wb(F.col("t"), 2, 3)).first()[0]
    assert sorted(g) == sorted([" a", "ab", "b ", " ab", "ab ", " c", "c ", " c "])


def test_getters(spark):
    authors = [f"A{i}" for i in range(8)]
    df = spark.createDataFrame([("A4", "X Inst", authors, 0), ("Zz", None, authors, 1999), (None, "", None, None)], "author_name string, author_affiliation string, authors array<string>, pub_year int")
    assert [r[0] for r in df.select(ft.coauthors_from_range(2)).collect()] == ["A2 A3 A4 A5", " ".join(authors), ""]
    assert [r[0] for r in df.select(ft.year()).collect()] == [-1, 1999, -1]
    assert [r[0] for r in df.select(ft.affiliation()).collect()] == ["inst x", "", ""]
    n = spark.createDataFrame([("Doe, John Ray",), ("Doe",), (None,)], "author_name string")
    assert [r[0] for r in n.select(ft.other_names()).collect()] == ["ray john", "", ""]
    assert [r[0] for r in n.select(ft.surname()).collect()] == ["Doe", "Doe", ""]
    assert [r[0] for r in n.select(ft.initials()).collect()] == ["DJR", "D", ""]


def test_sampling(spark):
    truth = spark.createDataFrame([(i, i % 7, f"n{i % 5}") for i in range(60)], "signature_id bigint, label bigint, author_name string")
    pairs = spark.createDataFrame([(i, j) for i in range(60) for j in range(i + 1, 60)], "l_id bigint, r_id bigint")
    c = sp.categorize(pairs, truth)
    for r in c.collect():
        assert r.category == ("sa" if r.l_id % 7 == r.r_id % 7 else "da") + ("sn" if r.l_id % 5 == r.r_id % 5 else "dn")
    s = sp.sample_balanced(c, 400)
    assert {r["category"]: r["count"] for r in s.groupBy("category").count().collect()} == {k: 100 for k in ("dasn", "sasn", "sadn", "dadn")}
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, sp.sample_balanced(c, 400).collect()))
    assert sp.sample_balanced(c.where("category <> 'sasn'"), 40).count() == 30
    u = sp.sample_unbalanced(c, 20).groupBy("target").count().collect()
    assert {r.target: r["count"] for r in u} == {0: 10, 1: 10}
    w = sp.sample_without_blocking(truth, 20).collect()
    assert {(r.l_id % 7 == r.r_id % 7) == (r.target == 0) for r in w} == {True} and len({(r.l_id, r.r_id) for r in w}) == len(w) == 20


def test_json_sources(spark, tmp_path):
    sig = [{"signature_id": 1, "author_name": "A", "author_affiliation": "x", "publication_id": 7}, {"signature_id": 1, "author_name": "B", "publication_id": 7}]
    (tmp_path / "s.json").write_text(json.dumps(sig))
    (tmp_path / "m.json").write_text(json.dumps({"1": sig[0]}))
    (tmp_path / "r.json").write_text(json.dumps([{"publication_id": 7, "title": "T", "authors": ["A", "B"]}]))
    (tmp_path / "none.json").write_text("[]")
    r = jsonio.load_signatures(spark, f"{tmp_path}/s.json", f"{tmp_path}/r.json").collect()
    assert [(x.author_name, x.publication.title) for x in r] == [("B", "T")]
    assert jsonio.load_signatures(spark, f"{tmp_path}/m.json", f"{tmp_path}/r.json").first().author_name == "A"
    with pytest.raises(Exception, match="no record"):
        jsonio.load_signatures(spark, f"{tmp_path}/s.json", f"{tmp_path}/none.json").collect()
    (tmp_path / "c.json").write_text(json.dumps({"3": [5, 4], "-1": [9]}))
    c = jsonio.read_clusters(spark, f"{tmp_path}/c.json")
    assert {r.label: r.ids for r in jsonio.cluster_lists(c).collect()} == {"3": [4, 5], "-1": [9]}
    (tmp_path / "p.json").write_text("[[1, 2, 0], [3, 4, 1]]")
    assert [tuple(r) for r in jsonio.read_pairs(spark, f"{tmp_path}/p.json").collect()] == [(1, 2, 0), (3, 4, 1)]
    np.savez(tmp_path / "x.npz", X=np.eye(2), y=np.array([0, 1]))
    assert jsonio.read_npz(spark, f"{tmp_path}/x.npz").count() == 2
    (tmp_path / "t.csv").write_text("A,B\nx,1\n")
    assert jsonio.read_csv(spark, f"{tmp_path}/t.csv", "A string, B int").first().B == 1


def test_incremental(spark, tmp_path):
    def cluster(rows):
        low = rows.groupBy("block").agg(F.min("row_id").alias("lo"))
        return rows.join(low, "block").withColumn("label", F.col("row_id") - F.col("lo")).drop("lo")

    schema = "row_id bigint, block string, label bigint"
    state = spark.createDataFrame([], schema)
    for batch in ([(5, "a"), (6, "b"), (9, None)], [(2, "a"), (5, "a")], [(7, "c")]):
        state = partial_fit(spark.createDataFrame(batch, "row_id bigint, block string"), state, cluster)
    assert {r.row_id: (r.block, r.label) for r in state.collect()} == {5: ("a", 3), 2: ("a", 0), 6: ("b", 0), 7: ("c", 0)}
    rows = spark.range(30).select(F.col("id").alias("row_id"), F.concat(F.lit("b"), (F.col("id") % 4).cast("string")).alias("block"))
    rows.repartitionByRange(3, "row_id").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = BlockStore(spark, f"{tmp_path}/state", schema)
    q = run_stream(source, store, cluster, f"{tmp_path}/cp")
    q.awaitTermination()
    got = {r.row_id: r.label for r in store.at(q.lastProgress["batchId"]).collect()}
    assert got == {i: i - i % 4 for i in range(30)}


def test_estimator_feature(spark):
    rows = [(i, "abab" if i % 2 else "xyxy", float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "signature_id bigint, t string, y double")
    model = ft.text_estimator(df, "t", "y", (1, 3), 256)
    p = spark.createDataFrame([(1, 3), (1, 2)], "l_id bigint, r_id bigint")
    got = {r.r_id: r.f_estimator for r in ft.estimator_pair_scores(model, p, df, "signature_id", "t", ngrams=(1, 3)).collect()}
    assert got[3][1] > got[2][1] and got[3][1] > got[3][0]


def test_vector_queries_take_all_pairs(spark, tmp_path):
    from entiforge.plans import pair_queries as pq

    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4))
    labels = [None if i == 7 else i % 2 for i in range(120)]
    rows = [(i * 30, [float(v) for v in x[i]], labels[i]) for i in range(120)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = x.astype("float32").astype("float64")
    want = {(i * 30, j * 30): x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) for i in range(120) for j in range(i + 1, 120) if labels[i] == labels[j] and labels[i] is not None}
    got = {(r.l_id, r.r_id): r.cosine for r in pq.pair_cosine(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    for query in (pq.pair_absdiff, pq.pair_elemmul, pq.pair_threshold):
        assert {(r.l_id, r.r_id) for r in query(spark, str(tmp_path)).select("l_id", "r_id").collect()} == want.keys()


def labelled_rows(spark):
    """Blocks of several sizes; null blocks, names and labels."""
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 23 == 0 else int(rng.integers(0, 6)), None if i % 17 == 0 else f"n{int(rng.integers(0, 4))}", None if i % 29 == 0 else f"b{int(rng.integers(0, 10)) // 4}") for i in range(150)]
    return spark.createDataFrame(rows, "signature_id bigint, label bigint, author_name string, block string")


def test_pairs_of_blocks_are_counted_without_being_listed(spark, monkeypatch):
    known = labelled_rows(spark)
    known = known.unionByName(known.where("signature_id < 9"))  # repeated ids pair with others, not with themselves
    want = {(r.category, r.target): r["count"] for r in sp.categorized_block_pairs(known).groupBy("category", "target").count().collect()}
    monkeypatch.setattr(sp, "block_pairs", None)
    assert {(r.category, r.target): r.n_pairs for r in sp.block_pair_counts(known).collect()} == want and len(want) == 4
    assert sp.block_pair_counts(known.where("block IS NULL")).count() == 0
    assert sp.block_pair_counts(known.where("author_name = 'n1' AND label = 1")).toPandas()["category"].tolist() == ["sasn"]


@pytest.mark.parametrize("balanced", [True, False])
def test_samples_of_blocks_are_drawn_without_listing_pairs(spark, monkeypatch, balanced):
    known = labelled_rows(spark)
    of = {(r.l_id, r.r_id): (r.target, r.category) for r in sp.categorized_block_pairs(known).collect()}
    monkeypatch.setattr(sp, "block_pairs", None)
    rows = sp.sample_block_pairs(known, 80, balanced).collect()
    assert all(of[r.l_id, r.r_id] == (r.target, r.category) for r in rows) and len({(r.l_id, r.r_id) for r in rows}) == 80
    kinds = [r.category if balanced else r.target for r in rows]
    assert {k: kinds.count(k) for k in kinds} == ({c: 20 for c in sp.CATEGORIES} if balanced else {0: 40, 1: 40})
    again = sp.sample_block_pairs(known.repartition(3), 80, balanced).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_drawn_pairs_are_all_pairs_or_a_uniform_part(spark):
    known = labelled_rows(spark)
    of = {(r.l_id, r.r_id, r.target, r.category) for r in sp.categorized_block_pairs(known).collect()}
    every = sp.drawn_block_pairs(known, {sp.CATEGORIES: 10**6}).collect()
    assert {tuple(r) for r in every} == of and len(every) == len(of)
    part = [tuple(r) for r in sp.drawn_block_pairs(known, {sp.CATEGORIES: 200}).collect()]
    assert set(part) <= of and len(part) == len(set(part)) and 200 <= len(part) < len(of) / 2
    for c in sp.CATEGORIES:
        share = len(part) / len(of)
        n, want = sum(r[3] == c for r in part), sum(r[3] == c for r in of)
        assert abs(n - share * want) < 4 * (share * want) ** 0.5
