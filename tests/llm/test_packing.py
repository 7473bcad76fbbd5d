import numpy as np
import pytest

from entiforge.llm import packing as pk


def test_tightest_fit_against_brute_force():
    rng = np.random.default_rng(2)
    for cap in (7, 64, 100):
        tree, held = pk.TightestFit(cap), []
        for k in range(600):
            if rng.random() < 0.5:
                room = int(rng.integers(1, cap + 1))
                tree.put(room, k)
                held.append(room)
            else:
                size = int(rng.integers(1, cap + 1))
                fits = [r for r in held if r >= size]
                got = tree.take(size)
                assert (got and got[0]) == (min(fits) if fits else None)
                if fits:
                    held.remove(min(fits))


def test_best_fit_decreasing():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 500)
    box, offset = pk.best_fit_decreasing(sizes, 100)
    filled = np.bincount(box, weights=sizes)
    assert filled.max() <= 100 and box.max() + 1 <= np.ceil(sizes.sum() / 100 * 1.05)
    for b in range(box.max() + 1):
        at = np.argsort(offset[box == b])
        assert list(offset[box == b][at]) == list(np.r_[0, np.cumsum(sizes[box == b][at])[:-1]])


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 200, 300))] + [(900, None), (901, ""), (902, "wort " * 3000), (903, "<|endoftext|> x")]
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, slice string")


def test_pack(docs, spark):
    kinds = spark.createDataFrame([("medium", 256), ("bad", None)], "container_kind string, capacity_tokens int")
    sizes = {r.doc_id: r.n_tokens for r in pk.count_tokens(docs).collect()}
    assert sizes[900] == sizes[901] == 0 and sizes[903] > 2
    out = pk.pack_documents(docs, kinds).collect()
    total, boxes = {}, {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        if r.container_id is not None:
            boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
    assert total == sizes and max(boxes.values()) <= 256
    assert len(boxes) <= 1.05 * sum(sizes.values()) / 256 + 1
    pieces = {i: sorted((r.piece, r.n_tokens) for r in out if r.doc_id == i) for i in sizes}
    assert all(len(p) == max(1, -(-sizes[i] // 256)) for i, p in pieces.items())
    assert all(n == 256 for _, n in pieces[902][:-1])
    with pytest.raises(ValueError):
        pk.pack_documents(docs, kinds, "none")
    with pytest.raises(ValueError):
        pk.pack_documents(docs, kinds, "bad")


def test_slices_and_empty(docs, spark):
    sized = spark.createDataFrame([(i, 1 + i % 50) for i in range(1000)] * 2, "doc_id bigint, n_tokens bigint")
    out = pk.pack(sized, 100, slice_items=300)
    per = out.groupBy("container_id").sum("n_tokens").collect()
    assert max(r[1] for r in per) <= 100 and out.count() == 2000 and len({r[0].split("-")[0] for r in per}) == 7
    assert pk.pack(sized.where("doc_id < 0"), 100).count() == 0
