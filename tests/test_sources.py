import json

import numpy as np
import pytest

from entiforge.sources import jsonio
from entiforge.streaming.incremental import partial_fit


def test_json_forms(spark, tmp_path):
    rows = [{"signature_id": 1, "author_name": "A", "publication_id": 7}, {"signature_id": 2, "author_name": None, "publication_id": 7}]
    record = {"publication_id": 7, "title": "T", "authors": ["A"]}
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "map.json").write_text(json.dumps({"7": record}))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, [*rows, rows[0]])))
    (tmp_path / "records.json").write_text(json.dumps(record))
    whole = jsonio.load_signatures(spark, str(tmp_path / "list.json"), str(tmp_path / "map.json"))
    lines = jsonio.load_signatures(spark, str(tmp_path / "lines.json"), str(tmp_path / "records.json"), lines=True)
    for got in (whole, lines):
        assert {(r.signature_id, r.author_name, r.publication.title) for r in got.collect()} == {(1, "A", "T"), (2, None, "T")}


def test_train_ids(spark, tmp_path):
    (tmp_path / "a.json").write_text("[3, 5, 3]")
    (tmp_path / "b.json").write_text('[{"signature_id": 4}, {"signature_id": 4}]')
    assert sorted(r.row_id for r in jsonio.read_train_ids(spark, str(tmp_path / "a.json")).collect()) == [3, 5]
    assert [r.row_id for r in jsonio.read_train_ids(spark, str(tmp_path / "b.json")).collect()] == [4]


def test_npz_and_csv(spark, tmp_path):
    np.savez(tmp_path / "x.npz", X=np.arange(6.0).reshape(3, 2), y=np.array([1, -1, 2]))
    got = sorted(map(tuple, jsonio.read_npz(spark, str(tmp_path / "x.npz")).collect()))
    assert got == [(0, [0.0, 1.0], 1), (1, [2.0, 3.0], -1), (2, [4.0, 5.0], 2)]
    np.savez(tmp_path / "y.npz", X=np.array([{}], dtype=object), y=np.array([1]))
    with pytest.raises(Exception):
        jsonio.read_npz(spark, str(tmp_path / "y.npz")).collect()
    (tmp_path / "p.csv").write_text("a,b\n1,x\n,y\n")
    assert {tuple(r) for r in jsonio.read_csv(spark, str(tmp_path / "p.csv"), "a int, b string").collect()} == {(1, "x"), (None, "y")}


def test_partial_fit_sees_old_rows(spark):
    from entiforge.plans.pipeline_queries import _close_names

    schema = "row_id bigint, block string, name string, label string"
    state = spark.createDataFrame([], schema)
    for batch in ([(1, "b", "anna"), (2, "b", "zzzzzz"), (3, "c", "anna")], [(4, "b", "annas"), (5, None, "x")], [(6, "b", "bannas"), (1, "b", "anna")]):
        state = partial_fit(spark.createDataFrame(batch, "row_id bigint, block string, name string"), state, _close_names).cache()
    got = {r.row_id: (r.block, r.label) for r in state.collect()}
    assert got == {1: ("b", "anna"), 2: ("b", "zzzzzz"), 3: ("c", "anna"), 4: ("b", "anna"), 6: ("b", "anna")}
