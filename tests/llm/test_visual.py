import unicodedata

from entiforge.llm import visual as vs

SAME = [
    ("Doe, José", "Doe, José"),
    ("Ｄｏｅ， Ｊｏｓé", "Doe, José"),
    ("Dоe, Jоsé", "Doe, José"),
    ("Doe, Jоsé", "Doe, José"),
    ("D​oe,\xa0Jo‍sé﻿", "Doe, José"),
    ("Ste\xadﬁ", "Stefi"),
    ("Κim,　Ο.", "Kim, O."),
    ("ё", "ë"),
]


def names(spark, values):
    return spark.createDataFrame([(i, v, f"x{i}") for i, v in enumerate(values)], "id bigint, author_name string, visual_form_ string")


def test_forms(spark):
    values = [a for a, _ in SAME] + ["", None, "​", "Doe, Jose", "DOE, JOSÉ", "a" * 100_000 + "Ａ", "  a  b "]
    got = {r.author_name: r.visual_form for r in vs.name_forms(names(spark, values)).collect()}
    for a, b in SAME:
        assert got[a] == b
    assert None not in got and got[""] == "" and got["​"] == "" and got["Doe, Jose"] == "Doe, Jose" and got["DOE, JOSÉ"] == "DOE, JOSÉ"
    assert got["a" * 100_000 + "Ａ"] == "a" * 100_000 + "A" and got["  a  b "] == "a b"
    again = {r.author_name: r.visual_form for r in vs.name_forms(names(spark, list(got.values()))).collect()}
    assert all(k == v for k, v in again.items())


def test_pass_through(spark):
    df = names(spark, ["Ａ", None])
    got = vs.with_visual_form(df, "author_name").orderBy("id").collect()
    assert [(r.id, r.visual_form, r.visual_form_) for r in got] == [(0, "A", "x0"), (1, None, "x1")]
    assert vs.with_visual_form(df.where("id > 9"), "author_name").count() == 0


def test_pairs_against_brute_force(spark):
    values = ["Ann", "Аnn", "Ann", "Ａnn", "Bob", "Bob", None, "", "​", "⁠", "ann", "Änn", unicodedata.normalize("NFD", "Änn")]
    df = names(spark, values).union(names(spark, values).limit(4))
    form = {r.author_name: r.visual_form for r in vs.name_forms(df).collect()}
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and a and b and a != b and form[a] == form[b] != ""}
    got = [(r.id_a, r.id_b) for r in vs.look_alike_pairs(df, "id").collect()]
    assert set(got) == want and len(got) == len(want) and (0, 1) in want and (11, 12) in want
