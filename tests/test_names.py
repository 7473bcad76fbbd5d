import pytest
from pyspark.sql import functions as F

from entiforge.functions import names as nm


def values(spark, inputs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_asciify(spark):
    assert values(spark, ["", "foo", "crèmå", "schröder", "Straße", "Ørsted", "Дени", None, "ＡＢ", "日"], nm.asciify) == ["", "foo", "crema", "schroder", "Strasse", "Orsted", "Deni", None, "AB", ""]


NORMAL = {
    "Doe, John": "doe john", "Doe, J.": "doe j", "Doe-Foe, Willem": "doefoe willem", "Doe-Foe Willem": "willem doe foe", "Dupont, René": "dupont rene",
    "Dupont., René": "dupont rene", "Dupont, Jean-René": "dupont jean rene", "Dupont, René, III": "dupont rene", "Dupont, René, Jr.": "dupont rene",
    "Dupont, J.-R.": "dupont j r", "Dupont": "dupont", "Dupont J.R.": "dupont j r", "von und zu Hohenstein, F.": "hohenstein f", "Jakub, Ibrahim ibn": "jakub ibrahim ibn",
    "o'Neill, Jack": "neill jack", "Ben, Robert": "ben robert", "Robert, L. W": "robert l w", "Mueller aus Auer, Peter": "muellerauer peter", "Doe,Ivan": "doe van", "": "",
}


def test_normalize_name(spark):
    assert values(spark, list(NORMAL), nm.normalize_name) == list(NORMAL.values())
    kept = {"von und zu Hohenstein, F.": "vonundzuhohenstein f", "o'Neill, Jack": "oneill jack", "Mueller aus Auer, Peter": "muellerausauer peter"}
    assert values(spark, list(kept), lambda c: nm.normalize_name(c, drop_common_affixes=False)) == list(kept.values())
    assert values(spark, ["Doe,Ivan"], lambda c: nm.normalize_name(c, strict_suffix=True)) == ["doe ivan"]


@pytest.mark.parametrize(
    ("name", "index", "initial"),
    [("Doe, John", 0, "j"), ("Doe=Foe, Willem John", 1, "j"), ("Dupont, Jean-René", 0, "j"), ("Dupont, René, III", 0, "r"), ("Dupont, René Pierre", 1, "p"), ("Dupont, René, III Pierre", 1, ""), ("Mieszko", 0, ""), ("John Doe", 0, "j"), ("Dupont, .J", 0, "j"), ("Doe, ", 0, "d")],
)
def test_given_name_initial(spark, name, index, initial):
    assert values(spark, [name], lambda c: nm.given_name_initial(c, index)) == [initial]


def test_given_name(spark):
    cases = [("Doe, John", 0, "John"), ("Doe, John", 1, ""), ("Doe, John William", 1, "William"), ("Dupont, .J", 0, ".J"), ("John Doe", 0, "John"), ("John Doe", 1, "Doe"), ("Mieszko", 0, "Mieszko"), ("Dupont, René, III Pierre", 0, "René"), ("Dupont, René, III Pierre", 2, "")]
    for name, i, want in cases:
        assert values(spark, [name], lambda c, i=i: nm.given_name(c, i)) == [want]
    assert values(spark, [None], nm.given_name) == [None]


def test_initials_and_tokens(spark):
    assert values(spark, ["Dupont, Jean-René"], nm.name_initials) == [["D", "J"]]

    def tokens(x, **k):
        t = values(spark, [x], lambda c: nm.tokenize_name(c, **k))[0]
        return t["surnames"], t["given"]

    assert tokens("Doe-Foe, Willem") == (["doe", "foe"], ["willem"])
    assert tokens("Jean Dupont") == tokens("Dupont, Jean") == (["dupont"], ["jean"])
    assert tokens("Dupont") == (["dupont"], [""])
    assert tokens("Aref'ev, M.") == (["arefev"], ["m"])
    assert tokens("An'Sun, J.") == (["an", "sun"], ["j"])
    assert tokens("von und zu Hohenstein, F.") == (["hohenstein"], ["f"])
    assert tokens("Ben, Robert") == (["ben"], ["robert"])
    assert tokens("Dupont, René, III") == (["dupont"], ["rene", "iii"])


def test_last_name_first_initial(spark):
    got = values(spark, ["Smith, Jonh", "Smith, James", "Smith, Peter", "Smit, John", "Mieszko", None], nm.block_last_name_first_initial)
    assert got == ["smith j", "smith j", "smith p", "smit j", "mieszko", None]
