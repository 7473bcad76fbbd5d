import pytest
from pyspark.sql import functions as F

from entiforge.llm import variants as va


def test_parse_and_fold():
    assert va.parse("van der Berg, José, Jr.") == (["berg"], ["jose"], True)
    assert va.parse("O'Neil, A.B.") == (["neil"], ["a", "b"], True)
    assert va.parse("ИВАНОВ, НИНА") == (["ivanov"], ["nina"], True)
    assert va.parse("Чагинейн, Вера") == (["chaginein"], ["vera"], True)
    assert va.parse("José Berg")[1:] == (["jose", "berg"], False)
    assert va.fold("Dоe") == "doe"


@pytest.mark.parametrize(
    ("a", "b", "fits"),
    [("john", "j", True), ("john", "k", False), ("elizabeth", "betty", True), ("betty", "e", True), ("john paul", "jp", True), ("john paul", "john", True), ("john", "jonh", True), ("john", "mary", False), ("anna", "amir", False), ("", "anna", True)],
)
def test_given(a, b, fits):
    c = va.Channel({"betty": ("elizabeth",)})
    assert (c.given(a, b) is not None) == fits == (c.given(b, a) is not None)
    assert not fits or "" in (a, b) or set(c.meeting_keys(a)) & set(c.meeting_keys(b))


def test_surname():
    c = va.Channel({})
    assert c.surname("berg", "berg") == ()
    assert c.surname("remar", "rernar") is not None and c.surname("smith", "jones") is None
    assert c.surname("kolt varn", "kolt") == ("part",) and c.surname("quon", "qoun") == ("typo",)


ROWS = [
    (1, "Kolvertin, Elizabeth", "Dept. of Physics, Alpha Institute, X", 10), (2, "Kolvertin, E.", "Physics Dept, x, Alpha Inst., X", 11), (3, "Kolvertin, Betty", "DEPT. OF PHYSICS, ALPHA INSTITUTE, X", 12),
    (4, "Kolvretin, Elizabeth", "Dept. of Physics, Alpha Institute, X", 13), (5, "Elizabeth Kolvertin", "Dept. of Physics, Alpha Institute, X", 14), (6, "KOLVERTIN, ELIZABETH", None, 15),
    (7, "Kolvertin, Elizabeth", "Dept. of Physics, Alpha Institute, X", 16), (8, "Kоlvertin, Elizabeth", "Dept. of Physics, Alpha Institute, X", 17),
    (20, "Kolvertin, Roman", "Dept. of Physics, Alpha Institute, X", 18), (21, "Kolvertin, R.", "Dept. of Physics, Alpha Institute, X", 19),
    (30, "Kolvertin, Elizabeth", "Dept. of Optics, Beta College, Y", 20), (31, "KOLVERTIN, ELIZABETH", "Dept. of Optics, Beta College, Y", 21), (32, "Kolvertin, Elizabeth", "Dept. of Optics, Beta College, Y", 22),
    (40, None, "Beta College", 23), (41, "", None, 24), (42, "  ", None, 24),
] + [(100 + i, f"Other{c}ern, Maria", "Gamma School", 50 + i) for i, c in enumerate("abcdefgh")]
# other families, so that the short form can be learned: two more have it, the others have names of their own
FAMILIES = "Brunt Calder Dorsing Eckvalt Fumeg Grishan Hollubek Istvarn Jorlin Kramdot Lopwick Mundarex Nisquall Ortegund Pabrist Quessel Rathmore Selvin Torquad".split()
for _i, _f in enumerate(FAMILIES):
    _names = ("Elizabeth", "Betty") if _i < 2 else (f"Aa{chr(97 + _i)}lin", f"Zu{chr(97 + _i)}mor")
    ROWS += [(200 + 2 * _i + _k, f"{_f}, {_g}", f"Place {_f}", 200 + 2 * _i + _k) for _k, _g in enumerate(_names)]


@pytest.fixture(scope="module")
def members(spark):
    df = spark.createDataFrame(ROWS, "signature_id bigint, author_name string, author_affiliation string, publication_id bigint").withColumn("entity", F.lit("clash"))
    return va.entities(df.drop("entity")), df


def test_entities(members, spark):
    got, df = members
    e = {r.signature_id: r.entity for r in got.collect()}
    assert not {40, 41, 42} & set(e)
    assert len({e[i] for i in (1, 2, 3, 4, 5, 7, 8)}) == 1
    assert len({e[i] for i in (20, 21)}) == 1 and len({e[i] for i in (30, 31, 32)}) == 1
    assert len({e[1], e[20], e[30]}) == 3 and e[200] == e[201] and e[206] != e[207]
    assert va.entities(df.where("signature_id < 0").drop("entity")).count() == 0


def test_hot_names_near_each_other_stay_apart(spark):
    rows = [(i, "Jae, Q." if i % 3 else "Jaye, Q.", f"Dept. of X, School {i % 5}", i) for i in range(3000)] + [(5000, "Jea, Q.", "Dept. of X, School 1", 5000)]
    df = spark.createDataFrame(rows, "signature_id bigint, author_name string, author_affiliation string, publication_id bigint")
    e = {r.signature_id: r.entity for r in va.entities(df).collect()}
    assert len(e) == 3001 and len(set(e.values())) == 10 and e[5000] == e[1] and all((e[i] == e[i + 15]) for i in range(1000))


def test_pairs(members):
    got, _ = members
    name = {r.signature_id: (r.author_name, r.entity) for r in got.collect()}
    want = {(a, b) for a in name for b in name if a < b and name[a][1] == name[b][1] and name[a][0] != name[b][0]}
    pairs = [(r.signature_id_a, r.signature_id_b) for r in va.variant_pairs(got).collect()]
    assert set(pairs) == want and len(pairs) == len(want) and (1, 7) not in want and (1, 2) in want


def test_institution(spark):
    df = spark.createDataFrame([("Dept. of X, Alpha Inst., Y",), ("DEPARTMENT OF X, ALPHA INSTITUTE",), ("",), (None,), ("Dept. of X",)], "a string")
    assert [r[0] for r in df.select(va.institution("a")).collect()] == ["alpha institute", "alpha institute", None, None, None]
