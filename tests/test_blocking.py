import random

import pytest
from pyspark.sql import functions as F

from entiforge.functions.phonetic import double_metaphone
from entiforge.operators import blocking as bl


def keys(spark, names, threshold=100):
    df = spark.createDataFrame(list(enumerate(names)), "row_id bigint, author_name string")
    return [r.block for r in bl.block_phonetic(df, threshold=threshold).orderBy("row_id").collect()]


@pytest.mark.parametrize(
    ("names", "threshold", "want"),
    [
        (["Smith, Joe"], 100, ["SM0"]),
        (["Smith-Jones, Joe", "Smith, Joe", "Jones, Paul", "Smith-Jones, Paul"], 100, ["SM0", "SM0", "JNS", "SM0"]),
        (["Jones-Smith, Joe", "Smith, Joe", "Jones-Smith, Paul"], 100, ["SM0"] * 3),
        (["Jones-Smith, Joe"], 100, ["SM0"]),
        (["Smith, Joe", "Smith, Paul"], 1, ["SM0j", "SM0p"]),
        (["Jones, Joe", "Smith, Joe Jones", "Jones, Joe", "Jones-Smith, Joe"], 100, ["JNS", "SM0", "JNS", "SM0"]),
    ],
)
def test_phonetic_fixtures(spark, names, threshold, want):
    assert keys(spark, names, threshold) == want


def sequential(rows):
    """The two phases row by row: what the closed form has to equal."""
    blocks, out = {}, {}
    for i, (s, g) in enumerate(rows):
        if len(s) == 1:
            blocks.setdefault(s[0], {}).setdefault(s, set()).add(g)
            out[i] = s[0]

    def fits(prefix, last):
        for h in blocks[last].get((last,), ()):
            k = min(len(prefix), len(h))
            if prefix[len(prefix) - k :] == h[len(h) - k :]:
                return True
        return False

    for i, (s, g) in enumerate(rows):
        if len(s) == 1:
            continue
        first, last = s[0], s[-1]
        if first in blocks and s in blocks[first]:
            out[i] = first
        elif last in blocks and s in blocks[last]:
            out[i] = last
        elif last in blocks and (last,) in blocks[last] and any(fits(s[:k], last) for k in range(len(s) - 1, 0, -1)):
            out[i] = last
        elif first in blocks:
            blocks[first].setdefault(s, set()).add(g)
            out[i] = first
        elif last not in blocks:
            blocks[last] = {s: {g}}
            out[i] = last
        else:
            out[i] = last
    return [out[i] for i in range(len(rows))]


def test_phonetic_equals_sequential(spark):
    rnd = random.Random(3)
    words = ["tom", "ben", "kor", "lim", "zed", "fox", "gus", "hap"]
    code = {w: double_metaphone(w)[0] for w in words}
    for _ in range(4):
        names, parsed = [], []
        for _ in range(60):
            s = [rnd.choice(words[2:]) for _ in range(rnd.choice([1, 1, 2, 2, 3]))]
            g = [rnd.choice(words[2:]) for _ in range(rnd.choice([1, 2]))]
            names.append(f"{'-'.join(s)}, {' '.join(g)}")
            parsed.append((tuple(code[w] for w in s), tuple(code[w] for w in g)))
        assert keys(spark, names, None) == sequential(parsed)


def test_schemes(spark):
    df = spark.createDataFrame([(1, "Smith, Jo"), (2, None), (3, "")], "row_id bigint, author_name string")
    assert {r.block for r in bl.with_block(df, "single").collect()} == {"0"}
    assert [r.block for r in bl.with_block(df, F.col("author_name")).orderBy("row_id").collect()] == ["Smith, Jo", None, ""]
    assert [r.block for r in bl.with_block(df, "phonetic").orderBy("row_id").collect()][:2] == ["SM0", None]
    assert bl.with_block(df, lambda d: d.withColumn("block", F.lit(1))).count() == 3
    with pytest.raises(ValueError):
        bl.with_block(df, "other")
    with pytest.raises(ValueError):
        bl.block_phonetic(df, threshold=-1)
    empty = df.where("row_id < 0")
    assert bl.block_phonetic(empty).count() == 0
