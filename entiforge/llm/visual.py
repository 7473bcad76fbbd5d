"""One consistent form for text that looks the same on screen but is stored in different characters.

DuckDB runs inside the Arrow partitions: each record batch is a relation of an in-process, single-threaded DuckDB, and
one embedded SQL expression maps compatibility forms, drops invisible characters, unifies blanks, maps look-alike
letters and composes accents with ``nfc_normalize``.  Case, accents and spelling stay, for a reader sees them.

Defined results: null gives null, the empty text gives itself, a text of invisible characters only gives the empty
text; texts of any length are mapped whole; the form of a form is itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiforge.operators.hotkeys import hot_keys, salted
from entiforge.plans.lineage import cut

# Letters drawn alike, Latin form first.
LOOK_ALIKE = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚK", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү",
    "Ë": "Ё", "ë": "ё", "Ï": "ЇΪ", "ï": "ї", "È": "Ѐ", "è": "ѐ", "Ÿ": "Ϋ", "Ó": "Ό", "ó": "ό", "Å": "Å", "'": "’ʼ‘", "-": "‐‑",
}
#: Characters without a picture: soft hyphen, joiners, direction marks, fillers, variation selectors, tags.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}]"
BLANKS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


#: Kinds of compatibility forms that are drawn like their plain letters (raised, lowered, circled and fraction forms are not).
SAME_PICTURE = ("<wide>", "<narrow>", "<font>", "<compat>")


@lru_cache(None)
def _compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """``(one character -> one, one -> several)`` from the Unicode data: wide, narrow, font and ligature forms of ASCII
    characters and of Latin letters."""
    single, several = {}, {}
    for code in range(0xA1, 0x20000):
        ch = chr(code)
        kind = unicodedata.decomposition(ch).split(" ")[0]
        if kind not in SAME_PICTURE:
            continue
        plain = unicodedata.normalize("NFKC", ch)
        if len(plain) == 1 and "!" <= plain <= "~":
            single[ch] = plain
        elif len(plain) > 1 and all(c.isalpha() and c < "\u0250" for c in plain):
            several[ch] = plain
    return single, several


def _translations() -> tuple[tuple[str, str], tuple[str, str]]:
    """Source and target alphabets: wide forms and look-alikes, which are common, and the rarer compatibility forms."""
    single = _compatibility()[0]
    common = {c: p for c, p in single.items() if unicodedata.decomposition(c).startswith("<wide>")} | {alike: form for form, alikes in LOOK_ALIKE.items() for alike in alikes}
    rare = {c: p for c, p in single.items() if c not in common}
    return ("".join(common), "".join(common.values())), ("".join(rare), "".join(rare.values()))


def form_expression(column: str) -> str:
    """The embedded SQL expression of the visual form of ``column``.  What few texts hold is only done where a text
    holds it: an alphabet of a thousand letters is set up anew for each text."""
    (src, dst), (rare, plain) = ((x.replace("'", "''"), y.replace("'", "''")) for x, y in _translations())
    several = _compatibility()[1]
    written_out = f"translate({column}, '{rare}', '{plain}')"
    for lig, letters in several.items():
        written_out = f"replace({written_out}, '{lig}', '{letters}')"
    e = f"CASE WHEN regexp_matches({column}, '[{rare}{''.join(several)}]') THEN {written_out} ELSE {column} END"
    e = f"translate(regexp_replace({e}, '{INVISIBLE}', '', 'g'), '{src}', '{dst}')"
    e = f"nfc_normalize({e})"
    # a base letter from another script may only now, composed, have become one letter with its accent
    e = f"translate({e}, '{src}', '{dst}')"
    return f"trim(regexp_replace({e}, '{BLANKS}+', ' ', 'g'))"


def with_visual_form(df: DataFrame, column: str, out: str = "visual_form") -> DataFrame:
    """``df`` with the visual form of ``column``; the other columns pass through unread."""
    source = f'"{column}"'.replace("'", "''")
    sql = f"SELECT *, {form_expression(source)} AS \"{out}\" FROM batch"
    names = [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": "1", "memory_limit": "256MB"})
        try:
            for b in batches:
                con.register("batch", pa.Table.from_batches([b]))
                got = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from pa.table({n: got.column(i) for i, n in enumerate(names)}).to_batches()
        finally:
            con.close()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string"
    return df.mapInArrow(run, ddl)


def name_forms(names: DataFrame, column: str = "author_name") -> DataFrame:
    """``(column, visual_form)`` of each distinct non-null value: equal names are mapped once, and a hot name is one
    row from here on.  Plain ASCII without runs of blanks is its own form and never leaves the JVM."""
    distinct = names.select(column).where(F.col(column).isNotNull()).distinct()
    plain = F.col(column).rlike(r"^(?:[!-~]+(?: [!-~]+)*)?$")
    return with_visual_form(distinct.where(~plain), column).unionByName(distinct.where(plain).withColumn("visual_form", F.col(column)))


def look_alike_classes(rows: DataFrame, column: str = "author_name") -> DataFrame:
    """``(visual_form, n_values, n_rows)`` of each non-empty form that several stored values share: the compact result,
    which grows with the values, not with the pairs of rows."""
    forms = cut(name_forms(rows, column), "forms")
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    classes = forms.where(F.col("visual_form") != "").join(counts, column).groupBy("visual_form").agg(F.count(F.lit(1)).alias("n_values"), F.sum("__n").alias("n_rows"))
    return classes.where("n_values > 1")


def look_alike_pairs(rows: DataFrame, id_col: str, column: str = "author_name") -> DataFrame:
    """``(<id>_a, <id>_b)``, a < b: rows whose values differ but have one non-empty visual form.

    Only forms with several stored values are expanded, and only between different values: copies of one value are
    never paired with each other, and rows of a hot value are spread over many tasks.  Ids delivered several times
    count once.  :func:`look_alike_classes` says the same without the pairs.
    """
    forms = cut(name_forms(rows, column), "forms")
    several = forms.where(F.col("visual_form") != "").groupBy("visual_form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("visual_form")
    shared = cut(forms.join(several, "visual_form"), "shared_forms")
    left = shared.select("visual_form", F.col(column).alias("value_a"))
    right = shared.select("visual_form", F.col(column).alias("value_b"))
    values = left.join(right, "visual_form").where("value_a < value_b").select("value_a", "value_b")
    hot = hot_keys(rows.select(column), column)
    kept = cut(salted(rows.select(id_col, column), shared.select(column), column, hot).distinct(), "shared_rows")
    a = kept.select(F.col(id_col).alias("x"), F.col(column).alias("value_a"))
    b = kept.select(F.col(id_col).alias("y"), F.col(column).alias("value_b"))
    half = salted(a, values, "value_a", hot).select("x", "value_b")
    both = salted(half, b, "value_b", hot).where("x <> y")
    return both.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))
