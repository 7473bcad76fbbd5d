"""Name functions as column expressions: they stay inside the JVM, and the same tables give the checking SQL.

All functions give null for null.  Names of any length and script are allowed; letters without a known transliteration
are dropped by :func:`asciify`.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Surname affixes that are dropped.
AFFIXES = (
    "a ab abu al am ap auf aus bar bat bath ben bet bin bint d da dall dalla das de degli del dell della dem den der di do dos ds du e el i ibn im "
    "jr l la las le los m mac mc mhic mic o ter und v van vom von zu zum zur"
).split()
# Letters that become several letters, or that decomposition leaves whole.
SEVERAL = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ", "ﬁ": "fi", "ﬂ": "fl", "ﬆ": "st", "ﬀ": "ff",
    "ж": "zh", "Ж": "Zh", "х": "kh", "Х": "Kh", "ц": "ts", "Ц": "Ts", "ч": "ch", "Ч": "Ch", "ш": "sh", "Ш": "Sh", "щ": "shch", "Щ": "Shch",
    "ю": "iu", "Ю": "Iu", "я": "ia", "Я": "Ia", "є": "ie", "Є": "Ie",
}
ONE = dict(zip("øØłŁđĐðÐıħĦŧŦŋŊĸабвгдеёзийклмнопрстуфыэґії’ʼ‘–—‐", "oOlLdDdDihHtTnNkabvgdeeziiklmnoprstufyegii'''---"))
ONE |= {k.upper(): v.upper() for k, v in ONE.items() if "а" <= k <= "ё" or k in "ґії"}


@lru_cache(None)
def letter_table() -> tuple[str, str]:
    """Source and target alphabets of one-to-one transliteration: by rule every accented or compatibility character
    whose decomposition is one ASCII character, plus the fixed letters."""
    pairs = {}
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), 0x3000, *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            pairs[chr(cp)] = base
    pairs |= ONE
    return "".join(pairs), "".join(pairs.values())


def asciify(col: Column) -> Column:
    """ASCII form: accents off, letters transliterated, the rest dropped."""
    src, dst = letter_table()
    c = F.translate(col, src, dst)
    for ch, out in SEVERAL.items():
        c = F.replace(c, F.lit(ch), F.lit(out))
    return F.when(col.rlike(r"^[\x00-\x7f]*$"), col).otherwise(F.regexp_replace(c, r"[^\x00-\x7f]+", ""))


def _affix_array() -> Column:
    return F.array(*[F.lit(a) for a in AFFIXES])


def normalize_name(name: Column, drop_common_affixes: bool = True, strict_suffix: bool = False) -> Column:
    """``"surname given"`` in lower-case ASCII with the surname's words joined.

    By default a suffix pattern is cut out wherever it follows a comma and one blank, even inside a word, as the
    original rules have it; ``strict_suffix`` cuts whole words only.
    """
    clean = F.regexp_replace(F.lower(asciify(name)), r"[^a-z,\s]+", " ")
    comma = F.instr(clean, ",")
    words = F.split(clean, " ")
    n = F.size(words)
    first = F.when(comma > 0, F.substring_index(clean, ",", 1)).when(n > 1, F.element_at(words, -1)).otherwise(clean)
    rest = F.when(comma > 0, F.substr(clean, comma + 1)).when(n > 1, F.array_join(F.slice(words, 1, n - 1), " ")).otherwise(F.lit(""))
    if drop_common_affixes:
        kept = F.filter(F.split(first, " "), lambda w: ~F.array_contains(_affix_array(), w))
        last = F.when(F.size(kept) > 0, F.array_join(kept, "")).otherwise(first)
    else:
        last = F.regexp_replace(first, r"\s", "")
    suffix = r",\s(?:i{1,3}|iv|v|vi|jr)" + (r"\b" if strict_suffix else "")
    return F.trim(F.regexp_replace(F.concat(last, F.lit(", "), rest), rf"{suffix}|[.'\-,\s]+", " "))


def name_initials(name: Column) -> Column:
    """Distinct first characters of the blank-separated words, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(name, r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1))))


def given_name(name: Column, index: int = 0) -> Column:
    """Word ``index`` of the given names (between first and second comma; without comma of the whole name), or ``""``."""
    # any script's blanks are stripped, but only plain blanks separate words
    stripped = F.regexp_replace(F.get(F.split(name, ","), F.lit(1)), r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")
    with_comma = F.get(F.split(stripped, " "), F.lit(index))
    without = F.get(F.split(name, " "), F.lit(index))
    return F.when(name.isNull(), None).otherwise(F.coalesce(F.when(F.instr(name, ",") > 0, with_comma).otherwise(without), F.lit("")))


def given_name_initial(name: Column, index: int = 0) -> Column:
    """First word character of given name ``index`` in lower-case ASCII, or ``""``; for index 0 a name without one
    falls back to its first blank-separated word, if it has several."""
    part = F.trim(F.lower(asciify(F.get(F.split(name, ","), F.lit(1)))))
    main = F.regexp_extract(F.coalesce(F.get(F.split(part, " "), F.lit(index)), F.lit("")), r"(\w)", 1)
    if index > 0:
        return F.when(name.isNull(), None).otherwise(F.coalesce(main, F.lit("")))
    words = F.split(name, " ")
    back = F.when(F.size(words) > 1, F.regexp_extract(F.lower(asciify(F.get(words, F.lit(0)))), r"(\w)", 1)).otherwise(F.lit(""))
    return F.when(name.isNull(), None).when(main != "", main).otherwise(F.coalesce(back, F.lit("")))


def tokenize_name(name: Column, handle_soft_sign: bool = True, drop_common_affixes: bool = True) -> Column:
    """``struct<surnames array<string>, given array<string>>`` of lower-case tokens."""
    c = F.regexp_replace(asciify(name), r"[^a-zA-Z',\s]+", " ")
    if handle_soft_sign:
        c = F.regexp_replace(c, r"^([^',]*)'(?=[a-z])", "$1")
    c = F.replace(c, F.lit("'"), F.lit(" "))
    parts = F.split(c, ",")

    def words(x: Column) -> Column:
        return F.split(F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))), " ")

    sur = words(F.get(parts, F.lit(0)))
    giv = words(F.array_join(F.slice(parts, 2, 1000000), ""))
    bare = giv == F.array(F.lit(""))
    surnames = F.when(bare & (F.size(sur) > 1), F.slice(sur, 2, 1000000)).otherwise(sur)
    given = F.when(bare & (F.size(sur) > 1), F.slice(sur, 1, 1)).otherwise(giv)
    if drop_common_affixes:
        kept = F.filter(surnames, lambda w: ~F.array_contains(_affix_array(), w))
        surnames = F.when(F.size(kept) > 0, kept).otherwise(surnames)
    return F.when(name.isNotNull(), F.struct(surnames.alias("surnames"), given.alias("given")))


def block_last_name_first_initial(name: Column) -> Column:
    """Blocking key ``"surname initial"`` of a name."""
    n = normalize_name(name)
    rest = F.trim(F.when(F.instr(n, " ") > 0, F.substr(n, F.instr(n, " ") + 1)))
    return F.when(F.length(rest) > 0, F.concat(F.substring_index(n, " ", 1), F.lit(" "), F.substring(rest, 1, 1))).otherwise(F.substring_index(n, " ", 1))
