"""Queries of the name functions and blocking keys, over the distinct stored names and whole signature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entiforge.functions import names as nm
from entiforge.functions.phonetic import encode_tokens
from entiforge.operators import blocking
from entiforge.plans.skew_queries import SIGNATURE_SQL
from entiforge.sources.tables import signatures, table


def distinct_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "signature").select("author_name").where(F.col("author_name").isNotNull()).distinct()


def asciify(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_names(spark, folder).select("author_name", nm.asciify(F.col("author_name")).alias("ascii_name"))


def normalize_name(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("author_name")
    return distinct_names(spark, folder).select("author_name", nm.normalize_name(n).alias("normal_name"), nm.normalize_name(n, drop_common_affixes=False).alias("with_affixes"))


def name_initials(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_names(spark, folder).select("author_name", F.array_join(nm.name_initials(nm.asciify(F.col("author_name"))), "").alias("initials"))


def given_names(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("author_name")
    return distinct_names(spark, folder).select("author_name", nm.given_name(n, 0).alias("first_given"), nm.given_name(n, 1).alias("second_given"))


def given_initials(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("author_name")
    return distinct_names(spark, folder).select("author_name", nm.given_name_initial(n, 0).alias("first_initial"), nm.given_name_initial(n, 1).alias("second_initial"))


def tokenize_name(spark: SparkSession, folder: str) -> DataFrame:
    t = distinct_names(spark, folder).withColumn("t", nm.tokenize_name(F.col("author_name")))
    return t.select("author_name", F.array_join("t.surnames", "|").alias("surnames"), F.array_join("t.given", "|").alias("given"))


def block_lnfi(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per last-name-first-initial block."""
    s = table(spark, folder, "signature").where(F.col("author_name").isNotNull())
    return blocking.with_block(s, "last_name_first_initial").groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"))


SPLIT_AT = 100


def block_size_split(spark: SparkSession, folder: str) -> DataFrame:
    """Upstream blocks above 100 rows split by initial: rows per key."""
    b = table(spark, folder, "block_clustering").where("blocks_ IS NOT NULL").select("signature_id", F.col("blocks_").alias("block"))
    j = b.join(signatures(spark, folder).select("signature_id", F.coalesce("author_name", F.lit("")).alias("author_name")), "signature_id")
    return blocking.split_blocks(j, SPLIT_AT).groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"))


def block_phonetic(spark: SparkSession, folder: str) -> DataFrame:
    """Each named signature with its phonetic block."""
    s = signatures(spark, folder).where(F.length("author_name") > 0).select(F.col("signature_id").alias("row_id"), "author_name")
    return blocking.block_phonetic(s, threshold=1000).select("row_id", "block")


def phonetic_tokens(spark: SparkSession, folder: str) -> DataFrame:
    t = blocking.phonetic_tokens(distinct_names(spark, folder), "author_name", "nysiis")
    return t.select("author_name", F.array_join("s", "|").alias("surname_codes"), F.array_join("g", "|").alias("given_codes"))


def block_single(spark: SparkSession, folder: str) -> DataFrame:
    return blocking.with_block(table(spark, folder, "signature"), "single").groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"))


def soundex_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code of each distinct name token."""
    t = distinct_names(spark, folder).withColumn("t", nm.tokenize_name(F.col("author_name"))).select(F.explode(F.concat("t.surnames", "t.given")).alias("token"))
    return encode_tokens(t, "token", "soundex")


QUERIES = {
    "soundex_codes": soundex_codes,
    "asciify": asciify,
    "normalize_name": normalize_name,
    "name_initials": name_initials,
    "given_names": given_names,
    "given_initials": given_initials,
    "tokenize_name": tokenize_name,
    "block_single": block_single,
    "block_lnfi": block_lnfi,
    "block_size_split": block_size_split,
    "block_phonetic": block_phonetic,
    "phonetic_tokens": phonetic_tokens,
}


# --- the same in SQL ------------------------------------------------------------------------------------------------
def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_asciify(c: str) -> str:
    src, dst = nm.letter_table()
    e = f"translate({c}, {_q(src)}, {_q(dst)})"
    for ch, out in nm.SEVERAL.items():
        e = f"replace({e}, {_q(ch)}, {_q(out)})"
    return f"(CASE WHEN regexp_matches({c}, '^[\\x00-\\x7f]*$') THEN {c} ELSE regexp_replace({e}, '[^\\x00-\\x7f]+', '', 'g') END)"


_AFFIXES = "[" + ", ".join(_q(a) for a in nm.AFFIXES) + "]"


def sql_normalized(source: str, c: str = "author_name", drop: bool = True) -> str:
    """A query giving ``(c, v)`` for the rows of ``source``."""
    kept = f"list_filter(string_split(first, ' '), lambda w: NOT list_contains({_AFFIXES}, w))"
    last = f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, '') ELSE first END" if drop else "regexp_replace(first, '\\s', '', 'g')"
    return f"""(SELECT {c}, trim(regexp_replace(concat({last}, ', ', rest), ',\\s(?:i{{1,3}}|iv|v|vi|jr)|[.''\\-,\\s]+', ' ', 'g')) AS v FROM (
SELECT *, CASE WHEN instr(clean, ',') > 0 THEN string_split(clean, ',')[1] WHEN len(string_split(clean, ' ')) > 1 THEN string_split(clean, ' ')[-1] ELSE clean END AS first,
  CASE WHEN instr(clean, ',') > 0 THEN substr(clean, instr(clean, ',') + 1) WHEN len(string_split(clean, ' ')) > 1 THEN array_to_string(string_split(clean, ' ')[:-2], ' ') ELSE '' END AS rest
FROM (SELECT *, regexp_replace(lower({sql_asciify(c)}), '[^a-z,\\s]+', ' ', 'g') AS clean FROM {source})))"""


_NAMES = "(SELECT DISTINCT author_name FROM signature WHERE author_name IS NOT NULL)"


def sql_block(v: str) -> str:
    """Block key of a normalised name."""
    first, rest = f"string_split({v}, ' ')[1]", f"trim(CASE WHEN instr({v}, ' ') > 0 THEN substr({v}, instr({v}, ' ') + 1) END)"
    return f"(CASE WHEN length({rest}) > 0 THEN concat({first}, ' ', substr({rest}, 1, 1)) ELSE {first} END)"


def _given(i: int) -> str:
    return f"coalesce(CASE WHEN instr(author_name, ',') > 0 THEN string_split(trim(string_split(author_name, ',')[2]), ' ')[{i + 1}] ELSE string_split(author_name, ' ')[{i + 1}] END, '')"


def _initial(i: int) -> str:
    part = f"string_split(trim(lower({sql_asciify('part')})), ' ')[{i + 1}]"
    return f"coalesce(regexp_extract({part}, '(\\w)', 1), '')"


def _fallback(main: str) -> str:
    return f"CASE WHEN {main} <> '' THEN {main} WHEN len(string_split(author_name, ' ')) > 1 THEN coalesce(regexp_extract(lower({sql_asciify('word')}), '(\\w)', 1), '') ELSE '' END"


_PARTS = f"(SELECT author_name, string_split(author_name, ',')[2] AS part, string_split(author_name, ' ')[1] AS word FROM {_NAMES})"

SQL = {
    "asciify": f"SELECT author_name, {sql_asciify('author_name')} AS ascii_name FROM {_NAMES}",
    "normalize_name": f"SELECT a.author_name, a.v AS normal_name, b.v AS with_affixes FROM {sql_normalized(_NAMES)} a JOIN {sql_normalized(_NAMES, drop=False)} b USING (author_name)",
    "name_initials": f"""SELECT author_name, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array({sql_asciify('author_name')}, '\\s+'),
  lambda w: w <> ''), lambda w: substr(w, 1, 1)))), '') AS initials FROM {_NAMES}""",
    "given_names": f"SELECT author_name, {_given(0)} AS first_given, {_given(1)} AS second_given FROM {_NAMES}",
    "given_initials": f"SELECT author_name, {_fallback('m0')} AS first_initial, m1 AS second_initial FROM (SELECT *, {_initial(0)} AS m0, {_initial(1)} AS m1 FROM {_PARTS})",
    "tokenize_name": f"""
WITH c AS (SELECT author_name, string_split(replace(regexp_replace(regexp_replace({sql_asciify('author_name')}, '[^a-zA-Z'',\\s]+', ' ', 'g'),
    '^([^'',]*)''([a-z])', '\\1\\2'), '''', ' '), ',') AS p FROM {_NAMES}),
t AS (SELECT author_name, string_split(lower(trim(regexp_replace(p[1], '\\s+', ' ', 'g'))), ' ') AS sur,
  string_split(lower(trim(regexp_replace(array_to_string(p[2:], ''), '\\s+', ' ', 'g'))), ' ') AS giv FROM c),
u AS (SELECT author_name, CASE WHEN giv = [''] AND len(sur) > 1 THEN sur[2:] ELSE sur END AS s, CASE WHEN giv = [''] AND len(sur) > 1 THEN sur[:1] ELSE giv END AS g FROM t)
SELECT author_name, array_to_string(CASE WHEN len(list_filter(s, lambda w: NOT list_contains({_AFFIXES}, w))) > 0
  THEN list_filter(s, lambda w: NOT list_contains({_AFFIXES}, w)) ELSE s END, '|') AS surnames, array_to_string(g, '|') AS given FROM u""",
    "block_single": "SELECT '0' AS block, count(*) AS n_rows FROM signature",
    "block_lnfi": f"SELECT {sql_block('v')} AS block, count(*) AS n_rows FROM signature JOIN {sql_normalized(_NAMES)} USING (author_name) GROUP BY 1",
    "block_size_split": f"""
WITH {SIGNATURE_SQL}, b AS (SELECT blocks_ AS block, coalesce(author_name, '') AS author_name FROM block_clustering JOIN sig USING (signature_id) WHERE blocks_ IS NOT NULL),
x AS (SELECT *, count(*) OVER (PARTITION BY block) AS n, string_split(author_name, ',')[2] AS part, string_split(author_name, ' ')[1] AS word FROM b),
i AS (SELECT *, {_initial(0)} AS m0 FROM x)
SELECT CASE WHEN n > {SPLIT_AT} THEN concat(block, {_fallback('m0')}) ELSE block END AS block, count(*) AS n_rows FROM i GROUP BY 1""",
}

_ONE_DIGIT = "d"
for _digit in "0123456":
    _ONE_DIGIT = f"regexp_replace({_ONE_DIGIT}, '{_digit}+', '{_digit}', 'g')"
SQL["soundex_codes"] = f"""WITH k AS ({SQL["tokenize_name"]}), e AS (SELECT DISTINCT unnest(list_concat(string_split(surnames, '|'), string_split(given, '|'))) AS token FROM k),
b AS (SELECT token, upper(regexp_replace(token, '[^a-z]', '', 'g')) AS w FROM e),
x AS (SELECT token, w, translate(concat(substr(w, 1, 1), regexp_replace(substr(w, 2), '[HW]', '', 'g')), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000') AS d FROM b)
SELECT token, CASE WHEN w = '' THEN '' ELSE concat(substr(w, 1, 1), substr(concat(replace(substr({_ONE_DIGIT}, 2), '0', ''), '0000'), 1, 4)) END AS code FROM x"""
