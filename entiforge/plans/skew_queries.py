"""Queries of the skewed-key operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entiforge.operators.hotkeys import heavy_hitters, key_profile, skew_join
from entiforge.sources.tables import signatures, table

#: A value is hot when it is in more than this share of its table's rows.
HOT_SHARE = 0.025


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, field in (("signature", "author_name"), ("block_clustering", "blocks_")):
        hot = heavy_hitters(table(spark, folder, name), field, HOT_SHARE)
        parts.append(hot.select(F.lit(field).alias("field_name"), "hot_key"))
    return parts[0].unionByName(parts[1])


def p1_block_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Size, distinct names and leading name of every block."""
    blocks = table(spark, folder, "block_clustering").select("signature_id", "blocks_")
    names = signatures(spark, folder).select("signature_id", "author_name")
    return key_profile(blocks.join(names, "signature_id", "left"), "blocks_", "author_name")


def p1_name_block_join(spark: SparkSession, folder: str) -> DataFrame:
    """How many signatures carry each (name, block), with the total of their name joined from the name table through
    the skew join: within-block work whose hot keys are spread."""
    s = signatures(spark, folder).select("signature_id", "author_name").where(F.col("author_name").isNotNull())
    totals = s.groupBy("author_name").agg(F.count(F.lit(1)).alias("name_rows"))
    b = table(spark, folder, "block_clustering").select("signature_id", "blocks_")
    joined = skew_join(s.join(b, "signature_id"), totals, "author_name")
    return joined.groupBy("author_name", "blocks_").agg(F.count(F.lit(1)).alias("pair_rows"), F.max("name_rows").alias("name_rows"))


QUERIES = {"p1_found": p1_found, "p1_block_profile": p1_block_profile, "p1_name_block_join": p1_name_block_join}

SIGNATURE_SQL = """sig AS (SELECT signature_id, author_name, author_affiliation, publication_id, received_at FROM (
  SELECT *, row_number() OVER (PARTITION BY signature_id ORDER BY coalesce(length(author_affiliation), 0) = 0, received_at,
    author_affiliation NULLS FIRST, author_name NULLS FIRST, publication_id) AS rn FROM signature) WHERE rn = 1)"""

SQL = {
    "p1_found": """
WITH n AS (SELECT 'author_name' AS field_name, author_name AS hot_key, count(*) AS n FROM signature GROUP BY 2
  UNION ALL SELECT 'blocks_', blocks_, count(*) FROM block_clustering GROUP BY 2)
SELECT field_name, hot_key FROM (SELECT *, sum(n) OVER (PARTITION BY field_name) AS total FROM n)
WHERE hot_key IS NOT NULL AND n > 0.025 * total""",
    "p1_block_profile": f"""
WITH {SIGNATURE_SQL}, c AS (SELECT blocks_, author_name, count(*) AS n FROM block_clustering LEFT JOIN sig USING (signature_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY blocks_ ORDER BY author_name IS NULL, n DESC, encode(author_name)) AS rn FROM c)
SELECT blocks_, CAST(sum(n) AS BIGINT) AS n_rows, count(author_name) AS n_items, max(CASE WHEN rn = 1 THEN author_name END) AS top_item,
  CAST(coalesce(max(CASE WHEN rn = 1 AND author_name IS NOT NULL THEN n END), 0) AS BIGINT) AS top_rows FROM r GROUP BY 1""",
    "p1_name_block_join": f"""
WITH {SIGNATURE_SQL}, t AS (SELECT author_name, count(*) AS name_rows FROM sig WHERE author_name IS NOT NULL GROUP BY 1)
SELECT author_name, blocks_, count(*) AS pair_rows, max(name_rows) AS name_rows
FROM sig JOIN block_clustering USING (signature_id) JOIN t USING (author_name) GROUP BY 1, 2""",
}
