"""Queries of the operators for training data, and the SQL to check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entiforge.llm import encoding, leakage, packing, splits, toxicity, variants, visual
from entiforge.plans.lineage import cut
from entiforge.sources.tables import labels, signatures, table


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each named signature with the entity its spelling is attributed to."""
    return variants.entities(signatures(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    unknown = labels(spark, folder).where("labels_true = -1").select(F.col("row_id").alias("signature_id"))
    return variants.variant_pairs(p2_entities(spark, folder).join(unknown, "signature_id"))


def _ties(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    blocks = table(spark, folder, "block_clustering").select(F.col("signature_id").alias("record"), F.col("blocks_").alias("block"))
    authors = labels(spark, folder).select(F.col("row_id").alias("record"), F.col("labels_true").alias("author"))
    return blocks, authors


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = splits.block_groups(*_ties(spark, folder))
    return groups.where("block <> group_block").select(F.col("group_block").alias("lead_block"), F.col("block").alias("tied_block"))


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Each signature with its group and split (80 : 10 : 10)."""
    return splits.split_records(table(spark, folder, "signature").select(F.col("signature_id").alias("record")), *_ties(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return visual.look_alike_pairs(table(spark, folder, "signature").select("signature_id", "author_name"), "signature_id")


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Each stored name with its consistent form."""
    return visual.name_forms(table(spark, folder, "signature"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each form shared by several stored names, with how many names and rows."""
    return visual.look_alike_classes(table(spark, folder, "signature").select("author_name"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled_rows(table(spark, folder, "signature"), "signature_id").select("signature_id")


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Each garbled signature with its original name where it can be recovered, and the mix-up undone."""
    return encoding.garbled_rows(table(spark, folder, "signature"), "signature_id")


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Each document, or piece of one larger than a container, with its container and place in it."""
    return packing.pack_documents(table(spark, folder, "documents"), table(spark, folder, "containers"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_unused_room(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, unused room and the least number of containers, for each kind of container."""
    documents, containers = table(spark, folder, "documents"), table(spark, folder, "containers")
    sized = cut(packing.count_tokens(documents), "sized")
    out = None
    for row in containers.where("capacity_tokens > 0").orderBy("container_kind").collect():  # one row a kind
        one = packing.unused_room(packing.pack(sized, row.capacity_tokens), row.capacity_tokens).withColumn("container_kind", F.lit(row.container_kind))
        out = one if out is None else out.unionByName(one)
    return out


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Each leak with the words given away and the longest verbatim run."""
    return _leaks(spark, folder).drop("spans")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with leaks, freed of the spans above the limits."""
    return leakage.remove_leaks(table(spark, folder, "documents"), cut(_leaks(spark, folder), "leaks"))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score."""
    documents = table(spark, folder, "documents")
    return toxicity.score_documents(documents, toxicity.fit(table(spark, folder, "reviewed_posts"), documents))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).where("toxic_windows > 0").select("doc_id")


def p8_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of such documents per source."""
    documents = table(spark, folder, "documents")
    return toxicity.source_rates(documents, cut(p8_scores(spark, folder), "scored"))


QUERIES = {
    "p2_found": p2_found,
    "p2_entities": p2_entities,
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p6_packing": p6_packing,
    "p6_unused_room": p6_unused_room,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_cleaned": p7_cleaned,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_source_rates": p8_source_rates,
}

_FORMS = f"forms AS MATERIALIZED (SELECT author_name, {visual.form_expression('author_name')} AS visual_form FROM (SELECT DISTINCT author_name FROM signature WHERE author_name IS NOT NULL))"

SQL: dict[str, str] = {
    "p4_forms": f"WITH {_FORMS} SELECT author_name, visual_form FROM forms",
    "p4_found": f"""
WITH {_FORMS}, s AS (SELECT DISTINCT signature_id, author_name, visual_form FROM signature JOIN forms USING (author_name) WHERE visual_form <> '')
SELECT a.signature_id AS signature_id_a, b.signature_id AS signature_id_b FROM s a JOIN s b USING (visual_form)
WHERE a.signature_id < b.signature_id AND a.author_name <> b.author_name""",
    "p4_classes": f"""
WITH {_FORMS}, n AS (SELECT author_name, count(*) AS n FROM signature GROUP BY 1)
SELECT visual_form, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_rows FROM forms JOIN n USING (author_name) WHERE visual_form <> '' GROUP BY 1 HAVING count(*) > 1""",
    "p3_found": """
WITH RECURSIVE lab AS (SELECT row_id, max(labels_true) AS a FROM metric_labels GROUP BY 1 HAVING max(labels_true) >= 0),
ties AS (SELECT DISTINCT b.blocks_ AS block, l.a FROM block_clustering b JOIN lab l ON l.row_id = b.signature_id WHERE b.blocks_ IS NOT NULL),
e AS (SELECT DISTINCT x.block AS s, y.block AS d FROM ties x JOIN ties y USING (a) WHERE x.block <> y.block),
r AS (SELECT s AS v, s AS lead FROM e UNION SELECT e.d, r.lead FROM r JOIN e ON e.s = r.v)
SELECT min(lead) AS lead_block, v AS tied_block FROM r GROUP BY v HAVING min(lead) < v""",
}
