"""Queries of the clustering operators and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entiforge.functions import names as nm
from entiforge.functions import strsim
from entiforge.operators import cluster as cl
from entiforge.operators import linkage as lk
from entiforge.operators import metrics as mt
from entiforge.operators import pairs as pr
from entiforge.plans.lineage import cut
from entiforge.plans.name_queries import distinct_names
from entiforge.plans.pair_queries import _PW
from entiforge.sources.tables import labels, table


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return labels(spark, folder).where("labels_true >= 0").select("row_id", F.col("labels_true").alias("label_true"), F.col("labels_pred").alias("label_pred"))


def b3_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = mt.b3_precision_recall_fscore(_known(spark, folder))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


def paired_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = mt.paired_precision_recall_fscore(_known(spark, folder))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


def merge_distance(spark: SparkSession, folder: str) -> DataFrame:
    return mt.unit_merge_distance(_known(spark, folder))


def merge_distance_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Merge distance with the product of the parts' sizes as cost of a split, and 1 for a merge."""
    return mt.merge_distance(_known(spark, folder), lambda a, b: float(a * b), lambda a, b: 1.0)


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def _vector_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine distances within labels; vectors are brought to unit length once each, so a pair costs one product."""
    norm = F.sqrt(pr.dot(F.col("v"), F.col("v")))
    v = _vectors(spark, folder).withColumn("norm", norm).select("row_id", F.col("label").alias("block"), F.transform("v", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)).alias("v"))
    p = pr.block_pairs(v, "block", "row_id", ["v"])
    return p.select("block", F.col("l_row_id").alias("i"), F.col("r_row_id").alias("j"), (1 - pr.dot(F.col("l_v"), F.col("r_v"))).alias("dist"))


def silhouette(spark: SparkSession, folder: str) -> DataFrame:
    return mt.silhouette_cosine(_vectors(spark, folder).withColumnRenamed("row_id", "id")).select(F.round("silhouette", 6).alias("silhouette"))


def cluster_single_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Single-linkage clusters of normalised names within their surname at two edits."""
    names = distinct_names(spark, folder).select(nm.normalize_name(F.col("author_name")).alias("row_id")).distinct().where("row_id <> ''").withColumn("block", F.substring_index("row_id", " ", 1))
    p = pr.block_pairs(names, "block", "row_id", [])
    d = p.select("block", F.col("l_row_id").alias("i"), F.col("r_row_id").alias("j"), strsim.levenshtein(F.col("l_row_id"), F.col("r_row_id")).cast("double").alias("dist"))
    return cl.cluster_threshold(names, d, 2.0)


def cluster_average_threshold(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder).withColumn("block", F.col("label"))
    return cl.cluster_threshold(v, _vector_distances(spark, folder), 0.8, method="average")


def _model(spark: SparkSession, folder: str, method: str, **how) -> DataFrame:
    v = _vectors(spark, folder).withColumn("block", F.col("label")).select("row_id", "block")
    return cl.fit_blocks(v, _vector_distances(spark, folder), method, **how)


def cluster_complete(spark: SparkSession, folder: str) -> DataFrame:
    return cl.global_labels(cl.cut_blocks(_model(spark, folder, "complete", threshold=0.9)))


def cluster_average(spark: SparkSession, folder: str) -> DataFrame:
    return cl.global_labels(cl.cut_blocks(_model(spark, folder, "average", threshold=0.9)))


def cluster_ward_count(spark: SparkSession, folder: str) -> DataFrame:
    """Four clusters in each block."""
    return cl.cut_blocks(_model(spark, folder, "ward"), n_clusters=4)


def threshold_search(spark: SparkSession, folder: str) -> DataFrame:
    """Each block's best threshold by silhouette, and the number of clusters it gives."""
    m = cut(_model(spark, folder, "average", unsupervised=lk.silhouette_score), "model")
    n = cl.cut_blocks(m).groupBy("block").agg((F.max("label") + 1).alias("n_clusters"))
    return m.join(n, "block").select("block", F.round("threshold", 6).alias("threshold"), "n_clusters")


def label_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Upstream local labels made global: blocks in sorted order."""
    b = table(spark, folder, "block_clustering").where("blocks_ IS NOT NULL AND local_label >= 0").select(F.col("signature_id").alias("row_id"), F.col("blocks_").alias("block"), F.col("local_label").alias("label"))
    return cl.global_labels(b).select("row_id", "block", "global_label")


def predict_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """Labels for all rows from a model that knows the blocks up to the letter m."""
    b = table(spark, folder, "block_clustering").where("blocks_ IS NOT NULL").select(F.col("signature_id").alias("row_id"), F.col("blocks_").alias("block"), F.col("local_label").alias("label"))
    known = b.where("block < 'n' AND label >= 0")
    return cl.predict_blocks(b.select("row_id", "block"), known.select("row_id", "block", "label"))


def linkage_heights(spark: SparkSession, folder: str) -> DataFrame:
    """Both merge heights of every three consecutive vectors, under each linkage method."""
    three = F.floor(F.col("row_id") / 3).alias("block")
    v = cut(_vectors(spark, folder).select("row_id", three, "v"), "threes")
    whole = v.join(v.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n = 3").select("block"), "block", "left_semi")
    p = pr.block_pairs(whole, "block", "row_id", ["v"])
    d = cut(p.select("block", F.col("l_row_id").alias("i"), F.col("r_row_id").alias("j"), (1 - pr.cosine_similarity(F.col("l_v"), F.col("r_v"))).alias("dist")), "distances")
    out = None
    for method in lk.METHODS:
        m = cl.fit_blocks(whole.select("row_id", "block"), d, method)
        one = m.select(F.lit(method).alias("method"), "block", F.round(F.get("tree", F.lit(0))["height"], 6).alias("first_height"), F.round(F.get("tree", F.lit(1))["height"], 6).alias("second_height"))
        out = one if out is None else out.unionByName(one)
    return out


def flat_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of every label's vectors by each criterion, from one average-linkage tree."""
    m = cut(_model(spark, folder, "average"), "model")
    kinds = {"distance": {"threshold": 0.9}, "n_clusters": {"n_clusters": 3}, "maxclust": {"threshold": 3, "criterion": "maxclust"}, "inconsistent": {"threshold": 0.5, "criterion": "inconsistent"}}
    out = None
    for kind, how in kinds.items():
        one = cl.cut_blocks(m, **how).groupBy("block").agg(F.count_distinct("label").alias("n_clusters")).select(F.lit(kind).alias("criterion"), "block", "n_clusters")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "linkage_heights": linkage_heights, "flat_cuts": flat_cuts,
    "b3_scores": b3_scores, "paired_scores": paired_scores, "merge_distance": merge_distance, "merge_distance_costs": merge_distance_costs, "silhouette": silhouette,
    "cluster_single_threshold": cluster_single_threshold, "cluster_average_threshold": cluster_average_threshold, "cluster_complete": cluster_complete,
    "cluster_average": cluster_average, "cluster_ward_count": cluster_ward_count, "threshold_search": threshold_search, "label_offsets": label_offsets,
    "predict_unknown": predict_unknown,
}

_CELLS = """k AS (SELECT row_id, max(labels_true) AS t, max(labels_pred) AS p FROM metric_labels GROUP BY 1 HAVING max(labels_true) >= 0),
c AS (SELECT t, p, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT t, sum(n) AS nt FROM c GROUP BY 1), s AS (SELECT p, sum(n) AS np FROM c GROUP BY 1)"""
_PAIR = "sum({0} * ({0} - 1) / 2)"

SQL = {
    "b3_scores": f"""WITH {_CELLS}, pr AS (SELECT sum(n * n / np) / sum(n) AS p, sum(n * n / nt) / sum(n) AS r FROM c JOIN r USING (t) JOIN s USING (p))
SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f_score FROM pr""",
    "paired_scores": f"""WITH {_CELLS}, pr AS (SELECT (SELECT {_PAIR.format('n')} FROM c) AS tp, (SELECT {_PAIR.format('nt')} FROM r) AS tt, (SELECT {_PAIR.format('np')} FROM s) AS pp),
q AS (SELECT CASE WHEN pp = 0 THEN 1 ELSE tp / pp END AS p, CASE WHEN tt = 0 THEN 1 ELSE tp / tt END AS r FROM pr)
SELECT round(p, 9) AS precision, round(r, 9) AS recall, CASE WHEN p + r = 0 THEN 0 ELSE round(2 * p * r / (p + r), 9) END AS f_score FROM q""",
    "merge_distance": f"WITH {_CELLS} SELECT CAST(2 * (SELECT count(*) FROM c) - (SELECT count(*) FROM r) - (SELECT count(*) FROM s) AS BIGINT) AS merge_distance",
    "merge_distance_costs": f"""WITH {_CELLS}, a AS (SELECT (np * np - sum(n * n)) / 2 AS cost FROM c JOIN s USING (p) GROUP BY p, np), b AS (SELECT count(*) - 1 AS cost FROM c GROUP BY t)
SELECT CAST((SELECT sum(cost) FROM a) + (SELECT sum(cost) FROM b) AS DOUBLE) AS merge_distance""",
    "silhouette": """WITH v AS MATERIALIZED (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id, a.label, b.label AS other, avg(1 - coalesce(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 0)) AS m
  FROM v a JOIN v b ON a.id <> b.id GROUP BY ALL),
s AS (SELECT id, max(CASE WHEN label = other THEN m END) AS a, min(CASE WHEN label <> other THEN m END) AS b FROM d GROUP BY 1)
SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM s""",
    "cluster_single_threshold": f"""WITH RECURSIVE {_PW}, e AS (SELECT l_name AS s, r_name AS d FROM pw WHERE distance <= 2 UNION ALL SELECT r_name, l_name FROM pw WHERE distance <= 2),
r AS (SELECT v, v AS lead, last FROM n UNION SELECT e.d, r.lead, r.last FROM r JOIN e ON e.s = r.v)
SELECT v AS row_id, last AS block, min(lead) AS cluster FROM r GROUP BY 1, 2""",
    "label_offsets": """WITH w AS (SELECT blocks_ AS block, max(local_label) + 1 AS k FROM block_clustering WHERE blocks_ IS NOT NULL AND local_label >= 0 GROUP BY 1),
o AS (SELECT block, coalesce(sum(k) OVER (ORDER BY encode(block) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM w)
SELECT signature_id AS row_id, block, CAST(local_label + off AS BIGINT) AS global_label FROM block_clustering JOIN o ON block = blocks_ WHERE local_label >= 0""",
    "predict_unknown": """WITH b AS (SELECT signature_id AS row_id, blocks_ AS block, local_label FROM block_clustering WHERE blocks_ IS NOT NULL),
w AS (SELECT block, max(local_label) + 1 AS k FROM b WHERE encode(block) < encode('n') AND local_label >= 0 GROUP BY 1),
o AS (SELECT block, coalesce(sum(k) OVER (ORDER BY encode(block) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM w)
SELECT row_id, b.block, CAST(CASE WHEN off IS NULL OR local_label < 0 THEN -1 ELSE local_label + off END AS BIGINT) AS label FROM b LEFT JOIN o ON o.block = b.block""",
}

def _agglomerate(height: str, until: str) -> str:
    """CTEs ``v, d`` and ``done(block, id, c)``: clusters (named by their smallest row) merged pair by pair, nearest
    first, while ``until`` holds; ``height`` is the linkage of two clusters over q (mean squares) and m, x of pairs."""
    return f"""v AS MATERIALIZED (SELECT vec_id AS id, label AS block, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS MATERIALIZED (SELECT a.block, a.id AS i, b.id AS j, CASE WHEN a.id = b.id THEN 0 ELSE 1 - coalesce(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 0) END AS dist FROM v a JOIN v b USING (block)),
s AS (SELECT 0 AS step, block, id, id AS c FROM v
  UNION ALL
  SELECT step + 1, s.block, id, CASE WHEN c = g.pick.hi THEN g.pick.lo ELSE c END FROM s JOIN (
    SELECT block, min_by(struct_pack(lo := lo, hi := hi), h) AS pick, min(h) AS h, max(k) AS k FROM (
      SELECT o.block, o.lo, o.hi, {height} AS h, k FROM (
        SELECT a.block, a.c AS lo, b.c AS hi, avg(dist) AS m, max(dist) AS x, avg(dist * dist) AS q, count(DISTINCT a.id) AS na, count(DISTINCT b.id) AS nb
        FROM s a JOIN s b ON a.block = b.block AND a.c < b.c JOIN d ON d.i = a.id AND d.j = b.id GROUP BY ALL) o
      JOIN (SELECT a.block, a.c, avg(dist * dist) AS q FROM s a JOIN s b ON a.block = b.block AND a.c = b.c JOIN d ON d.i = a.id AND d.j = b.id GROUP BY ALL) wa ON wa.block = o.block AND wa.c = lo
      JOIN (SELECT a.block, a.c, avg(dist * dist) AS q FROM s a JOIN s b ON a.block = b.block AND a.c = b.c JOIN d ON d.i = a.id AND d.j = b.id GROUP BY ALL) wb ON wb.block = o.block AND wb.c = hi
      JOIN (SELECT block, count(DISTINCT c) AS k FROM s GROUP BY 1) n ON n.block = o.block)
    GROUP BY block) g ON g.block = s.block WHERE {until}),
done AS (SELECT block, id, c FROM s JOIN (SELECT block, max(step) AS step FROM s GROUP BY 1) USING (block, step)),
lab AS (SELECT id AS row_id, CAST(block AS BIGINT) AS block, CAST(dense_rank() OVER (PARTITION BY block ORDER BY c) - 1 AS BIGINT) AS label, c FROM done),
wide AS (SELECT block, max(label) + 1 AS k FROM lab GROUP BY 1), off AS (SELECT block, coalesce(sum(k) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM wide)"""


_GLOBAL = "SELECT row_id, block, label, CAST(label + o AS BIGINT) AS global_label FROM lab JOIN off USING (block)"
_WARD = "sqrt(2.0 * na * nb / (na + nb) * (o.q - wa.q / 2 - wb.q / 2))"
SQL |= {
    "cluster_complete": f"WITH RECURSIVE {_agglomerate('x', 'g.h <= 0.9')} {_GLOBAL}",
    "cluster_average": f"WITH RECURSIVE {_agglomerate('m', 'g.h <= 0.9')} {_GLOBAL}",
    "cluster_average_threshold": f"WITH RECURSIVE {_agglomerate('m', 'g.h <= 0.8')} SELECT row_id, block, c AS cluster FROM lab",
    "cluster_ward_count": f"WITH RECURSIVE {_agglomerate(_WARD, 'g.k > 4')} SELECT row_id, block, label FROM lab",
    "linkage_heights": """WITH v AS (SELECT vec_id AS id, CAST(floor(vec_id / 3) AS BIGINT) AS block, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT block FROM v GROUP BY 1 HAVING count(*) = 3),
d AS (SELECT a.block, 1 - coalesce(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 0) AS x FROM v a JOIN v b ON a.block = b.block AND a.id < b.id WHERE a.block IN (SELECT block FROM f)),
h AS (SELECT block, list_sort(list(x)) AS x FROM d GROUP BY 1),
m AS (SELECT block, x[1] AS h, x[2] AS a, x[3] AS b FROM h),
r AS (SELECT *, unnest([struct_pack(method := 'single', h2 := a), struct_pack(method := 'complete', h2 := b), struct_pack(method := 'average', h2 := (a + b) / 2), struct_pack(method := 'weighted', h2 := (a + b) / 2),
  struct_pack(method := 'ward', h2 := sqrt((2 * a * a + 2 * b * b - h * h) / 3)), struct_pack(method := 'centroid', h2 := sqrt(greatest((a * a + b * b) / 2 - h * h / 4, 0))), struct_pack(method := 'median', h2 := sqrt(greatest((a * a + b * b) / 2 - h * h / 4, 0)))]) AS r FROM m)
SELECT r.method AS method, block, round(h, 6) AS first_height, round(r.h2, 6) AS second_height FROM r""",
}
