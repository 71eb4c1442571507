"""Problem 3: cutoffs that keep a target fraction of every category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.cutoffs import fraction_cutoffs
from graphloom.session import latest, table

DEFAULT_FRACTION = 0.95


def _category(c: str = "category"):
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def _cutoffs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every run of the judge is a batch of the count tree."""
    j = table(spark, sf, "judged_nodes").filter(F.col("distance").isNotNull() & ~F.isnan("distance")).withColumn("category", _category())
    j = latest(j, ["node_id", "category"], ["judged_at", "judgment_id"], ["node_id", "category", "judged_at", "judgment_id", "distance", "run_id"])
    c = table(spark, sf, "cfm_calibration").withColumn("category", _category())
    c = latest(c, ["category"], ["updated_at", "percentile"], ["category", "updated_at", "percentile", "threshold"])
    cutoffs, kept = fraction_cutoffs(j.select("judgment_id", "category", "distance", "run_id"), F.col("category"), F.col("distance"), c, F.col("category"), F.col("percentile"), DEFAULT_FRACTION, batch=F.col("run_id"))
    return cutoffs, kept, c


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cutoffs(spark, sf)[1].filter("not _keep").select("judgment_id").distinct()


def p3_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    """Cutoff, sizes kept and dropped and the stored threshold per category."""
    cutoffs, kept, c = _cutoffs(spark, sf)
    sizes = kept.groupBy("category").agg(F.sum(F.col("_keep").cast("long")).alias("n_kept"), F.sum((~F.col("_keep")).cast("long")).alias("n_dropped"))
    out = cutoffs.withColumnRenamed("source", "category").join(sizes, "category").join(c.select("category", "threshold"), "category", "left")
    return out.select("category", F.round("fraction", 6).alias("fraction"), F.round("cutoff", 9).alias("cutoff"), "n_kept", "n_dropped", F.round("threshold", 9).alias("threshold"))


QUERIES = {f.__name__: f for f in (p3_found, p3_cutoffs)}

_CUT = r"""
j0 AS (SELECT *, lower(regexp_replace(category, '^\s+|\s+$', '', 'g')) AS cat FROM judged_nodes WHERE distance IS NOT NULL AND NOT isnan(distance)),
j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, cat ORDER BY judged_at DESC, judgment_id DESC) AS rn FROM j0) WHERE rn = 1),
c AS (SELECT * FROM (SELECT *, lower(regexp_replace(category, '^\s+|\s+$', '', 'g')) AS cat, row_number() OVER (PARTITION BY lower(regexp_replace(category, '^\s+|\s+$', '', 'g')) ORDER BY updated_at DESC, percentile DESC NULLS LAST) AS rn FROM cfm_calibration) WHERE rn = 1),
s AS (
  SELECT j.judgment_id, j.cat, j.distance, CASE WHEN c.percentile IS NULL THEN 0.95 ELSE least(greatest(c.percentile, 0), 1) END AS fraction, c.threshold,
    count(*) OVER (PARTITION BY j.cat ORDER BY j.distance RANGE UNBOUNDED PRECEDING) AS below, count(*) OVER (PARTITION BY j.cat) AS n
  FROM j LEFT JOIN c ON j.cat = c.cat),
k AS (SELECT cat, min(distance) AS cutoff FROM s WHERE below::DOUBLE / n >= fraction GROUP BY cat)"""

ORACLE = {
    "p3_found": f"WITH {_CUT} SELECT judgment_id FROM s JOIN k USING (cat) WHERE distance > cutoff",
    "p3_cutoffs": f"""WITH {_CUT}
SELECT cat AS category, round(max(fraction), 6) AS fraction, round(max(cutoff), 9) AS cutoff,
  count(*) FILTER (WHERE distance <= cutoff) AS n_kept, count(*) FILTER (WHERE distance > cutoff) AS n_dropped, round(max(threshold), 9) AS threshold
FROM s JOIN k USING (cat) GROUP BY cat""",
}
