"""Problem 6: the five most similar nodes of every node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.neighbours import nearest
from graphloom.session import latest, table


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = latest(table(spark, sf, "cfm_vectors"), ["node_id"], ["updated_at", "model", "category", "embedding"], ["node_id", "updated_at", "model", "category", "embedding"])
    return v.filter("category is not null and model is not null").select("node_id", F.concat_ws("\u0001", "category", "model").alias("grp"), "embedding")


def p6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(_vectors(spark, sf)).select("node_id", "rank", "neighbour", "similarity")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    near = p6_neighbours(spark, sf)
    return near.select(F.least("node_id", "neighbour").alias("node_id_a"), F.greatest("node_id", "neighbour").alias("node_id_b")).distinct()


QUERIES = {f.__name__: f for f in (p6_found, p6_neighbours)}

_NEAR = """
v AS (
  SELECT node_id, category, model, embedding::DOUBLE[] AS e FROM (
    SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC) AS rn FROM cfm_vectors)
  WHERE rn = 1 AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
s AS (SELECT a.node_id, b.node_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 6) AS similarity
  FROM v a JOIN v b ON a.category = b.category AND a.model = b.model AND a.node_id <> b.node_id),
t AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY similarity DESC, neighbour) AS rank FROM s WHERE similarity >= 0.85)"""

ORACLE = {
    "p6_found": f"WITH {_NEAR} SELECT DISTINCT least(node_id, neighbour) AS node_id_a, greatest(node_id, neighbour) AS node_id_b FROM t WHERE rank <= 5",
    "p6_neighbours": f"WITH {_NEAR} SELECT node_id, rank::INTEGER AS rank, neighbour, similarity FROM t WHERE rank <= 5",
}
