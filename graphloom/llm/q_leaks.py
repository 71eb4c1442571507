"""Problem 8: evaluation items that leaked into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.leaks import leaks
from graphloom.session import table


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks with up to two character errors."""
    return leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_leaks(spark, sf).filter("edits = 0").select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per item, how many documents hold it exactly or nearly."""
    found = p8_leaks(spark, sf).groupBy("item_id").agg(F.sum((F.col("edits") == 0).cast("long")).alias("n_exact"), F.count("*").alias("n_documents"))
    items = table(spark, sf, "eval_items").select("item_id", "suite")
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_exact"), F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p8_found, p8_leaks, p8_items)}

_WORDS = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"

ORACLE = {
    "p8_found": f"""WITH d AS (SELECT doc_id, ' ' || {_WORDS.format('text')} || ' ' AS t FROM documents),
i AS (SELECT item_id, string_split({_WORDS.format('text')}, ' ') AS w FROM eval_items),
g AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[s : s + least(13, len(w)) - 1], ' ') || ' ' AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i))
SELECT DISTINCT doc_id, item_id FROM d JOIN g ON contains(d.t, g.g)""",
}
