"""Problem 7: credentials in code blocks and session notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.secrets import credentials, redacted
from graphloom.session import latest, table


def _code(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "code_blocks").select("block_id", "code_lang", "body_text", "updated_at")


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "agent_events").select("id", "summary", "loaded_at")
    return e.withColumn("_v", F.xxhash64("summary"))


def p7_credentials(spark: SparkSession, sf: str) -> DataFrame:
    """Every credential with its place and kind.  Old deliveries of a note are
    told apart after the search, so that no text has to move."""
    code = credentials(_code(spark, sf), ["block_id"], "body_text", "code_lang")
    code = code.select(F.lit("code_blocks").alias("src_table"), F.col("block_id").alias("record_id"), "line_no", "kind")
    notes = _notes(spark, sf)
    current = latest(notes.select("id", "loaded_at", "_v"), ["id"], ["loaded_at", "_v"], ["id", "loaded_at", "_v"])
    current = current.select(F.col("id").alias("_i"), F.col("_v").alias("_cv"))
    found = credentials(notes, ["id", "_v"], "summary")
    found = found.join(current, (F.col("id") == F.col("_i")) & (F.col("_v") == F.col("_cv")), "left_semi")
    found = found.select(F.lit("agent_events").alias("src_table"), F.col("id").alias("record_id"), "line_no", "kind")
    return code.unionByName(found).distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_credentials(spark, sf).select("src_table", "record_id", "line_no").distinct()


def p7_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Both texts with their credentials masked."""
    code = latest(_code(spark, sf), ["block_id"], ["updated_at", "body_text"], ["block_id", "updated_at", "body_text", "code_lang"])
    code = redacted(code, ["block_id"], "body_text", "code_lang").select(F.lit("code_blocks").alias("src_table"), F.col("block_id").alias("record_id"), "redacted", "n_credentials")
    notes = latest(_notes(spark, sf), ["id"], ["loaded_at", "_v"], ["id", "loaded_at", "_v", "summary"])
    notes = redacted(notes, ["id"], "summary").select(F.lit("agent_events").alias("src_table"), F.col("id").alias("record_id"), "redacted", "n_credentials")
    return code.unionByName(notes)


QUERIES = {f.__name__: f for f in (p7_found, p7_credentials, p7_redacted)}
ORACLE: dict[str, str] = {}
