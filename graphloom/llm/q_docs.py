"""Problem 2: functions paired with their documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.code_docs import documented_pairs, function_docs
from graphloom.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = function_docs(table(spark, sf, "function_nodes"), table(spark, sf, "code_blocks"))
    return docs.filter("not trivial and doc_source <> 'inherited'").select("file_path", "name").distinct()


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return documented_pairs(table(spark, sf, "function_nodes"), table(spark, sf, "code_blocks"))


def p2_sources(spark: SparkSession, sf: str) -> DataFrame:
    """How many functions have a documentation of each kind."""
    docs = function_docs(table(spark, sf, "function_nodes"), table(spark, sf, "code_blocks"))
    return docs.groupBy(F.coalesce("doc_source", F.lit("none")).alias("doc_source"), "trivial").agg(F.count("*").alias("n_functions"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p2_sources)}
ORACLE: dict[str, str] = {}
