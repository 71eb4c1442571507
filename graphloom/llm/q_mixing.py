"""Problem 9: mixing the sources of documents to target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.mixing import mixture
from graphloom.llm.tokens import TOKENIZER, count_tokens
from graphloom.session import maybe_broadcast, table


def _source(c: str):
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def _mixture(spark: SparkSession, sf: str, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf, "mix_targets").select(_source("source").alias("source"), "target_share", "max_repeats")
    docs = table(spark, sf, "documents").select("doc_id", _source("source").alias("source"), F.lower("lang").alias("lang"), F.col("doc_kind").alias("topic"), "text")
    counted = count_tokens(docs.join(maybe_broadcast(targets.select("source").distinct()), "source", "left_semi"), "text", tokenizer)
    return mixture(counted, F.col("source"), F.col("lang"), F.col("topic"), "doc_id", "n_tokens", targets)


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    s = _mixture(spark, sf)[1]
    return s.select("source", *[F.round(c, 6).alias(c) for c in ("target_share", "aimed_share", "share")], "max_repeats", "most_uses", "tokens_at_hand", "used_tokens", "n_records", "n_uses")


QUERIES = {f.__name__: f for f in (p9_mixture, p9_shares)}
ORACLE: dict[str, str] = {}
