"""Composite reads: modules, functions, changes and constraints in context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import contains_ci
from graphloom.model import PropertyGraph
from graphloom.operators.lookup import find_by_name


def modules_matching(graph: PropertyGraph, phrase: str, limit: int = 15) -> DataFrame:
    """Modules by their own name or path, by their service, or by a member
    function's name: three searches united, each module once (O-79)."""
    m = graph.labelled("Module")
    own = m.filter(contains_ci(F.col("name"), phrase) | contains_ci(F.col("file_path"), phrase))
    by_service = graph.hop(m, "BELONGS_TO").filter(contains_ci(F.col("to_name"), phrase)).select(*m.columns)
    by_member = graph.hop(m, "CONTAINS").filter(contains_ci(F.col("to_name"), phrase)).select(*m.columns)
    cols = ["id", "name", "file_path"]
    return own.select(*cols).unionByName(by_service.select(*cols)).unionByName(by_member.select(*cols)).distinct().orderBy("name", "id").limit(limit)


def module_members(graph: PropertyGraph, modules: DataFrame, label: str, limit: int) -> DataFrame:
    """``id, member_id, member``: members of a label, ``limit`` per module."""
    met = graph.hop(modules, "CONTAINS").filter(F.col("to_label") == label)
    w = Window.partitionBy("id").orderBy("to_name", "to_id")
    return met.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).select("id", F.col("to_id").alias("member_id"), F.col("to_name").alias("member"))


def function_detail(graph: PropertyGraph, name: str, path: str | None = None) -> DataFrame:
    """The functions found by name with their code, left empty where there is none
    (O-34, O-36)."""
    f = find_by_name(graph.labelled("Function"), name, path)
    code = graph.hop(f.select("id"), "HAS_CODE").select(F.col("id").alias("_f"), F.col("to_body_text").alias("body_text"))
    return f.join(code, F.col("id") == F.col("_f"), "left").select("id", "name", "file_path", F.coalesce("body_text", F.lit("")).alias("body_text"))


def recent_changes(changes: DataFrame, links: DataFrame, since: str, limit: int = 15, per_change: int = 10) -> DataFrame:
    """``hash, date, message, n_entities, entity``: the newest changes and the
    first entities each touched, with how many there are in all (O-27, O-61)."""
    new = changes.filter(F.col("date") >= F.lit(since)).orderBy(F.desc("date"), "hash").limit(limit)
    met = new.join(links.select(F.col("hash").alias("_h"), "entity"), F.col("hash") == F.col("_h"), "left")
    w = Window.partitionBy("hash").orderBy("entity")
    n = F.count("entity").over(Window.partitionBy("hash"))
    return met.withColumn("_n", F.row_number().over(w)).withColumn("n_entities", n).filter(F.col("_n") <= per_change).select("hash", "date", "message", "n_entities", "entity")


SEVERITIES = ("critical", "high", "medium", "low")


def severity_rank(c: str = "severity"):
    """Place of a severity in the fixed order, others last (O-59)."""
    rank = F.lit(len(SEVERITIES))
    for i, s in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(F.col(c) == s, i).otherwise(rank)
    return rank


def constraints_for(linked: DataFrame, direct: DataFrame, limit: int = 30) -> DataFrame:
    """``id, description, severity``: constraints linked to a scope, then those
    that name it, each description once, by severity (O-59, O-80)."""
    cols = ["id", "description", "severity"]
    both = linked.select(*cols, F.lit(0).alias("_from")).unionByName(direct.select(*cols, F.lit(1).alias("_from")))
    one = both.groupBy("description").agg(F.min(F.struct("_from", "id", "severity")).alias("_m"))
    out = one.select("_m.id", "description", "_m.severity")
    return out.withColumn("_rank", severity_rank()).orderBy("_rank", "description").limit(limit).select(*cols)
