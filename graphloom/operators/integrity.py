"""Integrity of a graph: six checks, one table of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators.traverse import without_chain

FINDING = ["check", "severity", "key", "cnt"]


def _finding(df: DataFrame, check: str, severity: str, key, cnt=None) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), key.alias("key"), (F.lit(1) if cnt is None else cnt).cast("long").alias("cnt"))


def duplicates(nodes: DataFrame, check: str) -> DataFrame:
    """Keys held by several nodes, with their number (O-46)."""
    d = nodes.groupBy("file_path", "name").agg(F.count("*").alias("n")).filter("n > 1")
    return _finding(d, check, "warning", F.concat_ws("::", "file_path", "name"), F.col("n"))


def incomplete(nodes: DataFrame, required: list[str]) -> DataFrame:
    """Nodes with a required field missing (O-33)."""
    bad = None
    for c in required:
        bad = F.col(c).isNull() if bad is None else bad | F.col(c).isNull()
    return _finding(nodes.filter(bad), "required-fields", "error", F.concat_ws("::", F.coalesce("file_path", F.lit("?")), F.coalesce("name", F.lit("?"))))


def orphans(nodes: DataFrame, edges: DataFrame, edge_type: str) -> DataFrame:
    """Nodes no edge of a type leads to (O-38)."""
    held = edges.filter(F.col("type") == edge_type).select(F.col("dst").alias("_d")).distinct()
    return _finding(nodes.join(held, F.col("id") == F.col("_d"), "left_anti"), "orphan", "warning", F.col("id"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which has no node."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    lost = edges.join(ids, F.col("src") == F.col("_id"), "left_anti").unionByName(edges.join(ids, F.col("dst") == F.col("_id"), "left_anti"))
    return _finding(lost.select("src", "dst", "type").distinct(), "dangling-edge", "error", F.concat_ws("->", "src", "dst"))


def check_graph(graph: PropertyGraph, required: list[str], limit: int = 20) -> DataFrame:
    """All findings, at most ``limit`` per check (a report, O-60)."""
    from pyspark.sql import Window

    functions, modules = graph.labelled("Function"), graph.labelled("Module")
    loose = without_chain(modules, graph.typed("BELONGS_TO"), graph.labelled("Service"))
    parts = [
        duplicates(functions, "duplicate-functions"),
        duplicates(graph.labelled("Type"), "duplicate-types"),
        incomplete(functions, required),
        orphans(functions, graph.edges, "CONTAINS"),
        dangling(graph.edges, graph.nodes),
        _finding(loose, "module-without-service", "warning", F.col("id")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("check").orderBy(F.desc("cnt"), "key")
    return every.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).select(*FINDING)


def passes(findings: DataFrame) -> bool:
    """Only errors fail a check."""
    return findings.filter("severity = 'error'").isEmpty()
