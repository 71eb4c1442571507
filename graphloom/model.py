"""The property graph: nodes, edges, and views over both.

``nodes``: ``id, label, file_path, name`` and any properties; ``edges``: ``src,
dst, type`` and any properties.  Edge types in use: CONTAINS, CONTAINS_FILE,
DEFINES, BELONGS_TO, HAS_CODE, IMPORTS, CALLS, USES_TYPE, EXTENDS, IMPLEMENTS,
INJECTS, CHANGED_IN, CONSTRAINED_BY, DATA_FLOWS_TO, BRIDGES, REACHES.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOW_EDGES = ("CALLS", "USES_TYPE", "EXTENDS", "IMPLEMENTS", "INJECTS", "IMPORTS", "DATA_FLOWS_TO", "BRIDGES")


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    def labelled(self, *labels: str) -> DataFrame:
        """Nodes of the given labels; partitioned storage by label prunes to them."""
        return self.nodes.filter(F.col("label").isin(*labels))

    def typed(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("type").isin(*types))

    def hop(self, left: DataFrame, edge_type: str, how: str = "inner", reverse: bool = False) -> DataFrame:
        """``left`` (with ``id``) joined to the nodes one edge away, whose columns
        get the prefix ``to_`` (O-35, O-36)."""
        a, b = ("dst", "src") if reverse else ("src", "dst")
        e = self.typed(edge_type).select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
        n = self.nodes.select(*[F.col(c).alias(f"to_{c}") for c in self.nodes.columns])
        met = e.join(n, F.col("_b") == F.col("to_id")).drop("_b")
        return left.join(met, F.col("id") == F.col("_a"), how).drop("_a")
