"""Cutoffs that keep a target fraction of each source's records.

Scores are coded as integers; a dyadic tree holds, for each source, how many
scores fall into each half, quarter, eighth... of the code range.  The tree is a
table that grows by one set of node counts per batch, so new records never need
a second look at old ones; beside it lie each batch's scores, counted, of which
only those of one leaf per source are read again.  Finding a cutoff descends
from the root to the leaf of the target rank over the counts of all batches and
then refines that leaf, by further trees over the leaf's own range, until it
holds one distinct score.  The result is exact.
"""

from __future__ import annotations

import math
import os
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import checkpoint, ensure_checkpoint_dir, maybe_broadcast

#: Levels below the root: a source has at most 2 ** (BITS + 1) nodes.
BITS = 12
#: Scores beyond it count as infinite.
LARGEST = 8e307


def coded(score: Column, lo: Column, hi: Column, bits: int = BITS) -> Column:
    """The leaf of a score in the range ``lo..hi``: order-preserving, clamped."""
    top = (1 << bits) - 1
    at = F.floor((score - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0)) * float(1 << bits))
    return F.when(score >= hi, F.lit(top)).when(score <= lo, F.lit(0)).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(top))).cast("int")


def node_counts(leaves: DataFrame, bits: int = BITS, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """``by, level, node, cnt, lo, hi`` of all nodes above the leaves (``by, leaf,
    cnt, score``).  Leaves are counted before anything is shuffled; ``lo`` and
    ``hi`` are the least and greatest score below."""
    low = leaves.groupBy(*by, "leaf").agg(F.sum("cnt").alias("cnt"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    up = low.select(*by, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.floor(F.col("leaf") / F.pow(F.lit(2.0), F.lit(bits) - k)).cast("int"))).alias("level", "node"), "cnt", "lo", "hi")
    return up.groupBy(*by, "level", "node").agg(F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


class CountTree:
    """A persistent tree: node counts and counted scores per batch, as two tables.

    Adding a batch again replaces it, so a retried job does no harm; a batch
    counts once its nodes are written, which comes last.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, lo: float = 0.0, hi: float = 1.0, bits: int = BITS):
        self.spark, self.lo, self.hi, self.bits = spark, lo, hi, bits
        self.path = path or os.path.join(ensure_checkpoint_dir(spark), f"count-tree-{uuid.uuid4().hex}")

    def leaf(self, score: Column) -> Column:
        return coded(score, F.lit(self.lo), F.lit(self.hi), self.bits)

    def add(self, batch: str | Column, records: DataFrame) -> None:
        """``records``: ``source, score``; null and NaN scores must be gone.  As a
        column, ``batch`` adds or replaces several batches in one pass."""
        name = F.lit(batch) if isinstance(batch, str) else F.coalesce(batch.cast("string"), F.lit("null"))
        counted = records.groupBy(name.alias("batch"), "source", "score").agg(F.count("*").alias("cnt"))
        counted = counted.withColumn("leaf", self.leaf(F.col("score")))
        known = self._write(counted, "scores")
        self._write(node_counts(known, self.bits, ("batch", "source")), "nodes")

    def _write(self, df: DataFrame, kind: str) -> DataFrame:
        """Puts the batches of ``df`` in place and returns it as it was written."""
        df = checkpoint(df)
        # a hot batch is split, small ones are put together
        even = df.hint("rebalance", F.col("batch"))
        even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(os.path.join(self.path, kind))
        return df

    def nodes(self) -> DataFrame:
        """``source, level, node, cnt, lo, hi`` over all batches."""
        t = self.spark.read.parquet(os.path.join(self.path, "nodes"))
        return t.groupBy("source", "level", "node").agg(F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def scores(self) -> DataFrame:
        """``source, score, leaf, cnt`` of all batches whose nodes are in place."""
        t = self.spark.read.parquet(os.path.join(self.path, "scores"))
        # one row per batch: as many as folders
        whole = self.spark.read.parquet(os.path.join(self.path, "nodes")).select("batch").distinct()
        return t.join(maybe_broadcast(whole), "batch", "left_semi").select("source", "score", "leaf", "cnt")

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def target_rank(n: int, fraction: float) -> int:
    """The smallest rank from 1 on whose share of ``n`` reaches ``fraction``."""
    r = min(n, max(1, math.ceil(fraction * n)))
    while r > 1 and (r - 1) / n >= fraction:
        r -= 1
    while r < n and r / n < fraction:
        r += 1
    return r


def _descend(bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(zip(pdf["level"], pdf["node"], strict=True), pdf["cnt"], strict=True))
        n = int(counts[(0, 0)])
        first = pdf.iloc[0]
        rank = int(first["rank"]) if first["rank"] == first["rank"] and first["rank"] > 0 else target_rank(n, float(first["fraction"]))
        node = 0
        for level in range(1, bits + 1):
            left = int(counts.get((level, 2 * node), 0))
            if rank <= left:
                node = 2 * node
            else:
                rank -= left
                node = 2 * node + 1
        at = pdf[(pdf["level"] == bits) & (pdf["node"] == node)].iloc[0]
        return pd.DataFrame([(first["source"], node, rank, n, at["lo"], at["hi"])], columns=["source", "leaf", "rank", "n", "lo", "hi"])

    return run


def descend(nodes: DataFrame, goals: DataFrame, bits: int = BITS) -> DataFrame:
    """The leaf that holds each source's target: ``source, leaf, rank`` (within
    the leaf), ``n, lo, hi``.  ``goals``: ``source, fraction, rank``; a positive
    rank is used as it is, else the one of the fraction.  A group is one source's
    nodes, whose number is bounded by the tree's depth."""
    kind = nodes.schema["source"].dataType.simpleString()
    return nodes.join(goals, "source").groupBy("source").applyInPandas(_descend(bits), f"source {kind}, leaf int, rank long, n long, lo double, hi double")


def fraction_cutoffs(
    records: DataFrame,
    source: Column,
    score: Column,
    targets: DataFrame,
    target_source: Column,
    fraction: Column,
    default: float,
    tree: CountTree | None = None,
    batch: str | Column = "all",
) -> tuple[DataFrame, DataFrame]:
    """``(cutoffs, kept)``.

    ``cutoffs``: ``source, fraction, n, cutoff``: the smallest score of the
    source such that at least ``fraction`` of its records have a score at or
    below it.  ``kept``: the records, their ``source``, ``score``, ``cutoff`` and
    ``keep``.  Records with null or NaN score are left out; infinite scores sort
    at the ends.  Fractions are brought into 0..1 and are ``default`` where null
    or where the source has no target; of several targets of a source the
    smallest fraction counts.  A null source is a source of its own.  Ties are
    kept or dropped together.  Tables may be empty; extra columns of ``records``
    come back in ``kept`` unless their names begin with ``_``.

    ``tree`` is a tree that goes on growing: the records are added to it as
    ``batch`` (in place of an earlier batch of that name), ``cutoffs`` are those
    of all batches it holds, ``kept`` are the records at hand.  Without one a tree
    is made for this call and deleted after it.
    """
    spark = records.sparkSession
    own = records.columns
    r = records.withColumn("_source", F.coalesce(source, F.lit("\u0000null"))).withColumn("_raw", score.cast("double"))
    r = r.filter(F.col("_raw").isNotNull() & ~F.isnan("_raw"))
    name = F.lit(batch) if isinstance(batch, str) else batch
    r = checkpoint(r.withColumns({"_score": F.least(F.greatest("_raw", F.lit(-LARGEST)), F.lit(LARGEST)), "_batch": name}).drop("_raw"))
    grown = tree or CountTree(spark, lo=0.0, hi=2.0)
    try:
        grown.add(F.col("_batch"), r.select(F.col("_source").alias("source"), F.col("_score").alias("score"), "_batch"))
        cutoffs = tree_cutoffs(grown, targets.select(F.coalesce(target_source, F.lit("\u0000null")).alias("source"), fraction.cast("double").alias("f")), default)
    finally:
        if tree is None:
            grown.drop()
    cut = maybe_broadcast(cutoffs.select(F.col("source").alias("_s"), F.col("cutoff").alias("_cutoff")))
    kept = r.join(cut, F.col("_source") == F.col("_s")).select(*own, F.col("_source").alias("_src"), "_score", "_cutoff", (F.col("_score") <= F.col("_cutoff")).alias("_keep"))
    return cutoffs, kept


def tree_cutoffs(tree: CountTree, targets: DataFrame, default: float) -> DataFrame:
    """``source, fraction, n, cutoff`` over all batches of a tree.  ``targets``:
    ``source, f``."""
    nodes = tree.nodes()
    # a target is a small fact per source: reduced to one row each before the join
    want = targets.groupBy("source").agg(F.min("f").alias("f"))
    f = F.when(F.col("f").isNotNull() & ~F.isnan("f"), F.least(F.greatest("f", F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(default))
    goals = nodes.filter("level = 0").select("source").join(want, "source", "left").select("source", f.alias("fraction"), F.lit(0).cast("long").alias("rank"))
    open_ = checkpoint(descend(nodes, goals, tree.bits))
    first = open_
    done = open_.filter("lo = hi").select("source", F.col("lo").alias("cutoff"))
    open_ = open_.filter("lo < hi")
    inside = tree.scores()
    while not open_.isEmpty():
        # refine: only records of the open leaves, recoded over the leaf's own range
        at = maybe_broadcast(open_.select(F.col("source").alias("_s"), F.col("leaf").alias("_l"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")))
        within = inside.join(at, (F.col("source") == F.col("_s")) & (F.col("leaf") == F.col("_l")))
        inside = checkpoint(within.select("source", "score", "cnt", coded(F.col("score"), F.col("_lo"), F.col("_hi"), tree.bits).alias("leaf")))
        goals = open_.select("source", F.lit(0.0).alias("fraction"), "rank")
        found = checkpoint(descend(node_counts(inside, tree.bits), goals, tree.bits))
        done = done.unionByName(found.filter("lo = hi").select("source", F.col("lo").alias("cutoff")))
        open_ = found.filter("lo < hi")
    sized = first.select("source", "n").join(want, "source", "left").select("source", f.alias("fraction"), "n")
    return checkpoint(sized.join(done, "source"))
