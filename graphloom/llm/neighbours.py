"""The k most similar vectors of every vector.

An inverted-list index with an adaptive dimension scan.  Equal vectors are one
class and searched once.  Groups of more than ``single_list`` classes get
centroids from a bounded sample, and lists that are still long get centroids of
their own from a bounded sample of theirs, so lists stay short whatever the
group's size.  Every class is indexed in its nearest list and asks the nearest
ones.  A list meets its questions in one task; only a list or a crowd of
questions beyond a task's bound is cut into blocks that spread over many tasks.
Within a pair of blocks the vectors, rotated at random, are compared column block
by column block: after each, a hypothesis test on the partial distance drops the
candidates that can hardly be near enough; what is left is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import checkpoint, maybe_broadcast

#: Columns scanned so far at each test of the adaptive scan (shares of the dimension).
STEPS = (0.25, 0.5)
#: Significance of the hypothesis test: larger drops fewer true neighbours.
EPSILON = 3.0


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.RandomState(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _units(m: np.ndarray) -> np.ndarray:
    # scaled by the largest entry first, so that very small and very large vectors keep their precision
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centroids of unit vectors by cosine, from a seeded start; an empty
    cluster keeps its centroid."""
    rng = np.random.RandomState(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def scan(q: np.ndarray, c: np.ndarray, least: float, epsilon: float | None = EPSILON, steps: tuple[float, ...] = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(question, candidate)`` that survive the adaptive scan.

    ``q`` and ``c`` hold unit vectors.  With squared distance at most ``r2`` for a
    cosine of ``least``, the partial distance over ``d`` of ``D`` rotated columns
    exceeds ``r2 * d / D * (1 + epsilon / sqrt(d)) ** 2`` only with a probability
    that falls exponentially in ``epsilon ** 2``; such candidates are abandoned.
    Without ``epsilon`` only those go whose partial distance is too large already.
    """
    dim = q.shape[1]
    r2 = 2.0 - 2.0 * least + 1e-5
    rot = rotation(dim)
    a, b = q.astype(np.float32) @ rot, c.astype(np.float32) @ rot
    cuts = [max(1, int(dim * s)) for s in steps] + [dim]
    d = cuts[0]
    part = (a[:, :d] ** 2).sum(1)[:, None] + (b[:, :d] ** 2).sum(1)[None, :] - 2.0 * (a[:, :d] @ b[:, :d].T)

    def bound(d: int) -> float:
        # rounding in single precision must drop nothing
        sure = r2 + 1e-4
        return sure if epsilon is None or d == dim else min(sure, r2 * d / dim * (1 + epsilon / np.sqrt(d)) ** 2)

    i, j = np.nonzero(part <= bound(d))
    part = part[i, j]
    for lo, d in zip(cuts, cuts[1:], strict=False):
        diff = a[i, lo:d] - b[j, lo:d]
        part = part + np.einsum("ij,ij->i", diff, diff)
        keep = part <= bound(d)
        i, j, part = i[keep], j[keep], part[keep]
    return i, j


def _search(dim: int, keep: int, least: float, epsilon: float | None):
    def run(table: pa.Table) -> pa.Table:
        role = np.asarray(table.column("role").to_numpy(zero_copy_only=False), bool)
        raw = _units(_matrix(table.column("embedding"), dim))
        at_q, at_c = np.flatnonzero(role), np.flatnonzero(~role)
        names = np.asarray(table.column("first_node").to_pylist(), dtype=object)
        # candidates in the order of their smallest node, so that equal similarities keep that order
        at_c = at_c[np.argsort(names[at_c].astype(str), kind="stable")]
        outs = []
        for lo in range(0, len(at_q), 1024):
            part = at_q[lo : lo + 1024]
            i, j = scan(raw[part], raw[at_c], least, epsilon)
            sim = np.round(np.einsum("ij,ij->i", raw[part[i]], raw[at_c[j]]), 6)
            ok = sim >= least
            i, j, sim = i[ok], j[ok], sim[ok]
            order = np.lexsort((j, -sim, i))
            i, j, sim = i[order], j[order], sim[order]
            first = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.zeros(0, int)
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) if len(i) else i
            top = rank < keep
            outs.append((part[i[top]], at_c[j[top]], sim[top]))
        qi = np.concatenate([o[0] for o in outs]) if outs else np.zeros(0, int)
        ci = np.concatenate([o[1] for o in outs]) if outs else np.zeros(0, int)
        sims = np.concatenate([o[2] for o in outs]) if outs else np.zeros(0)
        got = {n: table.column(n).to_numpy() for n in ("h1", "h2")}
        return pa.table({"q1": got["h1"][qi], "q2": got["h2"][qi], "c1": got["h1"][ci], "c2": got["h2"][ci], "first_node": pa.array(names[ci], pa.string()), "similarity": sims})

    return run


def vector_classes(vectors: DataFrame, dim: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """``(nodes, classes)`` of the usable vectors (``node_id, grp, embedding``).

    ``nodes``: ``node_id`` and its class ``h1, h2``; ``classes``: one row per
    distinct vector of a group with its ``keep`` smallest node ids.
    """
    ok = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = vectors.filter("node_id is not null").filter(F.col("embedding").isNotNull() & F.coalesce(ok, F.lit(False)))
    v = v.withColumns({"h1": F.xxhash64(F.lit(1), "grp", "embedding"), "h2": F.xxhash64(F.lit(2), "grp", "embedding")})
    w = Window.partitionBy("h1", "h2").orderBy("node_id")
    # the rank limit is applied before the shuffle, so a hot vector sends a few rows per task
    firsts = v.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep)
    classes = firsts.groupBy("h1", "h2").agg(F.first("grp").alias("grp"), F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("node_id")).alias("members"), F.min("node_id").alias("first_node"))
    return v.select("node_id", "h1", "h2"), classes


def _closest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` centroids nearest to each row, nearest first."""
    s = x @ c.T
    n = min(n, s.shape[1])
    top = np.argpartition(-s, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def _fit(name: str, list_rows: int, fit_rows: int):
    """Centroids of one group's or list's sample, about one per ``list_rows`` of
    all its rows (``_size``)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _units(np.stack(pdf.sort_values("_n")["embedding"].to_numpy()).astype(np.float64))
        c = spherical_means(x, max(1, min(-(-int(pdf["_size"].iloc[0]) // list_rows), len(x) // 4)))
        return pd.DataFrame({name: pdf[name].iloc[0], "c": [r.tolist() for r in c]})

    return run


def _sampled(rows: DataFrame, name: str, sizes: DataFrame, fit_rows: int, list_rows: int) -> DataFrame:
    """``name, c``: centroids of every ``name`` in ``sizes`` (``name, _size``), from
    its ``fit_rows`` first rows by hash; the rank limit comes before the shuffle."""
    pick = F.row_number().over(Window.partitionBy(name).orderBy(F.xxhash64("h1", "h2"), "h1"))
    few = rows.join(maybe_broadcast(sizes), name).select(name, "embedding", "_size", "h1", "h2").withColumn("_n", pick).filter(F.col("_n") <= fit_rows)
    return few.groupBy(name).applyInPandas(_fit(name, list_rows, fit_rows), f"{name} string, c array<double>")


def _split_lists(rows: DataFrame, dim: int, probes: int, fit_rows: int, list_rows: int, ask_block: int) -> DataFrame:
    """``rows`` (``h1, h2, embedding, first_node, list, pos``) in which every long
    list is replaced by shorter ones, of which a question asks the more the
    nearer the list is to it."""
    held = rows.filter("pos = 0").groupBy("list").agg(F.count("*").alias("_size")).filter(F.col("_size") > 4 * list_rows)
    long_ = checkpoint(held)
    if long_.isEmpty():
        return rows
    cents = checkpoint(_sampled(rows.filter("pos = 0"), "list", long_, fit_rows, list_rows))
    asking = rows.groupBy("list").agg(F.ceil(F.count("*") / ask_block).cast("int").alias("_parts"))
    parts = checkpoint(long_.select("list").join(asking, "list"))
    tagged = rows.join(maybe_broadcast(parts), "list", "left")
    stay = tagged.filter("_parts is null").select(*rows.columns)
    part = F.pmod(F.xxhash64(F.lit(5), "h1", "h2"), F.col("_parts")).cast("int").alias("_part")
    move = tagged.filter("_parts is not null").select(*rows.columns, part)
    spread = cents.join(maybe_broadcast(parts), "list").select(F.col("list").alias("list"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "c")

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        c = np.asarray(right.column("c").to_pylist(), float)
        pos = left.column("pos").to_numpy()
        top = _closest(_units(_matrix(left.column("embedding"), dim)), c, probes) if len(pos) else np.zeros((0, 1), int)
        most = np.maximum(1, probes // (pos + 1))
        i, r = np.nonzero(np.arange(top.shape[1])[None, :] < most[:, None])
        names = left.column("list").to_pylist()
        out = left.select(["h1", "h2", "embedding", "first_node"]).take(pa.array(i))
        home = (pos[i] == 0) & (r == 0)
        lists = [f"{names[a]}\u0000{b}" for a, b in zip(i.tolist(), top[i, r].tolist(), strict=True)]
        return out.append_column("list", pa.array(lists, pa.string())).append_column("pos", pa.array(np.where(home, 0, 1).astype(np.int32)))

    moved = move.groupBy("list", "_part").cogroup(spread.groupBy("list", "_part")).applyInArrow(assign, "h1 long, h2 long, embedding array<float>, first_node string, list string, pos int")
    return stay.select(*moved.columns).unionByName(moved)


def nearest(
    vectors: DataFrame,
    k: int = 5,
    least: float = 0.85,
    dim: int = 64,
    probes: int = 12,
    fit_rows: int = 8192,
    list_rows: int = 512,
    single_list: int = 2048,
    max_lists: int = 50_000,
    block: int = 2048,
    epsilon: float | None = EPSILON,
    exact: bool = False,
) -> DataFrame:
    """``node_id, neighbour, similarity, rank``: up to ``k`` most similar nodes.

    ``vectors``: ``node_id`` (unique), ``grp`` (only equal groups are compared),
    ``embedding``.  Similarity is the cosine in double precision rounded to six
    decimals; pairs under ``least`` are left out, equal ones ranked by smaller
    ``node_id``.  Vectors of another length, with nulls or NaN, or all zero take
    no part; neither do rows without an id.  An empty table gives no rows; extra
    columns are ignored.

    The index holds every row.  Its centroids are fitted on up to ``fit_rows``
    classes of each group of more than ``single_list``, taken by hash, and of each
    list that holds more than four times ``list_rows`` after that.  Up to
    ``max_lists`` centroids of groups go to every task; those of lists stay in a
    table.  Recall depends on ``probes`` and ``epsilon`` (measured in the README);
    ``exact`` compares every block of a group with every other, without lists and
    without the hypothesis test.
    """
    spark = vectors.sparkSession
    keep = k + 1
    ask_block = 16 * block
    epsilon = None if exact else epsilon
    nodes, classes = vector_classes(vectors.select("node_id", "grp", "embedding"), dim, keep)
    classes = checkpoint(classes)
    sizes = classes.groupBy("grp").agg(F.count("*").alias("_size")).filter(F.col("_size") > single_list)
    total = 0 if exact else sizes.agg(F.sum("_size")).first()[0] or 0
    per_list = max(list_rows, total // max_lists)
    centroids: dict = {}
    if total:
        # a group with centroids holds more than per_list rows, so these are about max_lists at most
        for r in _sampled(classes, "grp", sizes.filter(F.col("_size") > per_list), fit_rows, per_list).collect():
            centroids.setdefault(r["grp"], []).append(r["c"])
    cents = spark.sparkContext.broadcast({g: np.asarray(c) for g, c in centroids.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = cents.value
        for batch in batches:
            groups = np.asarray(batch.column("grp").to_pylist(), dtype=object)
            x = _units(_matrix(batch.column("embedding"), dim)) if len(groups) else None
            asked: list = [None] * len(groups)
            for g in set(groups.tolist()):
                at = np.flatnonzero(groups == g)
                if g not in lists:
                    for i in at:
                        asked[i] = [g]
                    continue
                for i, row in zip(at, _closest(x[at], lists[g], probes).tolist(), strict=True):
                    asked[i] = [f"{g}\u0000{t}" for t in row]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(asked, pa.list_(pa.string()))], names=[*batch.schema.names, "lists"])

    named = checkpoint(classes.select("h1", "h2", "grp", "embedding", "first_node").mapInArrow(assign, "h1 long, h2 long, grp string, embedding array<float>, first_node string, lists array<string>"))
    assigned = named.select("h1", "h2", "embedding", "first_node", F.posexplode("lists").alias("pos", "list"))
    if centroids:
        split = _split_lists(assigned, dim, probes, fit_rows, list_rows, ask_block)
        assigned = split if split is assigned else checkpoint(split)
    home = F.when(F.col("pos") == 0, 1).otherwise(0)
    # every class asks its own list, so no list is without questions
    counts = assigned.groupBy("list").agg(F.ceil(F.sum(home) / block).cast("int").alias("_nb"), F.ceil(F.count("*") / ask_block).cast("int").alias("_nq"))
    cut = maybe_broadcast(checkpoint(counts.filter("_nb > 1 or _nq > 1")).withColumnRenamed("list", "_l"))
    sized = assigned.join(cut, F.col("list") == F.col("_l"), "left").withColumns({"_nb": F.coalesce("_nb", F.lit(1)), "_nq": F.coalesce("_nq", F.lit(1))})
    data = sized.filter("pos = 0").select("list", F.pmod(F.xxhash64(F.lit(3), "h1", "h2"), F.col("_nb")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)).alias("q"), F.lit(False).alias("role"), "h1", "h2", "embedding", "first_node")
    asks = sized.select("list", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("b"), F.pmod(F.xxhash64(F.lit(4), "h1", "h2"), F.col("_nq")).cast("int").alias("q"), F.lit(True).alias("role"), "h1", "h2", "embedding", F.lit(None).cast("string").alias("first_node"))
    pairs = data.unionByName(asks).groupBy("list", "b", "q").applyInArrow(_search(dim, keep, least, epsilon), "q1 long, q2 long, c1 long, c2 long, first_node string, similarity double")
    # the best classes hold the best nodes: every class is led by its smallest node
    w = Window.partitionBy("q1", "q2").orderBy(F.desc("similarity"), "first_node")
    best = pairs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep)
    members = classes.select(F.col("h1").alias("_c1"), F.col("h2").alias("_c2"), F.explode("members").alias("neighbour"))
    cand = best.join(members, (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2")))
    w2 = Window.partitionBy("q1", "q2").orderBy(F.desc("similarity"), "neighbour")
    cand = cand.withColumn("_n", F.row_number().over(w2)).filter(F.col("_n") <= keep)
    lists = cand.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct(F.col("_n").alias("n"), "neighbour", "similarity"))).alias("_near"))
    met = nodes.join(lists, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")))
    near = F.slice(F.filter("_near", lambda x: x["neighbour"] != F.col("node_id")), 1, k)
    out = met.select("node_id", F.posexplode(near).alias("_r", "_x"))
    return out.select("node_id", F.col("_x.neighbour").alias("neighbour"), F.col("_x.similarity").alias("similarity"), (F.col("_r") + 1).alias("rank"))
