"""Embedding novelty: nearest neighbours, calibrated thresholds, verdicts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.vectors import cosine_distance
from graphloom.session import checkpoint, maybe_broadcast

FALLBACK_THRESHOLD = 0.1


def _blocks(counts: DataFrame, name: str, rows: int) -> DataFrame:
    return counts.select(F.col("grp").alias("_g"), F.ceil(F.col("count") / rows).cast("int").alias(name))


def _scan(k: int, skip_self: bool):
    def run(table: pa.Table) -> pa.Table:
        role = np.asarray(table.column("role").to_numpy(zero_copy_only=False), bool)
        vec = table.column("vec").combine_chunks()
        width = len(vec.flatten()) // max(len(vec), 1)
        m = vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vec), width)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
        ids = np.asarray(table.column("id").to_pylist(), dtype=object)
        qs, cs = np.flatnonzero(role), np.flatnonzero(~role)
        cs = cs[np.argsort(ids[cs], kind="stable")]
        out: list[tuple] = []
        for lo in range(0, len(qs), 512):
            part = qs[lo : lo + 512]
            d = np.round(1.0 - m[part] @ m[cs].T, 9)
            if skip_self:
                d[ids[part][:, None] == ids[cs][None, :]] = np.inf
            # equal distances keep the order of ids
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            dist = np.take_along_axis(d, best, 1)
            i, j = np.nonzero(np.isfinite(dist))
            out.append((ids[part[i]], ids[cs[best[i, j]]], dist[i, j]))
        cat = [np.concatenate([o[x] for o in out]) if out else np.zeros(0, object) for x in range(3)]
        kind = table.schema.field("id").type
        return pa.table({"id": pa.array(list(cat[0]), kind), "neighbour": pa.array(list(cat[1]), kind), "distance": pa.array(cat[2].astype(float), pa.float64())})

    return run


def nearest(queries: DataFrame, pool: DataFrame, k: int, skip_self: bool = True, block: int = 4096) -> DataFrame:
    """``id, neighbour, distance, rank``: the ``k`` nearest of the pool (O-66, O-67).

    Both sides: ``id, grp, vec``; only equal groups are compared.  Exact, in
    blocks: every pair of a question block and a candidate block is one task of
    bounded size that returns ``k`` rows per question, so neither a hot group nor
    the pairs themselves gather anywhere.  Ties fall to the smaller id; a zero
    vector is at distance 1 from all; null vectors take no part; a group without
    peers gives no rows.
    """
    near = _block_neighbours(queries, pool, k, skip_self, block)
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _block_neighbours(queries: DataFrame, pool: DataFrame, k: int, skip_self: bool, block: int = 4096) -> DataFrame:
    """The ``k`` nearest of every question in each block of its group."""
    q = queries.select("id", "grp", "vec").filter("vec is not null and id is not null")
    p = pool.select("id", "grp", "vec").filter("vec is not null and id is not null")
    nb = _blocks(p.groupBy("grp").count(), "_nb", block)
    nq = _blocks(q.groupBy("grp").count(), "_nq", block).withColumnRenamed("_g", "_g2")
    sizes = maybe_broadcast(nb.join(nq, F.col("_g").eqNullSafe(F.col("_g2"))).drop("_g2"))
    on = F.col("grp").eqNullSafe(F.col("_g"))
    mixed = F.xxhash64("id")
    cand = p.join(sizes, on).select("grp", F.pmod(mixed, F.col("_nb")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)).alias("q"), F.lit(False).alias("role"), "id", "vec")
    asks = q.join(sizes, on).select("grp", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("b"), F.pmod(mixed, F.col("_nq")).cast("int").alias("q"), F.lit(True).alias("role"), "id", "vec")
    kind = q.schema["id"].dataType.simpleString()
    return cand.unionByName(asks).groupBy("grp", "b", "q").applyInArrow(_scan(k, skip_self), f"id {kind}, neighbour {kind}, distance double")


def knn_distance(near: DataFrame) -> DataFrame:
    """Mean distance of the neighbours at hand, fewer than ``k`` if the pool is small."""
    return near.groupBy("id").agg(F.avg("distance").alias("knn_distance"))


def leave_one_out(pool: DataFrame, k: int = 5, keep_unjudged: bool = False) -> DataFrame:
    """``id, grp, knn_distance`` of every pool entry against its peers; 0 without
    peers, or null with ``keep_unjudged`` (O-68)."""
    d = knn_distance(nearest(pool, pool, k)).withColumnRenamed("id", "_i")
    return pool.select("id", "grp").join(d, F.col("id") == F.col("_i"), "left").select("id", "grp", F.col("knn_distance") if keep_unjudged else F.coalesce("knn_distance", F.lit(0.0)).alias("knn_distance"))


def calibrate(pool: DataFrame, k: int = 5, percentile: float = 0.95) -> DataFrame:
    """``grp, threshold, sample_size``: the interpolated percentile of the
    leave-one-out distances of each category (O-52, O-68)."""
    p = min(max(percentile, 0.0), 1.0)
    return leave_one_out(pool, k).groupBy("grp").agg(F.percentile("knn_distance", F.lit(p)).alias("threshold"), F.count("*").alias("sample_size"))


def judge(entries: DataFrame, pool: DataFrame, thresholds: DataFrame, k: int = 5) -> DataFrame:
    """``id, grp, distance, threshold, calibrated, verdict`` (O-69): ``outlier`` if
    the distance is above the threshold, ``conforming``, or ``unjudged`` without
    peers.  Categories without a threshold use the fallback."""
    d = knn_distance(nearest(entries, pool, k)).select(F.col("id").alias("_i"), F.col("knn_distance").alias("distance"))
    t = maybe_broadcast(thresholds.select(F.col("grp").alias("_g"), F.col("threshold").alias("_t")))
    out = entries.select("id", "grp").join(d, F.col("id") == F.col("_i"), "left").join(t, F.col("grp").eqNullSafe(F.col("_g")), "left")
    threshold = F.coalesce("_t", F.lit(FALLBACK_THRESHOLD))
    verdict = F.when(F.col("distance").isNull(), "unjudged").when(F.round("distance", 9) > F.round(threshold, 9), "outlier").otherwise("conforming")
    return out.select("id", "grp", "distance", threshold.alias("threshold"), F.col("_t").isNotNull().alias("calibrated"), verdict.alias("verdict"))


def judge_pool(pool: DataFrame, k: int = 5, percentile: float = 0.95) -> DataFrame:
    """``judge`` of a pool against itself, calibrated by itself: one search serves
    both, as the leave-one-out distances are the ones to be judged."""
    near = checkpoint(leave_one_out(pool, k, keep_unjudged=True))
    p = min(max(percentile, 0.0), 1.0)
    t = near.groupBy("grp").agg(F.percentile(F.coalesce("knn_distance", F.lit(0.0)), F.lit(p)).alias("threshold"))
    t = maybe_broadcast(t.select(F.col("grp").alias("_g"), "threshold"))
    out = near.join(t, F.col("grp").eqNullSafe(F.col("_g")))
    d = F.col("knn_distance")
    verdict = F.when(d.isNull(), "unjudged").when(F.round(d, 9) > F.round("threshold", 9), "outlier").otherwise("conforming")
    return out.select("id", "grp", d.alias("distance"), "threshold", F.lit(True).alias("calibrated"), verdict.alias("verdict"))


def _signatures(dim: int, tables: int, bits: int, seed: int):
    planes = np.random.RandomState(seed).normal(size=(dim, tables * bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(batch.schema.get_field_index("vec"))
            m = vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            side = (m @ planes > 0).reshape(len(m), tables, bits)
            codes = (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes), pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])

    return run


def nearest_approximate(queries: DataFrame, pool: DataFrame, k: int, dim: int, tables: int = 12, bucket_rows: int = 1024, skip_self: bool = True, seed: int = 5) -> DataFrame:
    """``nearest`` by random hyperplanes (O-71): a pair is compared if it lies on
    the same side of all planes of one of ``tables`` sets.

    A group of ``n`` rows gets ``log2(n / bucket_rows)`` planes a set, so buckets
    keep their size while the group grows and the work is in proportion to its
    rows; groups of up to ``bucket_rows`` are searched exactly.  Very near
    neighbours are found almost surely, distant ones less so: a query may get
    fewer than ``k``.  Vectors of another length take no part.
    """
    ok = (F.size("vec") == dim) & F.col("id").isNotNull()
    q, p = (d.select("id", "grp", "vec").filter(ok) for d in (queries, pool))
    n = p.groupBy(F.col("grp").alias("_g")).agg(F.count("*").alias("_n"))
    # at most 24 planes a set: beyond, buckets are cut into blocks
    n = maybe_broadcast(n.select("_g", F.least(F.greatest(F.ceil(F.log2(F.col("_n") / bucket_rows)), F.lit(0)), F.lit(24)).cast("int").alias("_bits")))
    kind = q.schema["id"].dataType.simpleString()
    grp = q.schema["grp"].dataType.simpleString()

    def bucketed(d: DataFrame) -> DataFrame:
        coded = d.mapInArrow(_signatures(dim, tables, 24, seed), f"id {kind}, grp {grp}, vec array<{d.schema['vec'].dataType.elementType.simpleString()}>, codes array<bigint>")
        sized = coded.join(n, F.col("grp").eqNullSafe(F.col("_g")))
        mask = F.expr("shiftleft(1L, _bits) - 1L")
        # without planes one set holds everything
        sets = F.when(F.col("_bits") == 0, F.slice("codes", 1, 1)).otherwise(F.col("codes"))
        named = F.transform(sets, lambda c, i: F.struct(F.col("grp").alias("grp"), i.alias("set"), c.bitwiseAND(mask).alias("code")))
        return sized.select("id", F.explode(named).alias("_b"), "vec").select("id", F.to_json("_b").alias("grp"), "vec")

    near = _block_neighbours(bucketed(q), bucketed(p), k, skip_self).distinct()
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def embed(texts: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray], dim: int, batch: int = 64) -> DataFrame:
    """``texts`` with ``embedding``, made by a function from up to ``batch`` texts to
    as many vectors of ``dim`` numbers (O-77).

    It runs on the executors and is the place for a model; results are scaled to
    length one, a vector of zeros stays, null texts get null, and a result of
    another shape is an error.
    """
    cols = texts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = pdf[text].notna().to_numpy()
            values = pdf[text][said].tolist()
            out: list = [None] * len(pdf)
            made: list = []
            for lo in range(0, len(values), batch):
                m = np.asarray(embedder(values[lo : lo + batch]), float)
                if m.shape != (len(values[lo : lo + batch]), dim):
                    raise ValueError(f"the embedder gave {m.shape}")
                size = np.linalg.norm(m, axis=1, keepdims=True)
                made += np.divide(m, size, out=np.zeros_like(m), where=size > 0).astype(np.float32).tolist()
            for i, v in zip(np.flatnonzero(said), made, strict=True):
                out[i] = v
            yield pdf.assign(embedding=out)[[*cols, "embedding"]]

    schema = T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return texts.mapInPandas(run, schema)


def hashed_words(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An embedder without a model: words counted in ``dim`` places by hash, with
    a sign.  The same on every machine."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", t):
                h = zlib.crc32(w.lower().encode())
                out[i, h % dim] += 1.0 if h & (1 << 30) else -1.0
        return out

    return run


def ngram_entropy(snippets: DataFrame, pool: DataFrame) -> DataFrame:
    """``id, n_grams, entropy``: mean bits per token pair of each snippet under the
    pair counts of the pool, each count plus one (O-78).

    Both: ``id, tokens``.  A pair's probability is its count over that of its
    first token, smoothed by the number of distinct tokens.  Snippets under two
    tokens give no rows.
    """
    pair = lambda d: d.filter(F.size("tokens") > 1).select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("tokens") - 2), lambda i: F.struct(F.get("tokens", i).alias("a"), F.get("tokens", i + 1).alias("b")))).alias("_p")).select("id", "_p.a", "_p.b")
    seen = pair(pool).groupBy("a", "b").agg(F.count("*").alias("n_pair"))
    first = seen.groupBy("a").agg(F.sum("n_pair").alias("n_first"))
    kinds = F.broadcast(pool.select(F.explode("tokens").alias("t")).agg(F.countDistinct("t").alias("n_kinds")))
    asked = pair(snippets).groupBy("id", "a", "b").agg(F.count("*").alias("n"))
    met = asked.join(seen, ["a", "b"], "left").join(first, "a", "left").crossJoin(kinds)
    bits = -F.log2((F.coalesce("n_pair", F.lit(0)) + 1) / (F.coalesce("n_first", F.lit(0)) + F.col("n_kinds")))
    return met.groupBy("id").agg(F.sum("n").alias("n_grams"), (F.sum(F.col("n") * bits) / F.sum("n")).alias("entropy"))


def ladder_rates(scored: DataFrame) -> DataFrame:
    """``n_ladders, monotone_rate, step_rate``: of edits of growing size (``id,
    level, distance``), the share of entries whose distance never falls from level
    to level, and the share of steps on which it doesn't (O-78)."""
    w = Window.partitionBy("id").orderBy("level")
    step = scored.withColumn("_up", F.col("distance") >= F.lag("distance").over(w)).filter("_up is not null")
    per = step.groupBy("id").agg(F.min(F.col("_up").cast("int")).alias("_all"), F.sum(F.col("_up").cast("int")).alias("_ok"), F.count("*").alias("_n"))
    return per.agg(F.count("*").alias("n_ladders"), F.avg("_all").alias("monotone_rate"), (F.sum("_ok") / F.sum("_n")).alias("step_rate"))


def semantic_search(pool: DataFrame, vector: list[float], k: int = 10, grp: str | int | None = None) -> DataFrame:
    """The ``k`` (at most 50) entries most like one vector (O-70)."""
    p = pool if grp is None else pool.filter(F.col("grp") == grp)
    q = F.array(*[F.lit(float(x)) for x in vector])
    dist = F.round(cosine_distance(F.col("vec"), q), 9)
    return p.select("id", "grp", (F.lit(1.0) - dist).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(min(max(k, 1), 50))


def near_duplicates(entries: DataFrame, pool: DataFrame, least: float = 0.85) -> DataFrame:
    """``id, duplicate_of, similarity``: the most similar pool entry, if similar
    enough (O-72)."""
    top = nearest(entries, pool, 1)
    sim = F.lit(1.0) - F.col("distance")
    return top.filter(F.round(sim, 9) >= least).select("id", F.col("neighbour").alias("duplicate_of"), sim.alias("similarity"))


def local_outlier_factors(pool: DataFrame, k: int = 20) -> DataFrame:
    """``id, lof``: density of the neighbours over the entry's own (O-78)."""
    near = nearest(pool, pool, k)
    kd = near.groupBy("id").agg(F.max("distance").alias("kd"))
    reach = near.join(kd.select(F.col("id").alias("_n"), F.col("kd").alias("_kd")), F.col("neighbour") == F.col("_n"))
    reach = reach.select("id", "neighbour", F.greatest("distance", "_kd").alias("reach"))
    lrd = reach.groupBy("id").agg(F.avg("reach").alias("_r")).select("id", (F.lit(1.0) / F.greatest("_r", F.lit(1e-12))).alias("lrd"))
    other = lrd.select(F.col("id").alias("_n"), F.col("lrd").alias("_lrd"))
    mean = near.join(other, F.col("neighbour") == F.col("_n")).groupBy("id").agg(F.avg("_lrd").alias("_m"))
    return mean.join(lrd, "id").select("id", (F.col("_m") / F.col("lrd")).alias("lof"))


def auroc(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """One row, ``auroc``: the share of pairs ranked rightly, ties counting half
    (O-78).  Scores are counted before they are ranked, and ranked in ranges."""
    c = scored.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n"))
    # scores are sorted over all tasks; only one sum per part goes through a single one
    parts = c.repartitionByRange("s").withColumn("_part", F.spark_partition_id())
    parts = checkpoint(parts)
    sums = parts.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = sums.select(F.col("_part").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    c = parts.withColumn("_in", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(before), F.col("_part") == F.col("_q")).withColumn("below", F.col("_in") + F.col("_before"))
    t = c.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return t.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auroc"))


def nearest_rank_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Minimum, median, p90, p95, maximum and mean by nearest rank (O-53)."""
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return df.groupBy(by).agg(F.min(value).alias("min_value"), q(0.5).alias("median_value"), q(0.9).alias("p90"), q(0.95).alias("p95"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"))
