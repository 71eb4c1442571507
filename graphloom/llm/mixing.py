"""Mixing sources to target weights.

Token counts are reduced to cells of source, language and topic.  Iterative
proportional fitting rakes the cells' tokens until the margins of all three
agree with their targets, no cell above what its repeats allow; a last pass on
the source margin makes the shares of sources exact.  Documents are then taken
by their cell's calibrated rate: its whole part for every document, its fraction
by systematic sampling along the order of sizes.  What whole documents leave of a
source's goal is settled by a few single uses.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import checkpoint, maybe_broadcast

DIMS = ("source", "lang", "topic")


def feasible_total(cells: pd.DataFrame) -> float:
    """The largest total at which every source reaches its share within its repeats."""
    by = cells.groupby("source").agg(tokens=("tokens", "sum"), share=("share", "first"), repeats=("repeats", "first"))
    by = by[by["share"] > 0]
    return float((by["tokens"] * by["repeats"] / by["share"]).min()) if len(by) else 0.0


def fill(want: float, weight: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """``want`` divided in proportion to ``weight``, none above its ``cap``."""
    out = np.zeros_like(weight)
    free = cap > 0
    weight = np.where(free & (weight <= 0), 1e-12, weight)
    while free.any() and want - out.sum() > 1e-9 * max(want, 1.0):
        left = want - out[~free].sum()
        scaled = weight * (left / weight[free].sum())
        over = free & (scaled >= cap)
        out[free] = np.minimum(scaled, cap)[free]
        if not over.any():
            break
        free &= ~over
    return out


def rake(cells: pd.DataFrame, total: float, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Tokens each cell contributes.

    ``cells``: ``source, lang, topic, tokens, share, repeats``.  Languages and
    topics aim at their shares of the tokens at hand.
    """
    tokens = cells["tokens"].to_numpy(float)
    cap = tokens * cells["repeats"].to_numpy(float)
    share = cells["share"].to_numpy(float)
    w = np.where(share > 0, tokens, 0.0)
    margins = []
    for d in DIMS:
        code, _ = pd.factorize(cells[d], use_na_sentinel=False)
        n = code.max() + 1 if len(code) else 0
        if d == "source":
            goal = np.zeros(n)
            goal[code] = share * total
        else:
            at_hand = np.bincount(code, np.where(share > 0, tokens, 0.0), n)
            goal = total * at_hand / max(at_hand.sum(), 1e-12)
        margins.append((code, n, goal))
    for _ in range(rounds):
        before = w.copy()
        for code, n, goal in margins:
            have = np.bincount(code, w, n)
            w = np.minimum(w * np.where(have > 0, goal / np.where(have > 0, have, 1.0), 0.0)[code], cap)
        if np.abs(w - before).max(initial=0.0) <= tolerance * max(total, 1.0):
            break
    code, n, goal = margins[0]
    order = np.argsort(code, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []:
        w[part] = fill(goal[code[part[0]]], w[part], cap[part])
    return w


def _settle(drawn: DataFrame, goal: DataFrame, seed: int) -> DataFrame:
    """Uses moved by one for a few records, so that every source meets its goal
    to within a few tokens.

    First as many records as fit into the difference, in an order by hash, then
    the one record whose size comes closest to what is left.  Both look at one
    bucket of each source only, so a hot source is never gathered.
    """

    def missing(d: DataFrame) -> DataFrame:
        used = d.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("_used"))
        return maybe_broadcast(used.join(goal, F.col("source") == F.col("_g")).select("_g", (F.col("goal") - F.col("_used")).alias("_miss")))

    def moved(d: DataFrame, steps: DataFrame) -> DataFrame:
        m = steps.select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), "_step")
        j = d.join(m, (F.col("doc_id") == F.col("_i")) & (F.col("source") == F.col("_s")), "left")
        return checkpoint(j.withColumn("n_uses", (F.col("n_uses") + F.coalesce("_step", F.lit(0))).cast("int")).drop("_i", "_s", "_step"))

    more, less = F.col("n_uses") < F.col("max_repeats"), F.col("n_uses") > 0
    near = drawn.filter("_b = 0").join(missing(drawn), F.col("source") == F.col("_g"))
    fits = near.filter(((F.col("_miss") > 0) & more | (F.col("_miss") < 0) & less) & (F.col("n_tokens") <= F.abs("_miss")))
    w = Window.partitionBy("source").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    first = fits.withColumn("_sum", F.sum("n_tokens").over(w)).filter(F.col("_sum") <= F.abs("_miss")).withColumn("_step", F.signum("_miss").cast("int"))
    drawn = moved(drawn, first)
    near = drawn.filter("_b = 0").join(missing(drawn), F.col("source") == F.col("_g"))
    either = near.withColumn("_step", F.explode(F.array(F.when(more, 1), F.when(less, -1)))).filter("_step is not null")
    off = F.abs(F.col("_miss") - F.col("_step") * F.col("n_tokens"))
    best = either.filter(off < F.abs("_miss")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "doc_id", "_step")).alias("_m"))
    return moved(drawn, best.select("source", "_m.doc_id", "_m._step"))


def mixture(
    docs: DataFrame,
    source: Column,
    lang: Column,
    topic: Column,
    doc_id: str,
    tokens: str,
    targets: DataFrame,
    total_tokens: float | None = None,
    seed: int = 17,
    bucket: int = 50_000,
    most_cells: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """``(chosen, shares)``.

    ``docs`` holds one row per record; ``targets``: ``source, target_share,
    max_repeats``.  ``chosen``: ``doc_id, source, n_tokens, n_uses`` for every
    record used, ``n_uses`` at most the source's ``max_repeats``.  ``shares``: per
    target its share, the one aimed at after targets without any document are
    left out, tokens at hand, tokens and records used, the share reached.

    The size is ``total_tokens``, or the largest at which every source can reach
    its share within its repeats; a larger one leaves scarce sources below their
    share.  Sources without a target aren't used.  Of several targets of a source
    the shares add up and the smallest cap holds; null or negative shares count
    as 0, caps under 1 as 1.  Null languages and topics are values of their own.
    Records without tokens are never used; empty tables give an empty mixture.
    The rates are fitted on the driver, per combination of the three labels; more
    than ``most_cells`` of them are refused.
    """
    spark = docs.sparkSession
    t = targets.groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.greatest(F.min(F.coalesce("max_repeats", F.lit(1))), F.lit(1)).cast("int").alias("max_repeats")).filter("source is not null")
    named = docs.select(F.col(doc_id).alias("doc_id"), source.alias("source"), F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(topic, F.lit("")).alias("topic"), F.col(tokens).alias("n_tokens"))
    use = checkpoint(named.join(maybe_broadcast(t.filter("target_share > 0").select("source", "max_repeats")), "source").filter("n_tokens > 0"))
    counts = use.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    # a cell is a combination of three labels, not of records
    cells = counts.limit(most_cells + 1).toPandas()
    if len(cells) > most_cells:
        raise ValueError(f"more than {most_cells} combinations of source, language and topic")
    goals = t.toPandas().set_index("source")
    cells["share"] = cells["source"].map(goals["target_share"]).astype(float)
    cells["repeats"] = cells["source"].map(goals["max_repeats"]).astype(float)
    present = goals[goals.index.isin(cells["source"])]["target_share"].sum()
    cells["share"] = cells["share"] / present if present else cells["share"]
    total = feasible_total(cells) if total_tokens is None else float(total_tokens)
    cells["rate"] = np.minimum(rake(cells, total) / cells["tokens"].to_numpy(float), cells["repeats"].to_numpy(float)) if len(cells) else []
    per_source = cells.groupby("source")["n"].sum() if len(cells) else pd.Series(dtype=float)
    cells["nb"] = [int(-(-per_source[s] // bucket)) for s in cells["source"]]
    rates = spark.createDataFrame([(str(r.source), str(r.lang), str(r.topic), float(r.rate), r.nb) for r in cells.itertuples()], "_s string, _l string, _t string, rate double, nb int")
    rated = use.join(maybe_broadcast(rates), (F.col("source") == F.col("_s")) & (F.col("lang") == F.col("_l")) & (F.col("topic") == F.col("_t")))
    # a hot source is sampled in many independent buckets
    dice = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("nb"))
    rated = rated.withColumn("_b", dice).withColumn("_whole", F.floor("rate")).withColumn("_part", F.col("rate") - F.floor("rate"))
    w = Window.partitionBy("source", "_b").orderBy("n_tokens", F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("source", "_b", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    run = F.round(F.sum("_part").over(w), 9)
    extra = F.floor(run + start) - F.floor(F.round(run - F.col("_part"), 9) + start)
    drawn = rated.withColumn("n_uses", F.least(F.col("_whole") + extra, F.col("max_repeats")).cast("int")).select("doc_id", "source", "n_tokens", "n_uses", "max_repeats", "_b")
    goal = spark.createDataFrame([(str(k), float(v) * total) for k, v in (cells.groupby("source")["share"].first().items() if len(cells) else ())], "_g string, goal double")
    chosen = checkpoint(_settle(checkpoint(drawn), goal, seed).filter("n_uses > 0").select("doc_id", "source", "n_tokens", "n_uses"))
    used = chosen.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("used_tokens"), F.count("*").alias("n_records"), F.sum("n_uses").cast("long").alias("n_uses"), F.max("n_uses").alias("most_uses"))
    hand = use.groupBy(F.col("source").alias("_h")).agg(F.sum("n_tokens").alias("tokens_at_hand"))
    aim = F.when(F.col("_h").isNotNull(), F.col("target_share") / F.lit(float(present) or 1.0)).otherwise(F.lit(0.0))
    shares = t.join(hand, F.col("source") == F.col("_h"), "left").join(used, F.col("source") == F.col("_s"), "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tokens_at_hand", "used_tokens", "n_records", "n_uses", "most_uses")}
    shares = shares.withColumn("aimed_share", aim).withColumns(zero)
    everything = float(chosen.agg(F.sum(F.col("n_tokens") * F.col("n_uses"))).first()[0] or 0) or 1.0
    shares = shares.withColumn("share", F.col("used_tokens") / F.lit(everything))
    return chosen, shares.select("source", "target_share", "aimed_share", "share", "max_repeats", "most_uses", "tokens_at_hand", "used_tokens", "n_records", "n_uses")
