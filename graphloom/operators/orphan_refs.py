"""References to records that do not exist.

A reference is alive if a life of its key was open when the referring record
was made: ``begin <= at < end`` (``end`` null: still open).  Everything else is
an orphan.

Plan: references are pre-aggregated per key and period (map-side combine).  Keys
that hold more than a share of all rows of their side are heavy, which bounds
their number by the share.  Their lives, merged into disjoint stretches, are
counted and, up to ``broadcast_rows``, broadcast, so the hot references never
move; beyond that bound they take an as-of pass split by key and day.  All other
keys take a plain shuffled anti-join.  Both orphan sets are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import BROADCAST_ROWS, checkpoint

#: A key with more than one in so many rows of a side is heavy: so many keys a side at most.
HEAVY_ONE_IN = 1000
FOREVER = "9999-12-31 00:00:00"


def _merged(lives: DataFrame, key: list[str]) -> DataFrame:
    """Disjoint stretches of the lives of each key (gaps and islands)."""
    end = F.coalesce(F.col("_end"), F.lit(FOREVER).cast("timestamp"))
    w = Window.partitionBy(*key).orderBy("_begin", "_stop")
    d = lives.withColumn("_stop", end).filter(F.col("_begin") < F.col("_stop"))
    d = d.withColumn("_reach", F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_island", F.sum(F.when(F.col("_begin") <= F.col("_reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*key, "_island").agg(F.min("_begin").alias("_begin"), F.max("_stop").alias("_end")).drop("_island")


def _asof_orphans(refs: DataFrame, lives: DataFrame, key: list[str]) -> DataFrame:
    """Orphans by one sorted pass per key and day.

    A reference is alive iff the latest end among the lives begun by then lies
    after it.  Days before contribute one carried maximum each, so a key's rows
    spread over as many groups as it has days, and no pairs are formed.
    """
    stop = F.coalesce(F.col("_end"), F.lit(FOREVER).cast("timestamp"))
    cols = refs.columns
    left = refs.withColumn("_row", F.struct(*cols)).select(*key, F.col("_at").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("timestamp").alias("_stop"), "_row")
    right = lives.select(*key, F.col("_begin").alias("_t"), F.lit(0).alias("_kind"), stop.alias("_stop"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    days = right.groupBy(*key, F.to_date("_t").alias("_day")).agg(F.max("_stop").alias("_stop"))
    asked = left.select(*key, F.to_date("_t").alias("_day"), F.lit(None).cast("timestamp").alias("_stop")).distinct()
    by_day = days.unionByName(asked).groupBy(*key, "_day").agg(F.max("_stop").alias("_stop"))
    w = Window.partitionBy(*key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_day.select(*key, F.to_timestamp("_day").alias("_t"), F.lit(-1).alias("_kind"), F.max("_stop").over(w).alias("_stop"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    both = left.unionByName(right).unionByName(carried).withColumn("_day", F.to_date("_t"))
    wd = Window.partitionBy(*key, "_day").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("_stop").over(wd)
    return both.withColumn("_reach", reach).filter((F.col("_kind") == 1) & ~F.coalesce(F.col("_reach") > F.col("_t"), F.lit(False))).select("_row.*")


def orphan_refs(
    refs: DataFrame,
    lives: DataFrame,
    key: list[str],
    at: str,
    begin: str,
    end: str,
    heavy_rows: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The rows of ``refs`` for which no life of their key was open.

    ``refs`` holds the columns ``key`` and ``at``; ``lives`` holds ``key``,
    ``begin`` and ``end``.  All columns of ``refs`` come back.  A reference with
    a null key part or a null ``at`` is an orphan; a life with a null ``begin``
    never began.  Exact copies of references come back as often as they went in;
    empty tables give all or no references.  Extra columns of ``lives`` are
    ignored, those of ``refs`` are kept whatever their names, except names that
    begin with an underscore, which are reserved.  Without ``heavy_rows`` a key is
    heavy if it holds more than one in ``HEAVY_ONE_IN`` rows of its side.
    """
    cols = refs.columns
    lives = lives.select(*key, F.col(begin).alias("_begin"), F.col(end).alias("_end")).dropna(subset=[*key, "_begin"])
    # both sides are read several times: for the counts, for the heavy and for the other keys
    lives = checkpoint(lives)
    refs = checkpoint(refs.withColumn("_at", F.col(at)))
    per_period = refs.dropna(subset=key).groupBy(*key, F.date_trunc("month", "_at").alias("_period")).agg(F.count("*").alias("_n"))

    def above(counts: DataFrame) -> DataFrame:
        if heavy_rows is not None:
            return counts.filter(F.col("_n") >= heavy_rows)
        total = F.broadcast(counts.agg(F.sum("_n").alias("_all")))
        return counts.crossJoin(total).filter(F.col("_n") * HEAVY_ONE_IN > F.col("_all")).drop("_all")

    heavy = above(per_period.groupBy(*key).agg(F.sum("_n").alias("_n")))
    hot = above(lives.groupBy(*key).agg(F.count("*").alias("_n")))
    # at most HEAVY_ONE_IN keys on each side (or rows / heavy_rows): the bound that lets them reach the driver's plan
    heavy_keys = heavy.select(*key).union(hot.select(*key)).distinct()
    found = heavy_keys.limit(broadcast_rows).collect()
    on = [F.col(f"r.{k}") == F.col(f"l.{k}") for k in key]
    alive = (F.col("l._begin") <= F.col("r._at")) & (F.col("l._end").isNull() | (F.col("r._at") < F.col("l._end")))
    if not found:
        return refs.alias("r").join(lives.alias("l"), [*on, alive], "left_anti").select(*cols)
    keys = F.broadcast(refs.sparkSession.createDataFrame(found, heavy_keys.schema))
    rare_refs, rare_lives = refs.join(keys, key, "left_anti"), lives.join(keys, key, "left_anti")
    rare = rare_refs.alias("r").join(rare_lives.alias("l"), [*on, alive], "left_anti").select(*cols)
    hot_refs, hot_lives = refs.join(keys, key, "left_semi"), lives.join(keys, key, "left_semi")
    # the merge is one sorted pass per key; only keys whose lives are few enough get it
    if hot_lives.limit(broadcast_rows + 1).count() <= broadcast_rows:
        merged = F.broadcast(_merged(hot_lives, key))
        hot_out = hot_refs.alias("r").join(merged.alias("l"), [*on, alive], "left_anti").select(*cols)
    else:
        dated = hot_refs.filter(F.col("_at").isNotNull())
        hot_out = _asof_orphans(dated, hot_lives, key).select(*cols).unionByName(hot_refs.filter(F.col("_at").isNull()).select(*cols))
    return rare.unionByName(hot_out)


def orphan_counts(refs: DataFrame, orphans: DataFrame, by: list[str], at: str) -> DataFrame:
    """References and orphans per ``by`` and month of ``at``.

    Columns ``by``, ``month`` (``yyyy-MM``, null where ``at`` is null),
    ``n_refs`` and ``n_orphans``.  Both sides are counted before they meet.
    """
    month: Column = F.date_format(at, "yyyy-MM").alias("month")
    tagged = refs.select(*by, month, F.lit(1).alias("_r"), F.lit(0).alias("_o")).unionByName(orphans.select(*by, month, F.lit(0).alias("_r"), F.lit(1).alias("_o")))
    return tagged.groupBy(*by, "month").agg(F.sum("_r").alias("n_refs"), F.sum("_o").alias("n_orphans"))
