"""What changed between consecutive full snapshots.

All snapshots are range-partitioned and sorted by key together, so the same
stretch of keys of every snapshot lies in one task.  There the keys are cut into
content-defined chunks (a key whose hash ends in zeros starts a chunk), each
chunk of each snapshot gets a digest, and chunks whose digests agree between two
consecutive snapshots are discarded.  Only rows of unmatched chunks leave the
task; a join on the key classifies them.  A task holds one chunk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A chunk holds this many keys on average, and never more than CHUNK_MOST.
CHUNK_KEYS = 64
CHUNK_MOST = 4096


def _unmatched(n_snapshots: int, keys: list[str]):
    """Rows of chunks whose digests differ between consecutive snapshots, with
    the number of the later one in ``_pair`` and their side in ``_later``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None

        def emit(tbl: pa.Table, starts: np.ndarray) -> pa.Table | None:
            seq = tbl.column("_seq").to_numpy()
            digest_in = tbl.column("_row").to_numpy().astype(np.uint64)
            chunk = np.zeros(len(seq), np.int64)
            chunk[starts[1:]] = 1
            chunk = np.cumsum(chunk)
            n_chunks = len(starts)
            # order matters within a chunk, so each row's hash is weighted by its rank there
            flat = chunk * n_snapshots + seq
            order = np.argsort(flat, kind="stable")
            first = np.r_[0, np.flatnonzero(np.diff(flat[order])) + 1]
            rank = np.empty(len(seq), np.uint64)
            rank[order] = (np.arange(len(seq)) - np.repeat(first, np.diff(np.r_[first, len(seq)]))).astype(np.uint64)
            digests = np.zeros((n_chunks, n_snapshots, 2), np.uint64)
            with np.errstate(over="ignore"):
                mixed = (digest_in ^ (digest_in >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                np.add.at(digests[:, :, 0], (chunk, seq), digest_in * (rank * np.uint64(2) + np.uint64(1)))
                np.add.at(digests[:, :, 1], (chunk, seq), mixed + rank)
            counts = np.zeros((n_chunks, n_snapshots), np.int64)
            np.add.at(counts, (chunk, seq), 1)
            same = (digests[:, 1:] == digests[:, :-1]).all(axis=2) & (counts[:, 1:] == counts[:, :-1])
            differs = np.zeros((n_chunks, n_snapshots + 1), bool)
            differs[:, 1:-1] = ~same
            parts = []
            for later in (True, False):
                # as the later side of pair seq, or as the earlier side of pair seq + 1
                take = np.flatnonzero(differs[chunk, seq if later else seq + 1])
                if len(take):
                    t = tbl.take(pa.array(take)).select([*keys, "_hash"])
                    t = t.append_column("_pair", pa.array((seq[take] + (0 if later else 1)).astype(np.int32)))
                    parts.append(t.append_column("_later", pa.array(np.full(len(take), later))))
            return pa.concat_tables(parts) if parts else None

        for batch in batches:
            tbl = pa.Table.from_batches([batch])
            if carry is not None:
                tbl = pa.concat_tables([carry, tbl]).combine_chunks()
            key_hash = tbl.column("_key").to_numpy()
            new_key = np.r_[True, key_hash[1:] != key_hash[:-1]]
            starts = np.flatnonzero(new_key & (key_hash % CHUNK_KEYS == 0))
            starts = starts if len(starts) and starts[0] == 0 else np.r_[0, starts]
            if len(tbl) - starts[-1] > CHUNK_MOST * n_snapshots:
                # no boundary came for very long: end the chunk at the last key begun
                starts = np.r_[starts, max(starts[-1], np.flatnonzero(new_key)[-1])]
            carry = tbl.slice(starts[-1])
            if starts[-1] > 0:
                out = emit(tbl.slice(0, starts[-1]), np.unique(starts[:-1]))
                if out is not None:
                    yield from out.to_batches()
        if carry is not None and len(carry):
            out = emit(carry, np.array([0]))
            if out is not None:
                yield from out.to_batches()

    return run


def snapshot_changes(
    df: DataFrame,
    snapshot: str,
    taken_at: str,
    keys: list[str],
    value: Column,
    pick: str,
) -> DataFrame:
    """Rows added, removed or changed between consecutive snapshots.

    Returns ``snapshot`` (the later of the two), the keys, and ``change``
    (``added``, ``removed``, ``changed``).  Snapshots follow each other by the
    earliest ``taken_at`` of their rows, then by ``snapshot``; gaps in the
    numbering don't matter.  If a snapshot has several rows of a key, the one
    with the greatest ``pick`` counts, then the greatest value; null ``pick`` is
    lowest.  ``value`` is compared null-safely.  Null key parts are a key of
    their own; rows without a snapshot are ignored.  Fewer than two snapshots or
    an empty table give no rows.  Other columns of ``df`` are ignored.
    """
    spark = df.sparkSession
    out_cols = [snapshot, *keys, "change"]
    taken = df.filter(F.col(snapshot).isNotNull()).groupBy(snapshot).agg(F.min(taken_at).alias("_t"))
    # the list of deliveries is short whatever their size
    order = [r[0] for r in taken.orderBy(F.col("_t").asc_nulls_first(), snapshot).select(snapshot).collect()]
    kind = df.schema[snapshot].dataType
    if len(order) < 2:
        return df.limit(0).select(snapshot, *keys, F.lit("").alias("change"))
    seq = spark.createDataFrame([(s, i) for i, s in enumerate(order)], f"_s {kind.simpleString()}, _seq int")
    rows = df.filter(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("_s"), *keys, F.struct(F.col(pick).alias("p"), value.alias("v")).alias("_best"))
    rows = rows.groupBy("_s", *keys).agg(F.max("_best").alias("_best"))
    rows = rows.join(F.broadcast(seq), "_s").select("_seq", *keys, F.col("_best.v").alias("_hash"), F.xxhash64(*keys).alias("_key"))
    rows = rows.withColumn("_row", F.xxhash64(*keys, "_hash", F.col("_hash").isNull()))
    arranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "_seq")
    fields = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "_hash string", "_pair int", "_later boolean"])
    left = arranged.mapInArrow(_unmatched(len(order), keys), fields)
    # the join on the key: both sides of a pair meet in one aggregation
    met = left.groupBy("_pair", *keys).agg(
        F.max("_later").alias("_now"),
        F.max(~F.col("_later")).alias("_then"),
        F.max(F.when(F.col("_later"), F.col("_hash"))).alias("_new"),
        F.max(F.when(~F.col("_later"), F.col("_hash"))).alias("_old"),
    )
    change = F.when(~F.col("_then"), "added").when(~F.col("_now"), "removed").when(~F.col("_new").eqNullSafe(F.col("_old")), "changed")
    names = seq.select(F.col("_seq").alias("_pair"), F.col("_s").alias(snapshot))
    return met.withColumn("change", change).filter(F.col("change").isNotNull()).join(F.broadcast(names), "_pair").select(*out_cols)
