"""Incremental versions of the change-capture operators.

An extension: the plans here follow files as they arrive, with the stream's
checkpoint as the cursor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import cdc
from graphloom.session import latest
from graphloom.sources import store


def follow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def sync_nodes(batches: DataFrame, root: str, checkpoint: str, validate=None):
    """Applies every batch of nodes (``file_path, name, content_hash, loaded_at``
    and more) to a versioned table; the query runs until the input is used up.

    A batch whose result ``validate`` refuses raises before the table's pointer
    moves, so the cursor stays behind it (commit after validation).  Applying a
    batch twice gives the same table.
    """

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keys = ["file_path", "name"]
        new = latest(batch, keys, ["loaded_at"], batch.columns).select(*batch.columns)
        old = store.read(spark, root)
        out = new if old is None else cdc.upsert(old, new, keys)
        if validate is not None and not validate(out):
            raise ValueError("the batch doesn't pass validation")
        store.write(out, root)

    return batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SESSION = "session_id string, last_id long, n_events long, summary string"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last, n, summary = state.get if state.exists else (0, 0, "")
    for f in frames:
        for i, s in f.sort_values("id")[["id", "summary"]].itertuples(index=False):
            last, n = max(last, int(i)), n + 1
            summary = f"{summary}\n---\n{s}" if summary and s else summary or s or ""
    state.update((last, n, summary))
    yield pd.DataFrame([(key[0], last, n, summary)], columns=["session_id", "last_id", "n_events", "summary"])


def merge_sessions(events: DataFrame) -> DataFrame:
    """The running note of each session, updated as events (``session_id, id,
    summary``) arrive (O-92)."""
    e = events.filter("session_id is not null").select("session_id", "id", "summary")
    return e.groupBy("session_id").applyInPandasWithState(_fold, SESSION, "last_id long, n_events long, summary string", "update", "NoTimeout")


def event_rates(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind; a window closes once the watermark passes it."""
    g = events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("begin"), by, "n")
