"""Session defaults, shared-storage checkpoints and bounded broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides below this many rows may be broadcast after they have been counted.
BROADCAST_ROWS = 200_000


def build_session(app: str = "graphloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators rely on: UTC, AQE with skew
    splitting, Arrow, and shuffle partitions that AQE may coalesce."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, str(v))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a session that names none gets a temporary one, which is right for a
    local master and refused on a cluster, where it would not be shared.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="graphloom-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if it has at most ``limit`` rows, else ``df`` itself
    (a shuffle join).  The count stops at ``limit + 1`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def latest(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The row with the greatest ``order`` columns of each key.

    An aggregation with map-side combine instead of a window, so a key that
    holds a third of all rows is reduced before the shuffle.  Ties fall to the
    greatest remaining columns, which makes the pick deterministic; nulls sort
    lowest; null keys form one group.
    """
    rest = [c for c in cols if c not in order and c not in keys]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.max(packed).alias("_latest"))
    return picked.select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in cols if c not in keys])
