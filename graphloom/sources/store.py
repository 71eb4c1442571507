"""Versioned tables: every write is a new version, made current by one pointer.

Plain parquet has no MERGE and must not be overwritten while it is read.  A table
is a folder of versions, each with a pointer ``_CURRENT.<number>`` that is created
after the version is complete and never replaced; readers see the version of the
highest number.  A pointer is written under another name and renamed into place,
and nothing is deleted before it stands, so a failure between any two steps
leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.cdc import upsert
from graphloom.session import latest


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


POINTER = "_CURRENT."


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointers in place, rising."""
    fs, jvm = _fs(spark, root)
    at = jvm.org.apache.hadoop.fs.Path(root)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    tails = [n[len(POINTER) :] for n in names if n.startswith(POINTER)]
    found = sorted(int(t) for t in tails if t.isdigit())
    if not found and any(n.startswith("v-") for n in names):
        # a first write that failed leaves a version without a pointer; a table that lost its pointers must not pass for an absent one
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/_TABLE")):
            raise RuntimeError(f"{root} holds versions but no pointer")
    return found


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the version in force, if the table exists; a table that has
    lost its pointers is an error."""
    numbers = _pointers(spark, root)
    if not numbers:
        return None
    fs, jvm = _fs(spark, root)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}{numbers[-1]}"))
    try:
        name = stream.readUTF()
    finally:
        stream.close()
    return f"{root}/{name}"


def read(spark: SparkSession, root: str) -> DataFrame | None:
    at = current(spark, root)
    return spark.read.parquet(at) if at else None


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete before it stands under its name; one that stands
    there already is an error."""
    fs, jvm = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path.rpartition('/')[0]}/_tmp-{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.writeUTF(text)
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    if fs.exists(target) or not fs.rename(tmp, target):
        fs.delete(tmp, False)
        raise RuntimeError(f"{path} stands already: another writer came first")


def write(df: DataFrame, root: str, partition_by: list[str] | None = None, keep: int = 2) -> str:
    """A new version of a table; returns its folder (O-15, O-87).

    Of two writers that start from one version the later one fails.  Once the
    new pointer stands, versions older than the last ``keep`` are deleted.
    """
    spark = df.sparkSession
    known = _pointers(spark, root)
    name = f"v-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{root}/{name}")
    number = known[-1] + 1 if known else 1
    _put(spark, f"{root}/{POINTER}{number}", name)
    fs, jvm = _fs(spark, root)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/_TABLE")):
        _put(spark, f"{root}/_TABLE", "1")
    _prune(spark, root, keep)
    return f"{root}/{name}"


def _prune(spark: SparkSession, root: str, keep: int) -> None:
    """Deletes what no reader of the last ``keep`` versions needs: first the
    version, then its pointer, never the newest."""
    fs, jvm = _fs(spark, root)
    for n in _pointers(spark, root)[: -max(keep, 1)]:
        pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}{n}")
        stream = fs.open(pointer)
        old = stream.readUTF()
        stream.close()
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{old}"), True)
        fs.delete(pointer, False)


def merge(spark: SparkSession, root: str, new: DataFrame, keys: list[str], preserve: dict[str, str] | None = None) -> None:
    """Upsert into a versioned table (O-15, O-16, O-18, O-19)."""
    old = read(spark, root)
    write(new if old is None else upsert(old, new, keys, preserve), root)


def merge_vectors(spark: SparkSession, root: str, new: DataFrame, dim: int, order: list[str]) -> None:
    """Upsert of vectors (``node_id, embedding`` and more), of which the last by
    ``order`` counts per node; one of another length is refused before anything
    is written (O-16)."""
    bad = new.filter(F.coalesce(F.size("embedding") != dim, F.lit(True)) | F.col("embedding").isNull()).select("node_id").first()
    if bad is not None:
        raise ValueError(f"the vector of {bad[0]} doesn't have {dim} numbers")
    merge(spark, root, latest(new, ["node_id"], order, new.columns).select(*new.columns), ["node_id"])


def delete(spark: SparkSession, root: str, ids: DataFrame, key: str) -> None:
    """A version without the rows of the given ids (O-17)."""
    old = read(spark, root)
    if old is not None:
        write(old.join(ids.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti"), root)


def counts(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """``table, rows`` of each table, null where it doesn't exist (O-21, O-54)."""
    rows = [(k, None if (t := read(spark, r)) is None else t.count()) for k, r in roots.items()]
    return spark.createDataFrame(rows, "table string, rows long")


def reset(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Empties every table that exists; returns what each held (O-21)."""
    held = counts(spark, roots)
    held = spark.createDataFrame(held.collect(), held.schema)
    for r in roots.values():
        t = read(spark, r)
        if t is not None:
            write(t.limit(0), r)
    return held


def render(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """``line_no, line``: rows of a bounded read as text, a heading and one line
    per row, nulls left out (O-20).  The rows are those of a top-k read: their
    order goes through one task."""
    part = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
    lines = df.select(F.row_number().over(Window.orderBy(*order)).alias("line_no"), F.concat(F.lit("- "), F.concat_ws(", ", *[part(c) for c in df.columns])).alias("line"))
    return df.sparkSession.createDataFrame([(0, f"# {title}")], "line_no int, line string").unionByName(lines)


def envelope(df: DataFrame, kind: str) -> DataFrame:
    """Rows as JSON texts with the version of their schema (O-20)."""
    return df.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit(kind).alias("kind"), F.struct(*df.columns).alias("item"))).alias("json"))
