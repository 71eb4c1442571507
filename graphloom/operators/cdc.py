"""Change data capture: diffs, and tables after changes are applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str, scope: DataFrame | None = None) -> DataFrame:
    """``keys, op``: ``create``, ``update`` or ``delete`` (O-84).

    Rows differ if their values do or either is null.  ``scope`` (one column
    ``file_path``) limits deletions to the files of the batch.  Keys are unique on
    either side.
    """
    o = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col(value).alias("_ov"), F.lit(True).alias("_o"))
    n = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.col(value).alias("_nv"), F.lit(True).alias("_n"))
    on = [F.col(f"_o_{k}") == F.col(f"_n_{k}") for k in keys]
    j = o.join(n, on, "full_outer")
    changed = F.col("_ov").isNull() | F.col("_nv").isNull() | (F.col("_ov") != F.col("_nv"))
    op = F.when(F.col("_o").isNull(), "create").when(F.col("_n").isNull(), "delete").when(changed, "update")
    out = j.select(*[F.coalesce(f"_n_{k}", f"_o_{k}").alias(k) for k in keys], op.alias("op")).filter("op is not null")
    if scope is None:
        return out
    files = scope.select(F.col("file_path").alias("_f")).distinct()
    return out.filter("op <> 'delete'").unionByName(out.filter("op = 'delete'").join(files, F.col("file_path") == F.col("_f"), "left_semi"))


def diff_imports(old: DataFrame, new: DataFrame, keys: list[str], names: str) -> DataFrame:
    """``keys, op`` of import edges: ``add`` if new or if the imported names differ
    as a multiset, ``remove`` if gone (O-85)."""
    o = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.array_sort(names).alias("_ov"), F.lit(True).alias("_o"))
    n = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.array_sort(names).alias("_nv"), F.lit(True).alias("_n"))
    j = o.join(n, [F.col(f"_o_{k}") == F.col(f"_n_{k}") for k in keys], "full_outer")
    op = F.when(F.col("_n").isNull(), "remove").when(F.col("_o").isNull() | ~F.col("_ov").eqNullSafe(F.col("_nv")), "add")
    return j.select(*[F.coalesce(f"_n_{k}", f"_o_{k}").alias(k) for k in keys], op.alias("op")).filter("op is not null")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], preserve: dict[str, str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key (O-15,
    O-18, O-19).

    ``preserve`` names columns that keep their old value, with the value for new
    keys (a node's domain).  The last of several new rows must be chosen before.
    """
    fresh = new
    for c, default in (preserve or {}).items():
        kept = old.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(c).alias("_kept"))
        fresh = fresh.drop(c).join(kept, [F.col(k) == F.col(f"_k_{k}") for k in keys], "left").withColumn(c, F.coalesce("_kept", F.lit(default)))
    fresh = fresh.select(*old.columns)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(fresh)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of ``gone`` (``id``) and all their edges
    (O-88)."""
    g = gone.select(F.col("id").alias("_g")).distinct()
    left = nodes.join(g, F.col("id") == F.col("_g"), "left_anti")
    kept = edges.join(g, F.col("src") == F.col("_g"), "left_anti").join(g, F.col("dst") == F.col("_g"), "left_anti")
    return left, kept


def replace_edges(edges: DataFrame, rebuilt: DataFrame, sources: DataFrame, types: list[str]) -> DataFrame:
    """``edges`` in which those of ``types`` that leave ``sources`` (``id``) are
    replaced by ``rebuilt`` (O-89)."""
    s = sources.select(F.col("id").alias("_s")).distinct()
    mine = F.col("type").isin(types)
    stay = edges.filter(~mine).unionByName(edges.filter(mine).join(s, F.col("src") == F.col("_s"), "left_anti"))
    return stay.unionByName(rebuilt.select(*edges.columns))


def apply_changes(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, deleted_files: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after a batch, in the order: deleted files, deleted nodes, new
    and changed nodes, rebuilt edges (O-87).

    ``changes``: the result of ``diff`` on ``file_path, name``; ``new_nodes`` has
    ``id`` and all columns of ``nodes``.
    """
    files = deleted_files.select(F.col("file_path").alias("_f")).distinct()
    by_file = nodes.join(files, F.col("file_path") == F.col("_f"), "left_semi").select("id")
    ops = changes.select(F.col("file_path").alias("_p"), F.col("name").alias("_n"), "op")
    on = (F.col("file_path") == F.col("_p")) & (F.col("name") == F.col("_n"))
    by_diff = nodes.join(ops.filter("op = 'delete'"), on, "left_semi").select("id")
    nodes2, edges2 = delete_nodes(nodes, edges, by_file.unionByName(by_diff))
    touched = new_nodes.join(ops.filter("op <> 'delete'"), on, "left_semi")
    # edge types are the names of the model, a handful
    types = [r[0] for r in new_edges.select("type").distinct().collect()]
    mine = new_edges.join(touched.select(F.col("id").alias("_t")).distinct(), F.col("src") == F.col("_t"), "left_semi")
    return upsert(nodes2, touched, ["id"]), replace_edges(edges2, mine, touched.select("id"), types)


def maintain_vectors(vectors: DataFrame, changes: DataFrame, entities: DataFrame, embed) -> DataFrame:
    """``vectors`` after a synchronisation (O-94): those of deleted entities go,
    those of created and changed ones are embedded anew, all others stay.

    ``vectors``: ``node_id`` and more; ``changes``: the result of ``diff`` on
    ``file_path, name``; ``entities``: ``file_path, name`` and what ``embed``, a
    function from DataFrame to DataFrame, turns into the columns of ``vectors``.
    Only changed entities reach it.
    """
    ops = changes.select(F.concat_ws("::", "file_path", "name").alias("_id"), "op")
    gone = ops.select("_id").distinct()
    left = vectors.join(gone, F.col("node_id") == F.col("_id"), "left_anti")
    due = entities.join(ops.filter("op <> 'delete'"), F.concat_ws("::", "file_path", "name") == F.col("_id"), "left_semi")
    return left.unionByName(embed(due).select(*vectors.columns))


def link_changes(entities: DataFrame, changed: DataFrame) -> DataFrame:
    """``entity, hash``: entities of the files a change touched (O-90)."""
    c = changed.select(F.col("file_path").alias("_f"), "hash").distinct()
    return entities.join(c, F.col("file_path") == F.col("_f")).select(F.col("id").alias("entity"), "hash").distinct()


def count_links(entities: DataFrame, changed: DataFrame) -> DataFrame:
    """``hash, n_entities``: the number of entities that ``link_changes`` pairs with
    each change, without a row for each pair (O-90): a file with many entities that
    many changes touch would have their product.

    Entities are counted by the set of files their id lies in, which is one file
    but for ids of a name or path with ``::``; an id in several files of a change
    counts once.  Null ids count nothing, but a change of which only such were
    found keeps its row.
    """
    where = entities.filter("file_path is not null").groupBy("id", F.when(F.col("id").isNull(), F.col("file_path")).alias("_p")).agg(F.sort_array(F.collect_set("file_path")).alias("_files"))
    sets = where.groupBy("_files").agg(F.count("id").alias("_n"))
    per_file = sets.select("_files", "_n", F.explode("_files").alias("_f"))
    touched = changed.join(per_file, F.col("file_path") == F.col("_f")).select("hash", "_files", "_n").distinct()
    return touched.groupBy("hash").agg(F.sum("_n").alias("n_entities"))
