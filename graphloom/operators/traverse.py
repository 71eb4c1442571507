"""Walking the graph: bounded traversal, neighbourhoods, reference checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lookup import find_by_name
from graphloom.session import checkpoint, maybe_broadcast

MAX_DEPTH = 6


def reach(edges: DataFrame, starts: DataFrame, depth: int = 3, reverse: bool = False, most: int = MAX_DEPTH) -> DataFrame:
    """``start, node, hop``: nodes within ``depth`` edges and their least hop (O-47,
    O-55).

    ``edges``: ``src, dst``; ``starts``: ``start``.  A start is listed itself only
    if a circle leads back to it (O-55b).  Every level joins only the nodes first
    seen on the level before, distinct, so neither walks nor paths multiply; the
    lineage is cut once a level.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    front = starts.filter("start is not null").select("start", F.col("start").alias("node")).distinct()
    seen = None
    for hop in range(1, min(depth, most) + 1):
        # a frontier of known size goes to the edges; only beyond it are the edges shuffled
        nxt = e.join(maybe_broadcast(front), F.col("node") == F.col("_a")).select("start", F.col("_b").alias("node")).distinct()
        if seen is not None:
            nxt = nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = checkpoint(nxt)
        level = front.withColumn("hop", F.lit(hop))
        seen = level if seen is None else seen.unionByName(level)
        if front.isEmpty():
            break
    return seen


def start_candidates(nodes: DataFrame, name: str, path: str | None = None, limit: int = 5) -> DataFrame:
    """``id, name, file_path, tier``: functions and types a start's name may mean
    (O-22, O-23, O-32).  More than one row is an ambiguous start, which
    ``flow_from`` answers with these candidates (O-55c)."""
    return find_by_name(nodes.filter(F.col("label").isin("Function", "Type")), name, path, limit).select("id", "name", "file_path", "tier")


def flow_from(edges: DataFrame, nodes: DataFrame, name: str, path: str | None = None, depth: int = 3, reverse: bool = False, limit: int = 50) -> DataFrame:
    """``kind, id, name, label, hop`` of the data flow of a start given by name.

    ``kind`` is ``flow``, or ``candidate`` (``hop`` null) where the name means
    several nodes, which are listed instead of a traversal (O-55c); a name that
    means none gives no rows.  The candidates are at most ``limit`` rows.
    """
    found = start_candidates(nodes, name, path, limit)
    starts = [r["id"] for r in found.select("id").distinct().collect()]
    if len(starts) != 1:
        known = nodes.filter(F.col("id").isin(starts)) if starts else nodes.limit(0)
        return known.select(F.lit("candidate").alias("kind"), "id", "name", "label", F.lit(None).cast("int").alias("hop")).distinct()
    one = nodes.sparkSession.createDataFrame([(starts[0],)], "start string")
    return data_flow(edges, nodes, one, depth, reverse, limit=limit).select(F.lit("flow").alias("kind"), "id", "name", "label", "hop")


def data_flow(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 3, reverse: bool = False, labels: tuple[str, ...] = ("Function", "Type"), limit: int = 50) -> DataFrame:
    """``start, id, name, label, hop``, nearest first, ``limit`` per start: only
    nodes of ``labels`` come out, any node may lie between (O-55)."""
    found = reach(edges, starts, depth, reverse)
    n = nodes.filter(F.col("label").isin(*labels)).select("id", "name", "label")
    w = Window.partitionBy("start").orderBy("hop", "name", "id")
    return found.join(n, F.col("node") == F.col("id")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).select("start", "id", "name", "label", "hop")


def neighbours(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """``ref, neighbour``: every reference and the nodes one edge away in either
    direction (O-43, O-57)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src is not null and dst is not null")
    near = refs.join(both, F.col("ref") == F.col("src")).select("ref", F.col("dst").alias("neighbour"))
    return near.unionByName(refs.select("ref", F.col("ref").alias("neighbour"))).distinct()


def validate_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``refs`` (``ref`` and more) with ``found`` (O-37)."""
    known = nodes.select(F.col("id").alias("_id")).distinct()
    return refs.join(known, F.col("ref") == F.col("_id"), "left").withColumn("found", F.col("_id").isNotNull()).drop("_id")


def without_chain(nodes: DataFrame, edges: DataFrame, ends: DataFrame, most: int = 3) -> DataFrame:
    """Nodes (``id``) from which no chain of up to ``most`` edges leads to one of
    ``ends`` (``id``) (O-38, O-56).  Walked backwards from the ends, so the work
    follows their surroundings, not all nodes."""
    good = reach(edges, ends.select(F.col("id").alias("start")), most, reverse=True, most=most)
    return nodes.join(good.select(F.col("node").alias("_g")).distinct(), F.col("id") == F.col("_g"), "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """``id, n_in, n_out, hub_score``: the score is the product of both degrees
    plus their sum (O-58; the formula is this engine's own)."""
    out = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    inn = edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    d = out.unionByName(inn).filter("id is not null").groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return d.withColumn("hub_score", F.col("n_in") * F.col("n_out") + F.col("n_in") + F.col("n_out"))


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes nothing points at: possibly dead (O-58)."""
    used = edges.filter("dst is not null and src <> dst").select(F.col("dst").alias("_d")).distinct()
    return nodes.join(used, F.col("id") == F.col("_d"), "left_anti")


def suffixes(name: Column, sep: str = ".") -> Column:
    """The name and what is left after each separator: ``a.b.c``, ``b.c``, ``c``."""
    parts = F.split(name, "\\" + sep)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), sep))


def resolve_calls(calls: DataFrame, functions: DataFrame, same_file: bool | None = None) -> DataFrame:
    """``caller_path, caller, callee, target_path, target``: one function per call
    (O-39).

    ``calls``: ``caller_path, caller, callee``; ``functions``: ``file_path, name``.
    A call meets functions whose name is the callee or ends in ``.callee``; the
    names' suffixes are exploded, which makes it an equality join.  Exact names
    come first, then the smallest path and name.  ``same_file`` keeps targets of
    the caller's file or of others only.
    """
    keys = functions.filter("name is not null").select("file_path", "name", F.explode(suffixes(F.col("name"))).alias("_key"))
    keys = keys.withColumn("_inexact", (F.col("_key") != F.col("name")).cast("int"))
    if same_file is None:
        # per key only the best target counts: reduced before the join, so a common name can't multiply
        best = keys.groupBy("_key").agg(F.min(F.struct("_inexact", "file_path", "name")).alias("_m"))
        met = calls.join(best, F.col("callee") == F.col("_key"))
        return met.select("caller_path", "caller", "callee", F.col("_m.file_path").alias("target_path"), F.col("_m.name").alias("target")).distinct()
    # one target per name and file, so that a common name can't multiply either
    per_file = keys.groupBy("_key", "file_path").agg(F.min(F.struct("_inexact", "name")).alias("_t"))
    target = F.struct("_t._inexact", "file_path", "_t.name")
    cols = ["caller_path", "caller", "callee"]
    if same_file:
        met = calls.join(per_file, (F.col("callee") == F.col("_key")) & (F.col("caller_path") == F.col("file_path"))).select(*cols, target.alias("_m"))
    else:
        # the best of all files, and the best of the others for callers in that file
        first = per_file.groupBy("_key").agg(F.min(target).alias("_first"))
        rest = per_file.join(first, "_key").filter(F.col("file_path") != F.col("_first.file_path")).groupBy("_key").agg(F.min(target).alias("_second"))
        both = first.join(rest, "_key", "left")
        other = F.when(F.col("_first.file_path") != F.col("caller_path"), F.col("_first")).otherwise(F.col("_second"))
        met = calls.join(both, F.col("callee") == F.col("_key")).select(*cols, other.alias("_m")).filter("_m is not null")
    return met.select(*cols, F.col("_m.file_path").alias("target_path"), F.col("_m.name").alias("target")).distinct()


def resolve_types(uses: DataFrame, types: DataFrame, every: bool = False) -> DataFrame:
    """``user_path, user, type_name, target_path``: the type of that name with the
    smallest path, or all of them (O-41)."""
    t = types.select(F.col("file_path").alias("target_path"), F.col("name").alias("_t"))
    t = t.distinct() if every else t.groupBy("_t").agg(F.min("target_path").alias("target_path"))
    return uses.join(t, F.col("type_name") == F.col("_t")).select("user_path", "user", "type_name", "target_path").distinct()


def match_paths(entities: DataFrame, changed: DataFrame, path: str = "file_path") -> DataFrame:
    """``entities`` whose path ends in a changed path at a ``/`` (O-40): both sides
    meet on exploded path suffixes, by equality."""
    c = changed.select(F.col(changed.columns[0]).alias("_c")).filter("_c is not null").distinct()
    keyed = entities.withColumn("_k", F.explode(suffixes(F.regexp_replace(path, "^/", ""), "/")))
    return keyed.join(c, F.col("_k") == F.regexp_replace("_c", "^/", ""), "left_semi").drop("_k").distinct()


def scope_targets(constraints: DataFrame, services: DataFrame, modules: DataFrame, functions: DataFrame) -> DataFrame:
    """``constraint_id, target``: what each constraint applies to, by the type of
    its scope: a service's name, a module's path prefix, a function's
    ``path::name`` (O-31, O-44).  Prefixes meet by equality on the beginnings of
    each path that are as long as some scope."""
    c = constraints.select(F.col("id").alias("constraint_id"), "scope", "scope_type")
    s = c.filter("scope_type = 'service'").join(services.select(F.col("name").alias("_n"), F.col("id").alias("target")), F.col("scope") == F.col("_n"))
    pre = modules.select(F.col("id").alias("target"), F.col("file_path").alias("_p")).filter("_p is not null and _p <> ''")
    # one row: as many lengths as there are different ones
    lengths = F.broadcast(c.filter("scope_type = 'module' and scope <> ''").agg(F.collect_set(F.length("scope")).alias("_lens")))
    fits = F.filter("_lens", lambda n: n <= F.length("_p"))
    pre = pre.crossJoin(lengths).select("target", F.explode(F.transform(fits, lambda n: F.left(F.col("_p"), n))).alias("_n"))
    m = c.filter("scope_type = 'module'").join(pre, F.col("scope") == F.col("_n"))
    f = c.filter("scope_type = 'function'").join(functions.select(F.col("id").alias("target")), F.col("scope") == F.col("target"))
    cols = ["constraint_id", "target"]
    return s.select(*cols).unionByName(m.select(*cols)).unionByName(f.select(*cols)).distinct()
