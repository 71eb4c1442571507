"""Parent-child links to full hierarchies.

Every row names at most one parent, so each connected component is a tree or a
circle with trees hanging off it.  Components are found by pointer doubling
(logarithmically many joins, only over rows that have not arrived).  Components
of up to ``max_component_rows`` rows are co-located and walked by an iterative
depth-first traversal with node colouring; larger ones, which may hold a third
of all rows, are never gathered and get the same columns from doubling joins.
A walk holds one entry per node; paths are made one at a time as they are
written, and only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import checkpoint, maybe_broadcast

WHITE, GREY, BLACK = 0, 1, 2


def links(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """``id`` and ``parent`` with parents that have no row set to null.

    Rows without an id are no nodes.  If an id has several rows, the one with
    the greatest parent counts; deduplicate beforehand for another rule.
    """
    e = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("_p")).filter(F.col("id").isNotNull())
    e = e.groupBy("id").agg(F.max("_p").alias("_p"))
    known = e.select(F.col("id").alias("_known"))
    return e.join(known, F.col("_p") == F.col("_known"), "left").select("id", F.col("_known").alias("parent"))


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``parent``, ``component``, ``depth``, ``in_circle`` of every node.

    ``component`` is the root's id, or the smallest id of the circle.  ``depth``
    counts the steps to the root or to the first node of the circle.  Doubling
    stops once every row has arrived, or once none more does and all that remain
    have made as many steps as there are: those lead into circles.
    """
    state = checkpoint(edges.select("id", "parent", F.coalesce("parent", "id").alias("ptr"), F.coalesce("parent", "id").alias("low"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("parent").isNull().alias("done")))
    done = state.filter("done")
    active = state.filter("not done")
    left, before, reach = active.count(), -1, 1
    # as long as rows of a tree are under way, every round brings some to their root
    while left and (left != before or reach <= left):
        nxt = state.select(F.col("id").alias("_i"), F.col("ptr").alias("_ptr"), F.col("low").alias("_low"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = active.join(nxt, F.col("ptr") == F.col("_i")).select("id", "parent", F.col("_ptr").alias("ptr"), F.least("low", "_low").alias("low"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"))
        state = checkpoint(done.unionByName(moved))
        done, active = state.filter("done"), state.filter("not done")
        left, before, reach = active.count(), left, reach * 2
    trees = done.select("id", "parent", F.col("ptr").alias("component"), F.col("steps").alias("depth"), F.lit(False).alias("in_circle"))
    if not left:
        return trees
    # after that many steps every pointer lies on a circle, and every node of a circle is pointed at
    low = active.select(F.col("id").alias("_i"), F.col("low").alias("_low"))
    rings = active.select(F.col("ptr").alias("_r")).distinct()
    tails = active.join(low, F.col("ptr") == F.col("_i")).select("id", "parent", F.col("_low").alias("component"))
    tails = tails.join(rings, F.col("id") == F.col("_r"), "left").withColumn("in_circle", F.col("_r").isNotNull()).drop("_r")
    cut = checkpoint(tails)
    inner = cut.filter("in_circle")
    outer = cut.filter("not in_circle")
    ends = components(outer.select("id", "parent").unionByName(inner.select("id", F.lit(None).cast(cut.schema["parent"].dataType).alias("parent")))).select(F.col("id").alias("_i"), F.col("depth"))
    circles = cut.join(ends, F.col("id") == F.col("_i")).select("id", "parent", "component", "depth", "in_circle")
    return trees.unionByName(circles)


def walk(ids: list, parents: list, with_paths: bool = True) -> Iterator[tuple]:
    """Depth-first traversal of one component, iterative, with node colouring.

    Gives ``(id, root_id, depth, path, in_circle)`` per node.  A grey parent is a
    back edge and closes a circle.  Nodes below are then walked from the roots
    (or the circle's nodes) down, with one trail that is cut back at every turn.
    """
    parent = dict(zip(ids, parents, strict=True))
    colour = dict.fromkeys(ids, WHITE)
    ring: set = set()
    for start in ids:
        trail = []
        at = start
        while at is not None and colour[at] == WHITE:
            colour[at] = GREY
            trail.append(at)
            at = parent[at]
        if at is not None and colour[at] == GREY:
            ring.update(trail[trail.index(at) :])
        for x in trail:
            colour[x] = BLACK
    lowest = min(ring) if ring else None
    children: dict = {}
    for x in ids:
        if parent[x] is not None and x not in ring:
            children.setdefault(parent[x], []).append(x)
    stack = [(x, 0) for x in ids if x in ring or parent[x] is None]
    way: list = []
    while stack:
        x, depth = stack.pop()
        del way[depth:]
        way.append(x)
        yield x, lowest if ring else way[0], depth, way[::-1] if with_paths else None, x in ring
        stack.extend((c, depth + 1) for c in children.get(x, ()))


def _walk_batches(id_type: str, with_paths: bool, cells: int = 500_000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple] = []

        def flush(rows: list[tuple]) -> Iterator[pd.DataFrame]:
            names = ["id", "root_id", "depth", "path", "in_circle", "component"]
            got, held, lo = [], 0, 0
            for hi in range(1, len(rows) + 1):
                if hi < len(rows) and rows[hi][0] == rows[lo][0]:
                    continue
                for r in walk([g[1] for g in rows[lo:hi]], [g[2] for g in rows[lo:hi]], with_paths):
                    got.append((*r, rows[lo][0]))
                    held += 1 + (r[2] if with_paths else 0)
                    # the paths of a long chain are far larger than the chain
                    if held >= cells:
                        yield pd.DataFrame(got, columns=names)
                        got, held = [], 0
                lo = hi
            yield pd.DataFrame(got, columns=names)

        for pdf in batches:
            col = pdf["parent"].astype(object)
            rows = list(zip(pdf["component"].tolist(), pdf["id"].tolist(), col.where(col.notna(), None).tolist(), strict=True))
            if id_type != "string":
                rows = [(c, i, None if p is None else int(p)) for c, i, p in rows]
            rows = kept + rows
            # the last component of a batch may go on in the next one
            cut = len(rows)
            while cut and rows[cut - 1][0] == rows[-1][0]:
                cut -= 1
            kept = rows[cut:]
            if cut:
                yield from flush(rows[:cut])
        if kept:
            yield from flush(kept)

    return run


def _long_paths(nodes: DataFrame) -> DataFrame:
    """Paths of large components by doubling: ancestors within 1, 2, 4... steps,
    as many rows as the paths are long, gathered per node."""
    far = nodes.agg(F.max("depth")).first()[0] or 0
    hop = nodes.select("id", F.when(~F.col("in_circle"), F.col("parent")).alias("to"))
    pairs = nodes.select("id", F.col("id").alias("anc"), F.lit(0).cast("long").alias("dist"))
    reach = 1
    while reach <= far:
        nxt = hop.filter("to is not null").join(pairs.select(F.col("id").alias("_i"), "anc", "dist"), F.col("to") == F.col("_i")).select("id", "anc", (F.col("dist") + reach).alias("dist"))
        pairs = checkpoint(pairs.unionByName(nxt))
        hop = checkpoint(hop.join(hop.select(F.col("id").alias("_i"), F.col("to").alias("_to")), F.col("to") == F.col("_i"), "left").select("id", F.col("_to").alias("to")))
        reach *= 2
    paths = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dist", "anc"))).alias("_p")).select(F.col("id").alias("_i"), F.transform("_p", lambda x: x["anc"]).alias("path"))
    return nodes.join(paths, F.col("id") == F.col("_i"))


def hierarchies(
    df: DataFrame,
    id_col: str,
    parent_col: str,
    max_component_rows: int = 100_000,
    with_paths: bool = True,
) -> DataFrame:
    """Root, depth and path of every node.

    Columns: ``id``, ``root_id``, ``depth``, ``path`` (from the node to its
    root), ``in_circle``, ``component`` and ``outcome``: ``root`` (no parent at
    all), ``dangling`` (its parent has no row, so it ends there), ``linked`` or
    ``cycle`` (never comes to an end).  In a cycle ``root_id`` is the smallest id
    of the circle, and depth and path end at the circle's first node reached.
    A row that is its own parent is a circle of one.  Null ids are skipped, an
    empty table gives no rows, extra columns are ignored.  ``with_paths=False``
    leaves every ``path`` null: paths can be far larger than the input.
    """
    edges = links(df, id_col, parent_col)
    id_type = edges.schema["id"].dataType.simpleString()
    nodes = checkpoint(components(edges))
    sizes = nodes.groupBy("component").agg(F.count("*").alias("_n"))
    large = checkpoint(sizes.filter(F.col("_n") > max_component_rows).select(F.col("component").alias("_c")))
    some = not large.isEmpty()
    marked = maybe_broadcast(large)
    on = F.col("component") == F.col("_c")
    small = nodes.join(marked, on, "left_anti") if some else nodes
    small = small.repartition("component").sortWithinPartitions("component", "id")
    schema = T.StructType(
        [
            T.StructField("id", edges.schema["id"].dataType),
            T.StructField("root_id", edges.schema["id"].dataType),
            T.StructField("depth", T.LongType()),
            T.StructField("path", T.ArrayType(edges.schema["id"].dataType)),
            T.StructField("in_circle", T.BooleanType()),
            T.StructField("component", edges.schema["id"].dataType),
        ]
    )
    out = small.select("component", "id", "parent").mapInPandas(_walk_batches(id_type, with_paths), schema)
    if some:
        rest = nodes.join(marked, on, "left_semi")
        rest = _long_paths(rest) if with_paths else rest.withColumn("path", F.lit(None).cast(schema["path"].dataType))
        out = out.unionByName(rest.select("id", F.col("component").alias("root_id"), "depth", "path", "in_circle", "component"))
    named = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_i")).agg(F.max(parent_col).alias("_asked"))
    circles = nodes.filter("in_circle").select(F.col("component").alias("_cyc")).distinct()
    out = out.join(named, F.col("id") == F.col("_i"), "left").join(circles, F.col("component") == F.col("_cyc"), "left")
    outcome = F.when(F.col("_cyc").isNotNull(), "cycle").when(F.col("depth") > 0, "linked").when(F.col("_asked").isNotNull(), "dangling").otherwise("root")
    return out.withColumn("outcome", outcome).drop("_i", "_asked", "_cyc")


def descendants(tree: DataFrame) -> DataFrame:
    """All ``(id, descendant_id, distance)`` of the result of ``hierarchies``.

    One row per pair, since a root's descendants can be a third of all rows and
    must not be gathered into one value.  Every node of a circle has all other
    nodes of its component as descendants, with ``distance`` null where the way
    leads along the circle.
    """
    below = tree.select(F.col("id").alias("descendant_id"), F.posexplode("path").alias("distance", "id")).filter("distance > 0")
    ring = tree.filter("in_circle").select("id", F.col("component").alias("_c"))
    every = tree.filter("outcome = 'cycle'").select(F.col("id").alias("descendant_id"), F.col("component").alias("_d"))
    round_ = ring.join(every, F.col("_c") == F.col("_d")).filter(F.col("id") != F.col("descendant_id")).select("id", "descendant_id")
    both = below.select("id", "descendant_id", F.col("distance").cast("long").alias("distance")).unionByName(round_.withColumn("distance", F.lit(None).cast("long")))
    return both.groupBy("id", "descendant_id").agg(F.min("distance").alias("distance"))
