"""Queries on the code graph's own tables: orphan references (p1), decision
hierarchies (p4) and snapshot changes (p5), with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import ref_name, ref_path, resolve_path, strip
from graphloom.operators.hierarchy import descendants, hierarchies
from graphloom.operators.orphan_refs import orphan_counts, orphan_refs
from graphloom.operators.snapshots import snapshot_changes
from graphloom.session import latest, table


def graph_references(spark: SparkSession, sf: str) -> DataFrame:
    """One row per reference written in either memory table: ``src_table``,
    ``record_id``, ``graph_ref``, ``at``, and its ``file_path`` and ``name``."""
    parts = []
    for name in ("agent_events", "agent_decisions"):
        t = latest(table(spark, sf, name), ["id"], ["loaded_at", "created_at"], ["id", "loaded_at", "created_at", "graph_refs"])
        parts.append(t.select(F.lit(name).alias("src_table"), F.col("id").alias("record_id"), F.col("created_at").alias("at"), F.explode(F.array_distinct("graph_refs")).alias("graph_ref")))
    refs = parts[0].unionByName(parts[1]).filter(F.col("graph_ref").isNotNull() & (strip(F.col("graph_ref")) != ""))
    ref = F.col("graph_ref")
    return refs.withColumns({"file_path": ref_path(ref), "name": ref_name(ref)})


def node_lives(spark: SparkSession, sf: str) -> DataFrame:
    """``file_path``, ``name``, ``first_seen_at``, ``deleted_at`` of every life,
    by its latest delivery."""
    n = table(spark, sf, "graph_nodes")
    lives = latest(n, ["file_path", "name", "first_seen_at"], ["loaded_at", "deleted_at"], ["file_path", "name", "first_seen_at", "loaded_at", "deleted_at"])
    return lives.select(resolve_path(F.col("file_path")).alias("file_path"), strip(F.col("name")).alias("name"), "first_seen_at", "deleted_at")


def _orphans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    refs = graph_references(spark, sf)
    return refs, orphan_refs(refs, node_lives(spark, sf), ["file_path", "name"], "at", "first_seen_at", "deleted_at")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)[1].select("src_table", "record_id", "graph_ref").distinct()


def p1_orphans_by_month(spark: SparkSession, sf: str) -> DataFrame:
    refs, orphans = _orphans(spark, sf)
    return orphan_counts(refs, orphans, ["src_table"], "at")


def current_decisions(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "agent_decisions")
    return latest(t, ["id"], ["loaded_at", "superseded_by"], ["id", "loaded_at", "superseded_by", "status"]).filter("id is not null")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    d = current_decisions(spark, sf)
    tree = hierarchies(d, "id", "superseded_by", with_paths=False)
    return tree.filter(F.col("outcome") != "root").select("id", "root_id").distinct()


def p4_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Path, depth, last decision, number of replaced decisions and whether the
    stored status agrees with the outcome."""
    d = current_decisions(spark, sf)
    tree = hierarchies(d, "id", "superseded_by")
    n = descendants(tree).groupBy(F.col("id").alias("_i")).agg(F.count("*").alias("_n"))
    status = d.select(F.col("id").alias("_s"), F.lower(strip(F.col("status"))).alias("status"))
    out = tree.join(n, F.col("id") == F.col("_i"), "left").join(status, F.col("id") == F.col("_s"))
    gone = F.col("outcome") != "root"
    agrees = F.coalesce((F.col("status") == "superseded") == gone, F.lit(False))
    return out.select("id", "root_id", F.col("depth").cast("long").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "outcome", F.coalesce("_n", F.lit(0)).cast("long").alias("n_replaced"), "status", agrees.alias("status_agrees"))


def p4_replaced(spark: SparkSession, sf: str) -> DataFrame:
    tree = hierarchies(current_decisions(spark, sf), "id", "superseded_by")
    return descendants(tree).select("id", F.col("descendant_id").alias("replaced_id"), "distance")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "graph_node_snapshots").select("snapshot_id", "taken_at", F.translate("file_path", "\\", "/").alias("file_path"), "name", "content_hash", "line_number")
    return snapshot_changes(t, "snapshot_id", "taken_at", ["file_path", "name"], F.lower("content_hash"), "line_number")


def p5_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p5_found(spark, sf).groupBy("snapshot_id", "change").agg(F.count("*").alias("n_nodes"))


QUERIES = {f.__name__: f for f in (p1_found, p1_orphans_by_month, p4_found, p4_hierarchy, p4_replaced, p5_found, p5_change_counts)}

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_PATH = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _TRIM + r", '^[a-zA-Z][a-zA-Z0-9+.-]+:(//(localhost)?)?', ''), '\\', '/', 'g'), '/(\./|/)+', '/', 'g'), '/[^/]+/\.\.(/|$)', '\1', 'g'), '/[^/]+/\.\.(/|$)', '\1', 'g')"

_REFS = f"""
refs0 AS (
  SELECT 'agent_events' AS src_table, id AS record_id, created_at AS "at", unnest(list_distinct(graph_refs)) AS graph_ref
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, created_at DESC) AS rn FROM agent_events) WHERE rn = 1
  UNION ALL
  SELECT 'agent_decisions', id, created_at, unnest(list_distinct(graph_refs))
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, created_at DESC) AS rn FROM agent_decisions) WHERE rn = 1),
refs AS (
  SELECT *, {_PATH.format("split_part(graph_ref, '::', 1)")} AS file_path,
    CASE WHEN instr(graph_ref, '::') > 0 THEN nullif({_TRIM.format("substr(graph_ref, instr(graph_ref, '::') + 2)")}, '') END AS name
  FROM refs0 WHERE {_TRIM.format("graph_ref")} <> ''),
lives AS (
  SELECT file_path, name, first_seen_at, deleted_at FROM (
    SELECT *, row_number() OVER (PARTITION BY file_path, name, first_seen_at ORDER BY loaded_at DESC, deleted_at DESC NULLS LAST) AS rn FROM graph_nodes)
  WHERE rn = 1),
orphans AS (
  SELECT * FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.file_path = r.file_path AND l.name = r.name
      AND l.first_seen_at <= r."at" AND (l.deleted_at IS NULL OR r."at" < l.deleted_at)))"""

_TREE = """
d AS (
  SELECT id, superseded_by, status FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, superseded_by DESC NULLS LAST) AS rn FROM agent_decisions)
  WHERE rn = 1 AND id IS NOT NULL),
e AS (SELECT d.id, p.id AS parent FROM d LEFT JOIN d p ON d.superseded_by = p.id),
w(id, anc, dist) AS (
  SELECT id, id, 0::BIGINT FROM e
  UNION
  SELECT w.id, e.parent, w.dist + 1 FROM w JOIN e ON w.anc = e.id WHERE e.parent IS NOT NULL AND w.dist < (SELECT count(*) FROM e)),
ring AS (SELECT DISTINCT id FROM w WHERE dist > 0 AND id = anc),
ringof AS (SELECT w.id, min(w.anc) AS root_id FROM w WHERE w.anc IN (SELECT id FROM ring) GROUP BY w.id),
entry AS (SELECT id, min(dist) AS depth FROM w WHERE anc IN (SELECT id FROM ring) GROUP BY id),
top AS (SELECT id, max(dist) AS depth, arg_max(anc, dist) AS root_id FROM w WHERE id NOT IN (SELECT id FROM ringof) GROUP BY id),
tree AS (
  SELECT d.id, coalesce(r.root_id, t.root_id) AS root_id, coalesce(en.depth, t.depth) AS depth,
    CASE WHEN r.id IS NOT NULL THEN 'cycle' WHEN t.depth > 0 THEN 'linked' WHEN d.superseded_by IS NOT NULL THEN 'dangling' ELSE 'root' END AS outcome,
    lower(trim(d.status)) AS status
  FROM d LEFT JOIN ringof r ON r.id = d.id LEFT JOIN entry en ON en.id = d.id LEFT JOIN top t ON t.id = d.id),
pairs AS (
  SELECT anc AS id, w.id AS replaced_id, min(dist) AS distance FROM w JOIN tree t ON t.id = w.id WHERE dist > 0 AND dist <= t.depth AND anc <> w.id GROUP BY ALL
  UNION
  SELECT a.id, b.id, NULL FROM ring a JOIN ringof ra ON ra.id = a.id JOIN ringof b ON b.root_id = ra.root_id AND b.id <> a.id
    WHERE NOT EXISTS (SELECT 1 FROM w JOIN tree t ON t.id = w.id WHERE w.id = b.id AND w.anc = a.id AND w.dist > 0 AND w.dist <= t.depth))"""

_CHANGES = r"""
s AS (SELECT snapshot_id, replace(file_path, '\', '/') AS file_path, name, lower(content_hash) AS h, line_number, taken_at FROM graph_node_snapshots),
k AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, file_path, name ORDER BY line_number DESC NULLS LAST, h DESC NULLS LAST) AS rn FROM s) WHERE rn = 1),
o AS (SELECT snapshot_id, row_number() OVER (ORDER BY min(taken_at), snapshot_id) AS seq FROM s GROUP BY snapshot_id),
a AS (SELECT o.seq, k.* FROM k JOIN o USING (snapshot_id)),
c AS (
  SELECT coalesce(n.seq, p.seq + 1) AS seq, coalesce(n.file_path, p.file_path) AS file_path, coalesce(n.name, p.name) AS name,
    CASE WHEN p.seq IS NULL THEN 'added' WHEN n.seq IS NULL THEN 'removed' WHEN n.h IS DISTINCT FROM p.h THEN 'changed' END AS change
  FROM a n FULL JOIN a p ON n.seq = p.seq + 1 AND n.file_path = p.file_path AND n.name = p.name),
found AS (
  SELECT o.snapshot_id, c.file_path, c.name, c.change FROM c JOIN o USING (seq) WHERE c.change IS NOT NULL AND c.seq > 1)"""

ORACLE = {
    "p1_found": f"WITH {_REFS} SELECT DISTINCT src_table, record_id, graph_ref FROM orphans",
    "p1_orphans_by_month": f"""WITH {_REFS}
SELECT src_table, strftime("at" AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_refs,
  count(*) FILTER (WHERE (src_table, record_id, graph_ref) IN (SELECT (src_table, record_id, graph_ref) FROM orphans)) AS n_orphans
FROM refs GROUP BY ALL""",
    "p4_found": f"WITH RECURSIVE {_TREE} SELECT id, root_id FROM tree WHERE outcome <> 'root'",
    "p4_replaced": f"WITH RECURSIVE {_TREE} SELECT * FROM pairs",
    "p4_hierarchy": f"""WITH RECURSIVE {_TREE},
paths AS (SELECT w.id, string_agg(anc::VARCHAR, '>' ORDER BY dist) AS path FROM w JOIN tree t ON t.id = w.id WHERE w.dist <= t.depth GROUP BY w.id)
SELECT t.id, t.root_id, t.depth, p.path, t.outcome, (SELECT count(*) FROM pairs x WHERE x.id = t.id) AS n_replaced, t.status,
  coalesce((t.status = 'superseded') = (t.outcome <> 'root'), false) AS status_agrees
FROM tree t JOIN paths p ON p.id = t.id""",
    "p5_found": f"WITH {_CHANGES} SELECT * FROM found",
    "p5_change_counts": f"WITH {_CHANGES} SELECT snapshot_id, change, count(*) AS n_nodes FROM found GROUP BY ALL",
}
