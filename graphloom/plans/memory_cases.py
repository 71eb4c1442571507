"""Queries on session memory, coding style and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import decisions, lookup, memory
from graphloom.session import latest, table

OVERRIDES = {"array_syntax": "generic"}
NOW = "2026-07-01 00:00:00"


def _events(spark, sf) -> DataFrame:
    cols = ["id", "loaded_at", "created_at", "session_id", "repo", "query", "summary", "caveats", "graph_refs", "resolutions", "model"]
    return latest(table(spark, sf, "agent_events"), ["id"], ["loaded_at", "created_at", "summary"], cols)


def _decisions(spark, sf) -> DataFrame:
    cols = ["id", "loaded_at", "created_at", "session_id", "decision", "scope", "status", "superseded_by", "graph_refs"]
    return latest(table(spark, sf, "agent_decisions"), ["id"], ["loaded_at", "superseded_by", "decision"], cols)


def _facts(spark, sf) -> DataFrame:
    b = table(spark, sf, "code_blocks").filter("code_lang = 'ts' and block_kind = 'function'").select("block_id", "body_text").distinct()
    return decisions.facts(b, "block_id", "body_text")


def decision_distribution(spark, sf) -> DataFrame:
    return decisions.distribution(_facts(spark, sf))


def decision_target(spark, sf) -> DataFrame:
    return decisions.targets(_facts(spark, sf), OVERRIDES)


def decision_flags(spark, sf) -> DataFrame:
    f = _facts(spark, sf)
    return decisions.flags(f, decisions.targets(f, OVERRIDES))


def decision_verdicts(spark, sf) -> DataFrame:
    f = _facts(spark, sf)
    return decisions.verdict_counts(f, decisions.targets(f, OVERRIDES))


def migration_progress(spark, sf) -> DataFrame:
    f = _facts(spark, sf)
    return decisions.migration(f, decisions.targets(f, OVERRIDES)).withColumn("pct", F.round("pct", 6))


def off_target_backlog(spark, sf) -> DataFrame:
    return decisions.backlog(_facts(spark, sf), "string_style", "template-literal").select("node_id", "value")


def minority_outliers(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.lit("returnflag").alias("axis"), F.col("l_returnflag").alias("value"))
    c = table(spark, sf, "customer").select(F.lit("segment").alias("axis"), F.col("c_mktsegment").alias("value"))
    return decisions.minority(li.unionByName(c), 0.26).withColumn("share", F.round("share", 6))


def session_merge(spark, sf) -> DataFrame:
    """Notes of each session as one; lists as joined texts."""
    m = memory.merge_sessions(_events(spark, sf).select("id", "session_id", "summary", "caveats", F.filter("graph_refs", lambda r: r.isNotNull()).alias("graph_refs")))
    return m.select("session_id", "id", "n_events", F.md5("summary").alias("summary_md5"), F.array_join("caveats", "|").alias("caveats"), F.array_join("graph_refs", "|").alias("graph_refs"))


def supersede_chain(spark, sf) -> DataFrame:
    """Decisions after every tenth replaces the one before it."""
    d = _decisions(spark, sf).select("id", "status", "superseded_by")
    r = d.filter("id % 10 = 0").select(F.col("id").alias("new_id"), (F.col("id") - 1).alias("old_id"))
    return memory.supersede(d, r)


def decision_record(spark, sf) -> DataFrame:
    """Decisions after a new one took the place of every tenth, its text masked."""
    d = _decisions(spark, sf).select("id", F.col("decision").alias("text"), "status", "superseded_by")
    secret = F.concat("text", F.lit(" with AKIA" + "QWERTYUIOP123456"))
    new = d.filter("id % 10 = 0").select((F.col("id") + 1_000_000).alias("id"), secret.alias("text"), F.col("id").alias("supersedes"))
    out = memory.record(d, new.unionByName(spark.createDataFrame([(9_000_000, "plain", -5)], "id long, text string, supersedes long")))
    return out.select("id", "text", "status", "superseded_by")


def session_timeline(spark, sf) -> DataFrame:
    e = _events(spark, sf).select("id", "session_id", "created_at", F.col("query").alias("text"))
    d = _decisions(spark, sf).select("id", "session_id", "created_at", F.col("decision").alias("text"))
    return memory.timeline({"event": e, "decision": d}).filter("session_id is not null").groupBy("session_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def caveat_resolution(spark, sf) -> DataFrame:
    """How many resolutions events hold after the first caveat of each hundredth
    event was resolved."""
    e = _events(spark, sf)
    due = e.filter("id % 100 = 0").select(F.col("id").alias("event_id"), F.lit(0).alias("caveat_index"), F.lit(NOW).cast("timestamp").alias("resolved_at"), F.lit("done").alias("note"))
    e = memory.resolve_caveats(e, due)
    return e.select("id", F.size(F.coalesce("resolutions", F.array().cast(e.schema["resolutions"].dataType))).alias("n_resolutions"))


def trigram_recall(spark, sf) -> DataFrame:
    """Events whose question is like a fixed one by trigrams."""
    e = _events(spark, sf).filter("query is not null")
    sim = F.round(tx.trigram_similarity(F.col("query"), F.lit("How do we rotate the broken manifest in billing?")), 6)
    return e.select("id", sim.alias("similarity")).filter("similarity >= 0.3")


def _recalled(spark, sf, **more) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_kind").alias("kind"), "created_at")
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vec"))
    n = v.count()
    items = d.join(v, F.pmod("id", F.lit(n)) == F.col("_v")).select("kind", "id", "text", "vec", F.array(F.concat(F.lit("ref-"), (F.col("id") % 7).cast("string"))).alias("graph_refs"), "created_at", F.when(F.col("id") % 11 == 0, "superseded").otherwise("active").alias("status"), F.concat(F.lit("s-"), (F.col("id") % 2).cast("string")).alias("session_id"))
    q = v.filter("_v = 3").first()["vec"]
    out = memory.recall(items, list(q), "the broken manifest in billing", NOW, ["ref-3"], 5, **more)
    return out.select("kind", "id", F.round("similarity", 6).alias("similarity"), F.round("lexical", 6).alias("lexical"), F.round("score", 6).alias("score"))


def hybrid_recall_text(spark, sf) -> DataFrame:
    """Documents and embeddings as memory items, recalled by both measures."""
    return _recalled(spark, sf)


def recall_near(spark, sf) -> DataFrame:
    """The same for two kinds and one session, with the references widened by the
    edges of a small graph, of the near ones only."""
    edges = spark.createDataFrame([("ref-3", "ref-4"), ("ref-5", "ref-3"), ("ref-5", "ref-6")], "src string, dst string")
    return _recalled(spark, sf, kinds=["changelog", "learning", "changelog"], session_id="s-1", edges=edges, only_near=True)


def content_fallback(spark, sf) -> DataFrame:
    """A phrase that no code block holds, found in the functions' own texts."""
    b = table(spark, sf, "code_blocks").select("file_path", F.col("function_name").alias("name"), "body_text").distinct()
    f = latest(table(spark, sf, "function_nodes"), ["file_path", "name"], ["updated_at", "content_hash"], ["file_path", "name", "updated_at", "content_hash", "js_doc"]).withColumn("own", F.concat(F.lit("line one\n<<"), "name", F.lit(">>\n")))
    return lookup.content_search_tiered(b, f, ["file_path", "name"], "body_text", "own", "<<PRUNE").select("file_path", "name", "line_no", "tier")


def block_categories(spark, sf) -> DataFrame:
    """Code blocks by their embedding category."""
    b = table(spark, sf, "code_blocks").select("block_id", "block_kind").distinct()
    return b.groupBy(decisions.category(F.col("block_kind")).alias("category")).agg(F.count("*").alias("n_blocks"))


def meta_fields(spark, sf) -> DataFrame:
    """A field of the notes' JSON, empty where it is broken or missing."""
    e = latest(table(spark, sf, "agent_events"), ["id"], ["loaded_at", "created_at"], ["id", "loaded_at", "created_at", "meta"])
    m = tx.json_or(F.col("meta"), "struct<tool: string, turns: int>", F.struct(F.lit("").alias("tool"), F.lit(0).alias("turns")))
    return e.select("id", m.alias("m")).groupBy(F.coalesce("m.tool", F.lit("")).alias("tool")).agg(F.count("*").alias("n"), F.sum(F.coalesce("m.turns", F.lit(0)).cast("long")).alias("turns"))


def text_tools(spark, sf) -> DataFrame:
    """Snippet, first line, and a node id taken apart, of every node and text."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.md5(tx.snippet(F.regexp_replace("text", r"\s+", " "))).alias("a"), F.md5(tx.first_line(F.col("text"))).alias("b"))
    n = table(spark, sf, "graph_nodes").select("file_path", "name").distinct().withColumn("id", tx.node_id(F.col("file_path"), F.col("name")))
    return d.unionByName(n.select(F.concat(F.lit("n"), "id").alias("key"), tx.id_path(F.col("id")).alias("a"), tx.id_name(F.col("id")).alias("b")))


def file_drift(spark, sf) -> DataFrame:
    """State of every node of the first delivery by the last one."""
    s = table(spark, sf, "graph_node_snapshots")
    ends = s.agg(F.min("snapshot_id").alias("a"), F.max("snapshot_id").alias("b")).first()
    one = lambda i: s.filter(F.col("snapshot_id") == i).groupBy("file_path", "name").agg(F.max("content_hash").alias("h"))
    n = one(ends["b"]).select(F.col("file_path").alias("_f"), F.col("name").alias("_n"), F.col("h").alias("_h"), F.lit(True).alias("_here"))
    j = one(ends["a"]).join(n, (F.col("file_path") == F.col("_f")) & (F.col("name") == F.col("_n")), "left")
    state = tx.drift_status(F.col("h"), F.col("_h"), F.coalesce("_here", F.lit(False)))
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def exact_duplicates(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").groupBy(tx.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return d.filter("n > 1")


def normalize_body(spark, sf) -> DataFrame:
    b = table(spark, sf, "code_blocks").select("block_id", "body_text").distinct()
    return b.select("block_id", F.md5(tx.strip_comments(F.col("body_text"))).alias("normalized_md5"))


def function_signatures(spark, sf) -> DataFrame:
    f = latest(table(spark, sf, "function_nodes"), ["file_path", "name"], ["updated_at", "content_hash"], ["file_path", "name", "updated_at", "content_hash", "args", "return_type"])
    return f.select("file_path", "name", tx.raw_signature(F.col("name"), F.col("args"), F.col("return_type")).alias("signature"), tx.normalized_signature(F.col("args"), F.col("return_type")).alias("shape"))


def redact_shapes(spark, sf) -> DataFrame:
    """Event summaries with known credential shapes masked, and their kinds."""
    e = _events(spark, sf).filter("summary is not null")
    return e.select("id", F.md5(tx.redact_shapes(F.col("summary"))).alias("masked_md5"), F.array_join(tx.shapes_found(F.col("summary")), ",").alias("kinds")).filter("kinds <> ''")


def path_parts(spark, sf) -> DataFrame:
    p = table(spark, sf, "graph_nodes").select("file_path").distinct()
    c = F.col("file_path")
    return p.select("file_path", tx.dirname(c).alias("dir"), tx.basename(c).alias("base"), tx.extension(c).alias("ext"))


def domain_counts(spark, sf) -> DataFrame:
    """Functions per domain, those without one counted as unclassified."""
    f = table(spark, sf, "function_nodes")
    return f.groupBy(F.coalesce("domain", F.lit("unclassified")).alias("domain")).agg(F.countDistinct("file_path", "name").alias("n_functions"))


def route_table(spark, sf) -> DataFrame:
    f = table(spark, sf, "function_nodes").filter("http_method is not null").select("file_path", "name", "http_method", "route_path").distinct()
    return f.select("file_path", "name", "http_method", tx.join_route(F.lit("/api/"), F.col("route_path")).alias("route"))


_Q = (decision_distribution, decision_target, decision_flags, decision_verdicts, migration_progress, off_target_backlog, minority_outliers, session_merge, supersede_chain, decision_record, session_timeline, caveat_resolution, trigram_recall, hybrid_recall_text, recall_near, content_fallback, block_categories, meta_fields, text_tools, file_drift, exact_duplicates, normalize_body, function_signatures, redact_shapes, path_parts, domain_counts, route_table)
QUERIES = {f.__name__: f for f in _Q}

_EV = "ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, created_at DESC, summary DESC) AS rn FROM agent_events) WHERE rn = 1)"
_DE = "de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, superseded_by DESC NULLS LAST, decision DESC) AS rn FROM agent_decisions) WHERE rn = 1)"
_FACTS = r"""
b AS (SELECT DISTINCT block_id, body_text FROM code_blocks WHERE code_lang = 'ts' AND block_kind = 'function'),
c AS (SELECT block_id, regexp_replace(regexp_replace(body_text, '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g') AS c FROM b),
h AS (SELECT block_id, c, regexp_replace(c, '\bfor\s*\(\s*(?:const|let|var)\b', 'for (', 'g') AS h FROM c),
m AS (SELECT block_id, regexp_matches(h, '\bconst\s') AS k, regexp_matches(h, '\blet\s') AS l, regexp_matches(h, '\bvar\s') AS v,
  regexp_matches(c, '`[^`]*\$\{') AS tpl, regexp_matches(c, '[''"]\s*\+|\+\s*[''"]') AS cat, regexp_matches(c, '\bawait\b') AS wait, regexp_matches(c, '\.then\s*\(') AS thn,
  regexp_matches(c, ':\s*\w+\[\]') AS brk, regexp_matches(c, '\bArray<') AS gen, regexp_matches(c, '\bexport\s+default\b') AS def, regexp_matches(c, '\bexport\b') AS exp FROM h),
f AS (
  SELECT block_id AS node_id, 'var_decl' AS axis, CASE WHEN v OR (k AND l) THEN 'mixed' WHEN k THEN 'const' WHEN l THEN 'let' ELSE 'none' END AS value FROM m
  UNION ALL SELECT block_id, 'string_style', CASE WHEN tpl AND cat THEN 'mixed' WHEN tpl THEN 'template-literal' WHEN cat THEN 'concat' ELSE 'none' END FROM m
  UNION ALL SELECT block_id, 'async_style', CASE WHEN wait THEN 'async-await' WHEN thn THEN 'promise-then' ELSE 'sync' END FROM m
  UNION ALL SELECT block_id, 'array_syntax', CASE WHEN brk AND gen THEN 'mixed' WHEN brk THEN 'bracket' WHEN gen THEN 'generic' ELSE 'none' END FROM m
  UNION ALL SELECT block_id, 'export_style', CASE WHEN def THEN 'default' WHEN exp THEN 'named' ELSE 'none' END FROM m),
d AS (SELECT axis, value, count(*) AS n FROM f GROUP BY ALL),
ab(axis, av) AS (VALUES ('var_decl', 'none'), ('string_style', 'none'), ('async_style', 'sync'), ('array_syntax', 'none'), ('export_style', 'none')),
md AS (SELECT axis, value, n, sum(n) OVER (PARTITION BY axis) AS deciders, row_number() OVER (PARTITION BY axis ORDER BY n DESC, value) AS rn FROM d JOIN ab USING (axis) WHERE value <> av),
t AS (SELECT x.axis, CASE x.axis WHEN 'array_syntax' THEN 'generic' ELSE md.value END AS target, coalesce(md.deciders, 0)::BIGINT AS deciders,
  CASE x.axis WHEN 'array_syntax' THEN 'override' ELSE 'mode' END AS source, x.axis = 'array_syntax' OR coalesce(md.deciders, 0) >= 10 AS enforced
  FROM (SELECT DISTINCT axis FROM d) x LEFT JOIN md ON md.axis = x.axis AND md.rn = 1),
fl AS (SELECT f.node_id, f.axis, f.value, t.target FROM f JOIN t USING (axis) JOIN ab USING (axis) WHERE t.enforced AND t.target IS NOT NULL AND f.value <> ab.av AND f.value <> t.target)"""
_TRI = """
words AS (SELECT k, unnest(list_filter(regexp_split_to_array(lower(s), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM src),
grams AS (SELECT DISTINCT k, substr('  ' || w || ' ', i, 3) AS g FROM (SELECT k, w, unnest(range(1, length(w) + 2)) AS i FROM words)),
sizes AS (SELECT k, count(*) AS n FROM grams GROUP BY k)"""

ORACLE = {
    "decision_distribution": f"WITH {_FACTS} SELECT axis, value, n FROM d",
    "decision_target": f"WITH {_FACTS} SELECT axis, target, deciders, source, enforced FROM t",
    "decision_flags": f"WITH {_FACTS} SELECT node_id, axis, value, target FROM fl",
    "decision_verdicts": f"""WITH {_FACTS}, p AS (SELECT x.node_id, count(fl.axis) AS f FROM (SELECT DISTINCT node_id FROM f) x LEFT JOIN fl USING (node_id) GROUP BY 1)
SELECT count(*) AS n_judged, count(*) FILTER (WHERE f = 0) AS n_conforming, count(*) FILTER (WHERE f > 0) AS n_off_target, sum(f)::BIGINT AS n_flags FROM p""",
    "migration_progress": f"""WITH {_FACTS} SELECT axis, sum(n) FILTER (WHERE value = target)::BIGINT AS at_target, (sum(n) - sum(n) FILTER (WHERE value = target))::BIGINT AS off_target, sum(n)::BIGINT AS considered, round(sum(n) FILTER (WHERE value = target) * 100.0 / sum(n), 6)::DOUBLE AS pct
FROM (SELECT d.axis, d.value, d.n, t.target FROM d JOIN t USING (axis) JOIN ab USING (axis) WHERE value <> av UNION ALL SELECT t.axis, t.target, 0, t.target FROM t JOIN d USING (axis) JOIN ab USING (axis) WHERE d.value <> av) GROUP BY axis""",
    "off_target_backlog": f"WITH {_FACTS} SELECT node_id, value FROM f WHERE axis = 'string_style' AND value <> 'template-literal'",
    "minority_outliers": """WITH f AS (SELECT 'returnflag' AS axis, l_returnflag AS value FROM lineitem UNION ALL SELECT 'segment', c_mktsegment FROM customer), d AS (SELECT axis, value, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT *, n / sum(n) OVER (PARTITION BY axis) AS share, row_number() OVER (PARTITION BY axis ORDER BY n DESC, value) AS rn FROM d)
SELECT axis, value, n, round(share, 6)::DOUBLE AS share FROM r WHERE rn > 1 AND share <= 0.26""",
    "session_merge": f"""WITH {_EV},
g AS (SELECT session_id, max(id) AS id, count(*) AS n_events, md5(coalesce(string_agg(summary, chr(10) || '---' || chr(10) ORDER BY id) FILTER (WHERE coalesce(summary, '') <> ''), '')) AS summary_md5 FROM ev WHERE session_id IS NOT NULL GROUP BY session_id),
c AS (SELECT session_id, string_agg(c, '|' ORDER BY id, i) AS caveats FROM (SELECT session_id, id, unnest(caveats) AS c, unnest(range(len(caveats))) AS i FROM ev) GROUP BY session_id),
r0 AS (SELECT session_id, id, unnest(graph_refs) AS r, unnest(range(len(graph_refs))) AS i FROM ev),
r1 AS (SELECT session_id, r, id, i FROM (SELECT *, row_number() OVER (PARTITION BY session_id, r ORDER BY id, i) AS rn FROM r0 WHERE r IS NOT NULL) WHERE rn = 1),
r AS (SELECT session_id, string_agg(r, '|' ORDER BY id, i) AS refs FROM r1 GROUP BY session_id)
SELECT g.session_id, g.id, g.n_events, g.summary_md5, coalesce(c.caveats, '') AS caveats, coalesce(r.refs, '') AS graph_refs FROM g LEFT JOIN c USING (session_id) LEFT JOIN r USING (session_id)""",
    "supersede_chain": f"""WITH {_DE}, r AS (SELECT id AS new_id, id - 1 AS old_id FROM de WHERE id % 10 = 0)
SELECT d.id, CASE WHEN r.new_id IS NOT NULL THEN 'superseded' ELSE d.status END AS status, coalesce(r.new_id, d.superseded_by) AS superseded_by FROM de d LEFT JOIN r ON r.old_id = d.id""",
    "decision_record": f"""WITH {_DE}, r AS (SELECT id FROM de WHERE id % 10 = 0)
SELECT d.id, d.decision AS text, CASE WHEN r.id IS NOT NULL THEN 'superseded' ELSE d.status END AS status, coalesce(r.id + 1000000, d.superseded_by) AS superseded_by FROM de d LEFT JOIN r ON r.id = d.id
UNION ALL SELECT id + 1000000, decision || ' with AKIA****', 'active', NULL FROM de WHERE id % 10 = 0 UNION ALL SELECT 9000000, 'plain', 'active', NULL""",
    "content_fallback": """WITH f AS (SELECT DISTINCT file_path, name FROM function_nodes) SELECT file_path, name, 2 AS line_no, 1 AS tier FROM f WHERE regexp_matches(name, '(?i)^prune')
AND NOT EXISTS (SELECT 1 FROM code_blocks WHERE contains(lower(body_text), '<<prune'))""",
    "block_categories": "SELECT CASE block_kind WHEN 'function' THEN 'function:body' WHEN 'class' THEN 'type:body' WHEN 'constant' THEN 'module:const' END AS category, count(*) AS n_blocks FROM (SELECT DISTINCT block_id, block_kind FROM code_blocks) GROUP BY 1",
    "meta_fields": """WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, created_at DESC) AS rn FROM agent_events) WHERE rn = 1),
m AS (SELECT CASE WHEN json_valid(meta) THEN coalesce(json_extract_string(meta, '$.tool'), '') ELSE '' END AS tool, CASE WHEN json_valid(meta) THEN coalesce(try_cast(json_extract_string(meta, '$.turns') AS INT), 0) ELSE 0 END AS turns FROM e)
SELECT tool, count(*) AS n, sum(turns)::BIGINT AS turns FROM m GROUP BY tool""",
    "text_tools": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS s, text FROM documents), n AS (SELECT DISTINCT file_path || '::' || name AS id FROM graph_nodes)
SELECT 'd' || doc_id AS key, md5(CASE WHEN length(s) > 120 THEN substr(s, 1, 120) || '…' ELSE s END) AS a, md5(split_part(text, chr(10), 1)) AS b FROM t
UNION ALL SELECT 'n' || id, regexp_replace(id, '::[^:]*(:[^:]+)*$', ''), regexp_extract(id, '::((?:[^:]|:[^:])*)$', 1) FROM n""",
    "file_drift": """WITH e AS (SELECT min(snapshot_id) AS a, max(snapshot_id) AS b FROM graph_node_snapshots),
o AS (SELECT file_path, name, max(content_hash) AS h FROM graph_node_snapshots, e WHERE snapshot_id = a GROUP BY ALL), n AS (SELECT file_path, name, max(content_hash) AS h FROM graph_node_snapshots, e WHERE snapshot_id = b GROUP BY ALL)
SELECT CASE WHEN n.file_path IS NULL THEN 'missing' WHEN o.h IS NULL THEN 'unknown' WHEN o.h = n.h THEN 'unchanged' ELSE 'modified' END AS state, count(*) AS n FROM o LEFT JOIN n ON n.file_path = o.file_path AND n.name = o.name GROUP BY 1""",
    "session_timeline": f"WITH {_EV}, {_DE} SELECT session_id, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM (SELECT session_id, created_at FROM ev UNION ALL SELECT session_id, created_at FROM de) WHERE session_id IS NOT NULL GROUP BY session_id",
    "caveat_resolution": f"""WITH {_EV} SELECT id, (len(list_filter(coalesce(resolutions, []), lambda r: NOT (id % 100 = 0 AND len(coalesce(caveats, [])) > 0 AND r.caveat_index = 0))) + (id % 100 = 0 AND len(coalesce(caveats, [])) > 0)::INT)::INTEGER AS n_resolutions FROM ev""",
    "trigram_recall": f"""WITH {_EV}, src AS (SELECT id AS k, query AS s FROM ev WHERE query IS NOT NULL UNION ALL SELECT -1, 'How do we rotate the broken manifest in billing?'), {_TRI}
SELECT * FROM (SELECT e.k AS id, round(coalesce(x.b, 0) / (e.n + q.n - coalesce(x.b, 0)), 6) AS similarity FROM sizes e, (SELECT n FROM sizes WHERE k = -1) q
  LEFT JOIN (SELECT a.k, count(*) AS b FROM grams a JOIN grams p ON p.g = a.g AND p.k = -1 GROUP BY a.k) x ON x.k = e.k WHERE e.k <> -1) WHERE similarity >= 0.3""",
    "hybrid_recall_text": f"""WITH n AS (SELECT count(*) AS n FROM embeddings),
i AS (SELECT d.doc_kind AS kind, d.doc_id AS id, d.text, e.embedding::DOUBLE[] AS v, d.doc_id % 7 = 3 AS near, d.created_at FROM documents d, n, embeddings e WHERE d.doc_id % n.n = e.vec_id AND d.doc_id % 11 <> 0),
s AS (SELECT i.*, round(list_cosine_similarity(i.v, q.e), 9) AS similarity FROM i, (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 3) q),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY similarity DESC, id) AS rn FROM s) WHERE rn <= 5),
src AS (SELECT id AS k, text AS s FROM top UNION ALL SELECT -1, 'the broken manifest in billing'), {_TRI},
l AS (SELECT a.k, count(*) AS b FROM grams a JOIN grams p ON p.g = a.g AND p.k = -1 GROUP BY a.k),
x AS (SELECT t.*, coalesce(l.b, 0) / (z.n + q.n - coalesce(l.b, 0)) AS lexical FROM top t JOIN sizes z ON z.k = t.id LEFT JOIN l ON l.k = t.id, (SELECT n FROM sizes WHERE k = -1) q)
SELECT kind, id, round(similarity, 6) AS similarity, round(lexical, 6) AS lexical,
  round(0.65 * similarity + 0.35 * lexical + CASE WHEN near THEN 0.15 ELSE 0 END + 0.05 * pow(0.5, (epoch_us('{NOW}+00'::TIMESTAMPTZ) - epoch_us(created_at)) / 86400000000.0 / 30), 6) AS score FROM x""",
    "exact_duplicates": "SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "normalize_body": r"""SELECT DISTINCT block_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(body_text, '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g'), '\s+', ' ', 'g'))) AS normalized_md5 FROM code_blocks""",
    "function_signatures": """WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY updated_at DESC, content_hash DESC) AS rn FROM function_nodes) WHERE rn = 1)
SELECT file_path, name, name || '(' || array_to_string(list_transform(coalesce(args, []), lambda a: a.name || CASE WHEN coalesce(a.type, '') <> '' THEN ': ' || a.type ELSE '' END), ', ') || '): ' || coalesce(return_type, 'void') AS signature,
  'fn(' || array_to_string(list_transform(coalesce(args, []), lambda a: coalesce(a.type, 'any')), ', ') || '): ' || coalesce(return_type, 'void') AS shape FROM f""",
    "redact_shapes": rf"""WITH {_EV}, s AS (SELECT id, summary AS s0 FROM ev WHERE summary IS NOT NULL),
r AS (SELECT id, s0, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s0, '\b(sk-)[A-Za-z0-9_\-]{{16,}}', '\1****', 'g'), '\b(gh[pousr]_)[A-Za-z0-9]{{20,}}', '\1****', 'g'), '\b(AKIA)[0-9A-Z]{{16}}\b', '\1****', 'g'),
  '\b(GOCSPX-)[A-Za-z0-9_\-]{{20,}}', '\1****', 'g'), '([A-Za-z][A-Za-z0-9+.\-]*://[^\s:/@]+:)[^\s@/]+(@)', '\1****\2', 'g'), '\b(eyJ)[A-Za-z0-9_\-]{{8,}}\.[A-Za-z0-9_\-]{{8,}}\.[A-Za-z0-9_\-]{{8,}}', '\1****', 'g') AS m,
  array_to_string(list_filter([CASE WHEN regexp_matches(s0, '\bsk-[A-Za-z0-9_\-]{{16,}}') THEN 'openai-style-key' END, CASE WHEN regexp_matches(s0, '\bgh[pousr]_[A-Za-z0-9]{{20,}}') THEN 'github-token' END, CASE WHEN regexp_matches(s0, '\bAKIA[0-9A-Z]{{16}}\b') THEN 'aws-access-key' END,
  CASE WHEN regexp_matches(s0, '\bGOCSPX-[A-Za-z0-9_\-]{{20,}}') THEN 'google-oauth-secret' END, CASE WHEN regexp_matches(s0, '[A-Za-z][A-Za-z0-9+.\-]*://[^\s:/@]+:[^\s@/]+@') THEN 'url-password' END,
  CASE WHEN regexp_matches(s0, '\beyJ[A-Za-z0-9_\-]{{8,}}\.[A-Za-z0-9_\-]{{8,}}\.[A-Za-z0-9_\-]{{8,}}') THEN 'jwt' END], lambda x: x IS NOT NULL), ',') AS kinds FROM s)
SELECT id, md5(m) AS masked_md5, kinds FROM r WHERE kinds <> ''""",
    "path_parts": r"""SELECT DISTINCT file_path, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS dir, regexp_extract(file_path, '([^/]*)$', 1) AS base, regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '(\.[^.]+)$', 1) AS ext FROM graph_nodes""",
    "domain_counts": "SELECT coalesce(domain, 'unclassified') AS domain, count(DISTINCT (file_path, name)) AS n_functions FROM function_nodes GROUP BY 1",
    "route_table": "SELECT DISTINCT file_path, name, http_method, regexp_replace(regexp_replace('/' || '/api/' || coalesce('/' || route_path, ''), '/{2,}', '/', 'g'), '(.)/$', '\\1') AS route FROM function_nodes WHERE http_method IS NOT NULL",
}
ORACLE["recall_near"] = ORACLE["hybrid_recall_text"].replace("d.doc_id % 7 = 3 AS near", "d.doc_id % 7 IN (3, 4, 5) AS near").replace("AND d.doc_id % 11 <> 0", "AND d.doc_id % 11 <> 0 AND d.doc_id % 2 = 1 AND d.doc_kind IN ('changelog', 'learning')") + " WHERE near"
