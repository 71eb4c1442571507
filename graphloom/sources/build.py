"""Parsed entities to the property graph.

One lazy plan from the table of ``parsers.parse_sources`` to nodes and edges:
every edge is an equality join on names or paths, reduced to one target per
source before it is joined, so a common name can't multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import basename, dirname, extension, node_id
from graphloom.model import PropertyGraph
from graphloom.operators.traverse import resolve_calls, resolve_types
from graphloom.session import checkpoint, latest
from graphloom.sources.trees import resolve_imports

TYPES = ("class", "interface", "type", "enum", "struct", "trait", "union")
BODY_CHARS = 8000


def label(kind: Column) -> Column:
    """The label of an entity's kind; null for imports and errors."""
    return F.when(kind == "function", "Function").when(kind.isin(*TYPES), "Type").when(kind == "const", "Constant")


def entity_nodes(entities: DataFrame) -> DataFrame:
    """``id, label`` and the parsed fields of functions, types and constants
    (O-15); of several of one label, path and name the one furthest down counts."""
    e = entities.withColumn("label", label(F.col("kind"))).filter("label is not null and name is not null and name <> ''")
    one = latest(e, ["label", "file_path", "name"], ["line_number", "content_hash"], ["label", "file_path", "name", "line_number", "content_hash", "kind", "end_line", "return_type", "doc", "is_exported", "is_async", "http_method", "route_path", "args", "callees", "type_refs", "extends", "implements", "params", "body_text"])
    return one.withColumn("id", node_id(F.col("file_path"), F.col("name"))).withColumn("domain", F.lit("unclassified"))


def _edge(df: DataFrame, src: Column, dst: Column, kind: str, **props: Column) -> DataFrame:
    given = F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]) if props else F.create_map().cast("map<string,string>")
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), given.alias("props"))


def call_edges(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """CALLS (O-39): a callee whose first part the caller's file imports is looked
    for in other files, any other in the caller's own."""
    calls = functions.select(F.col("file_path").alias("caller_path"), F.col("name").alias("caller"), F.explode("callees").alias("callee")).distinct()
    taken = imports.select(F.col("file_path").alias("_f"), F.explode("imported").alias("_i")).distinct()
    first = F.regexp_extract("callee", r"^([\w$]+)", 1)
    known = (F.col("caller_path") == F.col("_f")) & (first == F.col("_i"))
    targets = functions.select("file_path", "name")
    abroad = resolve_calls(calls.join(taken, known, "left_semi"), targets, same_file=False)
    at_home = resolve_calls(calls.join(taken, known, "left_anti"), targets, same_file=True)
    every = abroad.unionByName(at_home)
    return _edge(every, node_id(F.col("caller_path"), F.col("caller")), node_id(F.col("target_path"), F.col("target")), "CALLS")


def type_edges(users: DataFrame, names: Column, types: DataFrame, kind: str) -> DataFrame:
    """Edges of a kind from ``users`` to the types they name (O-41)."""
    uses = users.select(F.col("file_path").alias("user_path"), F.col("name").alias("user"), F.explode(names).alias("type_name")).filter("type_name is not null").distinct()
    met = resolve_types(uses, types)
    return _edge(met, node_id(F.col("user_path"), F.col("user")), node_id(F.col("target_path"), F.col("type_name")), kind)


def build_graph(entities: DataFrame, root: str, packages: DataFrame | None = None) -> PropertyGraph:
    """Nodes and edges of parsed sources (O-15, O-35, O-39, O-41, O-45).

    ``entities``: the result of ``parse_sources``; ``packages``: ``name, dir``
    (relative to ``root``), as ``trees.detect_packages`` gives them.  Nodes are
    Service, Module, File, Function, Type, Constant and CodeBlock; edges are
    BELONGS_TO, CONTAINS_FILE, CONTAINS, DEFINES, HAS_CODE, IMPORTS, CALLS,
    USES_TYPE, EXTENDS, IMPLEMENTS and INJECTS, with ``props``.  Files that
    couldn't be parsed are File nodes without entities.  Names that lead to no
    known node make no edge; an empty table gives an empty graph.
    """
    # parsing is the costly part: every branch below reads what was parsed once
    entities = checkpoint(entities)
    nodes = checkpoint(entity_nodes(entities))
    functions, types = nodes.filter("label = 'Function'"), nodes.filter("label = 'Type'")
    imports = entities.filter("kind = 'import'").select("file_path", "spec", "imported")
    files = entities.select("file_path").filter("file_path is not null").distinct()
    path = F.col("file_path")
    modules = files.select(dirname(path).alias("dir")).distinct()
    bare = lambda df, kind, key, where, name: df.select(key.alias("id"), F.lit(kind).alias("label"), where.alias("file_path"), name.alias("name"))
    d = F.col("dir")
    every = nodes.select("id", "label", "file_path", "name", "line_number", "end_line", "content_hash", "domain")
    for df in (
        bare(files, "File", path, path, basename(path)),
        bare(modules, "Module", d, d, basename(d)),
        bare(functions.unionByName(types).filter("body_text <> ''"), "CodeBlock", F.concat("id", F.lit("#code")), path, F.col("name")).distinct(),
    ):
        every = every.unionByName(df, allowMissingColumns=True)
    edges = (
        _edge(files, dirname(path), path, "CONTAINS_FILE")
        .unionByName(_edge(nodes, dirname(path), F.col("id"), "CONTAINS"))
        .unionByName(_edge(nodes, path, F.col("id"), "DEFINES"))
        .unionByName(_edge(functions.unionByName(types).filter("body_text <> ''"), F.col("id"), F.concat("id", F.lit("#code")), "HAS_CODE"))
        .unionByName(call_edges(functions, imports))
        .unionByName(type_edges(functions, F.col("type_refs"), types, "USES_TYPE"))
        .unionByName(type_edges(types, F.col("extends"), types, "EXTENDS"))
        .unionByName(type_edges(types, F.col("implements"), types, "IMPLEMENTS"))
    )
    wanted = types.select("file_path", "name", F.explode("params").alias("p")).select("file_path", "name", F.coalesce("p.inject_token", "p.type").alias("dep"), F.col("p.name").alias("param")).filter("dep <> '' and length(dep) <= 80")
    held = resolve_types(wanted.select(F.col("file_path").alias("user_path"), F.col("name").alias("user"), F.col("dep").alias("type_name")).distinct(), types)
    named = wanted.groupBy(F.col("file_path").alias("user_path"), F.col("name").alias("user"), F.col("dep").alias("type_name")).agg(F.min("param").alias("param"))
    edges = edges.unionByName(_edge(held.join(named, ["user_path", "user", "type_name"]), node_id(F.col("user_path"), F.col("user")), node_id(F.col("target_path"), F.col("type_name")), "INJECTS", paramName=F.col("param")))
    led = resolve_imports(imports.select(F.col("file_path").alias("from_file"), "spec", "imported"), modules, root).filter("target is not null")
    # one edge per pair of modules and specifier, with the names of all its imports
    merged = led.groupBy(dirname(F.col("from_file")).alias("src"), F.col("target").alias("dst"), "spec").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("imported")))), ",").alias("names"), F.min("from_file").alias("from_file"))
    edges = edges.unionByName(_edge(merged, F.col("src"), F.col("dst"), "IMPORTS", moduleSpecifier=F.col("spec"), importedNames=F.col("names"), fromFile=F.col("from_file")))
    if packages is not None:
        p = packages.select("name", "dir")
        every = every.unionByName(bare(p, "Service", F.concat(F.lit("service:"), "name"), F.col("dir"), F.col("name")), allowMissingColumns=True)
        inner = modules.select("dir", F.substring("dir", F.lit(len(root.rstrip("/")) + 2), F.length("dir")).alias("_rel"))
        # a module meets packages on the prefixes of its own path, by equality; the longest wins
        parts = F.split("_rel", "/")
        keys = inner.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("_key"))
        met = keys.join(p.withColumnRenamed("dir", "_pd"), F.col("_key") == F.col("_pd")).groupBy("dir").agg(F.max(F.struct(F.length("_key").alias("n"), "name")).alias("_m"))
        edges = edges.unionByName(_edge(met, F.col("dir"), F.concat(F.lit("service:"), F.col("_m.name")), "BELONGS_TO"))
    return PropertyGraph(every, edges)
