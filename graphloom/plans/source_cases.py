"""Queries on parsed sources; no SQL can parse them, so they are tested on
fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import dirname
from graphloom.operators import traverse
from graphloom.sources import build, parsers, trees
from graphloom.session import table


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "code_blocks").filter("block_kind in ('function', 'class')")
    return b.select(F.concat("file_path", F.lit("#"), F.col("block_id").cast("string"), F.regexp_extract("file_path", r"(\.[a-z]+)$", 1)).alias("file_path"), F.col("body_text").alias("text")).distinct()


def parsed_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities found in code blocks, each block read as a file."""
    return parsers.parse_sources(_blocks(spark, sf)).select("file_path", "kind", "name", "line_number", "end_line", "is_exported", "is_async", F.size("args").alias("n_args"), F.size("callees").alias("n_callees"), "error")


def parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.parse_sources(_blocks(spark, sf)).filter("kind = 'error'").select("file_path", "error")


def _parsed_graph(spark: SparkSession, sf: str):
    b = table(spark, sf, "code_blocks").filter("block_kind in ('function', 'class')").select("file_path", F.col("body_text").alias("text")).distinct()
    return build.build_graph(parsers.parse_sources(b), "/srv/checkout")


def parsed_graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and edges of the graph that all code blocks parse to."""
    g = _parsed_graph(spark, sf)
    n = g.nodes.groupBy(F.concat(F.lit("node:"), F.col("label")).alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(g.edges.groupBy(F.concat(F.lit("edge:"), F.col("type")).alias("kind")).agg(F.count("*").alias("n")))


def parsed_hubs(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees of the parsed modules, files and entities."""
    return traverse.degrees(_parsed_graph(spark, sf).typed("CONTAINS", "DEFINES", "CALLS").select("src", "dst"))


def import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Relative imports between the directories of the graph's files."""
    files = table(spark, sf, "graph_nodes").select("file_path").distinct()
    dirs = files.select(dirname(F.col("file_path")).alias("dir")).distinct()
    specs = F.explode(F.array(F.lit("../src/x"), F.lit("./y"), F.lit("left-pad"), F.lit("..")))
    imports = files.filter("file_path like '%.ts'").select(F.col("file_path").alias("from_file"), specs.alias("spec"))
    return trees.resolve_imports(imports, dirs, "/srv/checkout")


def detected_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Packages of every checkout, named by their place in it."""
    files = table(spark, sf, "graph_nodes").select("file_path").distinct()
    return trees.packages_by_root(files.withColumn("root", trees.checkout_root(F.col("file_path"))))


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "graph_nodes").select("file_path").distinct()
    return f.filter(trees.is_source(F.col("file_path"))).groupBy(trees.language(F.col("file_path")).alias("lang")).agg(F.count("*").alias("n_files"))


def suffix_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the files a list of relative paths names."""
    n = table(spark, sf, "graph_nodes").select("file_path").distinct()
    changed = n.filter("file_path like '%client.ts' or file_path like '%_1.py'").select(F.regexp_replace("file_path", "^/srv/checkout/", "").alias("p"))
    return traverse.match_paths(n, changed)


QUERIES = {f.__name__: f for f in (parsed_entities, parse_errors, parsed_graph_counts, parsed_hubs, import_resolution, detected_packages, source_files, suffix_paths)}
ORACLE = {
    "source_files": r"""SELECT CASE WHEN regexp_matches(file_path, '\.tsx?$') THEN 'ts' WHEN ends_with(file_path, '.py') THEN 'py' ELSE 'rs' END AS lang, count(DISTINCT file_path) AS n_files FROM graph_nodes
WHERE regexp_matches(file_path, '\.(ts|tsx|py|rs)$') AND NOT regexp_matches(file_path, 'node_modules|/dist/|\.d\.ts$|\.spec\.tsx?$|\.test\.tsx?$|__pycache__|/(venv|\.venv|\.tox)/|(^|/)test_[^/]+\.py$|_test\.py$|(^|/)conftest\.py$|(^|/)(tests|benches)/.*\.rs$|(^|/)target/.*\.rs$') GROUP BY 1""",
    "suffix_paths": "SELECT DISTINCT file_path FROM graph_nodes WHERE file_path LIKE '%client.ts' OR file_path LIKE '%\\_1.py' ESCAPE '\\' OR file_path LIKE '%_1.py'",
    "import_resolution": r"""WITH f AS (SELECT DISTINCT file_path, regexp_replace(file_path, '/[^/]*$', '') AS dir FROM graph_nodes), d AS (SELECT DISTINCT dir FROM f),
i AS (SELECT file_path AS from_file, dir, unnest(['../src/x', './y', 'left-pad', '..']) AS spec FROM f WHERE file_path LIKE '%.ts'),
c AS (SELECT *, CASE spec WHEN '../src/x' THEN regexp_replace(dir, '/[^/]*$', '') || '/src' WHEN '..' THEN regexp_replace(dir, '/[^/]*$', '') WHEN './y' THEN dir END AS a, CASE spec WHEN '..' THEN regexp_replace(regexp_replace(dir, '/[^/]*$', ''), '/[^/]*$', '') END AS b FROM i)
SELECT from_file, spec, CASE WHEN a IN (SELECT dir FROM d) AND a <> dir THEN a WHEN b IN (SELECT dir FROM d) THEN b END AS target FROM c""",
}
