"""Source trees, packages and import targets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import resolve_path
from graphloom.functions.text import basename, dirname

# What counts as source, and what is left out.
EXTENSIONS = (".ts", ".tsx", ".py", ".rs")
EXCLUDES = (
    r"node_modules",
    r"/dist/",
    r"\.d\.ts$",
    r"\.spec\.ts$",
    r"\.test\.ts$",
    r"\.spec\.tsx$",
    r"\.test\.tsx$",
    r"__pycache__",
    r"/(venv|\.venv|\.tox)/",
    r"(^|/)test_[^/]+\.py$",
    r"_test\.py$",
    r"(^|/)conftest\.py$",
    r"(^|/)(tests|benches)/.*\.rs$",
    r"(^|/)target/.*\.rs$",
)


def is_source(path: Column, excludes: tuple[str, ...] = EXCLUDES) -> Column:
    """Whether a path is a source file that isn't left out (O-01, O-02)."""
    ok = path.rlike("(?:" + "|".join(re.escape(e) for e in EXTENSIONS) + ")$")
    return ok & ~path.rlike("|".join(f"(?:{x})" for x in excludes)) if excludes else ok


def read_tree(spark: SparkSession, root: str, watched: list[str] | None = None, excludes: tuple[str, ...] = EXCLUDES) -> DataFrame:
    """``file_path, text, modified_at, n_bytes`` of all source files under a root
    (O-01), or under its watched directories (O-02)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = resolve_path(F.col("path"))
    f = f.withColumn("file_path", path).filter(is_source(path, excludes))
    if watched:
        base = root.rstrip("/")
        keep = F.lit(False)
        for d in watched:
            keep = keep | F.col("file_path").startswith(base + "/" if d == "." else f"{base}/{d.strip('/')}/")
        f = f.filter(keep)
    return f.select("file_path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("n_bytes"))


def language(path: Column) -> Column:
    """``ts``, ``py``, ``rs`` or null: which parser reads a file (O-07)."""
    return F.when(path.rlike(r"\.tsx?$"), "ts").when(path.endswith(".py"), "py").when(path.endswith(".rs"), "rs")


def detect_packages(files: DataFrame, root: str) -> DataFrame:
    """``name, dir`` of the packages of a repository (O-03).

    ``src`` is ``app``; children of ``apps`` and ``packages`` are packages, by their
    ``src`` if they have one; other top-level directories only with a ``src``.  A
    name in use gets ``-2``, ``-3`` and so on; without any package the root is one.
    """
    one = F.lit(root.rstrip("/"))
    named = packages_by_root(files.select("file_path", one.alias("root"))).select("name", "dir")
    none = files.sparkSession.createDataFrame([("root", ".")], "name string, dir string").join(named.agg(F.count("*").alias("_c")), F.col("_c") == 0).select("name", "dir")
    return named.unionByName(none)


def checkout_root(path: Column) -> Column:
    """The checkout a file belongs to: ``.../checkout/<repository>``, else the
    directory the path begins with; null for a bare file name (O-03)."""
    known = F.regexp_extract(path, r"^(.*?/checkout/[^/]+)/", 1)
    top = F.regexp_extract(path, r"^(/?[^/]+)/", 1)
    return F.when(known != "", known).when(top != "", top)


def packages_by_root(files: DataFrame) -> DataFrame:
    """``root, name, dir`` of the packages of every root (O-03): ``detect_packages``
    for ``files`` (``file_path, root``) of many repositories at once.  Files
    without a root or outside it are left out."""
    known = files.filter(F.startswith("file_path", F.concat("root", F.lit("/"))))
    rel = F.expr("substring(file_path, length(root) + 2)")
    parts = known.select("root", F.split(rel, "/").alias("p"))
    n = F.size("p")
    first, second, third = F.col("p")[0], F.try_element_at("p", F.lit(2)), F.try_element_at("p", F.lit(3))
    mono = first.isin("apps", "packages") & (n >= 3)
    kinds = F.when((first == "src") & (n >= 2), F.struct(F.lit(0).alias("o"), F.lit("app").alias("name"), F.lit("src").alias("dir"), F.lit(True).alias("src")))
    kinds = kinds.when(mono, F.struct(F.when(first == "apps", 1).otherwise(2).alias("o"), second.alias("name"), F.concat_ws("/", first, second).alias("dir"), ((third == "src") & (n >= 4)).alias("src")))
    kinds = kinds.when((second == "src") & (n >= 3) & ~first.startswith("."), F.struct(F.lit(3).alias("o"), first.alias("name"), first.alias("dir"), F.lit(True).alias("src")))
    found = parts.select("root", kinds.alias("k")).filter("k is not null").select("root", "k.*").groupBy("root", "o", "name", "dir").agg(F.max("src").alias("src"))
    found = found.withColumn("dir", F.when(F.col("src") & (F.col("dir") != "src"), F.concat("dir", F.lit("/src"))).otherwise(F.col("dir")))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("root", "name").orderBy("o", "dir"))
    named = found.withColumn("_k", k).select("root", F.when(F.col("_k") > 1, F.concat("name", F.lit("-"), F.col("_k").cast("string"))).otherwise(F.col("name")).alias("name"), "dir")
    bare = known.select("root").distinct().join(named.select(F.col("root").alias("_r")).distinct(), F.col("root") == F.col("_r"), "left_anti")
    return named.unionByName(bare.select("root", F.lit("root").alias("name"), F.lit(".").alias("dir")))


def _up(c: Column, levels: Column) -> Column:
    return resolve_path(F.concat(c, F.repeat(F.lit("/.."), levels)))


def import_candidates(kind: Column, from_file: Column, spec: Column, root: str, scopes: dict[str, str] | None = None, roots: list[str] | None = None, crate: Column | None = None) -> Column:
    """Directories an import may lead to, best first (O-45)."""
    here = dirname(from_file)
    joined = resolve_path(F.concat(here, F.lit("/"), spec))
    relative = F.when(spec.startswith("."), F.array(joined, F.when(dirname(joined) != here, dirname(joined))))
    ts = relative
    for pkg, d in sorted((scopes or {}).items(), key=lambda x: len(x[0])):
        rest = F.substring(spec, F.lit(len(pkg) + 2), F.length(spec))
        at = f"{root.rstrip('/')}/{d}"
        sub = F.concat(F.lit(at + "/"), rest)
        hit = (spec == pkg) | spec.startswith(pkg + "/")
        ts = F.when(hit, F.when(rest != "", F.array(sub, dirname(sub), F.lit(at))).otherwise(F.array(F.lit(at)))).otherwise(ts)
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    tail = F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/")
    base = _up(here, F.greatest(dots - 1, F.lit(0)))
    under = F.concat(base, F.lit("/"), tail)
    absolute = []
    for r in [*(roots or []), root.rstrip("/")]:
        c = F.concat(F.lit(r.rstrip("/") + "/"), tail)
        absolute += [c, F.when(dirname(c) != r.rstrip("/"), dirname(c))]
    py = F.when(dots > 0, F.when(tail == "", F.array(base)).otherwise(F.array(under, dirname(under)))).otherwise(F.array(*absolute))
    stem = F.regexp_replace(basename(from_file), r"\.rs$", "")
    mod = F.when(basename(from_file).isin("mod.rs", "lib.rs", "main.rs"), here).otherwise(F.concat(here, F.lit("/"), stem))
    segs = F.filter(F.split(spec, "::"), lambda s: s != "")
    supers = F.size(segs) - F.size(F.filter(segs, lambda s: s != "super"))
    start = F.when(segs[0] == "crate", crate if crate is not None else F.lit(f"{root.rstrip('/')}/src")).when(segs[0] == "self", mod).when(segs[0] == "super", _up(mod, supers))
    rest_segs = F.filter(segs, lambda s: ~s.isin("crate", "self", "super"))
    depths = F.reverse(F.sequence(F.lit(0), F.size(rest_segs)))
    rs = F.when(start.isNotNull(), F.transform(depths, lambda n: F.when(n > 0, F.concat(start, F.lit("/"), F.array_join(F.slice(rest_segs, F.lit(1), n), "/"))).otherwise(start)))
    return F.array_compact(F.when(kind == "ts", ts).when(kind == "py", py).when(kind == "rs", rs))


def resolve_imports(imports: DataFrame, dirs: DataFrame, root: str, scopes: dict[str, str] | None = None, roots: list[str] | None = None) -> DataFrame:
    """``imports`` (``from_file, spec`` and more) with ``target``: the first
    candidate that is a known directory (``dirs``: ``dir``), or null for external
    packages and for the importing directory itself (O-45).  Known directories
    take the place of the file system, so executors need none."""
    cand = import_candidates(language(F.col("from_file")), F.col("from_file"), F.col("spec"), root, scopes, roots)
    rows = imports.withColumn("_cand", cand)
    cols = imports.columns
    flat = rows.select("from_file", "spec", F.posexplode("_cand").alias("_p", "_d")).distinct()
    known = dirs.select(F.col("dir").alias("_k")).distinct()
    best = flat.join(known, F.col("_d") == F.col("_k")).groupBy(F.col("from_file").alias("_f"), F.col("spec").alias("_s")).agg(F.min(F.struct("_p", "_d")).alias("_m"))
    out = imports.join(best, (F.col("from_file") == F.col("_f")) & (F.col("spec") == F.col("_s")), "left")
    return out.select(*cols, F.when(F.col("_m._d") != dirname(F.col("from_file")), F.col("_m._d")).alias("target"))
