"""Column helpers, parsers, feeds, versioned tables and streams on fixtures."""

import datetime as dt

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions.vectors import cosine_distance
from graphloom.model import PropertyGraph
from graphloom.operators import cdc, decisions, lookup, memory, novelty, traverse
from graphloom.session import checkpoint
from graphloom.sources import build, feeds, parsers, store, trees
from graphloom.streaming import sync


def one(spark, c, **cols):
    row = [tuple(cols.values())] if cols else [(1,)]
    return spark.createDataFrame(row, list(cols) or ["x"]).select(c.alias("v")).first()["v"]


def test_text_helpers(spark):
    assert one(spark, tx.strip_comments(F.col("s")), s="a /* x\ny */  b // c\n d") == "a b d"
    assert one(spark, tx.id_name(F.col("s")), s="a.rs::m::N") == "N" and one(spark, tx.id_path(F.col("s")), s="a.rs::m::N") == "a.rs::m"
    assert one(spark, tx.join_route(F.lit("/api/"), F.col("s")), s="/x/") == "/api/x"
    assert one(spark, tx.mask_uri(F.col("s")), s="bolt://neo:pw@h:1") == "bolt://neo:****@h:1"
    assert one(spark, tx.redact_shapes(F.col("s")), s="k sk-abcdefghij1234567890 u://a:b@c") == "k sk-**** u://a:****@c"
    assert one(spark, F.array_join(tx.version_parts(F.col("s")), "."), s="v1.12.x-rc1") == "1.12.0"
    assert one(spark, tx.snippet(F.col("s"), 3), s="abcd") == "abc\u2026"
    assert one(spark, F.round(tx.trigram_similarity(F.col("s"), F.lit("word")), 3), s="words") == 0.571
    assert one(spark, tx.contains_ci(F.col("s"), " a.b "), s="x\nA.B") is True and one(spark, tx.contains_ci(F.col("s"), "a.b"), s="AxB") is False
    assert one(spark, F.array_join(tx.clean_callees(F.array(F.lit("this.a"), F.lit("a"), F.lit("print")), ["print"]), ",")) == "a"
    assert one(spark, F.array_join(tx.type_refs(F.col("s"), ["Map"]), ","), s="Map<Foo, Bar> Foo") == "Foo,Bar"
    assert one(spark, tx.drift_status(F.lit("a"), F.lit("b"), F.lit(True))) == "modified"
    assert one(spark, cosine_distance(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 1.0


def test_lookup(spark):
    n = spark.createDataFrame([("f1", "A.run"), ("f2", "run2"), ("f3", "B.run"), (None, None)], "file_path string, name string")
    assert [r["name"] for r in lookup.find_by_name(n, "run").collect()] == ["A.run", "B.run"]
    assert lookup.find_by_name(n, "x.run").count() == 0 and lookup.find_by_name(n, "run2").first()["tier"] == 0
    assert [tuple(r) for r in lookup.near_names(n, "rum").collect()] == [("A.run", 1), ("B.run", 1), ("run2", 2)]
    logs = spark.createDataFrame([("a.log", "2025-01-01 [svc] ERROR: x\n\n2025-01-02 [svc] INFO: y")], "path string, value string")
    assert [r["line_no"] for r in lookup.log_search(lookup.log_lines(logs), severity="info", since="2025-01-02").collect()] == [3]


def test_traversal(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), (None, "x"), ("c", "d")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "start string")
    assert {(r["node"], r["hop"]) for r in traverse.reach(e, s, 6).collect()} == {("b", 1), ("c", 1), ("a", 2), ("d", 2)}
    assert {r["node"] for r in traverse.reach(e, s, 1, reverse=True).collect()} == {"c"}
    f = spark.createDataFrame([("p/a.ts", "A.run"), ("p/b.ts", "run")], "file_path string, name string")
    c = spark.createDataFrame([("p/b.ts", "main", "run"), ("p/a.ts", "x", "none")], "caller_path string, caller string, callee string")
    assert [r["target"] for r in traverse.resolve_calls(c, f).collect()] == ["run"]
    assert [r["target"] for r in traverse.resolve_calls(c, f, same_file=False).collect()] == ["A.run"]
    m = traverse.match_paths(f, spark.createDataFrame([("a.ts",), ("xp/b.ts",)], "c string"))
    assert [r["file_path"] for r in m.collect()] == ["p/a.ts"]
    rules = spark.createDataFrame([("r1", "p/", "module"), ("r2", "S", "service"), ("r3", "p/a.ts::A.run", "function")], "id string, scope string, scope_type string")
    got = traverse.scope_targets(rules, spark.createDataFrame([("s1", "S")], "id string, name string"), spark.createDataFrame([("m1", "p/x"), ("m2", "q")], "id string, file_path string"), spark.createDataFrame([("p/a.ts::A.run",)], "id string"))
    assert {tuple(r) for r in got.collect()} == {("r1", "m1"), ("r2", "s1"), ("r3", "p/a.ts::A.run")}


def test_changes(spark):
    old = spark.createDataFrame([("f", "a", "1"), ("f", "b", "2"), ("g", "c", "3"), ("f", "n", None)], "file_path string, name string, h string")
    new = spark.createDataFrame([("f", "a", "1"), ("f", "d", "9"), ("f", "n", None)], "file_path string, name string, h string")
    files = spark.createDataFrame([("f",)], "file_path string")
    ops = {(r["name"], r["op"]) for r in cdc.diff(old, new, ["file_path", "name"], "h", files).collect()}
    assert ops == {("b", "delete"), ("d", "create"), ("n", "update")}
    a = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["z"])], "k int, names array<string>")
    b = spark.createDataFrame([(1, ["x", "y"]), (3, ["z"])], "k int, names array<string>")
    assert {tuple(r) for r in cdc.diff_imports(a, b, ["k"], "names").collect()} == {(1, "add"), (2, "remove"), (3, "add")}


def test_style_targets(spark):
    rows = [(i, "x", "b" if i % 2 else "a") for i in range(8)] + [(9, "y", "none")]
    d = spark.createDataFrame(rows, "node_id int, axis string, value string")
    t = {r["axis"]: r for r in decisions.targets(d).collect()}
    assert t["x"]["target"] == "a" and not t["x"]["enforced"] and decisions.flags(d, decisions.targets(d)).count() == 0
    assert decisions.flags(d, decisions.targets(d, {"x": "b"})).count() == 4
    v = {r["axis"]: r["value"] for r in decisions.facts(spark.createDataFrame([(1, "export const a = `x${1}`; for (let i of b) {} await c;")], "n int, body string"), "n", "body").collect()}
    assert v == {"var_decl": "const", "string_style": "template-literal", "async_style": "async-await", "array_syntax": "none", "export_style": "named"}


def test_memory(spark):
    e = spark.createDataFrame([(2, "s", "two", ["c2"], ["r1", "r2"]), (1, "s", "one", ["c1", "c1"], ["r1"]), (3, None, "x", None, None), (4, "t", None, None, None)], "id long, session_id string, summary string, caveats array<string>, graph_refs array<string>")
    m = {r["session_id"]: r for r in memory.merge_sessions(e).collect()}
    assert m["s"]["summary"] == "one\n---\ntwo" and m["s"]["caveats"] == ["c1", "c1", "c2"] and m["s"]["graph_refs"] == ["r1", "r2"] and m["s"]["id"] == 2 and m["t"]["summary"] == ""
    items = spark.createDataFrame([("event", 1, "alpha beta", [1.0, 0.0], ["r"], dt.datetime(2026, 1, 1), "active"), ("event", 2, "zzz", [0.9, 0.1], None, None, None), ("event", 3, "x", [1.0, 0.0], None, None, "superseded")], "kind string, id long, text string, vec array<double>, graph_refs array<string>, created_at timestamp, status string")
    got = memory.recall(items, [1.0, 0.0], "alpha beta", "2026-01-01 00:00:00", ["r"]).collect()
    assert [r["id"] for r in got] == [1, 2] and got[0]["score"] == pytest.approx(1.2)


def test_novelty_of_little(spark):
    p = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 0.0]), (4, "a", [0.0, 0.0])], "id int, grp string, vec array<double>")
    loo = {r["id"]: r["knn_distance"] for r in novelty.leave_one_out(p).collect()}
    assert loo == {1: 1.0, 2: 1.0, 3: 0.0, 4: 1.0}
    v = {r["id"]: (r["verdict"], r["calibrated"]) for r in novelty.judge(p, p, spark.createDataFrame([("a", 1.0)], "grp string, threshold double")).collect()}
    assert v == {1: ("conforming", True), 2: ("conforming", True), 3: ("unjudged", False), 4: ("conforming", True)}
    s = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "s double, p boolean")
    assert novelty.auroc(s, "s", "p").first()["auroc"] == 0.875


def test_parsers(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import os\nfrom ..b import c\nclass K(B):\n    async def go(self, x: int = 1):\n        return self.h(x)\n")
    (tmp_path / "src/bad.py").write_text("def (:\n")
    (tmp_path / "src/a.ts").write_text("import { A } from './x';\nexport class F extends G {\n  async run(a: string): Promise<void> { this.go(a); }\n}\nexport const mul = (x) => { return f(x); };\n")
    (tmp_path / "src/a.test.ts").write_text("x")
    (tmp_path / "src/l.rs").write_text("impl T for S { pub fn run(&self) { go(); } }\npub struct S;\n#[cfg(test)]\nmod t { fn hid() {} }\nmod m { pub fn deep() {} }\n")
    files = trees.read_tree(spark, str(tmp_path))
    assert files.count() == 4
    rows = {(r["kind"], r["name"]): r for r in parsers.parse_sources(files).collect()}
    assert rows[("function", "K.go")]["is_async"] and rows[("function", "K.go")]["callees"] == ["h"] and rows[("class", "K")]["bases"] == ["B"]
    assert rows[("function", "F.run")]["callees"] == ["go"] and ("function", "mul") in rows and rows[("class", "F")]["bases"] == ["G"]
    assert ("function", "S.run") in rows and ("function", "m::deep") in rows and ("function", "t::hid") not in rows and rows[("struct", "S")]["bases"] == ["T"]
    assert "SyntaxError" in rows[("error", "")]["error"] and rows[("import", "..b")]["imported"] == ["c"]
    assert [tuple(r) for r in trees.detect_packages(files, str(tmp_path)).collect()] == [("app", "src")]


def test_feeds(spark, tmp_path):
    text = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    assert {tuple(r) for r in feeds.status_entries(text(" M a.ts", 'R  "old" -> "new b"', "?? c")).collect()} == {("M", "a.ts"), ("R", "new b"), ("??", "c")}
    assert feeds.log_entries(text("h\x1fs\x1fme\x1f2025-01-02T03:04:05+00:00\x1fa | b", "broken")).first()["message"] == "a | b"
    (tmp_path / "rules.json").write_text('[{"id": "1", "description": "d", "scope": "s", "scopeType": "module", "severity": "must", "tags": ["t"]}, {"id": "2", "description": "d", "scope": "s", "scopeType": "x", "severity": "must"}]')
    assert {r["id"]: (r["problem"], r["tags"]) for r in feeds.read_rules(spark, str(tmp_path / "rules.json")).collect()} == {"1": (None, ["t"]), "2": ("scopeType", [])}
    assert feeds.read_overrides('{"a": "x", "b": 1}', ["a", "b"]) == {"a": "x"} and feeds.read_overrides("[", ["a"]) == {}
    steps = [("1.0.0", "1.1.0"), ("1.1.0", "2.0.0"), ("3.0.0", "3.0.0")]
    assert feeds.migration_chain(steps, "1.0.0", "2.0.0") == (steps[:2], None)
    assert [feeds.migration_chain(steps, a, b)[1] for a, b in (("2.0.0", "1.0.0"), ("3.0.0", "4.0.0"), ("2.0.0", "3.0.0"))] == ["downgrade", "cycle", "missing"]


def test_versioned_table_and_stream(spark, tmp_path):
    root, src = str(tmp_path / "table"), tmp_path / "in"
    schema = "file_path string, name string, content_hash string, loaded_at long"
    spark.createDataFrame([("f", "a", "1", 1), ("f", "a", "2", 2), ("f", "b", "1", 1)], schema).write.parquet(str(src / "1"))
    stream = lambda: sync.sync_nodes(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src)), root, str(tmp_path / "cp"))
    stream().awaitTermination()
    spark.createDataFrame([("f", "b", "9", 3)], schema).write.parquet(str(src / "2"))
    stream().awaitTermination()
    assert {(r["name"], r["content_hash"]) for r in store.read(spark, root).collect()} == {("a", "2"), ("b", "9")}
    store.delete(spark, root, spark.createDataFrame([("a",)], "name string"), "name")
    assert store.counts(spark, {"t": root, "no": str(tmp_path / "no")}).orderBy("table").collect()[1]["rows"] == 1
    store.reset(spark, {"t": root})
    assert store.read(spark, root).count() == 0


def test_session_stream(spark, tmp_path):
    schema = "session_id string, id long, summary string"
    spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("t", 3, None)], schema).write.parquet(str(tmp_path / "in"))
    q = sync.merge_sessions(sync.follow(spark, str(tmp_path / "in"), schema)).writeStream.outputMode("update").format("memory").queryName("notes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["session_id"], r["last_id"], r["n_events"], r["summary"]) for r in spark.sql("SELECT * FROM notes").collect()} == {("s", 2, 2, "a\n---\nb"), ("t", 3, 1, "")}


def test_packages_of_every_root(spark):
    paths = ["/srv/checkout/a/src/x.py", "/srv/checkout/a/apps/web/src/y.ts", "/srv/checkout/b/apps/web/y.ts", "/srv/checkout/b/packages/web/z.ts", "/srv/checkout/c/readme.py", "/opt/tools/src/t.rs", "lone.py", None]
    files = spark.createDataFrame([(p,) for p in paths], "file_path string").withColumn("root", trees.checkout_root(F.col("file_path")))
    got = {tuple(r) for r in trees.packages_by_root(files).collect()}
    c = "/srv/checkout/"
    assert got == {(c + "a", "app", "src"), (c + "a", "web", "apps/web/src"), (c + "b", "web", "apps/web"), (c + "b", "web-2", "packages/web"), (c + "c", "root", "."), ("/opt", "tools", "tools/src")}


def test_detected_packages_leave_no_checkout_out(spark):
    from graphloom.plans import QUERIES

    sf = "/root/testdata/sf0.01"
    roots = {"/".join(r["file_path"].split("/")[:4]) for r in spark.read.parquet(sf + "/graph_nodes.parquet").select("file_path").filter("file_path like '/srv/checkout/%/%'").distinct().collect()}
    assert len(roots) > 1 and {r["root"] for r in QUERIES["detected_packages"](spark, sf).collect()} >= roots


@pytest.mark.parametrize("name", ["data_flow_cyclic_all", "hybrid_recall_text"])
def test_whole_tables_equal_sql_at_scale(spark, name):
    from parity import compare

    from graphloom.plans import ORACLE, QUERIES

    sf = "/root/testdata/sf0.01"
    assert compare(spark, sf, name, QUERIES[name], ORACLE[name]) is None


def test_a_failed_write_leaves_the_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "id int, v string")
    held = lambda: sorted(map(tuple, store.read(spark, root).collect()))
    put = store._put

    def broken(*args):
        raise OSError("lost")

    # the first write fails before its pointer stands: there is no table yet, and a retry makes one
    monkeypatch.setattr(store, "_put", broken)
    with pytest.raises(OSError):
        store.write(rows((1, "a"), (2, "b")), root)
    monkeypatch.setattr(store, "_put", put)
    assert store.current(spark, root) is None
    store.merge(spark, root, rows((1, "a"), (2, "b")), ["id"])
    monkeypatch.setattr(store, "_put", broken)
    with pytest.raises(OSError):
        store.merge(spark, root, rows((2, "c")), ["id"])
    assert held() == [(1, "a"), (2, "b")]
    monkeypatch.setattr(store, "_put", put)
    monkeypatch.setattr(store, "_prune", broken)
    with pytest.raises(OSError):
        store.merge(spark, root, rows((2, "c")), ["id"])
    assert held() == [(1, "a"), (2, "c")]
    monkeypatch.undo()
    for k in range(4):
        store.merge(spark, root, rows((3, f"x{k}")), ["id"])
    assert held() == [(1, "a"), (2, "c"), (3, "x3")]
    assert len(list((tmp_path / "t").glob("v-*"))) <= 4 and len(list((tmp_path / "t").glob("_CURRENT.*"))) == 2
    # of two writers that start from one version the later one fails
    store._put(spark, f"{root}/_CURRENT.90", "v")
    with pytest.raises(RuntimeError):
        store._put(spark, f"{root}/_CURRENT.90", "w")


def test_a_table_without_its_pointers_is_no_new_table(spark, tmp_path):
    root = str(tmp_path / "t")
    store.write(spark.range(3), root)
    for f in (tmp_path / "t").glob("_CURRENT.*"):
        f.unlink()
    with pytest.raises(RuntimeError):
        store.merge(spark, root, spark.range(1), ["id"])


def test_vectors_of_another_length_are_refused(spark, tmp_path):
    root = str(tmp_path / "v")
    rows = lambda *x: spark.createDataFrame(list(x), "node_id string, embedding array<float>, seq int")
    store.merge_vectors(spark, root, rows(("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 2), ("b", [0.0, 1.0], 1)), 2, ["seq"])
    for bad in (("c", [1.0], 1), ("c", None, 1)):
        with pytest.raises(ValueError):
            store.merge_vectors(spark, root, rows(bad), 2, ["seq"])
    assert sorted((r["node_id"], r["embedding"]) for r in store.read(spark, root).collect()) == [("a", [3.0, 4.0]), ("b", [0.0, 1.0])]


SOURCES = {
    "/r/apps/web/src/user.controller.ts": """import { UserService } from './user.service';
import { audit } from '../../api/src/log';
@Controller('users')
export class UserController extends BaseController implements Auditable {
  constructor(private readonly svc: UserService, @Inject(Clock) at: unknown) { super(); }
  @Get(':id')
  async find(id: string, how: Query): Promise<User> { console.log(id); Math.max(1, 2); audit(id); return this.check(how); }
  @Post() make() { clearTimeout(1); this.find('x'); }
  check(how: Query) { return how; }
}
export class BaseController { }
export interface Auditable { }
export type Query = string;
""",
    "/r/apps/web/src/user.service.ts": "export class UserService { load(id: string): User { return audit(id); } }\nexport class User { }\nexport class Clock { }\n",
    "/r/apps/api/src/log.ts": "export function audit(id: string) { return format(id); }\nfunction format(x: string) { return x; }\n",
    "/r/apps/api/src/main.py": "from .log import audit\n@app.post('/run')\ndef run(job: Job) -> Done:\n    return audit(len(job))\nclass Job:\n    pass\nclass Done(Job):\n    pass\n",
    "/r/apps/api/src/bad.py": "def (:\n",
}


def test_parsed_fields(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "file_path string, text string")
    rows = {(r["kind"], r["name"]): r for r in parsers.parse_sources(files).collect()}
    find = rows[("function", "UserController.find")]
    assert (find["http_method"], find["route_path"], find["type_refs"], find["callees"]) == ("GET", "/users/:id", ["Query", "User"], ["audit", "check"])
    assert rows[("function", "UserController.make")]["route_path"] == "/users" and rows[("function", "UserController.make")]["callees"] == ["find"]
    cls = rows[("class", "UserController")]
    assert (cls["extends"], cls["implements"], [d["name"] for d in cls["decorators"]]) == (["BaseController"], ["Auditable"], ["Controller"])
    assert [(p["name"], p["type"], p["inject_token"]) for p in cls["params"]] == [("svc", "UserService", None), ("at", "unknown", "Clock")]
    run = rows[("function", "run")]
    assert (run["http_method"], run["route_path"], run["type_refs"], run["callees"]) == ("POST", "/run", ["Done", "Job"], ["audit"])


def test_graph_of_parsed_sources(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "file_path string, text string")
    packages = trees.detect_packages(files, "/r")
    g = build.build_graph(parsers.parse_sources(files), "/r", packages)
    g = PropertyGraph(checkpoint(g.nodes), checkpoint(g.edges))
    short = lambda x: x.replace("/r/apps/", "").replace("/src/", "/")
    edges = {}
    for r in g.edges.collect():
        edges.setdefault(r["type"], set()).add((short(r["src"]), short(r["dst"])))
    web, srv, api, py = "web/user.controller.ts", "web/user.service.ts", "api/log.ts", "api/main.py"
    assert edges["CALLS"] == {(f"{web}::UserController.find", f"{api}::audit"), (f"{web}::UserController.find", f"{web}::UserController.check"), (f"{web}::UserController.make", f"{web}::UserController.find"), (f"{api}::audit", f"{api}::format"), (f"{py}::run", f"{api}::audit")}
    assert edges["USES_TYPE"] == {(f"{web}::UserController.find", f"{web}::Query"), (f"{web}::UserController.find", f"{srv}::User"), (f"{web}::UserController.check", f"{web}::Query"), (f"{srv}::UserService.load", f"{srv}::User"), (f"{py}::run", f"{py}::Job"), (f"{py}::run", f"{py}::Done"), (f"{web}::UserController.constructor", f"{srv}::UserService")}
    assert edges["EXTENDS"] == {(f"{web}::UserController", f"{web}::BaseController"), (f"{py}::Done", f"{py}::Job")}
    assert edges["IMPLEMENTS"] == {(f"{web}::UserController", f"{web}::Auditable")}
    assert edges["INJECTS"] == {(f"{web}::UserController", f"{srv}::UserService"), (f"{web}::UserController", f"{srv}::Clock")}
    assert {(a.replace("/r/apps/", ""), b.replace("/r/apps/", "")) for a, b in edges["IMPORTS"]} == {("web/src", "api/src")}
    assert edges["BELONGS_TO"] == {("web/src", "service:web"), ("api/src", "service:api")}
    counts = {r["label"]: r["count"] for r in g.nodes.groupBy("label").count().collect()}
    assert counts == {"File": 5, "Module": 2, "Service": 2, "Function": 8, "Type": 9, "CodeBlock": 17}
    # structural questions run on it: an ambiguous name gives candidates, a plain one is walked
    flow = {(r["kind"], short(r["id"]), r["hop"]) for r in traverse.flow_from(g.edges.select("src", "dst"), g.nodes, "UserController.make", depth=2).collect()}
    assert ("flow", f"{web}::UserController.find", 1) in flow and ("flow", f"{api}::audit", 2) in flow
    assert build.build_graph(parsers.parse_sources(files.limit(0)), "/r").edges.count() == 0


def test_ambiguous_starts_give_candidates(spark):
    nodes = spark.createDataFrame([("a::run", "Function", "a", "run"), ("b::run", "Function", "b", "run"), ("c::K.go", "Function", "c", "K.go")], "id string, label string, file_path string, name string")
    edges = spark.createDataFrame([("c::K.go", "a::run"), ("a::run", "b::run")], "src string, dst string")
    ask = lambda *a: {(r["kind"], r["id"], r["hop"]) for r in traverse.flow_from(edges, nodes, *a).collect()}
    assert ask("run") == {("candidate", "a::run", None), ("candidate", "b::run", None)}
    assert ask("run", "a") == {("flow", "b::run", 1)} and ask("none") == set()
    assert ask("go") == {("flow", "a::run", 1), ("flow", "b::run", 2)}


def test_calls_within_and_beyond_a_file(spark):
    f = spark.createDataFrame([("a", "run"), ("a", "K.run"), ("b", "Z.run"), ("c", "Y.run")], "file_path string, name string")
    calls = spark.createDataFrame([(p, "x", "run") for p in "abcd"], "caller_path string, caller string, callee string")
    got = lambda same: {(r["caller_path"], r["target_path"], r["target"]) for r in traverse.resolve_calls(calls, f, same).collect()}
    assert got(True) == {("a", "a", "run"), ("b", "b", "Z.run"), ("c", "c", "Y.run")}
    assert got(False) == {("a", "b", "Z.run"), ("b", "a", "run"), ("c", "a", "run"), ("d", "a", "run")}
    assert got(None) == {(p, "a", "run") for p in "abcd"}


def test_changes_since_the_cursor(spark):
    text = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    tree = spark.createDataFrame([("a",), ("b",), (None,)], "file_path string")
    got = lambda *x: {tuple(r) for r in feeds.changed_files(*x).collect()}
    assert got(text("a ", "gone", ""), text("gone"), tree) == {("a", "changed"), ("gone", "deleted")}
    assert got(text("a"), text("gone"), tree, False) == {("a", "changed"), ("b", "changed")}
    pairs = lambda *v: spark.createDataFrame(list(v), "hash string, value string")
    files = feeds.commit_files(spark.createDataFrame([("1",), ("2",), ("3",)], "hash string"), pairs(("1", "a"), ("1", "a"), ("2", " "), ("9", "z")), pairs(("1", "no"), ("2", "b"), ("2", "c")))
    assert {tuple(r) for r in files.collect()} == {("1", "a"), ("2", "b"), ("2", "c")}


def test_rendered_lines(spark):
    df = spark.createDataFrame([(2, None), (1, "x")], "id int, v string")
    assert [r["line"] for r in store.render(df, "Things", ["id"]).orderBy("line_no").collect()] == ["# Things", "- id: 1, v: x", "- id: 2"]
    assert store.render(df.limit(0), "None", ["id"]).count() == 1


def test_embedder_hook_and_vector_maintenance(spark):
    texts = spark.createDataFrame([("f", f"name{i}", None if i == 3 else f"readFile number{i}") for i in range(7)], "file_path string, name string, text string")
    got = {r["name"]: r["embedding"] for r in novelty.embed(texts, "text", novelty.hashed_words(8), 8, batch=2).collect()}
    assert got["name3"] is None and all(abs(sum(x * x for x in v) - 1) < 1e-5 for k, v in got.items() if k != "name3")
    with pytest.raises(Exception, match="embedder"):
        novelty.embed(texts, "text", lambda t: [[1.0]] * len(t), 8).collect()
    vectors = spark.createDataFrame([("f::name0", [1.0]), ("f::name1", [1.0]), ("f::old", [1.0])], "node_id string, embedding array<float>")
    changes = spark.createDataFrame([("f", "name1", "update"), ("f", "name2", "create"), ("f", "old", "delete")], "file_path string, name string, op string")
    asked = []
    made = lambda d: asked.append(d.count()) or novelty.embed(d.withColumn("node_id", F.concat_ws("::", "file_path", "name")), "text", novelty.hashed_words(8), 8)
    out = {r["node_id"]: len(r["embedding"]) for r in cdc.maintain_vectors(vectors, changes, texts, made).collect()}
    assert out == {"f::name0": 1, "f::name1": 8, "f::name2": 8} and asked == [2]


@pytest.mark.parametrize("n", [2000, 8000])
def test_approximate_search_recalls_near_ones(spark, n):
    import numpy as np

    rng = np.random.RandomState(n)
    centre = rng.normal(size=(n // 20, 16))
    x = centre[rng.randint(len(centre), size=n)] + rng.normal(size=(n, 16)) * 0.15
    pool = spark.createDataFrame([(i, "g", [float(v) for v in x[i]]) for i in range(n)] + [(n, "g", [1.0])], "id long, grp string, vec array<double>")
    asked = pool.filter("id % 100 = 0 and size(vec) = 16")
    near = lambda d: {(r["id"], r["neighbour"]) for r in d.filter("distance < 0.1").collect()}
    want, got = near(novelty.nearest(asked, pool.filter("size(vec) = 16"), 5)), near(novelty.nearest_approximate(asked, pool, 5, 16, bucket_rows=128))
    assert len(want & got) >= 0.9 * len(want) > 0


def test_entries_are_recorded(spark):
    rows = spark.createDataFrame([(1, "a", "active", None), (2, "b", None, None)], "id long, text string, status string, superseded_by long")
    new = spark.createDataFrame([(3, "k ghp_abcdefghij1234567890", 1), (4, "plain", None), (5, "late", 99)], "id long, text string, supersedes long")
    assert {tuple(r) for r in memory.record(rows, new).collect()} == {(1, "a", "superseded", 3), (2, "b", None, None), (3, "k ghp_****", "active", None), (4, "plain", "active", None), (5, "late", "active", None)}


def test_many_caveats_are_resolved_at_once(spark):
    kind = "id long, caveats array<string>, resolutions array<struct<caveat_index:int,resolved_at:timestamp,note:string>>"
    at = dt.datetime(2026, 1, 1)
    e = spark.createDataFrame([(1, ["a", "b"], [(1, at, "old")]), (2, None, None), (3, ["c"], [(0, at, "old")])], kind)
    due = spark.createDataFrame([(1, 1, at, "x"), (1, 1, at + dt.timedelta(1), "new"), (1, 0, at, "zero"), (1, 7, at, "far"), (2, 0, at, "none"), (3, -1, at, "low")], "event_id long, caveat_index int, resolved_at timestamp, note string")
    got = {r["id"]: [(x["caveat_index"], x["note"]) for x in r["resolutions"] or []] for r in memory.resolve_caveats(e, due).collect()}
    assert got == {1: [(0, "zero"), (1, "new")], 2: [], 3: [(0, "old")]}


def _most_rows(plan) -> int:
    """Rows of the largest step of an executed plan."""
    m, below = plan.metrics().get("numOutputRows"), plan.children()
    return max([m.get().value() if m.isDefined() else 0, *(_most_rows(below.apply(i)) for i in range(below.size()))])


def test_changes_are_counted_without_their_pairs(spark, tmp_path):
    from parity import compare

    from graphloom.plans import ORACLE, QUERIES

    hub = [("Function", "/hub.ts", f"f{i}") for i in range(400)]
    odd = [("Type", "/hub.ts", "f1"), ("Function", "/hub.ts", None), ("Function", "/null.ts", None), ("Function", None, "f"), ("Function", "/p", ":n"), ("Function", "/p:", "n"), ("Function", "/p:", "m"), ("Function", "/a", "b::c"), ("Function", "/a::b", "c"), ("Function", "", "e")]
    put = lambda name, rows, kind: pq.write_table(spark.createDataFrame(rows, kind).toArrow(), tmp_path / f"{name}.parquet")
    put("graph_nodes", hub + hub[:9] + odd, "label string, file_path string, name string")
    at = dt.datetime(2026, 1, 1)
    refs = [(i, at, at, ["/hub.ts::f1", "/hub.ts", "/x/../hub.ts::f2"]) for i in range(300)]
    refs += [(300, at, at, ["/null.ts::f"]), (301, at, at, ["/p::x", "/p:", "/p:::n"]), (302, at, at, ["/p:", None]), (303, at, at, ["/a::b", "/a"]), (304, at, at, ["", "/gone::f"]), (305, at, at, None), (306, at, at, ["/hub.ts"]), (306, at, at + dt.timedelta(1), ["/a"]), (None, at, at, ["/hub.ts", "/p"])]
    put("agent_decisions", refs, "id long, created_at timestamp, loaded_at timestamp, graph_refs array<string>")
    assert compare(spark, str(tmp_path), "change_links", QUERIES["change_links"], ORACLE["change_links"]) is None
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES["change_links"](spark, str(tmp_path))
        got = {r["hash"]: r["n_entities"] for r in df.collect()}
        assert _most_rows(df._jdf.queryExecution().executedPlan()) < 2_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {i: 400 for i in range(300)} | {300: 0, 301: 2, 302: 2, 303: 1, 304: 1, 306: 1, None: 401}


def test_counted_links_equal_the_pairs(spark):
    e = spark.createDataFrame([("1", "f"), ("1", "g"), ("2", "f"), ("3", "g"), ("3", "g"), ("4", "h"), ("5", None)], "id string, file_path string")
    c = spark.createDataFrame([("x", "f"), ("x", "g"), ("x", "g"), ("y", "f"), ("z", "none"), (None, "h")], "hash string, file_path string")
    pairs = cdc.link_changes(e, c).groupBy("hash").agg(F.count("*").alias("n_entities"))
    assert {tuple(r) for r in cdc.count_links(e, c).collect()} == {tuple(r) for r in pairs.collect()} == {("x", 3), ("y", 2), (None, 1)}
