"""Orphan references, hierarchies and snapshot changes against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.paths import ref_name, ref_path, resolve_path
from graphloom.operators.hierarchy import descendants, hierarchies, walk
from graphloom.operators.orphan_refs import orphan_counts, orphan_refs
from graphloom.operators.snapshots import snapshot_changes


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)


def lives_and_refs(seed, n=400):
    r = random.Random(seed)
    lives = []
    for k in range(12):
        for _ in range(r.choice([0, 1, 1, 2, 5, 40])):
            a = r.randint(0, 2000)
            lives.append((f"k{k}", day(a), None if r.random() < 0.2 else day(a + r.randint(0, 300))))
    lives += [("k1", None, day(5)), (None, day(0), None)]
    refs = [(i, r.choice(["k0", "k0", "k0", *[f"k{j}" for j in range(13)], None]), None if r.random() < 0.03 else day(r.randint(0, 2300))) for i in range(n)]
    return lives, refs


@pytest.mark.parametrize("heavy, few", [(10**6, 10**5), (20, 10**5), (20, 3)])
def test_orphans_equal_brute_force(spark, heavy, few):
    lives, refs = lives_and_refs(heavy + few)
    want = {i for i, k, at in refs if not (k and at and any(lk == k and b and b <= at and (e is None or at < e) for lk, b, e in lives))}
    got = orphan_refs(
        spark.createDataFrame(refs, "id int, key string, at timestamp").withColumn("first", F.lit(1)),
        spark.createDataFrame([(*x, "extra") for x in lives], "key string, first timestamp, last timestamp, id string"),
        ["key"], "at", "first", "last", heavy_rows=heavy, broadcast_rows=few,
    )
    assert {r["id"] for r in got.collect()} == want


def test_a_key_with_a_third_of_the_references_is_split_off(spark):
    lives, refs = lives_and_refs(7)
    refs += [(1000 + i, f"r{i}", day(3)) for i in range(2000)]
    want = {i for i, k, at in refs if not (k and at and any(lk == k and b and b <= at and (e is None or at < e) for lk, b, e in lives))}
    got = orphan_refs(spark.createDataFrame(refs, "id int, key string, at timestamp"), spark.createDataFrame(lives, "key string, first timestamp, last timestamp"), ["key"], "at", "first", "last")
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"] for r in got.collect()} == want


def test_keys_heavy_on_both_sides_are_split_by_time(spark):
    r = random.Random(11)
    lives = [("hot", day(a), day(a + 2)) for a in range(0, 3000, 3)] + [("k", day(0), None)]
    refs = [(i, "hot" if i % 3 else r.choice("kz"), day(r.randint(0, 3100))) for i in range(3000)]
    want = {i for i, k, at in refs if not any(lk == k and b <= at and (e is None or at < e) for lk, b, e in lives)}
    args = (spark.createDataFrame(refs, "id int, key string, at timestamp"), spark.createDataFrame(lives, "key string, first timestamp, last timestamp"), ["key"], "at", "first", "last")
    assert {x["id"] for x in orphan_refs(*args, broadcast_rows=10).collect()} == want
    assert {x["id"] for x in orphan_refs(*args).collect()} == want


def test_orphans_of_empty_tables(spark):
    refs = spark.createDataFrame([(1, "a", day(0))], "id int, key string, at timestamp")
    lives = spark.createDataFrame([], "key string, first timestamp, last timestamp")
    assert orphan_refs(refs, lives, ["key"], "at", "first", "last").count() == 1
    assert orphan_refs(refs.limit(0), lives, ["key"], "at", "first", "last").count() == 0
    assert orphan_counts(refs, refs, ["key"], "at").collect()[0].asDict() == {"key": "a", "month": "2025-01", "n_refs": 1, "n_orphans": 1}


def test_spellings_of_a_path(spark):
    rows = [("/a/b/c.ts::N", "/a/b/c.ts", "N"), ("\\a\\b\\c.ts::N", "/a/b/c.ts", "N"), ("file:///a/b/c.ts::m::N.x", "/a/b/c.ts", "m::N.x"), (" /a/./x/../b//c.ts::N \n", "/a/b/c.ts", "N"), ("/a/b/c.ts", "/a/b/c.ts", None), ("/a/b/c.ts:: ", "/a/b/c.ts", None), (None, None, None), ("FILE://localhost/a/b%20d/c.ts::N", "/a/b d/c.ts", "N"), ("../a/../../b::N", "../../b", "N"), ("/../a::N", "/a", "N")]
    df = spark.createDataFrame(rows, "ref string, p string, n string")
    for r in df.select("ref", "p", "n", ref_path(F.col("ref")).alias("rp"), ref_name(F.col("ref")).alias("rn")).collect():
        assert (r["rp"], r["rn"]) == (r["p"], r["n"]), r
    assert spark.createDataFrame([("A/B",)], "p string").select(resolve_path(F.col("p"))).first()[0] == "A/B"


def brute_tree(parent):
    out = {}
    for x in parent:
        seen, at = [x], x
        while parent[at] is not None and parent[at] in parent and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        nxt = parent[at]
        if nxt is not None and nxt in parent:
            ring = set(seen[seen.index(nxt) :])
            depth = next(i for i, y in enumerate(seen) if y in ring)
            out[x] = (min(ring), depth, seen[: depth + 1], "cycle")
        else:
            out[x] = (at, len(seen) - 1, seen, "linked" if len(seen) > 1 else "dangling" if nxt is not None else "root")
    return out


@pytest.mark.parametrize("most", [100_000, 3])
def test_hierarchies_equal_brute_force(spark, most):
    r = random.Random(most)
    n = 300
    parent = {i: (i + 1 if i < 60 else r.choice([None, r.randint(0, n + 20), r.randint(0, n - 1), i])) for i in range(n)}
    df = spark.createDataFrame([(k, v, "x") for k, v in parent.items()] + [(None, 3, "x")], "id long, up long, depth string")
    tree = hierarchies(df, "id", "up", max_component_rows=most)
    got = {x["id"]: (x["root_id"], x["depth"], x["path"], x["outcome"]) for x in tree.collect()}
    want = brute_tree(parent)
    assert got == want
    pairs = {(x["id"], x["descendant_id"]) for x in descendants(tree).collect()}
    below = set()
    for x in parent:
        at, seen = parent[x], {x}
        while at is not None and at in parent and at not in seen:
            below.add((at, x))
            seen.add(at)
            at = parent[at]
    # a node of a circle has all other nodes of its component below it
    roots = {x: want[x][0] for x in want if want[x][3] == "cycle"}
    rings = {x for x in roots if want[x][1] == 0}
    below |= {(a, b) for a in rings for b in roots if roots[a] == roots[b] and a != b}
    assert pairs == below


def test_hierarchies_of_little(spark):
    empty = spark.createDataFrame([], "id long, up long")
    assert hierarchies(empty, "id", "up").count() == 0
    text = spark.createDataFrame([("a", "b"), ("b", None), ("c", "c"), ("d", "zz")], "id string, up string")
    assert {(r["id"], r["root_id"], r["outcome"]) for r in hierarchies(text, "id", "up").collect()} == {("a", "b", "linked"), ("b", "b", "root"), ("c", "c", "cycle"), ("d", "d", "dangling")}


def test_walk_colours_back_edges():
    rows = {r[0]: r for r in walk([1, 2, 3, 4], [2, 3, 2, 1])}
    assert rows[4][1:] == (2, 2, [4, 1, 2], False) and rows[3][4] and rows[2][4] and not rows[1][4]


def test_a_long_chain_is_walked_without_copied_paths():
    import tracemalloc

    n = 100_000
    ids = list(range(n))
    tracemalloc.start()
    got = [(x, root, depth) for x, root, depth, path, _ in walk(ids, [i + 1 if i < n - 1 else None for i in ids], False) if x % 1000 == 0 and path is None]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(x, n - 1, n - 1 - x) for x in range(0, n, 1000)][::-1] and peak < 100e6


@pytest.mark.parametrize("most", [100_000, 50])
def test_without_paths_every_size_is_alike(spark, most):
    n = 200
    df = spark.createDataFrame([(i, i + 1 if i % 100 < 99 else None) for i in range(n)] + [(500, 501), (501, 500)], "id long, up long")
    tree = hierarchies(df, "id", "up", max_component_rows=most, with_paths=False).collect()
    assert all(r["path"] is None for r in tree)
    assert {(r["id"], r["root_id"], r["depth"], r["outcome"]) for r in tree} == {(i, i // 100 * 100 + 99, 99 - i % 100, "linked" if i % 100 < 99 else "root") for i in range(n)} | {(500, 500, 0, "cycle"), (501, 500, 0, "cycle")}


def brute_changes(rows):
    seq = {}
    for s, at, *_ in rows:
        seq[s] = min(seq.get(s, at), at)
    order = sorted(seq, key=lambda s: (seq[s], s))
    state = {s: {} for s in order}
    for s, _, k, n, h, ln in rows:
        v = (ln if ln is not None else -1, h or "")
        if (k, n) not in state[s] or v >= state[s][(k, n)][0]:
            state[s][(k, n)] = (v, h)
    out = set()
    for a, b in zip(order, order[1:]):
        for k in state[a].keys() | state[b].keys():
            if k not in state[a]:
                out.add((b, *k, "added"))
            elif k not in state[b]:
                out.add((b, *k, "removed"))
            elif state[a][k][1] != state[b][k][1]:
                out.add((b, *k, "changed"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshot_changes_equal_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for s in (7, 3, 9):
        for i in range(1500):
            if r.random() < 0.95:
                h = f"h{i}" if r.random() < 0.95 else r.choice([None, f"g{r.random()}"])
                rows.append((s, day(s), f"f{i % 3 if seed == 1 else i // 100}", f"n{i}", h, i))
                if r.random() < 0.03:
                    rows.append((s, day(s), rows[-1][2], f"n{i}", f"old{i}", i - 2 if i > 2 else None))
    df = spark.createDataFrame(rows, "snap int, taken timestamp, path string, name string, hash string, line int").withColumn("change", F.lit("own"))
    got = snapshot_changes(df, "snap", "taken", ["path", "name"], F.col("hash"), "line")
    assert {tuple(x) for x in got.collect()} == brute_changes(rows)


def test_snapshot_changes_of_little(spark):
    one = spark.createDataFrame([(1, day(0), "p", "n", "h", 1)], "snap int, taken timestamp, path string, name string, hash string, line int")
    for df in (one, one.limit(0)):
        assert snapshot_changes(df, "snap", "taken", ["path", "name"], F.col("hash"), "line").count() == 0
    two = one.unionByName(spark.createDataFrame([(2, day(1), None, "n", None, None), (2, day(1), "p", "n", "h", 1)], one.schema))
    assert [tuple(x) for x in snapshot_changes(two, "snap", "taken", ["path", "name"], F.col("hash"), "line").collect()] == [(2, None, "n", "added")]
