import random

from lemmaworks.operators import closure as G
from lemmaworks.operators import hierarchy as H

SCHEMA = "paper_id string, stmt_id string, depends_on array<string>, id int"


def trees(spark, rows):
    return spark.createDataFrame([("p", s, d, 1) for s, d in rows], SCHEMA)


def brute_cycles(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    hit = set()
    for v in out:
        seen, todo = set(), list(out[v])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        if v in seen:
            hit.add(v)
    return hit


def cycles(spark, rows, **k):
    return {r["id"] for r in H.cycle_members(trees(spark, rows), **k).collect()}


def test_entries(spark):
    rows = [("a::1", [" b::9", None, "", "2 ", "a::2", "zz"]), ("a::2", None), ("a::1", ["2"]), (None, ["a::1"]), ("a::3", ["1"])]
    nodes, edges = H.resolve_entries(trees(spark, rows))
    assert {r["id"] for r in nodes.collect()} == {"a::1", "a::2", "a::3"}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("a::1", "a::2"), ("a::3", "a::1")}


def test_cycles_both_ways(spark):
    rnd = random.Random(3)
    for size, n in ((12, 20), (30, 34)):
        ids = [f"g{i % 3}::{i}" for i in range(size)]
        rows = [(i, [rnd.choice(ids) for _ in range(rnd.randint(0, 2))]) for i in ids] + [("h::1", ["h::2"]), ("h::2", ["1"]), ("h::3", ["h::3"]), ("h::4", ["h::1"])]
        full = {i for i, _ in rows}
        edges = [(i, e if e in full else i.split("::")[0] + "::" + e) for i, d in rows for e in d]
        want = brute_cycles(edges)
        assert cycles(spark, rows) == want
        assert cycles(spark, rows, limit=1) == want  # everything by joins


def test_paths_both_ways(spark):
    rows = [("a::1", []), ("a::2", ["1"]), ("a::3", ["a::2", "a::1"]), ("a::4", ["2"]), ("c::1", ["2"]), ("c::2", ["1"]), ("c::3", ["1"]), ("d::1", ["nothing"]), ("x", ["a::4"])]
    for limit in (50_000, 1):
        got = {r["id"]: r for r in H.hierarchy(trees(spark, rows), limit=limit).collect()}
        assert got["a::3"]["path"] == ["a::1", "a::2", "a::3"] and got["a::3"]["depth"] == 2 and got["a::3"]["root"] == "a::1"
        assert got["a::1"]["subtree_size"] == 5 and got["a::1"]["depth"] == 0 and got["x"]["path"][-2:] == ["a::4", "x"]
        assert {k: got[k]["status"] for k in ("c::1", "c::2", "c::3", "d::1")} == {"c::1": "cycle", "c::2": "cycle", "c::3": "below_cycle", "d::1": "tree"}
        assert got["c::3"]["path"] is None and got["c::1"]["subtree_size"] is None
    down = {(r["ancestor"], r["descendant"], r["distance"]) for r in H.descendants(H.hierarchy(trees(spark, rows))).collect()}
    assert ("a::1", "x", 3) in down and ("a::2", "a::4", 1) in down and len(down) == 4 + 3 + 1


def test_empty(spark):
    assert H.hierarchy(trees(spark, [])).collect() == [] and cycles(spark, []) == set()


def test_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b"), (None, "x")], "src string, dst string")
    got = {(r["start"], r["node"]): r["depth"] for r in G.closure(e).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("b", "c"): 1, ("b", "a"): 2, ("b", "d"): 2, ("c", "a"): 1, ("c", "d"): 1, ("c", "b"): 2}


def test_long_chain_in_batches(spark, monkeypatch):
    rows = [("a::0", [])] + [(f"a::{i}", [str(i - 1)]) for i in range(1, 1500)] + [("a::x", ["y"]), ("a::y", ["x"])]
    got = {r["id"]: r for r in H.hierarchy(trees(spark, rows)).collect()}
    assert len(got) == 1502 and got["a::1499"]["depth"] == 1499 and got["a::1499"]["path"][:2] == ["a::0", "a::1"] and got["a::0"]["subtree_size"] == 1500 and got["a::x"]["status"] == "cycle"
    ring = [(f"r::{i}", [str((i + 1) % 3000)]) for i in range(3000)]
    assert len(cycles(spark, ring)) == 3000


def test_limits_raise(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(H, "MAX_ROUNDS", 2)
    with pytest.raises(RuntimeError):
        H.hierarchy(trees(spark, [("a::0", [])] + [(f"a::{i}", [str(i - 1)]) for i in range(1, 6)]), limit=1).collect()
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "src string, dst string")
    with pytest.raises(RuntimeError):
        G.closure(e, max_depth=3)
    assert G.closure(e, max_depth=6).count() == 21
