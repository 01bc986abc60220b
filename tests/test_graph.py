import random

import pytest

from docquarry.operators import graph

EDGES = "crate string, alias_path string, actual_path string, link_type string"


def edges_of(spark, pairs, link_type="reexport"):
    return spark.createDataFrame([("c", s, t, link_type) for s, t in pairs], EDGES)


def walks(pairs, depth):
    """Edges per depth by listing every walk."""
    pairs = set(pairs)
    out, states = {(s, t, 1) for s, t in pairs}, [(s, t, {s}) for s, t in pairs]
    for d in range(2, depth + 1):
        states = [(t, y, used | {t}) for _, t, used in states for x, y in pairs if x == t and y not in used]
        out |= {(s, t, d) for s, t, _ in states}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_dependency_graph_equals_enumeration(spark, seed):
    rng = random.Random(seed)
    nodes = [f"c::n{i}" for i in range(7)]
    pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(16)}
    depth = 3 + seed % 2
    items = spark.createDataFrame([(n,) for n in nodes], "item_path string")
    crates = spark.createDataFrame([("c", "1.0")], "crate string, version string")
    got = graph.dependency_graph(edges_of(spark, pairs, "dependency"), items, crates, "c", depth).collect()
    assert {(r["source"], r["target"], r["depth"]) for r in got} == walks(pairs, depth)
    assert {r["target_version"] for r in got} == {"1.0"}


def test_a_hub_keeps_few_ways_per_node():
    import pandas as pd

    ways = pd.DataFrame({"node": ["hub"] * 5000, "used": [[f"s{i}"] for i in range(5000)]})
    kept = pd.concat(graph._representatives(2)(iter([ways])))
    assert len(kept) == 3  # enough for any two further nodes


@pytest.mark.parametrize(
    "pairs, cyclic",
    [
        ([("a", "b"), ("b", "c")], False),
        ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], False),
        ([("a", "a")], True),
        ([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "y")], True),
    ],
)
def test_cycles(spark, pairs, cyclic):
    edges = spark.createDataFrame(pairs, "source string, target string")
    assert graph.has_cycles(edges).head()["has_cycles"] is cyclic


def test_trace(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(12)]
    pairs = [*chain, ("p", "q"), ("q", "p"), ("x", "y"), ("s", "s")]
    got = {r["alias_path"]: r for r in graph.trace_reexports(edges_of(spark, pairs)).collect()}
    assert got["x"]["original_source"] == "y" and list(got["x"]["chain"]) == ["c::x -> c::y"]
    assert got["p"]["original_source"] == "" and len(got["p"]["chain"]) == 2
    assert got["s"]["original_source"] == "" and len(got["s"]["chain"]) == 1
    assert got["n0"]["original_source"] == "" and len(got["n0"]["chain"]) == 10
    assert got["n3"]["original_source"] == "n12" and len(got["n3"]["chain"]) == 9


def test_tree_levels_and_root(spark):
    rows = [(1, "a", "a", None, 0, 2), (2, "b", "a::b", 1, 1, 3), (3, "c", "a::b::c", 2, 2, 0), (4, "z", "z", None, 0, 5)]
    modules = spark.createDataFrame(rows, "id bigint, name string, path string, parent_id bigint, depth int, item_count bigint")
    levels = {r["id"]: r["level"] for r in graph.module_tree(modules).collect()}
    assert levels == {1: 0, 2: 1, 3: 2, 4: 0}
    rooted = {r["id"]: (r["parent_id"], r["item_count"]) for r in graph.tree_with_root(modules, "k").collect()}
    assert rooted[-1] == (None, 7) and rooted[1][0] == -1 and rooted[2][0] == 1
    single = graph.tree_with_root(modules.where("id < 4"), "k").collect()
    assert {r["id"] for r in single} == {1, 2, 3}
    assert [r["path"] for r in graph.tree_with_root(modules.limit(0), "k").collect()] == ["k"]
