"""Cycles and strong components against plain searches, and the rounds that long chains take."""

import random

import pytest

from docquarry.operators import cycles


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def components_of(pairs):
    """Mutual reachability by plain search."""
    ways = {}
    for s, t in pairs:
        if s is not None and t is not None:
            ways.setdefault(s, set()).add(t)
    reach = {}
    for node in {n for p in pairs for n in p if n is not None}:
        seen, todo = set(), [node]
        while todo:
            for t in ways.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach[node] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in reach if n in reach[n]}


def core_of(pairs):
    left = {p for p in pairs if None not in p}
    while True:
        kept = {(s, t) for s, t in left if any(y == s for _, y in left) and any(x == t for x, _ in left)}
        if kept == left:
            return left
        left = kept


@pytest.mark.parametrize("seed", [1])
def test_equals_plain_search(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range([12, 24][seed])]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(int(len(nodes) * [1.2, 1.0][seed]))]
    ring = rng.sample(nodes, 4)
    # some edges become chains, some lead through chains back to where they began
    for i, (s, t) in enumerate(list(pairs[:5])):
        inner = [f"c{seed}_{i}_{k}" for k in range(rng.randint(1, 5))]
        pairs += list(zip([s, *inner], [*inner, rng.choice([s, t])]))
    pairs += list(zip(ring, ring[1:] + ring[:1])) if seed % 2 else []
    pairs += [(f"r{k}", f"r{(k + 1) % 3}") for k in range(3)] + [(None, "n1"), ("n1", None), pairs[0]]
    edges = edges_of(spark, pairs)
    want = components_of(pairs)
    assert {r.node: r.component for r in cycles.strong_components(edges).collect()} == want
    assert {(r.source, r.target) for r in cycles.cyclic_core(edges).collect()} == core_of(set(pairs))
    assert cycles.has_cycles(edges).first().has_cycles == bool(want)


@pytest.mark.parametrize("pairs", [[], [("a", "a"), ("b", "c")], [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "a")]])
def test_small_graphs(spark, pairs):
    edges = edges_of(spark, pairs)
    assert {r.node: r.component for r in cycles.strong_components(edges).collect()} == components_of(pairs)
    assert {(r.source, r.target) for r in cycles.cyclic_core(edges).collect()} == core_of(set(pairs))
    assert cycles.has_cycles(edges).first().has_cycles == bool(components_of(pairs))


def test_a_long_chain_takes_few_rounds(spark):
    n, rounds = 100_000, []
    chain = spark.range(n).selectExpr("cast(id as string) as source", "cast(id + 1 as string) as target")
    assert cycles.has_cycles(chain, lambda kind, _: rounds.append(kind)).first().has_cycles is False
    assert len(rounds) < 25
    rounds.clear()
    closed = chain.where("cast(target as int) <= 2000").union(edges_of(spark, [("2000", "0"), ("x", "0"), ("5", "y")]))
    found = cycles.strong_components(closed, lambda kind, _: rounds.append(kind))
    assert len(rounds) < 25
    assert found.count() == 2001 and found.select("component").distinct().count() == 1
