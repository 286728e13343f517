"""Strong components and shortest cycles against plain searches; chains and long rings in few rounds."""

import random

import pytest

from loam.operators import graph as G


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for a in out:
        todo, seen = list(out[a]), set(out[a])
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        found[a] = seen
    return out, found


def brute(edges):
    out, found = reach(edges)
    scc = {a: min(b for b in found[a] if a in found.get(b, ())) for a in found if a in found[a]}
    cycles = {}
    for root in set(scc.values()):
        members = {a for a, r in scc.items() if r == root}
        first = min(b for b in out[root] if b in members)
        layer, seen = {first: [root, first]}, {first}
        while root not in layer:
            step = {}
            for node, path in layer.items():
                for b in out[node]:
                    if b in members and b not in seen:
                        step[b] = min(step.get(b, path + [b]), path + [b])
            seen |= set(step)
            layer = step
        cycles[root] = layer[root]
    return scc, cycles


def checked(spark, edges):
    table = spark.createDataFrame(edges or [("x", "y")], "source string, target string").repartition(3)
    if not edges:
        table = table.where("false")
    components = G.strong_components(table)
    found = {r["node"]: r["scc"] for r in components.collect()}
    cycles = {r["scc"]: list(r["cycle"]) for r in G.representative_cycles(table, components).collect()}
    return found, cycles


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = rnd.choice([6, 12, 25])
    edges = [(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(int(n * rnd.choice([0.8, 1.2, 1.8])))]
    if seed == 0:
        edges = [(a, b) for a, b in edges if a < b] + [("n00", "n00")]
    assert checked(spark, edges) == brute(edges)


def test_shapes(spark):
    """A chain into a ring with a tail, a ring through a hub, a comb, a figure of eight, two ways of one length, a loop, and nothing."""
    names = [f"c{i:03}" for i in range(40)]
    chain = list(zip(names, names[1:]))
    ring = [(f"r{i:02}", f"r{(i + 1) % 17:02}") for i in range(17)]
    comb = [(f"t{i:02}", f"t{i + 1:02}") for i in range(20)] + [(f"t{i:02}", f"leaf{i:02}") for i in range(20)]
    eight = [("e0", "e1"), ("e1", "e2"), ("e2", "e0"), ("e2", "e3"), ("e3", "e4"), ("e4", "e2")]
    ways = [("w0", "w1"), ("w1", "w3"), ("w1", "w2"), ("w2", "w4"), ("w3", "w4"), ("w4", "w0"), ("w1", "w5"), ("w5", "w6"), ("w6", "w0")]
    edges = chain + ring + [(names[-1], "r00"), ("r03", "tail1"), ("tail1", "tail2")] + comb + eight + ways + [("s", "s"), ("s", "t00")]
    assert checked(spark, edges) == brute(edges)
    assert checked(spark, []) == ({}, {})


def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch):
    """20,000 nodes in a chain and 3,000 in a ring: rounds go with the logarithm."""
    rounds = []
    real = G.written
    monkeypatch.setattr(G, "written", lambda df, name="step": rounds.append(name) or real(df, name))
    chain = spark.range(20_000).selectExpr("concat('c', lpad(hash(id), 11, '0'), id) AS source", "concat('c', lpad(hash(id + 1), 11, '0'), id + 1) AS target")
    ring = spark.range(3000).selectExpr("concat('r', lpad(id, 5, '0')) AS source", "concat('r', lpad((id + 1) % 3000, 5, '0')) AS target")
    edges = chain.union(ring)
    components = G.strong_components(edges)
    assert components.count() == 3000 and components.select("scc").distinct().collect()[0][0] == "r00000"
    assert len(rounds) < 40
    cycle = G.representative_cycles(edges, components).first()["cycle"]
    assert list(cycle) == [f"r{i:05}" for i in range(3000)] + ["r00000"] and len(rounds) < 100
