import itertools
import random
from collections import deque

import pytest

from graphloom.operators import flow, graph


def edge_frame(spark, pairs, extra=None):
    return spark.createDataFrame([(*p, *(extra or ())) for p in pairs], "src string, dst string" + (", cost double" if extra else ""))


def random_graph(seed, n=14, m=30):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)})


def reach(pairs, start):
    seen, todo = {start: 0}, deque([start])
    while todo:
        a = todo.popleft()
        for x, b in pairs:
            if x == a and b not in seen:
                seen[b] = seen[a] + 1
                todo.append(b)
    return seen


@pytest.mark.parametrize("limit", [1000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed, limit):
    pairs = random_graph(seed)
    nodes = {x for p in pairs for x in p}
    far = {n: reach(pairs, n) for n in nodes}
    wanted = {n: min(m for m in nodes if m in far[n] and n in far[m]) for n in nodes}
    got = {r.node: r.scc for r in graph.strong_components(edge_frame(spark, pairs), limit).collect()}
    assert got == wanted


def test_components_and_metrics(spark):
    pairs = [("a", "b"), ("c", "b"), ("d", "e"), ("e", "f"), ("f", "g")]
    got = {r.node: r.component for r in graph.components(edge_frame(spark, pairs)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d", "g": "d"}
    nodes = spark.createDataFrame([(x,) for x in "abcdefgz"], "node string")
    row = graph.graph_metrics(edge_frame(spark, pairs), nodes).first()
    assert (row.nodes, row.isolated_ratio, row.largest, row.diameter) == (8, 0.125, 4, 3)


def brandes(pairs, nodes):
    total = dict.fromkeys(nodes, 0.0)
    out = {n: sorted({b for a, b in pairs if a == n and b != n}) for n in nodes}
    for s in nodes:
        order, before, paths, dist, todo = [], {n: [] for n in nodes}, dict.fromkeys(nodes, 0), {s: 0}, deque([s])
        paths[s] = 1
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        dep = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in before[w]:
                dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                total[w] += dep[w]
    n = len(nodes)
    return {v: round(x / ((n - 1) * (n - 2)), 6) for v, x in total.items()}


def test_betweenness(spark):
    pairs = random_graph(3)
    nodes = sorted({x for p in pairs for x in p})
    got = {r.node: r.choke for r in graph.betweenness(spark.createDataFrame([(n,) for n in nodes], "node string"), edge_frame(spark, pairs)).collect()}
    assert got == pytest.approx(brandes(pairs, nodes), abs=2e-6)


def test_distances_cutoff_directions(spark):
    edges = spark.createDataFrame([("s", "a", 1.0), ("a", "b", 1.0), ("s", "b", 3.0), ("b", "c", 4.0), ("z", "s", 1.0)], "src string, dst string, cost double")
    seeds = spark.createDataFrame([(0, "s"), (1, "nowhere")], "query int, node string")
    run = lambda cut, way: {(r.query, r.node): r.dist for r in graph.distances(edges, seeds, cut, way).collect()}
    assert run(6.0, "forward") == {(0, "a"): 1.0, (0, "b"): 2.0, (0, "c"): 6.0}
    assert run(5.9, "forward") == {(0, "a"): 1.0, (0, "b"): 2.0}
    assert run(2.0, "reverse") == {(0, "z"): 1.0}
    assert run(1.0, "both") == {(0, "a"): 1.0, (0, "z"): 1.0}


def test_blocked_bfs_and_confirmed(spark):
    edges = edge_frame(spark, [("s", "hub"), ("hub", "x"), ("s", "y"), ("y", "x2")])
    hub = spark.createDataFrame([("hub",)], "node string")
    seeds = spark.createDataFrame([(0, "s")], "query int, node string")
    assert {r.node for r in graph.bfs(edges, seeds, blocked=hub).collect()} == {"s", "hub", "y", "x2"}
    walks = spark.createDataFrame([("s", "a", 1.0, False), ("a", "b", 1.0, False), ("s", "b", 2.0, True)], "src string, dst string, cost double, confirmed boolean")
    assert {r.node: r.confirmed for r in graph.confirmed_reachable(walks, seeds).collect()} == {"a": False, "b": True}


@pytest.mark.parametrize("pairs,sinks,wanted", [
    ([("f", "x.s")], ["x.s"], {("f", "x.s"): 1.0}),
    ([("f", "x"), ("f", "y")], ["x", "y"], {("f", "x"): 0.5, ("f", "y"): 0.5}),
    ([("f", "g"), ("g", "x")], ["x"], {("f", "x"): 1.0, ("g", "x"): 1.0}),
    ([("f", "g"), ("f", "h"), ("g", "x"), ("h", "x")], ["x"], {("f", "x"): 1.0, ("g", "x"): 1.0, ("h", "x"): 1.0}),
    ([("f", "g"), ("g", "h"), ("h", "f"), ("h", "x")], ["x"], {("f", "x"): 1.0}),
    ([("f", "g"), ("g", "f")], [], {}),
])
def test_absorption(spark, pairs, sinks, wanted):
    edges = edge_frame(spark, pairs)
    inner = sorted({x for p in pairs for x in p} - set(sinks))
    internal = spark.createDataFrame([(n,) for n in inner], "node string")
    table = flow.transition_table(edges, internal, graph.strong_components(edges))
    assert {(r.node, r.sink): round(r.mass, 9) for r in flow.absorption(table).collect()} == wanted


def test_longest_path_and_cycle(spark):
    assert {r.node: r.depth for r in graph.longest_path(edge_frame(spark, [("a", "b"), ("b", "c"), ("a", "c")])).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        graph.longest_path(edge_frame(spark, [("a", "b"), ("b", "a")]))


def test_pagerank_sums_to_one(spark):
    pairs = [p for p in itertools.product("abc", "bcd") if p[0] != p[1]]
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    assert sum(r.rank for r in graph.pagerank(nodes, edge_frame(spark, pairs)).collect()) == pytest.approx(1.0)
