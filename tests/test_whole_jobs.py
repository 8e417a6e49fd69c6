"""Queries held against plain Python over whole tables, where their SQL says less."""

import heapq
import inspect

import pytest

from conftest import DATA
from graphloom.operators import contracts, graph, metrics
from graphloom.plans import all as plans
from graphloom.plans import views


def fk_pairs(spark):
    return [tuple(r) for r in views.fk_edges(lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")).collect()]


def test_callers_of_callers_lose_no_order(spark):
    fk = fk_pairs(spark)
    callers = {}
    for src, dst, relation in fk:
        if relation == "INSTANTIATES":
            callers.setdefault(dst, []).append(src)
    wanted = {(seed, direct, far) for direct, seed, _ in fk if seed.startswith("s:") for far in callers.get(direct, ())}
    got = [tuple(r) for r in plans.QUERIES["callers_of_callers"](spark, DATA).select("seed", "direct", "transitive").collect()]
    assert len(got) == len(wanted) and set(got) == wanted


def reached(pairs, start):
    """Hops of all nodes that start reaches."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    hops, now = {start: 0}, [start]
    while now:
        new = []
        for node in now:
            for b in out.get(node, ()):
                if b not in hops:
                    hops[b] = hops[node] + 1
                    new.append(b)
        now = new
    return hops


def test_bfs_ranking_walks_to_the_end(spark):
    pairs = [(a, b) for a, b, _ in fk_pairs(spark)]
    wanted = {}
    for query in sorted({a for a, _ in pairs if a.startswith("n:")}):
        down, up = reached(pairs, query), reached([(b, a) for a, b in pairs], query)
        scores = {node: 0.7 / (1 + h) ** 2 for node, h in up.items()} | {node: 1 / (1 + h) ** 2 for node, h in down.items()}
        order = sorted(scores, key=lambda node: (-scores[node], node))
        wanted |= {(query, node): (round(scores[node], 6), i + 1) for i, node in enumerate(order)}
    got = {(r.query, r.node): (r.score, r.rank) for r in plans.QUERIES["bfs_baseline_ranking"](spark, DATA).collect()}
    assert got == wanted and min(s for s, _ in got.values()) < 0.1
    chain = spark.createDataFrame([(f"x{i:02d}", f"x{i + 1:02d}") for i in range(12)], "src string, dst string")
    ranked = contracts.bfs_ranked(chain, spark.createDataFrame([("q", "x00")], "query string, node string"))
    assert [r.node for r in ranked.orderBy("rank").collect()] == [f"x{i:02d}" for i in range(13)]


def test_topological_distances_reach_orders_through_parts(spark):
    cost = {"EXTENDS": 1 / 0.85, "IMPLEMENTS": 1 / 0.8}
    back = {}
    for src, dst, relation in fk_pairs(spark):
        back.setdefault(dst, []).append((src, cost.get(relation, 1.0)))
    wanted = {}
    for seed in sorted(n for n in back if n.startswith("r:")):
        dist, todo = {}, [(0.0, seed)]
        while todo:
            d, node = heapq.heappop(todo)
            if node not in dist:
                dist[node] = d
                for src, c in back.get(node, ()):
                    if d + c <= 5.0:
                        heapq.heappush(todo, (d + c, src))
        wanted |= {(seed, node): round(d, 6) for node, d in dist.items() if node != seed}
    got = {(r.seed, r.node): r.dist for r in plans.QUERIES["topological_distances"](spark, DATA).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - d) < 2e-6 for k, d in wanted.items())
    assert max(got.values()) > 4.0


def test_mro_ancestors_to_depth_ten(spark, tmp_path):
    spark.range(2000).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    found = plans.QUERIES["mro_ancestors"](spark, str(tmp_path)).where("node < 12").collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.node, r["rank"])):
        got.setdefault(r.node, []).append(r.ancestor)

    def visit(path, order):
        for b in ((path[-1] * 7 + 3) % 2000, (path[-1] * 13 + 5) % 2000):
            if b not in path:
                order.append(b)
                if len(path) < 10:
                    visit([*path, b], order)
        return order

    assert got == {node: list(dict.fromkeys(visit([node], []))) for node in range(12)}


def power_ranks(nodes, pairs):
    """networkx's power iteration: until the changes sum to less than 1e-6 a node."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    n = len(nodes)
    rank = dict.fromkeys(nodes, 1 / n)
    while True:
        loose = sum(x for node, x in rank.items() if node not in out)
        new = dict.fromkeys(nodes, 0.15 / n + 0.85 * loose / n)
        for a, ends in out.items():
            for b in ends:
                new[b] += 0.85 * rank[a] / len(ends)
        if sum(abs(new[node] - rank[node]) for node in nodes) < n * 1e-6:
            return new
        rank = new


def test_pagerank_settles(spark):
    chain = [(f"x{i:02d}", f"x{i + 1:02d}") for i in range(40)] + [("x40", "x38"), ("x05", "x03")]
    nodes = sorted({x for p in chain for x in p})
    frame = spark.createDataFrame(chain, "src string, dst string")
    got = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame([(x,) for x in nodes], "node string"), frame).collect()}
    assert got == pytest.approx(power_ranks(nodes, chain), abs=1e-9)


def test_pagerank_query_settles(spark):
    pairs = [(r.src, r.dst) for r in views.transitions(lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")).collect()]
    got = {r.node: r["rank"] for r in plans.QUERIES["pagerank"](spark, DATA).collect()}
    assert got == pytest.approx(power_ranks({x for p in pairs for x in p}, pairs), abs=2e-8)


def test_bootstrap_draws_ten_thousand(spark, monkeypatch):
    calls, real = [], metrics.bootstrap_mean

    def noted(*given, **named):
        bound = inspect.signature(real).bind(*given, **named)
        bound.apply_defaults()
        calls.append(bound.arguments["resamples"])
        return real(*given, **named)

    monkeypatch.setattr(metrics, "bootstrap_mean", noted)
    frame = plans.QUERIES["bootstrap_ci"](spark, DATA)
    assert calls == [10_000] and frame.columns == ["event_type", "mean", "low", "high"]
