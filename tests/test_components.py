"""Components by contraction: what is left shrinks, names come back whole, numbers that clash are made anew."""

import random

from pyspark.sql import functions as F


def smallest(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def test_components_by_contraction(spark, monkeypatch):
    from graphloom.operators import graph

    rng = random.Random(5)
    path = [(f"p{i:04}", f"p{i + 1:04}") for i in range(600)]
    star = [("hub", f"leaf{i}") for i in range(300)]
    rest = [(f"x{rng.randrange(400)}", f"x{rng.randrange(400)}") for _ in range(330)] + [("self", "self"), ("a", "b"), ("b", "a"), ("a", "b")]
    pairs = path + star + rest
    edges = spark.createDataFrame(pairs + [(None, "a")], "src string, dst string").repartition(5)
    wanted = smallest(pairs)
    made, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: (made.append(real(df)), made[-1])[1])
    assert {r.node: r.component for r in graph.components(edges, component_edges=0).collect()} == wanted
    sizes = [df.count() for df in made if df.columns == ["a", "b"]]
    assert sizes[-1] == 0 and len(sizes) < 16 and all(y < 0.8 * x for x, y in zip(sizes, sizes[1:], strict=False))  # whole edges came again each round before
    assert {r.node: r.component for r in graph.components(edges).collect()} == wanted
    strong = {r.node: r.scc for r in graph.strong_components(edges.where("src IS NOT NULL"), component_edges=50).collect()}
    assert strong["a"] == strong["b"] == "a" and strong["self"] == "self" and strong["p0007"] == "p0007"


def test_numbers_that_clash_are_made_anew(spark, monkeypatch):
    from graphloom.operators import graph

    real = F.xxhash64
    monkeypatch.setattr(graph.F, "xxhash64", lambda c, seed: F.when(F.lit(seed._jc.toString() == "0"), F.lit(7).cast("long")).otherwise(real(c, seed)))
    edges = spark.createDataFrame([(1, 2), (3, 4), (4, 5)], "src long, dst long")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}


def test_transitions_are_shuffled_once(spark):
    from conftest import DATA

    from graphloom.plans import views

    found = views.transitions(lambda name: spark.read.parquet(f"{DATA}/{name}.parquet"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
