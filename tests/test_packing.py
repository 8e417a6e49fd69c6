import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import packing
from graphloom.operators.packing import Candidate, GreedyPacker


def pack(nodes, budget, **kw):
    return GreedyPacker({n: Candidate(*v) for n, v in nodes.items()}, "s", budget, **kw).run()


def test_density_and_ties():
    nodes = {"s": (0.0, 1, 10, "m", False, ["a", "b", "c"]), "a": (1.0, 2, 10, "m", False, []), "b": (1.0, 2, 10, "m", False, []), "c": (1.0, 2, 5, "m", False, [])}
    assert pack(nodes, 30) == ["s", "c", "a"]
    assert pack(nodes, 10) == ["s"]
    # a misfit is skipped, a later smaller one enters
    nodes["b"] = (1.0, 2, 2, "m", False, [])
    assert pack(nodes, 18) == ["s", "b", "c"]


def test_gates():
    nodes = {"s": (0.0, 0, 1, "a.b.c", False, ["t", "n"]), "t": (1.0, 0, 1, "a.b.c", True, []), "n": (1.0, 0, 1, "a.b.c", False, ["far"]), "far": (3.0, 0, 1, "z", False, [])}
    assert pack(nodes, 100) == ["s", "n"]
    assert pack(nodes, 100, scoped=False) == ["s", "n", "t", "far"]
    with pytest.raises(ValueError):
        pack(nodes, 10, beta=0.2)


def test_upstream_is_kept():
    nodes = {"s": (0.0, 0, 1, "m", False, ["a"]), "a": (1.0, 0, 5, "m", False, []), "u": (None, 0, 5, "m", False, ["s"])}
    assert set(pack(nodes, 20, upstream={"u": 0.8})) == {"s", "a", "u"}


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_budget_never_exceeded(data):
    names = [f"n{i}" for i in range(8)]
    nodes = {n: (data.draw(st.floats(0.5, 6)), data.draw(st.integers(0, 1 << 41)), data.draw(st.integers(1, 9)), "m", False, data.draw(st.lists(st.sampled_from(names), max_size=4))) for n in names}
    nodes["s"] = (0.0, 0, 3, "m", False, names[:4])
    budget = data.draw(st.integers(3, 40))
    picked = pack(nodes, budget)
    assert picked[0] == "s" and len(set(picked)) == len(picked) and sum(nodes[n][2] for n in picked) <= budget


def test_frames(spark):
    rows = [(q, "s", 20, n, d, None, False, 1 << i, c, "m", False, succ) for q in (1, 2) for i, (n, d, c, succ) in enumerate([("s", 0.0, 5, ["a", "b"]), ("a", 1.0, 5, []), ("b", 1.0, 50, [])])]
    df = spark.createDataFrame(rows, "query int, seed string, budget int, qname string, distance double, upstream double, preserving boolean, mask long, cost int, module string, verification boolean, successors array<string>")
    got = sorted((r.query, r.ord, r.qname, r.running_cost) for r in packing.select_submodular(df).collect())
    assert got == [(1, 0, "s", 5), (1, 1, "a", 10), (2, 0, "s", 5), (2, 1, "a", 10)]
    req = spark.createDataFrame([(1, 10, i, n, c) for i, (n, c) in enumerate([("a", 6), ("b", 5), ("c", 4)])], "query int, budget int, ord int, qname string, cost int")
    assert [(r.qname, r.admitted, r.running_cost) for r in packing.first_fit(req).orderBy("ord").collect()] == [("a", True, 6), ("b", False, 6), ("c", True, 10)]


def test_pack_by_distance(spark):
    rows = [(1, 20, "s", 0.0, True, 9, 5, 3, 1), (1, 20, "a", 0.1, False, 9, 8, 3, 1), (1, 20, "b", 0.6, False, 9, 8, 3, 2), (1, 20, "c", 0.9, False, 9, 9, 9, 9)]
    df = spark.createDataFrame(rows, "query int, budget int, qname string, distance double, protected boolean, c0 int, c1 int, c2 int, c3 int")
    got = {r.qname: (r.resolution, r.cost) for r in packing.pack_by_distance(df).collect()}
    assert got == {"s": (0, 9), "a": (1, 8), "b": (3, 2)}
    levels = df.select(packing.degrade_to_fit(F.lit(4), F.col("c0"), F.col("c1"), F.col("c2"), F.col("c3")).alias("k"))
    assert [r.k for r in levels.collect()] == [2, 2, 2, 3]
