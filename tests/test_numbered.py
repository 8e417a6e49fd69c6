"""Nodes as numbers give what names give, and joins on nodes carry numbers."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F


@pytest.fixture
def t(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


def test_numbers_have_names(t):
    from graphloom.plans import views

    names = lambda df, cols, of: sorted(tuple(r) for r in df.select(*(of(F.col(c)).alias(c) for c in cols)).collect())
    same = lambda c: c
    for view, cols in ((views.fk_edges, ("src", "dst")), (views.symbols, ("qname",)), (views.trace_events, ("caller", "callee"))):
        assert names(view(t, views.number), cols, views.named) == names(view(t), cols, same)


@pytest.mark.parametrize("query", ("subsystem_profile", "role_bits", "ingress_by_category", "reconcile_events", "runtime_trust"))
def test_joins_on_nodes_carry_numbers(spark, query):
    from graphloom.plans import all as plans

    text = plans.QUERIES[query](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(o:" not in text  # names of orders were made before every join


def test_leaves_are_looked_up_by_name(spark):
    from graphloom.operators import traces

    named = lambda node: F.concat(F.lit("a.f"), node.cast("string"))
    events = spark.createDataFrame([(1, 2, "tracer"), (1, 9, "otel"), (7, 2, "tracer"), (2, 1, "otel")], "caller long, callee long, source string")
    symbols, edges = spark.createDataFrame([(1,), (2,)], "qname long"), spark.createDataFrame([(1, 2), (1, 2)], "src long, dst long")
    got = {(r.caller, r.callee): (r.route, r.orphan_reason) for r in traces.route_events(events, symbols, edges, named).collect()}
    assert got == {(1, 2): ("confirmed", None), (1, 9): ("orphan_callee", "NATIVE_OR_C_EXTENSION"), (7, 2): ("unresolved", "AMBIGUOUS_SIGNATURE"), (2, 1): ("discovered", None)}
