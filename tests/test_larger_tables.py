"""Steps that have to keep their size and their number of tasks on larger tables."""

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packages_are_made_in_one_stream(spark):
    from graphloom.operators import packing

    rows = [(q, f"n{q}", 40, n, d, None, False, m, 10, "m", False, s) for q in range(50) for n, d, m, s in ((f"n{q}", 0.0, 1, ["a", "b"]), ("a", 1.0, 6, ["c"]), ("b", 1.0, 6, None), ("c", 2.0, 1, None))]
    schema = "query int, seed string, budget int, qname string, distance double, upstream double, preserving boolean, mask long, cost int, module string, verification boolean, successors array<string>"
    found = packing.select_submodular(spark.createDataFrame(rows, schema))
    assert "FlatMapGroupsInPandas" not in plan(found)
    got = {}
    for r in found.orderBy("query", "ord").collect():
        got.setdefault(r.query, []).append((r.qname, r.running_cost))
    assert got == {q: [(f"n{q}", 10), ("a", 20), ("b", 30), ("c", 40)] for q in range(50)}


def test_values_of_arrow_arrays(spark):
    import pyarrow as pa

    from graphloom.operators.groups import values_of

    for kind, values in ((pa.string(), ["a", None, "", "b"]), (pa.int64(), [1 << 60 | 1, None, 3, 4]), (pa.int32(), [1, 2, 3, 4]), (pa.float64(), [0.5, None, float("inf"), 1.0]), (pa.bool_(), [True, None, False, True]), (pa.list_(pa.string()), [["a", None], None, [], ["b"]]), (pa.date32(), [None] * 4)):
        whole = pa.array(values, kind)
        assert values_of(whole) == values and values_of(whole.slice(1, 3)) == values[1:] and values_of(whole.slice(1, 0)) == []


def test_first_fit_in_one_stream(spark):
    from graphloom.operators import packing

    rows = [(q, 10, k, f"i{k}", c) for q in (1, 2, None) for k, c in enumerate((4, 9, None, 6, 1))]
    found = packing.first_fit(spark.createDataFrame(rows, "query int, budget int, ord int, qname string, cost long"))
    assert "FlatMapGroupsInPandas" not in plan(found)
    got = sorted((r.query or 0, r.ord, r.admitted, r.running_cost) for r in found.collect())
    assert got == [(q, k, ok, n) for q in (0, 1, 2) for k, (ok, n) in enumerate(((True, 4), (False, 4), (False, 4), (True, 10), (False, 10)))]


def test_candidates_are_scored_by_class_and_dealt_to_tasks(spark, tmp_path, monkeypatch):
    import duckdb

    from graphloom.plans import all as plans
    from graphloom.plans import scalar_queries

    spark.createDataFrame([(0, "A", 0), (1, "B", 0), (2, "C", 1), (6, "D", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k, n) for k, n in zip((1, 2, 3, 4, 5, -6, None, 8), (0, 1, 2, 6, 1, 1, 6, 9), strict=True)], "s_suppkey int, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, k % 3) for k in range(-9, 30)] + [(None, 1), (31, None)], "c_custkey int, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for name in ("nation", "supplier", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    monkeypatch.setattr(scalar_queries, "tasks_for", lambda rows: 7)
    found = plans.QUERIES["score_candidate"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 7
    order = lambda rows: sorted(rows, key=str)
    assert order((r.s_suppkey, r.c_custkey, r.score) for r in found.collect()) == order((s, c, float(x)) for s, c, x in con.execute(plans.SQL["score_candidate"]).fetchall())


def test_chunks_are_dealt_to_tasks_with_equal_ones_together(spark, monkeypatch):
    from graphloom.operators import joins

    monkeypatch.setattr(joins, "tasks_for", lambda rows: 5)
    chunks = spark.range(40).select(F.col("id").alias("chunk"), F.lit("f").alias("file"), (F.col("id") % 10 * 30).alias("first"), (F.col("id") % 10 * 30 + 40).alias("last"))
    spans = spark.range(60).select(F.lit("f").alias("file"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + 70).alias("end"), F.col("id").alias("qname"))
    found = joins.overlapping(chunks, spans)
    assert found.rdd.getNumPartitions() == 5
    rows = [tuple(r) for r in found.collect()]
    assert sorted(rows) == sorted((c, s) for c in range(40) for s in range(60) if s * 5 <= c % 10 * 30 + 40 and s * 5 + 70 >= c % 10 * 30)
    monkeypatch.setattr(joins, "BROADCAST_LIMIT", 0)
    assert sorted(tuple(r) for r in joins.overlapping(chunks, spans).collect()) == sorted(rows)


def test_constants_are_chosen_in_one_stream(spark):
    from graphloom.operators import compress

    picked = spark.createDataFrame([(1, "a", 1, 5), (1, "b", 2, 5), (2, "a", 1, None), (2, "b", 2, None), (3, "c", 1, 9)], "query int, qname string, ord int, left int")
    references = spark.createDataFrame([("a", "k2", 3), ("a", "k1", 3), ("b", "k2", 3), ("b", "k3", 2), ("b", "a", 1)], "qname string, constant string, cost int")
    found = compress.bundle_constants(picked, references)
    assert "FlatMapGroupsInPandas" not in plan(found)
    assert sorted((r.query, r.qname, r.constants) for r in found.collect()) == [(1, "a", ["k1"]), (1, "b", ["k3"]), (2, "a", ["k1", "k2"]), (2, "b", ["k3"])]


def test_similar_names_are_found_where_they_lie(spark, monkeypatch):
    from graphloom.operators import joins

    names = spark.createDataFrame([("app.x_1.alpha1",), ("app.x_1.alpha1",), ("app.x_2.alpha2",), ("lib.other.zzzzzz9",)] + [(f"app.q_{i}.alphabet{i}",) for i in range(50)], "qname string")
    queries = spark.createDataFrame([("app.alpha1",), ("lib.alpha2",)], "query string")
    found = joins.similar_names(names, queries, top=2)
    rows, _ = found.orderBy("query", "rank").collect(), monkeypatch.setattr(joins, "sized", lambda df, *more: df)
    assert [(r.query, r.qname, r["rank"]) for r in rows] == [("app.alpha1", "app.x_1.alpha1", 1), ("app.alpha1", "app.x_1.alpha1", 2), ("lib.alpha2", "app.x_2.alpha2", 1), ("lib.alpha2", "app.x_1.alpha1", 2)]
    assert "SortMergeJoin" not in plan(found) and "BroadcastHashJoin" not in plan(found)
    assert joins.similar_names(names, queries, top=2).orderBy("query", "rank").collect() == rows


def test_reach_of_several_queries_has_one_row_a_node(spark, monkeypatch):
    from graphloom.operators import graph

    edges = spark.createDataFrame([(f"a{i}", "b") for i in range(5)] + [("b", "c"), ("c", "d"), ("d", "b")], "src string, dst string")
    sources = spark.createDataFrame([(f"q{i}", f"a{i}") for i in range(5)] + [("q9", "c")], "query string, node string")
    asked, real = [], graph.sized
    monkeypatch.setattr(graph, "sized", lambda df, rows, *more: (asked.append(rows), real(df, rows, *more))[1])
    got = {tuple(r) for r in graph.bfs(edges, sources).collect()}
    wanted = {(f"q{i}", n, h) for i in range(5) for n, h in ((f"a{i}", 0), ("b", 1), ("c", 2), ("d", 3))} | {("q9", "c", 0), ("q9", "d", 1), ("q9", "b", 2)}
    assert got == wanted and asked == [6, 2, 2, 1]  # 5 queries are at one node from hop 1 on
    near = {tuple(r) for r in graph.ego(edges, sources, 1).collect()}
    assert near == {(f"q{i}", f"a{i}", "b") for i in range(5)} | {("q9", "c", "d")}
    monkeypatch.setattr(graph, "TOGETHER", 0)
    assert {tuple(r) for r in graph.bfs(edges, sources).collect()} == wanted and {tuple(r) for r in graph.ego(edges, sources, 1).collect()} == near


def test_edges_in_buckets_are_not_shuffled_again(spark):
    from graphloom.storage import written_by

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = written_by(spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), "src", each=20)
        joined = kept.join(spark.range(50).select((F.col("id") % 10).alias("src")).distinct(), "src")
        assert joined.count() == 10
        assert "Bucketed: true" in plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
