"""Steps that must not grow with the square of a group, counted in rows of the executed plan."""

from pyspark.sql import functions as F

from graphloom.operators import joins


def most_rows(df):
    """Rows collected, and the most rows that any step of the plan made."""
    df = df.select("*")
    rows = df.collect()
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        else:
            plans.extend(p.children().apply(i) for i in range(p.children().size()))
            n = p.metrics().get("numOutputRows")
            most = max(most, n.get().value() if n.isDefined() else 0)
    return rows, most


def test_ambiguous_calls_meet_one_row_a_key(spark):
    calls = spark.range(400).select(F.col("id").alias("call"), (F.col("id") % 2).alias("k"))
    candidates = spark.range(400).select((F.col("id") % 2).alias("k"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("qname"), (F.floor(F.col("id") / 4) / 100).alias("score"), F.lit(True).alias("same_package"))
    rows, most = most_rows(joins.ambiguous_calls(calls, candidates, "k"))
    assert {(r.call % 2, r.target, r.kind) for r in rows} == {(0, "q396", "CALLS"), (1, "q397", "CALLS")} and len(rows) == 400
    assert most <= 400


def _crowded(spark, probe):
    """600 probes of one line, and 300 spans around it, equal ones among them."""
    probes = spark.range(600).select(probe.alias("probe"), F.lit("f").alias("file"), F.lit(50).alias("line"))
    return probes, spark.range(300).select(F.lit("f").alias("file"), (F.col("id") % 3).alias("start"), F.lit(90).alias("end"), F.col("id").alias("qname"))


def test_nearest_spans_are_found_once_a_line(spark):
    probes, spans = _crowded(spark, F.col("id"))
    rows, most = most_rows(joins.nearest_span(probes, spans))
    assert len(rows) == 600 and {r.qname for r in rows} == {None} and most <= 1200
    one = spans.unionByName(spark.createDataFrame([("f", 10, 60, 7)], spans.schema))
    assert {r.qname for r in joins.nearest_span(probes, one).collect()} == {7}


def test_a_probe_of_two_lines_has_one_answer(spark):
    probes = spark.createDataFrame([(1, "f", 10), (1, "f", 12), (2, "f", 10), (2, "g", 10), (3, "f", 99)], "probe long, file string, line int")
    spans = spark.createDataFrame([("f", 8, 20, 5), ("g", 3, 15, 6)], "file string, start int, end int, qname long")
    assert {(r.probe, r.qname) for r in joins.nearest_by_probe(probes, spans).collect()} == {(1, 5), (2, None)}
    assert {(r.probe, r.qname) for r in joins.locate(probes, spans).collect()} == {(1, 5), (2, 5), (3, None)}


def test_spans_are_located_once_a_line(spark):
    probes, spans = _crowded(spark, F.col("id"))
    rows, most = most_rows(joins.locate(probes, spans))
    assert len(rows) == 600 and {r.qname for r in rows} == {2} and most <= 1200
    rows = joins.locate(probes, spans, rank=F.col("end") - F.col("start") + 2 * F.col("qname")).collect()
    assert {r.qname for r in rows} == {0}


def test_contract_of_large_keys_is_that_of_the_sql(spark, tmp_path):
    import duckdb

    from graphloom.plans import all as plans

    lineitem = [(1_500_000, 1, 1), (30, 1, 2), (2_000_001, 2, 3), (7, 2, 4), (8, 2, 6)]
    spark.createDataFrame(lineitem, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "F" if k == 8 else "O") for k, _, _ in lineitem], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {tuple(r) for r in plans.QUERIES["derive_contract"](spark, str(tmp_path)).select("callee", "caller", "line").collect()}
    assert got == set(con.sql(plans.SQL["derive_contract"]).fetchall()) == {(1, 30, 1), (2, 7, 3)}


def test_windows_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from graphloom.plans import all as plans

    texts = [None, "", " \n", "a b", "a\x0bb\x1cc\xa0d e\ff", "x " * 512, " ".join("y" * 513), "z\n" * 960 + "z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in plans.QUERIES["chunk_windows"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(plans.SQL["chunk_windows"]).fetchall()) and (1, 0, 0) in got


def test_masses_walk_back_by_effect(spark):
    from graphloom.operators import flow

    pairs = [(f"o{i}", f"p{j}", False, 0.1) for i in range(10) for j in range(10)] + [(f"p{j}", f"s:{k}", True, 1 / 60) for j in range(10) for k in range(60)]
    table = spark.createDataFrame(pairs, "src string, dst string, absorbed boolean, p double")
    effect = F.element_at(F.array(*(F.lit(d) for d in flow.DIMENSIONS)), (F.substring("sink", 3, 20).cast("int") % 6 + 1))
    rows, most = most_rows(flow.absorption_by_effect(table, effect))
    wanted = {r.node: tuple(r)[1:] for r in flow.absorption(table).groupBy("node").agg(*flow.effect_sums(effect, F.col("mass"))).collect()}
    assert len(rows) == 20 and most <= 40
    assert all(abs(x - y) < 1e-9 for r in rows for x, y in zip(tuple(r)[1:], wanted[r.node], strict=True))


def test_bootstrap_draws_once_for_equal_rows(spark):
    from graphloom.operators import metrics

    rows = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") > 9, (F.col("id") % 20).cast("double")).alias("v"))
    found, most = most_rows(metrics.bootstrap_mean(rows, ["k"], "v", 500))
    assert most <= 40_000  # 500 draws of 20 values, where each row had 500
    width = {r.k: r.high - r.low for r in found}
    assert len(found) == 2 and all(0.7 < w / (2 * 1.96 * 5.74 / 10_000**0.5) < 1.3 for w in width.values()) and all(r.low < r.mean < r.high for r in found)
    again = metrics.bootstrap_mean(rows.repartition(7), ["k"], "v", 500).collect()
    assert {r.k: round(r.low, 9) for r in again} == {r.k: round(r.low, 9) for r in found}


def test_state_reads_take_each_pair_once(spark):
    reads = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (1, "c", "z")], "reader int, class string, name string")
    held = spark.createDataFrame([("a", "x", 7), ("a", "y", 7), ("a", "x", 8), ("b", "x", 9), ("b", "x", 9), ("d", "x", 9)], "class string, name string, qname int")
    found = joins.state_reads(reads, held)
    assert sorted((r.src, r.dst) for r in found.collect()) == [(1, 7), (1, 8), (2, 7), (3, 9)]
    text = joins.state_reads(reads, held)._jdf.queryExecution().optimizedPlan().toString()
    assert not text.lstrip().startswith(("Aggregate", "Distinct", "Deduplicate"))


def test_classes_of_the_same_bases_are_walked_from_once(spark, monkeypatch):
    from graphloom.operators import graph

    kept, real = [], graph.written

    def noted(df):
        out = real(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", noted)
    pairs = [(i, 1000 + j, j) for i in range(100) for j in range(2)] + [(1000, 2000, 0), (2000, 1000, 0), (1001, 2000, 0), (500, 1001, 0), (500, 1000, 1)]
    found = {}
    for r in graph.ancestors(spark.createDataFrame(pairs, "src int, dst int, k int"), F.col("k")).orderBy("node", "rank").collect():
        found.setdefault(r.node, []).append(r.ancestor)
    assert found == {i: [1000, 2000, 1001] for i in range(100)} | {500: [1001, 2000, 1000], 1000: [2000], 2000: [1000], 1001: [2000, 1000]}
    assert max(kept[2:]) <= 20


def test_bfs_sends_a_short_frontier(spark, monkeypatch):
    from graphloom.operators import graph

    asked, real = [], graph.sized
    monkeypatch.setattr(graph, "sized", lambda df, rows, *more: (asked.append(rows), real(df, rows, *more))[1])
    chain = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = {tuple(r) for r in graph.bfs(chain, spark.createDataFrame([("q", "a")], "query string, node string")).collect()}
    assert got == {("q", "a", 0), ("q", "b", 1), ("q", "c", 2)} and asked == [1, 1, 1]


def test_callers_of_callers_are_not_shuffled_as_triples(spark):
    from graphloom.operators import linking

    edges = spark.createDataFrame([("p", "s"), ("p", "s"), ("o", "p"), ("o", "p"), ("u", "p"), ("p", "t"), ("x", "y")], "src string, dst string")
    found = linking.transitive_callers(edges, spark.createDataFrame([("s",), ("s",), ("t",)], "id string"))
    assert sorted(tuple(r) for r in found.collect()) == [("s", "p", "o"), ("s", "p", "u"), ("t", "p", "o"), ("t", "p", "u")]
    assert not found._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Aggregate")
