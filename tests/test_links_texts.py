"""Walks to the end, scanners of other languages, compressed texts, package budgets and reports on small cases."""

import ast

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import compress, contracts, flow, graph, linking, metrics, profiles, reports, tagging
from graphloom.plans import all as plans
from graphloom.sources import files, other_languages

CHAIN = [(f"x{i:03d}", f"x{i + 1:03d}") for i in range(130)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_walks_have_no_cap(spark):
    edges = spark.createDataFrame([(*p, 1.0, p[0] == "x100") for p in CHAIN], "src string, dst string, cost double, confirmed boolean")
    start = spark.createDataFrame([("q", "x000")], "query string, node string")
    assert graph.bfs(edges, start).agg(F.count("*"), F.max("hops")).first() == (131, 130)
    assert graph.bfs(edges, start, max_hops=7).agg(F.max("hops")).first()[0] == 7
    far = graph.distances(edges, start, 1000.0)
    assert far.agg(F.count("*"), F.max("dist")).first() == (130, 130.0)
    short = edges.where("src BETWEEN 'x095' AND 'x106'")
    reached = {r.node: r.confirmed for r in graph.confirmed_reachable(short, spark.createDataFrame([("q", "x095")], "query string, node string")).collect()}
    assert len(reached) == 12 and not reached["x100"] and reached["x101"]
    assert graph.longest_path(short).agg(F.max("depth")).first()[0] == 12
    deep = flow.relative_depth(short, short.select(F.col("src").alias("node")), spark.createDataFrame([("x107",)], "node string"))
    assert {r.node: r.depth for r in deep.collect()}["x101"] == 0.5


def test_walks_on_odd_graphs(spark):
    start = spark.createDataFrame([("q", "a"), ("q", "a"), ("p", "z")], "query string, node string")
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "b"), ("a", "b")], "src string, dst string")
    assert sorted(tuple(r) for r in graph.bfs(loop, start).collect()) == [("p", "z", 0), ("q", "a", 0), ("q", "b", 1)]
    assert sorted(tuple(r) for r in graph.bfs(loop, start, "both", blocked=spark.createDataFrame([("b",)], "node string")).collect()) == [("p", "z", 0), ("q", "a", 0), ("q", "b", 1)]
    nothing = loop.where("false")
    assert graph.bfs(nothing, start).count() == 2 and graph.bfs(loop, start.where("false")).count() == 0
    with pytest.raises(ValueError):
        graph.longest_path(loop)
    with pytest.raises(ValueError):
        graph.distances(loop.withColumn("cost", F.lit(-1.0)), start, 5.0)
    assert sorted(tuple(r) for r in graph.ego(loop, start.where("query = 'q'"), 1).collect()) == [("q", "a", "b"), ("q", "b", "a"), ("q", "b", "b")]


def test_ancestors_keep_the_first_way(spark):
    # a diamond on a diamond, and a cycle
    pairs = [("d", "b", 1), ("d", "c", 2), ("b", "a", 1), ("c", "a", 1), ("a", "y", 1), ("a", "x", 2), ("x", "w", 1), ("y", "w", 1), ("w", "d", 1)]
    got = {}
    for r in graph.ancestors(spark.createDataFrame(pairs, "src string, dst string, k int"), F.col("k")).orderBy("node", "rank").collect():
        got.setdefault(r.node, []).append(r.ancestor)
    bases = {}
    for s, d, _ in pairs:
        bases.setdefault(s, []).append(d)

    def visit(path, order):
        for b in bases.get(path[-1], ()):
            if b not in path:
                order.append(b)
                visit([*path, b], order)
        return order

    assert got == {n: list(dict.fromkeys(visit([n], []))) for n in bases}


def test_prune_limits(spark):
    ids = spark.createDataFrame([(f"n{i}",) for i in range(9)], "id string")
    edges = spark.createDataFrame([("n0", f"n{i}") for i in range(1, 8)], "src string, dst string")
    anchors = ids.where("id = 'n0'")
    got = {r.id: r.status for r in contracts.prune_candidates(ids, anchors, edges, max_nodes=3).collect()}
    assert [k for k, v in sorted(got.items()) if v == "kept"] == ["n0", "n1", "n2"] and got["n8"] == "island" and got["n7"] == "over_limit"
    free = {r.id: r.status for r in contracts.prune_candidates(ids, anchors, edges, max_depth=None, max_nodes=None).collect()}
    assert sum(v == "kept" for v in free.values()) == 8


def test_scanners_on_odd_sources(spark):
    for scan in (other_languages.js_imports, other_languages.js_reexports, other_languages.go_imports, other_languages.java_imports, other_languages.csharp_imports, other_languages.ts_heritage, other_languages.go_embeds):
        assert one(spark, F.size(scan(F.lit("")))) == 0 and one(spark, F.size(scan(F.lit("x" * 10_000 + "\n{[(")))) == 0 and one(spark, scan(F.lit(None).cast("string"))) is None
    assert one(spark, F.size(other_languages.imports(F.lit("cobol"), F.lit("import a from 'b'")))) == 0
    kept = one(spark, other_languages.js_imports(F.lit("import type { A, type B as C } from 'https://x/y';\nimport D from \"d\"\nimport E, * as f from 'e'")))
    assert [(b.local, b.specifier, b.member) for b in kept] == [("A", "https://x/y", "A"), ("C", "https://x/y", "B"), ("D", "d", "default"), ("E", "e", "default"), ("f", "e", "")]
    assert one(spark, other_languages.joined_path(F.lit("a/b"), F.lit("../../../c/./d"))) == "c/d"
    nothing = spark.createDataFrame([], "path string, language string, source string")
    assert other_languages.definitions(nothing).count() == 0


def test_specifiers_prefer_the_first_ending(spark):
    bindings = spark.createDataFrame([("a/f.js", "./x"), ("a/f.js", "./y"), ("a/f.js", "./gone"), ("f.js", "./a/x.js"), ("f.js", "pkg")], "path string, specifier string")
    found = spark.createDataFrame([("a/x.js",), ("a/x.ts",), ("a/y/index.tsx",)], "path string")
    got = {(r.path, r.specifier): r.module for r in other_languages.resolve_specifiers(bindings, found).collect()}
    assert got == {("a/f.js", "./x"): "a.x", ("a/f.js", "./y"): "a.y", ("a/f.js", "./gone"): "a.gone", ("f.js", "./a/x.js"): "a.x", ("f.js", "pkg"): "pkg"}


def test_promoted_methods_shadow(spark):
    embeds = spark.createDataFrame([("T", "A"), ("T", "B"), ("A", "D"), ("B", "D"), ("U", "A"), ("V", "V")], "src string, dst string")
    methods = spark.createDataFrame([("A", "M", "A.M"), ("D", "M", "D.M"), ("A", "N", "A.N"), ("B", "N", "B.N"), ("D", "P", "D.P")], "struct string, method string, qname string")
    asked = spark.createDataFrame([(s, m) for s in ("T", "U", "V") for m in "MNP"] + [("T", "M")], "struct string, method string")
    got = {(r.struct, r.method): (r.target, r.ambiguous) for r in linking.promoted_methods(asked, embeds, methods).collect()}
    assert got == {("T", "M"): ("A.M", False), ("T", "N"): (None, True), ("T", "P"): ("D.P", False), ("U", "M"): ("A.M", False), ("U", "N"): ("A.N", False), ("U", "P"): ("D.P", False), **{("V", m): (None, False) for m in "MNP"}}


def test_type_names_need_one_owner(spark):
    types = spark.createDataFrame([("m", "A", "m.A"), ("n", "A", "n.A"), ("n", "B", "n.B")], "module string, name string, qname string")
    asked = spark.createDataFrame([("m", "A"), ("m", "B"), ("k", "A"), ("k", "C")], "module string, name string")
    assert {(r.module, r.name): r.qname for r in linking.type_names(asked, types).collect()} == {("m", "A"): "m.A", ("m", "B"): "n.B"}


SOURCE = '''
class K(Base, other.Mixin):
    """Doc."""
    async def run(self, a, *, b: int = 2) -> bool:
        """Doc."""
        self.x = 1
        self.y = make(a, b)
        for i in range(3):
            print(i)
        try:
            with open(a) as f:
                f.read(10)
        except (KeyError, OSError) as e:
            raise Wrong("x") from e
        finally:
            done()
        match a:
            case 1:
                go(a)
            case _:
                pass
        def inner(z):
            return z + 1
        while a:
            a -= 1
        return check(a)
'''


def test_python_levels():
    tree = ast.parse(SOURCE)
    run = tree.body[0].body[1]
    whole, l1, l2, l3 = compress.python_levels(run, "text", ["#state_mutation", "#a"], ["make", "go"])
    assert whole == "text" and l3 == "async def run(self, a, *, b: int=2) -> bool: ..."
    assert "make(a, b)" in l1 and "print" not in l1 and "Doc" not in l1 and "self.x" not in l1 and "def inner(z):\n        return z + 1" in l1 and "a -= 1" in l1
    assert "make(...)" in l2 and "raise Wrong(...) from e" in l2 and "go(...)" in l2 and "for i in range(3):\n        pass" in l2
    assert l2.endswith("# Tags: [#a, #state_mutation]\n# Mutates: self.x, self.y\n# Raises: Wrong\n# Calls: make, go")
    ast.parse(l1.replace("async def run", "async def run")), ast.parse(l2)
    assert compress.python_levels(tree.body[0], "t", [], ["c"], compact=True) == ("t", "class K(Base, other.Mixin): ...\n# tags=[] calls=[c]", "class K(Base, other.Mixin): ...\n# tags=[] calls=[c]", "class K(Base, other.Mixin): ...")
    deep = ast.parse("def f():\n    return " + "not " * 400 + "x").body[0]
    assert compress.python_levels(deep, "t", [], [])[:3] == ("t", "t", "t")


def test_compress_odd_sources(spark):
    sources = spark.createDataFrame([("a.py", "python", "def broken(:\n    x"), ("b.py", "python", None), ("c.py", "python", "def f(): pass"), ("d.js", "javascript", "\n\n"), ("e.py", "python", "x = 1")], "path string, language string, source string")
    found = spark.createDataFrame([("a", "a.py", "broken", 1, 2), ("b", "b.py", "f", 1, 1), ("c", "c.py", "g", 1, 1), ("d", "d.js", "f", 1, 2), ("z", "none.py", "f", 1, 1)], "qname string, path string, name string, start int, end int")
    found = found.withColumns({"tags": F.lit(None).cast("array<string>"), "calls": F.array().cast("array<string>")})
    got = {r.qname: (r.l0, r.l1, r.l2, r.l3) for r in compress.compress(sources, found).collect()}
    assert got == {"a": ("def broken(:\n    x",) * 4, "b": ("",) * 4, "c": ("def f(): pass",) * 4, "d": ("\n",) * 4}
    assert compress.compress(sources.where("false"), found).count() == 0 and compress.compress(sources, found.where("false")).count() == 0


def test_constants_within_the_budget(spark):
    picked = spark.createDataFrame([(1, "f", 0, 10), (1, "g", 1, 10), (1, "A", 2, 10), (2, "f", 0, None)], "query int, qname string, ord int, left int")
    references = spark.createDataFrame([("f", "A", 1), ("f", "B", 8), ("f", "C", 5), ("g", "B", 8), ("g", "D", 2)], "qname string, constant string, cost int")
    got = {(r["query"], r.qname): r.constants for r in compress.bundle_constants(picked, references).collect()}
    # A is picked itself; C doesn't fit after B; D fits what is left; without a limit all come
    assert got == {(1, "f"): ["B"], (1, "g"): ["D"], (2, "f"): ["A", "B", "C"]}


def test_budget_stubs_the_farthest(spark):
    rows = [(1, "seed", "seed", 0.0, 100, 60, 5), (1, "a", "callee", 1.0, 100, 40, 5), (1, "b", "transitive", 2.0, 100, 20, 5), (1, "c", "transitive", 3.0, 100, 30, 5), (1, "d", "transitive", 3.0, 100, 4, 5), (2, "seed", "seed", 0.0, 100, 105, 5), (3, "seed", "seed", 0.0, 10, 200, 5)]
    df = spark.createDataFrame(rows, "query int, id string, role string, distance double, budget int, full_cost int, stub_cost int")
    assert {(r["query"], r.id) for r in compress.enforce_budget(df).where("stub").collect()} == {(1, "c"), (1, "b")}


def test_registry_and_tags_are_whole(spark):
    registry = tagging.default_registry(spark)
    assert registry.groupBy("language", "entry", "category").count().where("count > 1").count() == 0 and registry.select("category").distinct().count() == 6
    calls = spark.createDataFrame([("f", "python", "requests", None), ("g", "python", "requestsx.get", None), ("h", "python", "c.get", "http.client.HTTPConnection"), ("i", "go", "requests.get", None)], "caller string, language string, chain string, target string")
    assert {r.caller: r["mask"] for r in tagging.sink_bits(calls, registry).collect()} == {"f": 1, "h": 1}


def test_reports(spark, tmp_path):
    cells = spark.createDataFrame([("t1", "own", 1, 0.2, 1.0), ("t1", "bfs", 1, 0.5, None), ("t1", "oracle", 1, 0.9, None), ("t2", "own", 1, 0.9, 3.0), ("t2", "bfs", 1, 0.1, None)], "task string, engine string, budget int, tsr double, fpr double")
    assert [(r.task, r.below, r.under_oracle) for r in reports.failures(cells, "own", ["bfs"], "oracle").collect()] == [("t1", True, True)]
    assert reports.diagnostics_table(cells, ["tsr", "fpr"]).split("\n") == ["| engine | tsr | fpr |", "|---|---|---|", "| bfs | 0.300 | - |", "| oracle | 0.900 | - |", "| own | 0.550 | 2.000 |"]
    assert {r.engine: (r.cells, r.tsr) for r in reports.engine_summary(cells, ["tsr"]).collect()} == {"own": (2, 0.55), "bfs": (2, 0.3), "oracle": (1, 0.9)}
    path = str(tmp_path / "results")
    reports.write_results(cells, path)
    newer = cells.where("engine = 'own'").withColumn("tsr", F.lit(1.0))
    assert {(r.task, r.engine, r.tsr) for r in reports.write_results(newer, path).collect()} == {("t1", "own", 1.0), ("t2", "own", 1.0), ("t1", "bfs", 0.5), ("t2", "bfs", 0.1), ("t1", "oracle", 0.9)}
    assert spark.read.json(path).count() == 5
    body = reports.write_markdown(str(tmp_path / "report"), "Run", {"Diagnostics": "x"}, spark)
    assert body == "# Run\n\n## Diagnostics\n\nx" and [r.value for r in spark.read.text(str(tmp_path / "report"), wholetext=True).collect()] == [body + "\n"]
    took = reports.latency(lambda: cells, lambda: None, 2)
    assert set(took) == {"cold", "warm"} and min(took.values()) > 0
    r = reports.success_summary(cells, resamples=300).where("engine = 'own'").first()
    assert r.low <= r["mean"] <= r.high
    score = lambda answer: one(spark, reports.rubric_score(F.lit(answer), F.lit("app.pay.charge"), F.array(F.lit("app.pay.refund"))))
    assert (score("call CHARGE here"), score("nothing"), score("refund replaces charge"), score("recharged")) == (1, 0, 0, 0)


def test_kept_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s", "function", "h1"), ("b", "s", "class", "h2")], "qname string, scope string, kind string, structural_hash string")
    path = str(tmp_path / "kept")
    assert files.load_keyed(spark, path, "s1") is None
    files.save_keyed(rows, path, "s1")
    files.save_keyed(rows.limit(1), path, "s2")
    files.save_keyed(rows.limit(1), path, "s2")
    assert files.load_keyed(spark, path, "s1").count() == 2 and files.load_keyed(spark, path, "s2").count() == 1
    files.write_fingerprints(rows, str(tmp_path / "prints"))
    assert sorted(map(tuple, files.read_fingerprints(spark, str(tmp_path / "prints")).collect())) == sorted(map(tuple, rows.collect()))
    rows.write.parquet(str(tmp_path / "cache"))
    files.clear_cache(spark, str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 0 and spark.read.parquet(str(tmp_path / "cache")).columns == rows.columns


def test_path_aliases(spark, tmp_path):
    (tmp_path / "tsconfig.json").write_text('{ // aliases\n "compilerOptions": { "baseUrl": "./web", "paths": { "@/*": ["src/*", "x/*"], "~/*": ["./*"], "exact": ["one"] } } }')
    assert {tuple(r) for r in files.path_aliases(spark, str(tmp_path / "tsconfig.json")).collect()} == {("@/", "web/src/"), ("~/", "web/")}


def test_only_changed_files_are_computed(spark, tmp_path):
    seen = []

    def compute(todo):
        seen.append(sorted(r.path for r in todo.collect()))
        return todo.where("content <> ''").select("path", F.length("content").alias("n"))

    first = spark.createDataFrame([("a", "1", "xx"), ("b", "1", "yyy"), ("e", "1", "")], "path string, sha string, content string")
    path = str(tmp_path / "masks")
    assert sorted(map(tuple, files.by_file_cached(first, compute, path).collect())) == [("a", 2), ("b", 3)]
    second = spark.createDataFrame([("a", "1", "xx"), ("b", "2", "y"), ("c", "1", "zzzz"), ("e", "1", "")], "path string, sha string, content string")
    assert sorted(map(tuple, files.by_file_cached(second, compute, path).collect())) == [("a", 2), ("b", 1), ("c", 4)]
    assert sorted(map(tuple, files.by_file_cached(second.where("path = 'c'"), compute, path).collect())) == [("c", 4)]
    assert seen == [["a", "b", "e"], ["b", "c"], []]


def test_relative_module_column(spark):
    m = lambda module, package, level, name: one(spark, text.relative_module(F.lit(module), F.lit(package), F.lit(level), F.lit(name)))
    assert (m("a.b.c", False, 1, "d"), m("a.b", True, 1, "d"), m("a.b.c", False, 2, None), m("a", False, 3, "x"), m("a", False, 0, "os")) == ("a.b.d", "a.b.d", "a", "x", "os")


def test_stubs(spark):
    assert one(spark, compress.signature_stub(F.lit("def f(a,\n      b):\n    x = {1:\n 2}"))) == "def f(a,\n      b): ..."
    assert one(spark, compress.signature_stub(F.lit("x = 1\ny = 2"))) is None
    assert one(spark, compress.constant_stub(F.lit("X"), F.lit("X = {1: 2}"), F.lit(1), F.lit(70))) == "X = {...}  # 1 entries"
    assert one(spark, compress.constant_stub(F.lit("X"), F.lit("X = call()"), F.lit(0), F.lit(70))) is None


def test_core_queries_without_sql_compute_what_they_say(spark):
    from conftest import DATA

    without = set(plans.QUERIES) - set(plans.SQL)
    assert without == {"betweenness", "graph_metrics", "bootstrap_ci", "ordered_subsequence_coverage", "submodular_packing", "distance_packing", "causal_path", "count_tokens"}
    got = {r.event_type: (r["mean"], r.low, r.high) for r in plans.QUERIES["bootstrap_ci"](spark, DATA).collect()}
    plain = {r.event_type: (r.m, r.s, r.n) for r in spark.read.parquet(f"{DATA}/events.parquet").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev("value").alias("s"), F.count("*").alias("n")).collect()}
    for k, (mean, low, high) in got.items():
        m, s, n = plain[k]
        assert mean == pytest.approx(m) and low == pytest.approx(m - 1.96 * s / n**0.5, abs=0.4 * s / n**0.5) and high == pytest.approx(m + 1.96 * s / n**0.5, abs=0.4 * s / n**0.5)
    assert metrics is not None and profiles is not None
