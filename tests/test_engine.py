import json
import textwrap

import pytest

from graphloom import cli
from graphloom.engine import Engine, Query, SymbolNotFoundError
from graphloom.operators import joins, surface, traces
from graphloom.plans.tag_filter import QueryValidationError
from graphloom.sources import files, python_source

SERVICE = '''
import requests
from app.store import Store, save as persist
from . import util

class Base:
    def check(self, x):
        if x is None:
            raise ValueError("no")
        return x > 0

class Service(Base):
    """Serves orders."""
    def __init__(self):
        self.store = Store()
    def run(self, order: int, *, fast: bool = False) -> bool:
        ok = self.check(order)
        persist(order)
        requests.post("http://x", json=order)
        self.store.get(1)
        return ok

class Special(Service):
    def run(self, order):
        return self

async def main(n=1):
    s = Service()
    for i in range(n):
        try:
            s.run(i)
        except ValueError:
            continue
    return util.done(n)
'''


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, source in {"app/__init__.py": "", "app/service.py": SERVICE, "app/store.py": "class Store:\n    def get(self, k):\n        return k\ndef save(x):\n    pass\n", "app/util.py": "def done(n): return [n]\n", "app/bad.py": "def broken(:\n", "tests/test_a.py": "from app.service import main\ndef test_main():\n    assert main(1)\n", "node_modules/x.js": "x", "notes.txt": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(textwrap.dedent(source))
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, repo):
    return Engine.from_repo(spark, repo)


def test_scan(spark, repo):
    found = files.discover_files(spark, repo)
    assert [(r.path, r.language) for r in found.collect()] == [(p, "python") for p in ("app/__init__.py", "app/bad.py", "app/service.py", "app/store.py", "app/util.py", "tests/test_a.py")]


def test_edges(engine):
    got = {(r.src, r.dst, r.relation) for r in engine.edges.collect()}
    s = "app.service.Service"
    assert {(f"{s}.run", "app.service.Base.check", "CALLS"), (f"{s}.run", "app.store.save", "CALLS"), (f"{s}.run", "requests.post", "CALLS"), (f"{s}.run", "app.store.Store.get", "CALLS"), ("app.service.main", f"{s}.run", "CALLS"), ("app.service.main", s, "INSTANTIATES"), (s, "app.service.Base", "EXTENDS"), ("app.service.Special.run", f"{s}.run", "OVERRIDES"), ("tests.test_a.test_main", "app.service.main", "CALLS")} <= got


def test_contracts(engine):
    rows = {r.qname: r for r in engine.symbols.collect()}
    run = rows["app.service.Service.run"]
    assert [p.asDict() for p in run.params] == [{"name": "order", "type": "int", "default": None}, {"name": "fast", "type": "bool", "default": "False"}]
    assert run.return_type == "bool" and rows["app.service.main"].is_async and rows["app.service.Service.__init__"].mutations == ["self.store"]
    assert rows["app.service.Base.check"].raises == ["ValueError"] and rows["app.service.main"].complexity == 3
    assert {r.path: r.error for r in engine.files.collect()}["app/bad.py"] == "SyntaxError on line 1"


def test_retrieve_render_parse(engine):
    query = Query(seed="app.service.Service.run", budget=400)
    result = engine.retrieve(query)
    rows = result.orderBy("ord").collect()
    assert rows[0].id == "app.service.Service.run" and sum(r.cost for r in rows) <= 400
    xml = engine.render(result, [query]).first().xml
    assert xml == engine.render(result, [query]).first().xml
    parsed = surface.parse_context(xml)
    assert parsed["seed"] == query.seed and {n["id"] for n in parsed["nodes"]} == {r.id for r in rows} and parsed["nodes"][0]["role"] == "seed"
    assert engine.render(result, [query], "markdown").first().markdown.startswith("# app.service.Service.run")
    path = surface.causal_paths(surface.induced_edges(result, engine.edges.select("src", "dst", "relation").distinct()), result).first().path
    assert path[0] == query.seed
    assert [r.body for r in surface.detail_level(result, "manifest").collect()] == [None] * len(rows)


def test_two_pass_and_search(engine):
    seen = []
    engine.register_before(seen.append)
    got = engine.retrieve_two_pass(Query(seed="app.service.main"), lambda lines: ["app.util.done", "nothing.here"])
    ids = [r.id for r in got.collect()]
    assert ids[:2] == ["app.service.main", "app.util.done"]
    assert [r.qname for r in engine.find_symbols("#network AND NOT #test").collect()] == ["app.service.Service.run"]
    with pytest.raises(SymbolNotFoundError) as e:
        engine.retrieve(Query(seed="app.service.Service.rum"))
    assert "app.service.Service.run" in e.value.candidates and seen
    assert engine.status().first().errors == 1


def test_snapshot_is_all_or_nothing(spark, repo, tmp_path):
    path = str(tmp_path / "snap")
    first = Engine.from_repo(spark, repo, path)
    current = spark.read.parquet(f"{path}/files")
    assert files.load_snapshot(spark, path, 1, current)["symbols"].count() == first.symbols.count()
    assert files.load_snapshot(spark, path, 2, current) is None
    assert files.load_snapshot(spark, path, 1, current.limit(2)) is None


def test_query_validation():
    for bad in ({}, {"seed": "a", "seeds": ("b",)}, {"seed": "a", "budget": 0}, {"seed": "a", "budget": 128001}, {"seed": "a", "task_type": "x"}, {"seed": "a", "d_max": 0}):
        with pytest.raises(QueryValidationError):
            Query(**bad)


def test_parse_context_rejects():
    for bad in ("<x/>", '<!DOCTYPE a [<!ENTITY b "c">]><context version="3"/>', '<context version="3">' + "<a>" * 200 + "</a>" * 200 + "</context>"):
        with pytest.raises(ValueError):
            surface.parse_context(bad)


def test_cli(spark, repo, capsys):
    assert cli.main(["query", repo, "app.service.main", "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["id"] == "app.service.main"
    assert cli.main(["query", repo, "no.such.name"], spark) == 1


def test_otlp(spark, tmp_path):
    attr = lambda **kw: [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in kw.items()]
    spans = [{"spanId": "1", "kind": 2, "attributes": attr(code__namespace="a", code__function="f")}, {"spanId": "2", "parentSpanId": "1", "kind": "SPAN_KIND_CLIENT", "attributes": attr(code__function="g", http__url="http://h")}, {"spanId": "3", "parentSpanId": "2", "kind": 1, "attributes": attr(db__statement="insert into t")}]
    (tmp_path / "t.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]}))
    events = traces.spans_to_events(files.read_spans(spark, str(tmp_path)))
    got = {(r.caller, r.callee, r.sink_tag, r.detail) for r in events.collect()}
    assert got == {("a.f", "g", None, None), ("a.f", None, "#external_io", "http://h"), ("g", None, "#db_write", "insert into t")}


def test_trace_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"caller": "a", "callee": "b", "source": "tracer"}\n\nnot json\n')
    assert files.read_traces(spark, str(tmp_path)).count() == 1
    files.write_traces(files.read_traces(spark, str(tmp_path)), str(tmp_path / "out"))
    assert files.read_traces(spark, str(tmp_path / "out")).first().callee == "b"
    (tmp_path / "e.json").write_text(json.dumps({"manifest": {"git_commit_sha": "c", "environment": "prod", "file_fingerprints": {"x": "1"}}, "edges": [{"caller": "a", "callee": "b"}, {"caller": "a"}]}))
    manifests, edges = files.read_exports(spark, str(tmp_path / "e.json"))
    assert edges.select("env", "caller", "callee", "count").first() == ("prod", "a", "b", 0) and edges.count() == 1 and manifests.first().files == {"x": "1"}


def test_caches(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    assert sorted(files.upsert(old, spark.createDataFrame([("b", 3), ("c", 4)], "path string, v int"), ["path"]).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert files.invalidate(old, spark.createDataFrame([("a",)], "path string")).collect() == [("b", 2)]


def test_relative_imports():
    assert python_source.relative_module("a.b.c", False, 1, "d") == "a.b.d"
    assert python_source.relative_module("a.b", True, 1, "d") == "a.b.d"
    assert python_source.relative_module("a.b.c", False, 2, None) == "a"
    assert python_source.structural_hash(__import__("ast").parse("def f(a): return a+1").body[0]) == python_source.structural_hash(__import__("ast").parse("def g(b): return b+1").body[0])


def test_similar_names(spark):
    names = spark.createDataFrame([("app.checkout",), ("app.check_out",), ("lib.zzz",), ("x.checkouts",)], "qname string")
    got = joins.similar_names(names, spark.createDataFrame([("app.chekout",)], "query string"))
    assert [r.qname for r in got.orderBy("rank").collect()][:1] == ["app.checkout"] and "lib.zzz" not in {r.qname for r in got.collect()}


def test_validation(engine):
    from graphloom import validation

    assert validation.symbol_named(engine.symbols, "done") == "app.util.done"
    for call in (lambda: validation.symbol_named(engine.symbols, "run"), lambda: validation.token_budget(0), lambda: validation.tag_name("x"), lambda: validation.symbol_name("a b")):
        with pytest.raises(QueryValidationError):
            call()
    line = json.loads(surface.debug_json(engine.symbols.select("qname", "kind"), engine.edges).where("json LIKE '%app.util.done%'").first().json)
    assert line["qname"]


def test_tasks(spark, tmp_path):
    pytest.importorskip("yaml")
    from graphloom.sources.tasks import load_tasks

    (tmp_path / "a.yaml").write_text("task_id: t1\nrepo: r\nseed_symbol: s\ntask_type: x\ncohen_kappa: 0.9\nannotation_a: {pipeline_symbols: [a, b]}\n")
    (tmp_path / "b.yaml").write_text("task_id: t2\nrepo: r\nseed_symbol: s\ntask_type: x\ncohen_kappa: 0.7\n")
    (tmp_path / "c.yaml").write_text("just text")
    accepted, rejected = load_tasks(spark, str(tmp_path))
    assert [(r.task_id, r.pipeline) for r in accepted.collect()] == [("t1", ["a", "b"])] and rejected.count() == 2


def test_prune_and_ego(spark):
    from graphloom.operators import contracts

    ids = spark.createDataFrame([(x,) for x in "abcz"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "q")], "src string, dst string")
    got = {r.id: r.status for r in contracts.prune_candidates(ids, spark.createDataFrame([("a",)], "id string"), edges).collect()}
    assert got == {"a": "kept", "b": "kept", "c": "kept", "z": "island"}
    tags = spark.createDataFrame([("b", "#x"), ("a", "#y")], "node string, tag string")
    row = contracts.ego_coverage(edges, tags, spark.createDataFrame([("a",)], "node string"), "a", 1).first()
    assert (row.nodes, row.packed, row.tag_coverage) == (3, 1, 0.5)


def test_data_flow_confidences(spark):
    from graphloom.operators import contracts

    rows = [(1, 1, "x", "load", [], []), (1, 2, "y", "parse", ["x.field"], []), (1, 3, "err", "risky", [], []), (1, 4, "z", "save", ["y", "err", "x[0]"], ["dump"]), (1, 5, "y", None, ["q"], []), (1, 6, None, "end", ["y"], [])]
    df = spark.createDataFrame(rows, "def int, pos int, target string, call string, inputs array<string>, nested array<string>")
    assert {(r.src, r.dst, r.confidence) for r in contracts.data_flow(df).collect()} == {("load", "parse", 0.7), ("parse", "save", 0.9), ("load", "save", 0.9), ("dump", "save", 1.0)}


def test_sinks_reach_masks(engine):
    from graphloom.functions import bits

    masks = {r.qname: r["mask"] for r in engine.masks().select("qname", "mask").collect()}
    assert masks["app.service.Service.run"] & bits.bit("SINK_NETWORK_IO") and not masks["app.util.done"] & bits.IMPURE_SINKS


def test_packages_keep_to_the_budget(spark, engine):
    asked = [Query(seed="app.service.main", budget=4000), Query(seed="app.service.Service.run", budget=30)]
    full = engine.build_package(asked).collect()
    main = {r.id: r for r in full if r["query"] == 0}
    assert main["app.service.main"].body.startswith("async def main") and not any(r.stub for r in main.values())
    assert main["app.service.Service.run"].l3 == "def run(self, order: int, *, fast: bool=False) -> bool: ..." and "# Calls: " in main["app.service.Service.run"].l2
    small = [r for r in full if r["query"] == 1]
    assert all(r.stub == (r.role == "transitive" and r.c3 < r.c0) for r in small) and all(r.body == r.l3 for r in small if r.stub)
    told = {(r["query"], r.code) for r in engine.warnings(engine.build_package(asked), asked).collect()}
    assert (1, "BUDGET_OVERFLOW") in told and (0, "BUDGET_OVERFLOW") not in told


def test_requests_and_three_passes(spark, engine):
    asked = Query(seed="app.service.main", budget=4000)
    package = {r.id: r.role for r in engine.build_package_requested(asked, ["app.store.save", "app.gone", "app.store.save"]).collect()}
    assert package["app.service.main"] == "seed" and package["app.store.save"] == "transitive" and package["app.service.Service.run"] == "callee" and "app.gone" not in package
    externals = spark.createDataFrame([("requests.post", 100, "def post"), ("requests.get", 100, "def get"), ("huge.f", 10_000, "x")], "name string, cost int, body string")
    picked, outside = engine.retrieve_three_pass(asked, lambda lines: [x.split("|")[0] for x in lines[:2]], externals, lambda names: ["huge.f", "requests.post", "requests.post", "none"])
    assert picked.first().id == "app.service.main" and [r.id for r in outside.collect()] == ["requests.post"]


def test_explain(engine):
    full, manifest, summary = (engine.explain(Query(seed="app.service.main"), d).first()[1] for d in ("full", "manifest", "summary"))
    assert "async def main" in full and "async def main" not in manifest and "app.service.main" in manifest and len(summary) < len(manifest)


def test_repositories_hold_few(spark, repo, tmp_path):
    from graphloom.engine import Repositories

    (tmp_path / "a.py").write_text("def one(): pass\n")
    kept = Repositories(spark, most=1)
    first = kept.get_or_index(str(tmp_path))
    assert kept.get_or_index(str(tmp_path)) is first and [r.qname for r in first.symbols.collect()] == ["a.one"]
    (tmp_path / "a.py").write_text("def two(): pass\n")
    assert [r.qname for r in kept.reindex(str(tmp_path)).symbols.collect()] == ["a.two"]
    kept.get_or_index(repo)
    assert kept.get_or_index(str(tmp_path)) is not first and len(kept._held) == 1
    assert {r.kind for r in kept.get_or_index(repo).status_by_kind().collect()} == {"class", "function", "method"}


def test_other_languages_in_the_index(spark, tmp_path):
    for name, source in {"web/a.ts": "import { Base } from './b';\nexport class K extends Base implements I {\n}\ninterface I {\n}\n", "web/b.ts": "export class Base {\n}\n", "svc/m.go": "package m\ntype T struct {\n\tP\n}\nfunc (t *T) Run() {\n}\n", "svc/p.go": "package m\ntype P struct { }\n", "x.py": "def f(): pass\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(source)
    made = Engine.from_repo(spark, str(tmp_path))
    assert {(r.qname, r.kind, r.start, r.end) for r in made.symbols.collect()} >= {("web.a.K", "class", 2, 3), ("web.b.Base", "class", 1, 3), ("svc.m.T.Run", "method", 5, 7), ("x.f", "function", 1, 1)}
    assert {(r.src, r.dst, r.relation) for r in made.edges.collect()} == {("web.a.K", "web.b.Base", "EXTENDS"), ("web.a.K", "web.a.I", "IMPLEMENTS"), ("svc.m.T", "svc.p.P", "EMBEDS")}
    assert made.masks().count() == made.symbols.count()
