"""Queries over sources of other languages, links between types, tags, sinks and compressed texts.

Sources are written from parts, one file each, so that what a scanner must find is known in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compress as texts
from ..operators import contracts, flow, graph, linking, profiles, tagging
from ..sources import other_languages as languages
from ..storage import written
from . import views
from .catalog import query

FK, SYM = views.FK_EDGES, views.SYMBOLS

def _text(*parts):
    """Text of constants and numbers."""
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def _bindings(t, source, scan):
    rows = t("part").select("p_partkey", F.explode(scan(source)).alias("b"))
    return rows.select("p_partkey", "b.local", "b.specifier", "b.member", "b.is_wildcard")


@query("""SELECT p_partkey, local, specifier, member, false AS is_wildcard FROM (SELECT p_partkey, unnest([
  {'local': 'def' || p_partkey, 'specifier': './lib/m' || p_partkey % 7, 'member': 'default'}, {'local': 'a' || p_partkey, 'specifier': './lib/m' || p_partkey % 7, 'member': 'alpha'}, {'local': 'beta', 'specifier': './lib/m' || p_partkey % 7, 'member': 'beta'},
  {'local': 'ns', 'specifier': 'pkg/sub' || p_partkey % 3, 'member': ''}, {'local': 'r' || p_partkey, 'specifier': '../u' || p_partkey % 5, 'member': 'q'}, {'local': 's', 'specifier': '../u' || p_partkey % 5, 'member': 's'},
  {'local': 't', 'specifier': 'w', 'member': 'z'}, {'local': 'u', 'specifier': 'v', 'member': ''}], recursive := true) FROM part)""")
def js_import_bindings(t):
    key = F.col("p_partkey")
    source = _text("import def", key, ", { alpha as a", key, ",\n  beta } from './lib/m", key % 7, "';\nimport * as ns from \"pkg/sub", key % 3, "\";\n// import no from 'comment'\n/* import no2 from 'block' */\nimport 'side';\n")
    source = F.concat(source, _text("const { q: r", key, ", s } = require('../u", key % 5, "');\nconst t = require('w').z, u = require('v');\nconst dyn = require(name), far = require('a').b.c;\nrequire('effect');\n"))
    return _bindings(t, source, languages.js_imports)


@query("""SELECT p_partkey, local, specifier, member, is_wildcard FROM (SELECT p_partkey, unnest([{'local': 'b' || p_partkey, 'specifier': './b' || p_partkey % 3, 'member': 'aa', 'is_wildcard': false},
  {'local': 'cc', 'specifier': './b' || p_partkey % 3, 'member': 'cc', 'is_wildcard': false}, {'local': '', 'specifier': './c' || p_partkey % 4, 'member': '', 'is_wildcard': true}], recursive := true) FROM part)""")
def js_reexport_rows(t):
    key = F.col("p_partkey")
    source = _text("export { aa as b", key, ", cc } from './b", key % 3, "';\nexport * from './c", key % 4, "';\nexport * as ns from './d';\nexport { local };\n")
    return _bindings(t, source, languages.js_reexports)


@query("""SELECT p_partkey, local, specifier, '' AS member, false AS is_wildcard FROM (SELECT p_partkey, unnest([{'local': 'fmt', 'specifier': 'fmt'}, {'local': 'al' || p_partkey, 'specifier': 'a.b' || p_partkey % 3},
  {'local': 'http', 'specifier': 'net.http'}, {'local': '.', 'specifier': 'dot'}, {'local': 'x', 'specifier': 'y.z'}], recursive := true) FROM part)""")
def go_import_bindings(t):
    key = F.col("p_partkey")
    source = _text('package main\nimport "fmt"\nimport al', key, ' "a/b', key % 3, '"\n// import "no"\nimport (\n\t"net/http"\n\t. "dot"\n\tx "y/z" // why\n)\nvar s = "import"\n')
    return _bindings(t, source, languages.go_imports)


@query("""SELECT p_partkey, local, specifier, '' AS member, is_wildcard FROM (SELECT p_partkey, unnest(CASE WHEN p_partkey % 2 = 0 THEN [{'local': 'B' || p_partkey, 'specifier': 'com.a.B' || p_partkey, 'is_wildcard': false}, {'local': '', 'specifier': 'com.c', 'is_wildcard': true}]
  ELSE [{'local': '', 'specifier': 'System', 'is_wildcard': true}, {'local': '', 'specifier': 'App.M' || p_partkey % 3, 'is_wildcard': true}, {'local': '', 'specifier': 'G', 'is_wildcard': true}] END, recursive := true) FROM part)""")
def java_csharp_imports(t):
    key = F.col("p_partkey")
    java = _text("package p;\nimport com.a.B", key, ";\nimport com.c.*;\nimport static com.d.E.f;\n")
    sharp = _text("using System;\nusing App.M", key % 3, ";\nusing X = Y.Z;\nusing static A.B;\nglobal using G;\n")
    return _bindings(t, F.when(key % 2 == 0, java).otherwise(sharp), lambda s: languages.imports(F.when(key % 2 == 0, "java").otherwise("c_sharp"), s))


def _clauses():
    key = F.col("p_partkey")
    return _text("export class K", key, "<T> extends Base", key % 5, "<Map<T, U>>\n  implements I", key % 3, ", other.J {\n}\n// class No extends Base1 {\ninterface P", key, " extends I", key % 3, " {\n}\n")


@query("""SELECT 'm.K' || p_partkey AS src, 'm.Base' || p_partkey % 5 AS dst, 'EXTENDS' AS relation FROM part WHERE p_partkey % 5 < 4 UNION ALL SELECT 'm.K' || p_partkey, 'm.I' || p_partkey % 3, 'IMPLEMENTS' FROM part
UNION ALL SELECT 'm.K' || p_partkey, 'pkg.other.J', 'IMPLEMENTS' FROM part UNION ALL SELECT 'm.P' || p_partkey, 'm.I' || p_partkey % 3, 'EXTENDS' FROM part""")
def ts_heritage_links(t):
    key = F.col("p_partkey")
    spark = t("part").sparkSession
    file = _text("f", key)
    clauses = t("part").select(file.alias("file"), F.explode(languages.ts_heritage(_clauses())).alias("c")).select("file", F.lit("m").alias("module"), F.concat(F.lit("m."), "c.name").alias("qname"), "c.base", "c.relation")
    imports = t("part").select(file.alias("file"), F.lit("other").alias("local"), F.lit("pkg.other").alias("target"))
    names = [("m", f"Base{i}", "class") for i in range(4)] + [("m", f"I{i}", "interface") for i in range(3)] + [("pkg.other", "J", "interface")]
    symbols = spark.createDataFrame(names, "module string, name string, kind string").withColumn("qname", F.concat_ws(".", "module", "name"))
    return linking.heritage_edges(clauses, imports, symbols, spark.createDataFrame([], "file string, module string, ord int"))


def _embeds(t):
    key = F.col("p_partkey")
    source = _text("type T", key, " struct {\n\tT", F.floor(key / 2), "\n\t*Pool `json:\"p\"`\n\tname string\n\tpkg.Other\n}\n")
    found = t("part").select(F.explode(languages.go_embeds(source)).alias("e")).select(F.lit("m").alias("module"), "e.name", "e.embedded")
    types = t("part").select(F.lit("m").alias("module"), _text("T", key).alias("name")).unionByName(t("part").sparkSession.createDataFrame([("m", "Pool")], "module string, name string"))
    return linking.embed_edges(found, types.withColumn("qname", F.concat_ws(".", "module", "name")))


_EMBEDS = "em AS (SELECT 'm.T' || p_partkey AS src, 'm.Pool' AS dst FROM part UNION ALL SELECT 'm.T' || p_partkey, 'm.T' || p_partkey // 2 FROM part WHERE p_partkey // 2 IN (SELECT p_partkey FROM part))"


@query(f"WITH {_EMBEDS} SELECT src, dst, 'EMBEDS' AS relation FROM em")
def go_embed_links(t):
    return _embeds(t)


@query(f"""WITH RECURSIVE {_EMBEDS}, me AS (SELECT 'm.T' || p_partkey AS struct, 'M' AS method FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT 'm.Pool', x FROM (VALUES ('M'), ('Get')) v(x)),
b(q, node, h) AS (SELECT 'm.T' || p_partkey, 'm.T' || p_partkey, 0 FROM part UNION SELECT q, dst, h + 1 FROM b JOIN em ON src = node WHERE src <> dst AND h < 20), r AS (SELECT q, node, min(h) AS h FROM b GROUP BY 1, 2),
d AS (SELECT q AS struct, method, h, count(*) AS n, min(me.struct || '.' || method) AS target FROM r JOIN me ON me.struct = node WHERE h > 0 GROUP BY 1, 2, 3), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY struct, method ORDER BY h) = 1)
SELECT 'm.T' || p_partkey AS struct, a.method, CASE WHEN n = 1 THEN target END AS target, coalesce(n > 1, false) AS ambiguous FROM part CROSS JOIN (VALUES ('M'), ('Get'), ('No')) a(method) LEFT JOIN f ON f.struct = 'm.T' || p_partkey AND f.method = a.method""")
def go_promoted_methods(t):
    key = F.col("p_partkey")
    names = F.explode(F.array(F.lit("M"), F.lit("Get"), F.lit("No"))).alias("method")
    methods = t("part").where("p_partkey % 4 = 1").select(_text("m.T", key).alias("struct"), F.lit("M").alias("method")).unionByName(t("part").sparkSession.createDataFrame([("m.Pool", "M"), ("m.Pool", "Get")], "struct string, method string"))
    return linking.promoted_methods(t("part").select(_text("m.T", key).alias("struct"), names), _embeds(t).select("src", "dst"), methods.withColumn("qname", F.concat_ws(".", "struct", "method")))


@query("""SELECT p_partkey, specifier, module FROM (SELECT p_partkey, unnest([{'specifier': '../a' || p_partkey % 60, 'module': 'src.a' || p_partkey % 60}, {'specifier': './../lib' || p_partkey % 10, 'module': 'src.lib' || p_partkey % 10},
  {'specifier': '@/x/y' || p_partkey % 5, 'module': 'src.x.y' || p_partkey % 5}, {'specifier': 'react/dom', 'module': 'react.dom'}], recursive := true) FROM part)""")
def js_specifier_resolution(t):
    key = F.col("p_partkey")
    spark = t("part").sparkSession
    bindings = t("part").select("p_partkey", _text("src/sub/f", key, ".ts").alias("path"), F.explode(F.array(_text("../a", key % 60), _text("./../lib", key % 10), _text("@/x/y", key % 5), F.lit("react/dom"))).alias("specifier"))
    files = spark.range(50).select(_text("src/a", F.col("id"), ".ts").alias("path")).unionByName(spark.range(10).select(_text("src/lib", F.col("id"), "/index.js").alias("path")))
    aliases = spark.createDataFrame([("@/", "src/"), ("@/x/", "src/x/"), ("~/", "")], "prefix string, target string")
    return languages.resolve_specifiers(bindings, files, aliases).select("p_partkey", "specifier", "module")


@query("""WITH RECURSIVE up(c, a, d) AS (SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_partkey > 1 UNION ALL SELECT c, a // 2, d + 1 FROM up WHERE a > 1 AND d < 10)
SELECT p_partkey AS class, 'run' AS method, f.target FROM part LEFT JOIN (SELECT c, min_by(a || '.run', d) AS target FROM up WHERE a % 3 = 0 AND a IN (SELECT p_partkey FROM part) GROUP BY c) f ON f.c = p_partkey""")
def inherited_methods(t):
    key = F.col("p_partkey")
    edges = t("part").where("p_partkey > 1").select(key.alias("src"), F.floor(key / 2).alias("dst"))
    methods = t("part").where("p_partkey % 3 = 0").select(key.alias("class"), F.lit("run").alias("method"), _text(key, ".run").alias("qname"))
    return linking.inherited_methods(t("part").select(key.alias("class"), F.lit("run").alias("method")), graph.ancestors(edges, F.col("dst")), methods)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'CALLS' WHEN p_partkey % 2 = 0 THEN 'SUBSCRIPT_DISPATCH' ELSE 'UNRESOLVED' END AS kind, CASE WHEN p_partkey % 3 < 2 THEN 'm.f' || p_partkey % 3 END AS target FROM part""")
def generic_calls(t):
    key = F.col("p_partkey")
    functions = t("part").sparkSession.createDataFrame([("f0", "m.f0"), ("f1", "m.f1")], "name string, qname string")
    calls = t("part").select(key.alias("call"), _text("f", key % 3).alias("base"), (key % 2 == 0).alias("indexed"))
    return linking.generic_calls(calls, functions).select(F.col("call").alias("p_partkey"), "kind", "target")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name IN ('x', p_name) AND p_partkey % 2 = 0 ELSE p_partkey % 5 <> 0 END AS permitted FROM part""")
def wildcard_exports(t):
    key = F.col("p_partkey")
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.when(key % 5 == 0, "_").otherwise(""), F.col("p_name")))
    listed = F.when(F.col("p_size") % 3 < 2, F.when((key % 2 == 0) & (F.col("p_size") % 3 == 0), F.array("p_name")).otherwise(F.array(F.lit("x"))))
    return t("part").select("p_partkey", linking.permits_wildcard(name, listed, F.col("p_size") % 3 == 1).alias("permitted"))


@query("""SELECT user_id AS scope, event_type AS variable, max_by(floor(value)::BIGINT % 4, event_id) AS class, count(DISTINCT floor(value)::BIGINT % 4) > 1 AS ambiguous FROM events GROUP BY 1, 2""")
def instance_types(t):
    return linking.instance_types(t("events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("variable"), (F.floor("value") % 4).alias("class"), F.col("event_id").alias("pos")))


@query("""SELECT p_partkey, p_name || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS id FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END, p_size, p_partkey) AS k FROM part)""")
def named_once(t):
    key = F.col("p_partkey")
    rows = t("part").select("p_partkey", F.col("p_name").alias("qname"), F.when(F.col("p_size") % 4 == 0, "interface").otherwise("class").alias("kind"), F.col("p_size").alias("file_ord"), key.alias("start"))
    return linking.named_once(rows).select("p_partkey", "id")


@query("""SELECT path, kind, name, holder, line::INTEGER AS line FROM (SELECT 'f' || p_partkey AS path, unnest(CASE p_partkey % 3 WHEN 0 THEN [{'kind': 'class', 'name': 'S' || p_partkey, 'holder': NULL, 'line': 2}, {'kind': 'method', 'name': 'Run', 'holder': 'S' || p_partkey, 'line': 3}, {'kind': 'function', 'name': 'main', 'holder': NULL, 'line': 5}]
  WHEN 1 THEN [{'kind': 'class', 'name': 'C' || p_partkey, 'holder': NULL, 'line': 1}, {'kind': 'function', 'name': 'g', 'holder': NULL, 'line': 3}, {'kind': 'function', 'name': 'h', 'holder': NULL, 'line': 4}]
  ELSE [{'kind': 'class', 'name': 'D' || p_partkey, 'holder': NULL, 'line': 1}, {'kind': 'method', 'name': 'run', 'holder': NULL, 'line': 2}] END, recursive := true) FROM part)""")
def other_language_definitions(t):
    key = F.col("p_partkey")
    go = _text("package p\ntype S", key, " struct {\n}\nfunc (s *S", key, ") Run(x int) error {\n}\nfunc main() {\n}\n")
    go = F.replace(go, F.lit("struct {\n}\n"), F.lit("struct { }\n"))
    js = _text("export class C", key, " extends B {\n}\nexport async function g(x) {}\nconst h = (a) => a;\n// function no() {}\n")
    java = _text("public final class D", key, " {\n  public static void run(int x) {\n    f(x);\n  }\n}\n")
    language = F.when(key % 3 == 0, "go").when(key % 3 == 1, "typescript").otherwise("java")
    files = t("part").select(_text("f", key).alias("path"), language.alias("language"), F.when(key % 3 == 0, go).when(key % 3 == 1, js).otherwise(java).alias("source"))
    return languages.definitions(files).select("path", "kind", "name", "holder", "line")


def _facts(t):
    key = F.col("p_partkey")
    none = F.array().cast("array<string>")
    one = lambda x: F.array(F.lit(x))
    return t("part").select(
        _text("p:", key).alias("qname"), F.when(key % 4 == 0, F.array(F.lit("repo.save"), F.lit("x"))).when(key % 4 == 1, one("s.get")).when(key % 4 == 2, one("verify")).otherwise(none).alias("calls"),
        F.when(key % 3 == 0, one("sqlalchemy")).when(key % 3 == 1, one("Requests")).otherwise(none).alias("roots"), F.when(key % 5 == 0, one('app.get("/x")')).when(key % 5 == 1, one("Transactional")).otherwise(none).alias("decorators"),
        F.when(key % 7 == 0, one("AuthError")).otherwise(none).alias("raises"), (key % 2 == 0).alias("writes_self"), (key % 11 == 0).alias("dynamic_attribute"), (key % 13 == 0).alias("hazard"),
        F.when(key % 6 == 0, "src/api/x.py").when(key % 6 == 1, "main.go").otherwise("lib/y.py").alias("file"), F.when(key % 6 == 1, "go").otherwise("python").alias("language"),
        F.when(key % 8 == 0, "os.remove(x)").when(key % 8 == 1, "if err != nil {").otherwise("y").alias("body"), (F.col("p_size") % 2 == 0).alias("returns_value"), (F.col("p_size") % 3 == 0).alias("has_try"), (F.col("p_size") % 5 == 0).alias("has_raise"),
    )


_OWN = """own AS (SELECT 'p:' || p_partkey AS qname, unnest([CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 = 0 OR p_partkey % 5 = 1 THEN '#db_write' END, CASE WHEN p_partkey % 4 = 1 AND p_partkey % 3 = 1 THEN '#external_io' END, CASE WHEN p_partkey % 5 = 0 THEN '#route_handler' END,
  CASE WHEN p_partkey % 5 = 1 OR p_partkey % 2 = 0 THEN '#state_mutation' END, CASE WHEN p_partkey % 4 = 2 OR p_partkey % 7 = 0 THEN '#auth_guard' END, CASE WHEN p_partkey % 11 = 0 THEN '#dynamic_attribute' END, CASE WHEN p_partkey % 13 = 0 THEN '#dynamic_hazard' END]) AS tag FROM part)"""
_TOPO = """deg AS (SELECT qname, count(*) FILTER (i = 1) AS n_in, count(*) FILTER (i = 0) AS n_out FROM (SELECT DISTINCT dst AS qname, src AS o, 1 AS i FROM fk UNION ALL SELECT DISTINCT src, dst, 0 FROM fk) GROUP BY qname),
topo AS (SELECT qname, unnest([CASE WHEN n_in = 0 AND n_out > 0 AND p_partkey % 6 < 2 THEN '#entrypoint' END, CASE WHEN n_in > 0 AND n_out = 0 AND p_size % 2 = 0 THEN '#pure_transform' END, CASE WHEN p_partkey % 8 = 0 THEN '#io_sink' END,
  CASE WHEN (p_size % 3 = 0 OR p_partkey % 6 = 1 AND p_partkey % 8 = 1) AND (p_size % 2 = 0 OR p_size % 5 = 0) THEN '#error_handler' END]) AS tag FROM part JOIN deg ON qname = 'p:' || p_partkey)"""


@query(f"WITH {_OWN} SELECT 'p:' || p_partkey AS qname, coalesce(tags, []) AS tags FROM part LEFT JOIN (SELECT qname, list(tag ORDER BY tag) AS tags FROM own WHERE tag IS NOT NULL GROUP BY qname) x ON x.qname = 'p:' || p_partkey")
def tag_symbols(t):
    return tagging.tag_symbols(_facts(t))


@query(f"WITH {FK}, {_OWN}, {_TOPO}, a AS (SELECT DISTINCT qname, tag FROM (SELECT * FROM own UNION ALL SELECT * FROM topo) WHERE tag IS NOT NULL), s AS (SELECT 'z:' || p_partkey AS qname, p_partkey FROM part WHERE p_partkey % 10 = 1) "
       "SELECT qname, list(tag ORDER BY tag) AS tags FROM a GROUP BY qname UNION ALL SELECT s.qname, CASE WHEN s.p_partkey % 20 = 1 THEN ['#dynamic_hazard'] ELSE coalesce((SELECT list(tag ORDER BY tag) FROM (SELECT DISTINCT tag FROM a WHERE a.qname IN ('p:' || (s.p_partkey + 1), 'p:' || (s.p_partkey + 2)))), []) END FROM s")
def tag_graph(t):
    key = F.col("p_partkey")
    sentinels = t("part").where("p_partkey % 10 = 1").select(_text("z:", key).alias("qname"), F.array(_text("p:", key + 1), _text("p:", key + 2)).alias("candidates"), (key % 20 == 1).alias("dynamic"))
    return tagging.tag_graph(written(_facts(t)), written(views.fk_edges(t)), sentinels)


@query("""SELECT 'f' || p_partkey AS caller, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 32 END::BIGINT AS mask FROM part WHERE p_partkey % 5 < 4""")
def sink_bits(t):
    key = F.col("p_partkey")
    chain = F.when(key % 5 == 0, "requests.get").when(key % 5 == 1, "db.connect").when(key % 5 == 2, "open").when(key % 5 == 3, "random").otherwise("opening.x")
    target = F.when(key % 5 == 1, "sqlite3.connect").when(key % 5 == 2, "httpx.Client.get")
    calls = t("part").select(_text("f", key).alias("caller"), F.lit("python").alias("language"), chain.alias("chain"), target.alias("target"))
    return tagging.sink_bits(calls, tagging.default_registry(t("part").sparkSession))


@query(f"""WITH {FK}, d AS (SELECT 'p:' || p_partkey AS q, CASE WHEN p_partkey % 3 = 0 THEN 1 << (p_size % 6) ELSE 0 END AS m, p_size, p_partkey FROM part), e AS (SELECT DISTINCT a.p_partkey AS k, b.q AS dst FROM part a JOIN d b ON b.p_partkey IN (a.p_partkey * 2, a.p_partkey * 2 + 1)),
l AS (SELECT e.k, bit_or(d.m) AS m FROM e JOIN d ON d.q = e.dst WHERE d.m > 0 AND d.p_size % 5 <= 3 GROUP BY e.k) SELECT d.q AS qname, CASE WHEN d.m | coalesce(l.m, 0) <> 0 THEN d.m | coalesce(l.m, 0) WHEN p_size % 2 = 0 THEN 64 ELSE 0 END::BIGINT AS mask FROM d LEFT JOIN l ON l.k = d.p_partkey""")
def substance_bits(t):
    key = F.col("p_partkey")
    p = t("part")
    direct = p.where("p_partkey % 3 = 0").select(_text("p:", key).alias("caller"), F.expr("shiftleft(1L, p_size % 6)").alias("mask"))
    edges = p.select(_text("p:", key).alias("src"), F.explode(F.array(_text("p:", key * 2), _text("p:", key * 2 + 1))).alias("dst"))
    return tagging.substance(direct, edges, p.select(_text("p:", key).alias("qname"), (F.col("p_size") % 5).alias("n_statements"), (F.col("p_size") % 2 == 1).alias("mutates")))


@query("""SELECT 'p:' || p_partkey AS qname, list_sort(list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'NETWORK_HTTP' END, CASE WHEN p_partkey % 4 = 1 THEN 'DISK_IO' END, CASE WHEN p_partkey % 4 = 2 OR p_size % 3 = 0 THEN 'ASSERTS' END, CASE WHEN p_size % 2 = 0 THEN 'ASYNC_WAIT' END], lambda x: x IS NOT NULL)) AS effects,
  CASE WHEN p_size % 3 = 0 THEN ['AssertionError', 'KeyError'] ELSE ['KeyError'] END AS thrown FROM part""")
def effect_flags(t):
    key = F.col("p_partkey")
    calls = F.when(key % 4 == 0, F.array(F.lit("Requests.Post"), F.lit("get"))).when(key % 4 == 1, F.array(F.lit("os.path.exists"))).when(key % 4 == 2, F.array(F.lit("self.assertEqual"), F.lit("page.expect"))).otherwise(F.array(F.lit("db.get")))
    return tagging.effects(t("part").select(_text("p:", key).alias("qname"), calls.alias("calls"), F.array(F.lit("KeyError")).alias("raises"), (F.col("p_size") % 2 == 0).alias("awaits"), (F.col("p_size") % 3 == 0).alias("asserts")))


_HEAD = "'def f' || p_partkey || '(x, y=1):'"
_PY = (
    f"""{_HEAD} || E'\\n    v = call(' || a || E')\\n    if v:\\n        raise ValueError(' || b || E')\\n    return g(' || c || ')'"""
)


@query(f"""SELECT 'm.f' || p_partkey AS qname, {_HEAD} || E'\\n    \"\"\"Doc.\"\"\"\\n    z = 1 + x\\n    log.info(z)\\n    v = call(x, ' || p_partkey || E')\\n    if v:\\n        raise ValueError(x)\\n    return g(v)' AS l0,
  (SELECT {_PY} FROM (SELECT 'x, ' || p_partkey AS a, 'x' AS b, 'v' AS c)) AS l1, (SELECT {_PY} FROM (SELECT '...' AS a, '...' AS b, '...' AS c)) || E'\\n# Tags: [#t]\\n# Raises: ValueError\\n# Calls: call, g' AS l2, {_HEAD} || ' ...' AS l3 FROM part
UNION ALL SELECT 'm.G' || p_partkey, E'func G(x int) {{\\n\\tlog.Print(x)\\n\\treturn x\\n}}', E'func G(x int) {{\\n\\treturn x\\n}}', E'func G(x int) ...\\n# Tags: []', 'func G(x int) ...' FROM part""")
def compressed_texts(t):
    key = F.col("p_partkey")
    p = t("part")
    python = _text("import os\n\ndef f", key, '(x, y=1):\n    """Doc."""\n    z = 1 + x\n    log.info(z)\n    v = call(x, ', key, ")\n    if v:\n        raise ValueError(x)\n    return g(v)\n")
    go = F.lit("package p\nfunc G(x int) {\n\tlog.Print(x)\n\treturn x\n}\n")
    files = p.select(_text(key, ".py").alias("path"), F.lit("python").alias("language"), python.alias("source")).unionByName(p.select(_text(key, ".go").alias("path"), F.lit("go").alias("language"), go.alias("source")))
    words = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    row = lambda q, path, name, start, end, tags, calls: p.select(q.alias("qname"), path.alias("path"), name.alias("name"), F.lit(start).alias("start"), F.lit(end).alias("end"), words(*tags).alias("tags"), words(*calls).alias("calls"))
    found = row(_text("m.f", key), _text(key, ".py"), _text("f", key), 3, 10, ("#t",), ("call", "g")).unionByName(row(_text("m.G", key), _text(key, ".go"), F.lit("G"), 2, 5, (), ()))
    return texts.compress(files, found)


@query("""WITH x AS (SELECT o_custkey AS query, o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'callee' ELSE 'transitive' END AS role, o_orderkey % 7 AS distance, 30 + o_orderkey % 50 AS full_cost, 5 + o_orderkey % 9 AS stub_cost FROM orders),
y AS (SELECT *, sum(full_cost) OVER (PARTITION BY query) AS total, coalesce(sum(CASE WHEN role = 'transitive' THEN full_cost - stub_cost ELSE 0 END) OVER (PARTITION BY query ORDER BY role = 'transitive' DESC, distance DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved FROM x)
SELECT query, id, role = 'transitive' AND total - saved > 200 * 1.05 AS stub FROM y""")
def enforce_render_budget(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(F.col("o_custkey").alias("query"), k.alias("id"), F.when(k % 4 == 0, "callee").otherwise("transitive").alias("role"), (k % 7).alias("distance"), F.lit(200).alias("budget"), (30 + k % 50).alias("full_cost"), (5 + k % 9).alias("stub_cost"))
    return texts.enforce_budget(rows).select("query", "id", "stub")


@query("""WITH r AS (SELECT o_custkey AS q, o_orderkey AS ord, 'k' || (o_orderkey % 9) AS c FROM orders), f AS (SELECT q, c, min(ord) AS ord FROM r GROUP BY q, c), g AS (SELECT q, ord, list(c ORDER BY c) AS constants FROM f GROUP BY q, ord)
SELECT q AS query, 's' || ord AS qname, constants FROM g""")
def bundled_constants(t):
    rows = t("orders").select(F.col("o_custkey").alias("query"), _text("s", F.col("o_orderkey")).alias("qname"), F.col("o_orderkey").alias("ord"), F.lit(None).cast("int").alias("left"))
    references = t("orders").select(_text("s", F.col("o_orderkey")).alias("qname"), _text("k", F.col("o_orderkey") % 9).alias("constant"), F.lit(3).alias("cost"))
    return texts.bundle_constants(rows, references)


@query("SELECT p_brand AS query, count(*) <= 3 OR sum(p_size) < 1200 AS compact FROM part GROUP BY 1")
def compact_mode(t):
    return texts.compact_mode(t("part").select(F.col("p_brand").alias("query"), F.col("p_size").alias("tokens")))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['A', 'C'] ELSE ['A'] END AS constants FROM part""")
def referenced_constants(t):
    names = F.array(F.lit("C"), F.lit("A"), F.lit("x"), F.lit("B"))
    bound = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("B"))).otherwise(F.array(F.lit("B"), F.lit("C")))
    return t("part").select("p_partkey", texts.referenced_constants(names, F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D")), bound).alias("constants"))


@query(f"""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'class' ELSE 'function' END AS kind, p_partkey % 6 AS n FROM part),
c AS (SELECT 'c' || p_partkey AS qname, kind = 'class' AND n IN (0, 2) AS t FROM s)
SELECT 'c' || s.p_partkey AS qname, CASE WHEN kind = 'class' THEN CASE WHEN n IN (0, 2) THEN 'verification' ELSE 'implementation' END
  WHEN coalesce(o.t, false) OR n = 1 OR n = 3 OR n = 5 AND s.p_partkey % 5 < 3 THEN 'verification' WHEN s.p_partkey % 7 = 0 THEN 'interface' ELSE 'implementation' END AS role FROM s LEFT JOIN c o ON o.qname = 'c' || (s.p_partkey - s.p_partkey % 4)""")
def symbol_roles(t):
    key = F.col("p_partkey")
    n, none = key % 6, F.array().cast("array<string>")
    one = lambda when, *x: F.when(when, F.array(*map(F.lit, x))).otherwise(none)
    is_class = key % 4 == 0
    calls = F.when((n == 5) & (key % 5 == 0), F.array(F.lit("self.assertEqual"), F.lit("x"))).when((n == 5) & (key % 5 < 3), F.concat(F.array(F.lit("assertTrue")), F.array_repeat(F.lit("f"), 20))).otherwise(none)
    rows = t("part").select(
        _text("c", key).alias("qname"), F.when(is_class, "class").otherwise("function").alias("kind"), F.when(is_class & (n == 0), "OrderTest").when(~is_class & (n == 1), "test_x").otherwise("work").alias("name"), F.when(~is_class, _text("c", key - key % 4)).alias("enclosing_class"),
        F.lit("python").alias("language"), one(is_class & (n == 2), "unittest.TestCase").alias("bases"), one(~is_class & (n == 3), "pytest.fixture").alias("decorators"), calls.alias("calls"), F.lit("").alias("parameters"), ((n == 5) & (key % 5 == 0)).alias("returns"), (key % 7 == 0).alias("empty_body"),
    )
    return profiles.symbol_roles(rows)


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['cb:typing.Callable[[int], str]'] WHEN 1 THEN ['fn:func(int) error'] ELSE ['go:(x: number) => void'] END AS callbacks FROM part""")
def callback_parameters(t):
    key = F.col("p_partkey")
    language = F.element_at(F.array(F.lit("python"), F.lit("go"), F.lit("typescript")), (key % 3 + 1).cast("int"))
    p = lambda name, kind: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"))
    params = F.array(p("cb", "typing.Callable[[int], str]"), p("fn", "func(int) error"), p("go", "(x: number) => void"), p("n", "int"), p("none", None))
    return t("part").select("p_partkey", F.transform(profiles.callback_parameters(language, params), lambda x: F.concat_ws(":", x["name"], x["type"])).alias("callbacks"))


_SEEDED = f"""{FK}, seed AS (SELECT 'n:' || n_nationkey AS q FROM nation WHERE n_nationkey < 4 UNION ALL SELECT 's:' || s_suppkey FROM supplier WHERE s_suppkey <= 3),
e AS (SELECT src, dst, length(src) % 2 = 0 AS rb FROM fk WHERE src NOT LIKE 'o:%' AND src NOT LIKE 'c:%'), b(q, node, h) AS (SELECT q, q, 0 FROM seed UNION SELECT q, dst, h + 1 FROM b JOIN e ON src = node), h AS (SELECT q, node, min(h) AS h FROM b GROUP BY 1, 2), f AS (SELECT q, max(h) + 1 AS far FROM h GROUP BY q),
w AS (SELECT f.q, e.src, e.dst, 1.0 / CASE WHEN h.h >= 1 THEN h.h ELSE far END * (1 + CASE WHEN rb THEN 1.5 ELSE 1.0 END * ln(1 + length(e.dst) % 3)) AS w FROM e CROSS JOIN f LEFT JOIN h ON h.q = f.q AND h.node = e.dst)"""


@query(f"WITH RECURSIVE {_SEEDED} SELECT q AS query, src, dst, dst LIKE 'r:%' AS absorbed, round(w / sum(w) OVER (PARTITION BY q, src), 6) AS p FROM w")
def seed_transitions(t):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    seeds = t("nation").where("n_nationkey < 4").select(key("n:", "n_nationkey").alias("node")).unionByName(t("supplier").where("s_suppkey <= 3").select(key("s:", "s_suppkey").alias("node")))
    edges = written(views.fk_edges(t).where("src NOT LIKE 'o:%' AND src NOT LIKE 'c:%'").select("src", "dst", (F.length("src") % 2 == 0).alias("return_bound"), F.lit("plain").alias("role")))
    nodes = edges.select(F.col("src").alias("node")).distinct()
    runs = edges.select("src", "dst", (F.length("dst") % 3).cast("double").alias("n")).distinct()
    found = flow.seed_transitions(edges, nodes, nodes.select("node", F.col("node").alias("scc")), seeds.select(F.col("node").alias("query"), "node"), runs)
    return found.withColumn("p", F.round("p", 6))


@query("SELECT l_partkey AS node, min_by('s' || l_suppkey, lpad((l_suppkey % 4)::VARCHAR, 4, '0') || 's' || l_suppkey) AS entry FROM lineitem GROUP BY 1")
def covering_flows(t):
    flows = t("supplier").select(_text("s", F.col("s_suppkey")).alias("entry"), (F.col("s_suppkey") % 4).alias("depth"))
    return contracts.covering_flows(t("lineitem").select(_text("s", F.col("l_suppkey")).alias("entry"), F.col("l_partkey").alias("node")), flows)


@query(f"""WITH {FK}, tg AS (SELECT 's:' || s_suppkey AS qname, CASE s_suppkey % 3 WHEN 0 THEN '#db_write' WHEN 1 THEN '#auth_guard' ELSE '#db_read' END AS tag FROM supplier),
c AS (SELECT src AS seed, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM (SELECT DISTINCT src, dst FROM fk WHERE src LIKE 'p:%')), x AS (SELECT 'p:' || p_partkey AS seed, 0 AS level, NULL AS relation, 'p:' || p_partkey AS node FROM part
  UNION ALL SELECT seed, 1, 'calls', dst FROM c WHERE k <= 6 UNION ALL SELECT DISTINCT seed, 2, 'requires', (SELECT min(qname) FROM tg WHERE tag = '#auth_guard') FROM c JOIN tg ON tg.qname = c.dst WHERE k <= 6 AND tag = '#db_write')
SELECT seed, node, min(level)::INTEGER AS level, min_by(coalesce(relation, ''), level) AS relation FROM x GROUP BY 1, 2""")
def architectural_paths(t):
    key = F.col("p_partkey")
    s = F.col("s_suppkey")
    tags = t("supplier").select(_text("s:", s).alias("qname"), F.when(s % 3 == 0, "#db_write").when(s % 3 == 1, "#auth_guard").otherwise("#db_read").alias("tag"))
    found = contracts.architectural_paths(t("part").select(_text("p:", key).alias("seed")), views.fk_edges(t), tags)
    return found.select("seed", "node", "level", F.coalesce("relation", F.lit("")).alias("relation"))


@query(f"""WITH {FK}, n AS (SELECT 'n:' || n_nationkey AS q, 'n:' || n_nationkey AS node FROM nation UNION SELECT dst, src FROM fk WHERE dst LIKE 'n:%' UNION SELECT b.dst, a.src FROM fk a JOIN fk b ON a.dst = b.src WHERE b.dst LIKE 'n:%')
SELECT x.q AS query, src, dst FROM (SELECT DISTINCT src, dst FROM fk) e JOIN n x ON x.node = e.src JOIN n y ON y.node = e.dst AND y.q = x.q""")
def ego_edges(t):
    key = F.concat(F.lit("n:"), F.col("n_nationkey").cast("string"))
    return graph.ego(written(views.fk_edges(t)), t("nation").select(key.alias("query"), key.alias("node")), 2, "reverse")
