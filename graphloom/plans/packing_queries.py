"""Queries over budgeted selection, packages and their rendering, and parsed source text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import compress, graph, joins, linking, packing, profiles, reports, surface
from ..sources import python_source
from ..storage import written
from . import views
from .catalog import query

FK, SYM, P = views.FK_EDGES, views.SYMBOLS, views.PART_PATHS


def _key(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _candidates(t):
    """For each part as a seed: what it reaches, with distances, masks and costs, and its orders as callers."""
    edges = written(views.fk_edges(t))
    seeds = t("part").select(_key("p:", "p_partkey").alias("query"), _key("p:", "p_partkey").alias("node"))
    cost = edges.withColumn("cost", scores.edge_cost(scores.relation_weight(F.col("relation"))))
    reach = graph.distances(cost.where("src NOT LIKE 'o:%'"), seeds, 6.0).select("query", F.col("node").alias("qname"), F.col("dist").alias("distance"))
    own = seeds.select("query", F.col("node").alias("qname"), F.lit(0.0).alias("distance"))
    up = edges.where("src LIKE 'o:%' AND dst LIKE 'p:%'").select(F.col("dst").alias("query"), F.col("src").alias("qname"), (F.lit(1.0) / (1 + F.length("src") % 3 * 0.3)).alias("upstream"))
    succ = edges.where("src NOT LIKE 'o:%'").groupBy(F.col("src").alias("qname")).agg(F.collect_set("dst").alias("successors"))
    mask = F.expr("shiftleft(1L, cast(pmod(crc32(qname), 42) as int)) | shiftleft(1L, cast(pmod(crc32(qname), 7) as int))")
    df = own.unionByName(reach).join(up, ["query", "qname"], "full").join(succ, "qname", "left")
    return df.select(
        "query", F.col("query").alias("seed"), F.lit(120).alias("budget"), "qname", "distance", "upstream", F.coalesce(F.col("upstream") < 0.8, F.lit(False)).alias("preserving"), mask.alias("mask"),
        (5 + F.pmod(F.crc32("qname"), F.lit(20))).cast("int").alias("cost"), F.substring_index("qname", ":", 1).alias("module"), F.lit(False).alias("verification"), "successors",
    )


@query()
def submodular_packing(t):
    """Greedy packages of all parts as seeds (invariants and hand-worked cases in tests)."""
    return packing.select_submodular(_candidates(t))


@query()
def distance_packing(t):
    """Packages by distance with falling resolution, for each brand's parts (hand-worked cases in tests)."""
    p = views.part_paths(t)
    cost = lambda k: (F.col("p_size") * k + 5).cast("int")
    df = p.select(F.col("p_brand").alias("query"), F.lit(600).alias("budget"), "qname", (F.col("p_retailprice") % 100 / 100).alias("distance"), (F.col("p_size") < 3).alias("protected"), cost(4).alias("c0"), cost(3).alias("c1"), cost(2).alias("c2"), cost(1).alias("c3"))
    return packing.pack_by_distance(df)


@query("""WITH RECURSIVE r AS (SELECT o_custkey AS query, o_orderkey AS qname, floor(o_totalprice / 1000)::BIGINT AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders),
f(query, ord, admitted, used) AS (SELECT query, ord, cost <= 900, CASE WHEN cost <= 900 THEN cost ELSE 0 END FROM r WHERE ord = 1 UNION ALL SELECT r.query, r.ord, used + cost <= 900, CASE WHEN used + cost <= 900 THEN used + cost ELSE used END FROM f JOIN r ON r.query = f.query AND r.ord = f.ord + 1)
SELECT query, ord::INTEGER AS ord, admitted, used::BIGINT AS running_cost FROM f""")
def first_fit_external(t):
    from pyspark.sql import Window

    o = t("orders").select(F.col("o_custkey").alias("query"), F.lit(900).alias("budget"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ord"), F.col("o_orderkey").alias("qname"), F.floor(F.col("o_totalprice") / 1000).alias("cost"))
    return packing.first_fit(o).select("query", "ord", "admitted", "running_cost")


@query("SELECT p_partkey, CASE WHEN p_size * 4 <= 60 THEN 0 WHEN p_size * 3 <= 60 THEN 1 WHEN p_size * 2 <= 60 THEN 2 ELSE 3 END::INTEGER AS resolution FROM part")
def degrade_seed_to_fit(t):
    return t("part").select("p_partkey", packing.degrade_to_fit(F.lit(60), *(F.col("p_size") * k for k in (4, 3, 2, 1))).alias("resolution"))


@query(f"WITH {FK} SELECT 'p:' || p_partkey AS seed, n.node AS qname, CASE WHEN n.node = 'p:' || p_partkey THEN 'seed' WHEN e.src IS NOT NULL THEN 'callee' ELSE 'caller' END AS role FROM part JOIN (SELECT 'p:' || p_partkey AS k, 'p:' || p_partkey AS node FROM part UNION SELECT src, dst FROM fk WHERE src LIKE 'p:%' UNION SELECT dst, src FROM fk WHERE dst LIKE 'p:%') n ON n.k = 'p:' || p_partkey LEFT JOIN fk e ON e.src = n.k AND e.dst = n.node")
def package_roles(t):
    e = views.fk_edges(t)
    down = e.where("src LIKE 'p:%'").select(F.col("src").alias("seed"), F.col("dst").alias("qname"), F.lit(True).alias("direct"), F.lit(1.0).alias("distance"), F.lit(None).cast("double").alias("upstream"))
    up = e.where("dst LIKE 'p:%'").select(F.col("dst").alias("seed"), F.col("src").alias("qname"), F.lit(False), F.lit(None).cast("double"), F.lit(0.8))
    own = t("part").select(_key("p:", "p_partkey").alias("seed"), _key("p:", "p_partkey").alias("qname"), F.lit(False), F.lit(0.0), F.lit(None).cast("double"))
    df = down.union(up).union(own)
    return df.select("seed", "qname", packing.role_in_package(F.col("qname"), F.col("seed"), F.col("direct"), F.col("distance"), F.col("upstream")).alias("role"))


_NODE = """'<node distance="' || CASE WHEN p_size = 1 THEN '0.0' ELSE printf('%.1f', p_size / 10.0) END || '" end="' || p_size || '" file="' || path || '" id="' || qname || '" kind="' || p_type || '" role="' || CASE WHEN p_size = 1 THEN 'seed' ELSE 'callee' END || '" start="1"><body><![CDATA[' || p_name || ']]></body></node>'"""


@query(f"""WITH {P}, n AS (SELECT p_brand AS query, string_agg({_NODE}, chr(10) ORDER BY p_size <> 1, p_size, qname) AS nodes, sum(p_size)::BIGINT AS used FROM pp GROUP BY 1),
b AS (SELECT *, '<nodes>' || chr(10) || nodes || chr(10) || '</nodes>' || chr(10) || '<edges>' || chr(10) || '</edges>' || chr(10) || '<warnings>' || chr(10) || CASE WHEN used > 1500 THEN '<warning code="BUDGET_OVERFLOW" severity="warning"/>' || chr(10) ELSE '' END || '</warnings>' || chr(10) AS body FROM n)
SELECT query, '<context budget="1500" seed="' || query || '" used="' || used || '" version="3">' || chr(10) || body || '<trailer sha256="' || sha256(body) || '" tokens="' || used || '"/>' || chr(10) || '</context>' || chr(10) AS xml FROM b""")
def render_xml(t):
    p = views.part_paths(t)
    seed = F.col("p_size") == 1
    nodes = p.select(F.col("p_brand").alias("query"), F.col("qname").alias("id"), F.when(seed, "seed").otherwise("callee").alias("role"), F.when(seed, 0.0).otherwise(F.col("p_size") / 10.0).alias("distance"), F.col("p_type").alias("kind"), F.col("path").alias("file"), F.lit(1).alias("start"), F.col("p_size").alias("end"), F.col("p_name").alias("body"))
    packages = p.groupBy(F.col("p_brand").alias("query")).agg(F.first("p_brand").alias("seed"), F.lit(1500).alias("budget"), F.sum("p_size").alias("used"))
    spark = nodes.sparkSession
    return surface.render_xml(packages, nodes, spark.createDataFrame([], "query string, src string, dst string, relation string"), spark.createDataFrame([], "query string, code string, severity string"))


@query(f"WITH {P} SELECT p_brand AS query, '# ' || p_brand || chr(10) || chr(10) || string_agg('## ' || qname || ' (callee, ' || printf('%.1f', p_size::DOUBLE) || ')' || chr(10) || '```' || chr(10) || p_name || chr(10) || '```' || chr(10), chr(10) ORDER BY p_size, qname) AS markdown FROM pp GROUP BY 1")
def render_markdown(t):
    p = views.part_paths(t)
    nodes = p.select(F.col("p_brand").alias("query"), F.col("qname").alias("id"), F.lit("callee").alias("role"), F.col("p_size").cast("double").alias("distance"), F.col("p_name").alias("body"))
    return surface.render_markdown(t("part").select(F.col("p_brand").alias("query"), F.col("p_brand").alias("seed")).distinct(), nodes)


@query(f"WITH {FK}, nd AS (SELECT 's:' || s_suppkey AS query, 's:' || s_suppkey AS id FROM supplier UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION SELECT 's:' || s_suppkey, 'r:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT a.query, src, dst, relation FROM fk JOIN nd a ON a.id = src JOIN nd b ON b.query = a.query AND b.id = dst")
def induced_edges(t):
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    q = _key("s:", "s_suppkey").alias("query")
    nodes = s.select(q, F.explode(F.array(_key("s:", "s_suppkey"), _key("n:", "s_nationkey"), _key("r:", "n_regionkey"))).alias("id"))
    return surface.induced_edges(nodes, views.fk_edges(t))


@query()
def causal_path(t):
    """Path from each supplier to its best sink in a small package (brute force by hand-worked cases in tests)."""
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    q = _key("s:", "s_suppkey").alias("query")
    nodes = s.select(q, F.posexplode(F.array(_key("s:", "s_suppkey"), _key("n:", "s_nationkey"), _key("r:", "n_regionkey"))).alias("k", "id"))
    nodes = nodes.select("query", "id", F.when(F.col("k") == 0, "seed").otherwise("callee").alias("role"), F.col("k").cast("double").alias("distance"), F.expr("shiftleft(1L, cast(pmod(crc32(id), 7) as int))").alias("mask"))
    return surface.causal_paths(surface.induced_edges(nodes, views.fk_edges(t)), nodes).select("query", F.array_join("path", ">").alias("path"))


@query("""SELECT p_partkey, 'm' || p_partkey || '.f' || p_size AS qname, 1 + (p_size % 3) AS complexity, (p_size % 2 + 1)::INTEGER AS n_params, p_size % 2 = 0 AS is_async FROM part""")
def parse_python_definitions(t):
    """Definitions of one small Python module per part, made from its columns and parsed again."""
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), lambda i: F.when(i == 0, F.lit("    y = 1")).otherwise(F.concat(F.lit("    if y > "), i.cast("string"), F.lit(": y = 2")))), "\n")
    head = F.concat(F.when(F.col("p_size") % 2 == 0, "async ").otherwise(""), F.lit("def f"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "(a)").otherwise("(a, b: int = 2)"), F.lit(":\n"))
    files = t("part").select(F.concat(_key("m", "p_partkey"), F.lit(".py")).alias("path"), _key("m", "p_partkey").alias("module"), F.concat(head, body).alias("content"))
    rows = python_source.symbols_of(python_source.parse_files(files))
    return rows.select(F.substring("module", 2, 20).cast("long").alias("p_partkey"), "qname", "complexity", F.size("params").alias("n_params"), "is_async")


@query("SELECT 'm' || p_partkey || '.caller' AS src, CASE WHEN p_size % 2 = 0 THEN 'm' || p_partkey || '.Helper.run' ELSE 'lib.io.run' END AS dst, 'CALLS' AS relation FROM part UNION ALL SELECT 'm' || p_partkey || '.caller', 'm' || p_partkey || '.Helper', 'INSTANTIATES' FROM part WHERE p_size % 2 = 0")
def parse_python_edges(t):
    """Call edges of one small Python module per part: through a bound instance, or an import."""
    bound = F.lit("class Helper:\n    def run(self): pass\ndef caller():\n    h = Helper()\n    h.run()\n")
    imported = F.lit("from lib import io as x\ndef caller():\n    x.run()\n")
    files = t("part").select(F.concat(_key("m", "p_partkey"), F.lit(".py")).alias("path"), _key("m", "p_partkey").alias("module"), F.when(F.col("p_size") % 2 == 0, bound).otherwise(imported).alias("content"))
    return python_source.edges_of(written(python_source.parse_files(files))).select("src", "dst", "relation")


@query("SELECT sink, CASE WHEN sink IN ('a.ship', 'x.REG AIR', 'FOB') THEN 'IO_NETWORK' WHEN sink LIKE '%.click' THEN 'UI_RENDER' WHEN sink LIKE '%.error' THEN 'ASSERT_SIGNAL' WHEN flag = 'DISK_IO' THEN 'IO_STORAGE' WHEN pure AND flag IS NULL THEN 'PURE_LEAF' ELSE 'PROC_LIFECYCLE' END AS effect FROM (SELECT event_id || '.' || event_type AS sink, CASE WHEN user_id % 3 = 0 THEN 'DISK_IO' END AS flag, user_id % 2 = 0 AS pure FROM events)")
def classify_sinks(t):
    from ..operators.flow import classify_sinks as classify

    sinks = t("events").select(F.concat_ws(".", F.col("event_id").cast("string"), "event_type").alias("sink"), F.when(F.col("user_id") % 3 == 0, "DISK_IO").alias("effect_flag"), (F.col("user_id") % 2 == 0).alias("pure"))
    taxonomy = sinks.sparkSession.createDataFrame([("click", "UI_RENDER"), ("error", "ASSERT_SIGNAL"), ("a.ship", "IO_NETWORK")], "path string, basis string")
    return classify(sinks, taxonomy)


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'PUBLIC_API_ROUTE' WHEN user_id % 4 = 0 THEN 'TEST_HARNESS' WHEN event_type = 'click' THEN 'CLI_COMMAND' ELSE 'INTERNAL_EVENT' END AS category FROM events")
def categorize_entry_root(t):
    from ..operators.flow import entry_category

    name = F.when(F.col("event_type") == "click", "app.main").otherwise("app.work")
    file = F.when(F.col("user_id") % 4 == 0, "src/test_x.py").otherwise("src/x.py")
    tags = F.when(F.col("event_type") == "view", F.array(F.lit("#route_handler"))).otherwise(F.array().cast("array<string>"))
    return t("events").select("event_id", entry_category(name, file, tags).alias("category"))


@query("""SELECT p_partkey, CASE WHEN a > 0.5 AND d > 0.6 THEN 'VERIFICATION_ORACLE' WHEN u > 0.5 AND a < 0.2 THEN 'UI_STATE_MUTATOR' WHEN p = 1 AND p_size % 2 = 0 THEN 'PURE_TRANSFORMER_LEAF' WHEN c >= 0.85 THEN 'ARCHITECTURAL_CHOKEPOINT' WHEN p_size % 5 > 2 AND d BETWEEN 0.2 AND 0.5 THEN 'COMPOSITE_ORCHESTRATOR' ELSE 'GENERAL_LOGIC_UNIT' END AS archetype
FROM (SELECT *, p_partkey % 11 / 10.0 AS a, p_partkey % 7 / 6.0 AS u, (p_partkey % 3) / 2.0 AS p, p_size / 50.0 AS d, (p_partkey % 13) / 12.0 AS c FROM part)""")
def symbol_archetypes(t):
    from ..operators.flow import archetype

    k = F.col("p_partkey")
    return t("part").select("p_partkey", archetype(k % 11 / 10.0, k % 7 / 6.0, (k % 3) / 2.0, F.col("p_size") % 2 == 0, F.col("p_size") / 50.0, (k % 13) / 12.0, F.col("p_size") % 5).alias("archetype"))


@query(f"WITH {P}, w AS (SELECT p_brand AS module, p_partkey % 3 = 0 AS pure, p_size % 4 AS c FROM pp) SELECT module, round(avg(pure::INT), 4) AS purity_ratio, CASE WHEN max(c) = 0 THEN 'STATELESS' WHEN bool_or(c = 1) THEN 'LEAKY_GLOBAL_MUTATION' ELSE 'ENCAPSULATED_MUTATION' END AS state_locality FROM w GROUP BY module")
def module_contracts(t):
    p = views.part_paths(t)
    symbols = p.select("qname", F.lit("function").alias("kind"), F.col("p_brand").alias("module"))
    changes = F.when(F.col("p_size") % 4 == 1, F.array(F.lit("counter"))).when(F.col("p_size") % 4 > 1, F.array(F.lit("self.x"))).otherwise(F.array().cast("array<string>"))
    contracts = p.select("qname", F.when(F.col("p_partkey") % 3 == 0, "pure").otherwise("impure").alias("purity"), changes.alias("state_mutations"))
    edges = p.select(F.col("qname").alias("src"), F.lit("x").alias("dst"), F.lit("CALLS").alias("relation"))
    return profiles.subsystem_profile(edges, symbols, contracts).select("module", "purity_ratio", "state_locality")


@query(f"WITH {FK} SELECT DISTINCT b.dst AS seed, b.src AS direct, a.src AS transitive FROM fk b JOIN fk a ON a.dst = b.src WHERE b.dst LIKE 's:%' AND a.relation = 'INSTANTIATES'")
def callers_of_callers(t):
    edges = views.fk_edges(t).where("relation = 'INSTANTIATES' OR dst LIKE 's:%'")
    return linking.transitive_callers(edges, t("supplier").select(_key("s:", "s_suppkey").alias("id")))


@query(r"""SELECT doc_id, CAST(regexp_matches(text, '(?i)\b' || source || '\b') AS INTEGER) - CAST(regexp_matches(text, '(?i)\bthe\b\s+(?:is|replaces|equals|is the same as)\s+\b' || source || '\b') AS INTEGER) AS score FROM documents WHERE text IS NOT NULL""")
def mention_recall(t):
    rows = t("documents").where("text IS NOT NULL")
    return rows.select("doc_id", reports.rubric_score(F.col("text"), F.concat(F.lit("a."), "source"), F.array(F.lit("x.the"))).alias("score"))


@query(f"WITH {FK}, {SYM}, c AS (SELECT src, count(*) AS n FROM fk WHERE relation IN ('CALLS', 'INSTANTIATES') GROUP BY src) SELECT kind, count(*)::BIGINT AS symbols, count(DISTINCT module)::BIGINT AS modules, coalesce(sum(n), 0)::BIGINT AS calls FROM sym LEFT JOIN c ON c.src = qname GROUP BY kind")
def graph_status(t):
    return reports.graph_status(views.symbols(t), views.fk_edges(t))


@query("SELECT 'BUILDING' AS tag, c_custkey AS symbol, count(o_orderkey)::BIGINT AS invocations FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2")
def find_symbols_by_tag(t):
    return reports.symbols_by_tag(t("customer").select(F.col("c_custkey").alias("symbol"), F.array("c_mktsegment").alias("tags")), "BUILDING", t("orders").select(F.col("o_custkey").alias("symbol")))


@query("SELECT p_partkey, p_size < 20 AND p_partkey % 4 <= 2 AND p_partkey % 3 > 0 AND p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS infallible FROM part")
def infallible_symbols(t):
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    one = lambda when, x: F.when(when, F.array(F.lit(x))).otherwise(none)
    return t("part").select("p_partkey", compress.infallible(F.when(F.col("p_size") < 20, "pure").otherwise("impure"), k % 4, one(k % 3 == 0, "KeyError"), one(k % 5 == 0, "DISK_IO"), one(k % 7 == 0, "#db_read")).alias("infallible"))


@query("SELECT o_orderkey, substr(o_orderpriority, 1, 1)::INT AS priority, starts_with('o:' || o_orderkey, prefix) AS hit, prefix FROM orders, (SELECT 'o:1' AS prefix)")
def longest_root_import(t):
    df = t("orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), _key("o:", "o_orderkey").alias("name"))
    found = joins.longest_prefix(df, df.sparkSession.createDataFrame([("o:1",)], "prefix string"), "name", "prefix")
    return found.select("o_orderkey", "priority", F.col("prefix").isNotNull().alias("hit"), F.lit("o:1").alias("prefix"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'os.path' WHEN 1 THEN CASE WHEN n_regionkey = 0 THEN 'a.b.' || n_name ELSE 'a.b' END || '.z' WHEN 2 THEN CASE WHEN n_regionkey = 0 THEN 'a.b' ELSE 'a' END ELSE CASE WHEN n_regionkey = 0 THEN 'a.z' ELSE 'z' END END AS module FROM nation""")
def relative_module(t):
    level = F.col("n_nationkey") % 4
    name = F.when(level == 0, "os.path").when(level != 2, "z")
    return t("nation").select("n_nationkey", text.relative_module(F.concat(F.lit("a.b."), "n_name"), F.col("n_regionkey") == 0, level, name).alias("module"))


@query("""SELECT 'f' || p_partkey || '.py' AS path, pattern, text, line::INTEGER AS line FROM (SELECT p_partkey, unnest([{'pattern': 'definitions', 'text': 'K' || p_partkey, 'line': 2}, {'pattern': 'definitions', 'text': 'run', 'line': 4}, {'pattern': 'imports', 'text': 'import os', 'line': 1},
  {'pattern': 'calls', 'text': 'os.getcwd', 'line': 5}, {'pattern': 'calls', 'text': 'app.get', 'line': 3}, {'pattern': 'calls', 'text': 'g' || p_size, 'line': 5}, {'pattern': 'decorators', 'text': 'app.get(''/x'')', 'line': 4}], recursive := true) FROM part)""")
def source_captures(t):
    source = F.concat(F.lit("import os\nclass K"), F.col("p_partkey").cast("string"), F.lit(":\n    @app.get('/x')\n    def run(self):\n        return g"), F.col("p_size").cast("string"), F.lit("(os.getcwd())\n"))
    sources = written(t("part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), source.alias("content")))
    found = [python_source.captures(sources, p) for p in python_source.PATTERNS]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
