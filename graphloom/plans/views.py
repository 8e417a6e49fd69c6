"""Graph views of the driver's tables: symbols, edges, traces and names, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


#: Kinds of nodes in the order of their numbers.
KINDS = ("o:", "c:", "p:", "s:", "n:", "r:", "x:<lambda>")


def number(prefix: str, column):
    """A node as a number: its key times 8 and its kind; what shuffles by node then carries 8 bytes."""
    return F.col(column).cast("long") * 8 + KINDS.index(prefix)


def named(node):
    """The name of a numbered node."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(node, F.lit(8)) + 1).cast("int"))
    return F.concat(kind, F.shiftright(node, 3).cast("string"))


def fk_edges(t, _key=_key) -> DataFrame:
    """Typed foreign-key graph (src, dst, relation): a DAG from orders down to regions. Nodes are names, or with number as _key numbers."""
    pairs = [
        t("orders").select(_key("o:", "o_orderkey").alias("src"), _key("c:", "o_custkey").alias("dst"), F.lit("CALLS").alias("relation")),
        t("lineitem").select("l_orderkey", "l_partkey").distinct().select(_key("o:", "l_orderkey").alias("src"), _key("p:", "l_partkey").alias("dst"), F.lit("INSTANTIATES").alias("relation")),
        t("lineitem").select("l_partkey", "l_suppkey").distinct().select(_key("p:", "l_partkey").alias("src"), _key("s:", "l_suppkey").alias("dst"), F.lit("CALLS").alias("relation")),
        t("customer").select(_key("c:", "c_custkey").alias("src"), _key("n:", "c_nationkey").alias("dst"), F.lit("EXTENDS").alias("relation")),
        t("supplier").select(_key("s:", "s_suppkey").alias("src"), _key("n:", "s_nationkey").alias("dst"), F.lit("EXTENDS").alias("relation")),
        t("nation").select(_key("n:", "n_nationkey").alias("src"), _key("r:", "n_regionkey").alias("dst"), F.lit("IMPLEMENTS").alias("relation")),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


FK_EDGES = """fk AS (
  SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst, 'CALLS' AS relation FROM orders
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'INSTANTIATES' FROM lineitem
  UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'CALLS' FROM lineitem
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'EXTENDS' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'EXTENDS' FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'IMPLEMENTS' FROM nation)"""


def symbols(t, _key=_key) -> DataFrame:
    """(qname, kind, module): orders, customers and parts are functions, the rest classes. Names or numbers as in fk_edges."""
    parts = [
        t("orders").select(_key("o:", "o_orderkey").alias("qname"), F.lit("function").alias("kind"), F.col("o_orderpriority").alias("module")),
        t("customer").select(_key("c:", "c_custkey").alias("qname"), F.lit("function").alias("kind"), F.concat(F.lit("nation."), F.col("c_nationkey").cast("string")).alias("module")),
        t("part").select(_key("p:", "p_partkey").alias("qname"), F.lit("function").alias("kind"), F.col("p_brand").alias("module")),
        t("supplier").select(_key("s:", "s_suppkey").alias("qname"), F.lit("class").alias("kind"), F.concat(F.lit("nation."), F.col("s_nationkey").cast("string")).alias("module")),
        t("nation").select(_key("n:", "n_nationkey").alias("qname"), F.lit("class").alias("kind"), F.lit("geo").alias("module")),
        t("region").select(_key("r:", "r_regionkey").alias("qname"), F.lit("class").alias("kind"), F.lit("geo").alias("module")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SYMBOLS = """sym AS (
  SELECT 'o:' || o_orderkey AS qname, 'function' AS kind, o_orderpriority AS module FROM orders
  UNION ALL SELECT 'c:' || c_custkey, 'function', 'nation.' || c_nationkey FROM customer
  UNION ALL SELECT 'p:' || p_partkey, 'function', p_brand FROM part
  UNION ALL SELECT 's:' || s_suppkey, 'class', 'nation.' || s_nationkey FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'class', 'geo' FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, 'class', 'geo' FROM region)"""


def transitions(t) -> DataFrame:
    """(src, dst, n): steps of a user's events; nodes are user:day:type, so cycles stay within a day."""
    from pyspark.sql import Window

    node = lambda at, kind: F.concat_ws(":", F.col("user_id").cast("string"), F.date_format(at, "yyyyMMdd"), kind)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")  # one user's events
    steps = t("events").select("user_id", "ts", "event_type", F.lead(F.struct("ts", "event_type")).over(w).alias("next")).where("next IS NOT NULL")
    named = steps.select("user_id", node("ts", "event_type").alias("src"), node("next.ts", "next.event_type").alias("dst"))
    # a node names its user, so these groups need no shuffle but the window's
    return named.where("src <> dst").groupBy("user_id", "src", "dst").agg(F.count("*").alias("n")).drop("user_id")


TRANSITIONS = """tr AS (SELECT src, dst, count(*)::BIGINT AS n FROM (
  SELECT node AS src, lead(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM (
    SELECT *, user_id || ':' || strftime(ts, '%Y%m%d') || ':' || event_type AS node FROM events)) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""


def part_paths(t) -> DataFrame:
    """(p_partkey, path, module, qname, language, mask): parts as source files and symbols."""
    name = F.translate("p_name", " ", "_")
    ext = F.element_at(F.array(*(F.lit(x) for x in (".py", ".go", ".ts", "_test.py", "/__init__.py"))), (F.col("p_size") % 5 + 1).cast("int"))
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), name, ext)
    brand = F.lower(F.translate("p_brand", "#", "_"))
    mask = F.expr("(shiftleft(1L, p_size % 7) | shiftleft(1L, 10 + p_partkey % 10) | shiftleft(1L, cast(25 + p_partkey % 9 as int)) | shiftleft(1L, cast(35 + p_size % 7 as int)))")
    language = F.when(ext == ".go", "go").when(ext == ".ts", "typescript").otherwise("python")
    return t("part").select("p_partkey", path.alias("path"), F.concat(F.lower("p_type"), F.lit("."), name, F.lit("."), brand).alias("module"), F.concat(name, F.lit("."), brand, F.lit(".f"), F.col("p_partkey").cast("string")).alias("qname"), language.alias("language"), mask.alias("mask"), "p_size", "p_name", "p_brand", "p_type", "p_retailprice")


PART_PATHS = """pp AS (SELECT p_partkey, 'src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || ext AS path,
  lower(p_type) || '.' || replace(p_name, ' ', '_') || '.' || lower(replace(p_brand, '#', '_')) AS module,
  replace(p_name, ' ', '_') || '.' || lower(replace(p_brand, '#', '_')) || '.f' || p_partkey AS qname,
  CASE ext WHEN '.go' THEN 'go' WHEN '.ts' THEN 'typescript' ELSE 'python' END AS language,
  (1::BIGINT << (p_size % 7)) | (1::BIGINT << (10 + p_partkey % 10)) | (1::BIGINT << (25 + p_partkey % 9)) | (1::BIGINT << (35 + p_size % 7)) AS mask,
  p_size, p_name, p_brand, p_type, p_retailprice
  FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.ts' WHEN 3 THEN '_test.py' ELSE '/__init__.py' END AS ext FROM part))"""


def trace_events(t, _key=_key) -> DataFrame:
    """Call events from lineitem: an order calls a part in an environment; a share of the parts isn't known statically. Names or numbers as in fk_edges."""
    env = F.element_at(F.array(*(F.lit(x) for x in ("unit", "integration", "e2e", "staging", "prod"))), (F.pmod(F.col("l_suppkey"), F.lit(5)) + 1).cast("int"))
    unknown = F.col("l_linenumber") == 7
    return t("lineitem").select(
        _key("o:", "l_orderkey").alias("caller"), F.when(unknown, _key("x:<lambda>", "l_partkey")).otherwise(_key("p:", "l_partkey")).alias("callee"),
        env.alias("env"), F.when(F.col("l_returnflag") == "R", "otel").otherwise("tracer").alias("source"), F.col("l_quantity").cast("long").alias("count"), (F.col("l_returnflag") == "R").cast("long").alias("errors"), F.col("l_partkey").alias("line"),
    )


TRACE_EVENTS = """te AS (SELECT 'o:' || l_orderkey AS caller, CASE WHEN l_linenumber = 7 THEN 'x:<lambda>' || l_partkey ELSE 'p:' || l_partkey END AS callee,
  CASE l_suppkey % 5 WHEN 0 THEN 'unit' WHEN 1 THEN 'integration' WHEN 2 THEN 'e2e' WHEN 3 THEN 'staging' ELSE 'prod' END AS env,
  CASE WHEN l_returnflag = 'R' THEN 'otel' ELSE 'tracer' END AS source, l_quantity::BIGINT AS count, (l_returnflag = 'R')::BIGINT AS errors, l_partkey AS line FROM lineitem)"""
