"""Queries over graph analytics and absorbing walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow, graph
from ..operators.profiles import subsystem_profile as profile
from ..storage import written
from . import views
from .catalog import query

FK, SYM, TR = views.FK_EDGES, views.SYMBOLS, views.TRANSITIONS


@query(f"""WITH {FK}, {SYM}, fn AS (SELECT * FROM sym WHERE kind = 'function'),
e AS (SELECT a.module AS u, b.module AS v, fk.dst FROM fk JOIN fn a ON a.qname = fk.src LEFT JOIN fn b ON b.qname = fk.dst WHERE relation IN ('CALLS', 'INSTANTIATES')),
o AS (SELECT u AS module, count(*) FILTER (v = u)::BIGINT AS internal, count(*) FILTER (v IS NULL OR v <> u)::BIGINT AS ce FROM e GROUP BY u),
i AS (SELECT v AS module, count(*)::BIGINT AS ca FROM e WHERE v IS NOT NULL AND v <> u GROUP BY v),
s AS (SELECT module, list(dst ORDER BY k) AS sinks FROM (SELECT u AS module, dst, row_number() OVER (PARTITION BY u ORDER BY count(*) DESC, dst) AS k FROM e WHERE v IS NULL GROUP BY u, dst) WHERE k <= 3 GROUP BY module),
m AS (SELECT module, count(*)::BIGINT AS symbol_count FROM fn GROUP BY module)
SELECT m.module, symbol_count, round(CASE WHEN coalesce(internal, 0) + coalesce(ce, 0) > 0 THEN internal::DOUBLE / (internal + ce) ELSE 1 END, 4) AS cohesion_score,
  round(CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0)::DOUBLE / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0 END, 4) AS coupling_instability, coalesce(s.sinks, []) AS dominant_sinks
FROM m LEFT JOIN o ON m.module = o.module LEFT JOIN i ON m.module = i.module LEFT JOIN s ON m.module = s.module""")
def subsystem_profile(t):
    return profile(views.fk_edges(t, views.number), views.symbols(t, views.number), named=views.named).select("module", "symbol_count", "cohesion_score", "coupling_instability", "dominant_sinks")


@query(f"""WITH RECURSIVE {FK}, b(node, hops) AS (SELECT 'o:' || o_orderkey, 0 FROM orders WHERE o_orderstatus = 'F' UNION SELECT dst, hops + 1 FROM b JOIN fk ON src = node WHERE hops < 10)
SELECT node, min(hops)::INTEGER AS hops FROM b GROUP BY node""")
def multi_source_bfs(t):
    sources = t("orders").where("o_orderstatus = 'F'").select(F.lit(0).alias("query"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.bfs(views.fk_edges(t), sources).select("node", "hops")


@query(f"""WITH RECURSIVE {FK}, b(seed, node, hops) AS (SELECT 'r:' || r_regionkey, 'r:' || r_regionkey, 0 FROM region UNION SELECT seed, src, hops + 1 FROM b JOIN fk ON dst = node WHERE hops < 2)
SELECT seed, node, min(hops)::INTEGER AS hops FROM b GROUP BY seed, node""")
def bounded_reverse_reach(t):
    key = F.concat(F.lit("r:"), F.col("r_regionkey").cast("string"))
    return graph.bfs(views.fk_edges(t), t("region").select(key.alias("query"), key.alias("node")), "reverse", 2).select(F.col("query").alias("seed"), "node", "hops")


_COST = "1 / CASE relation WHEN 'EXTENDS' THEN 0.85 WHEN 'IMPLEMENTS' THEN 0.8 ELSE 1.0 END::DOUBLE"


@query(f"""WITH RECURSIVE {FK}, e AS (SELECT src, dst, {_COST} AS cost FROM fk), b(seed, node, dist) AS (SELECT 'r:' || r_regionkey, 'r:' || r_regionkey, 0.0::DOUBLE FROM region UNION SELECT seed, src, dist + cost FROM b JOIN e ON dst = node WHERE dist + cost <= 5.0)
SELECT seed, node, round(min(dist), 6) AS dist FROM b WHERE node <> seed GROUP BY seed, node""")
def topological_distances(t):
    from ..functions import scores

    key = F.concat(F.lit("r:"), F.col("r_regionkey").cast("string"))
    edges = views.fk_edges(t).withColumn("cost", scores.edge_cost(scores.relation_weight(F.col("relation"))))
    found = graph.distances(edges, t("region").select(key.alias("query"), key.alias("node")), 5.0, "reverse")
    return found.select(F.col("query").alias("seed"), "node", F.round("dist", 6).alias("dist"))


@query(f"""WITH {FK}, ends AS (SELECT src AS node, 0 AS i, 1 AS o FROM fk UNION ALL SELECT dst, 1, 0 FROM fk)
SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out, CASE WHEN sum(i) >= 5 AND sum(o) <= 1 THEN 'leaf_utility' WHEN sum(i) >= 5 AND sum(o) <= 2 THEN 'core_domain' WHEN sum(i) >= 5 THEN 'bridge'
  WHEN sum(i) <= 2 AND sum(o) >= 8 THEN 'coordinator' WHEN sum(i) BETWEEN 3 AND 4 AND sum(o) BETWEEN 3 AND 7 THEN 'adapter' END AS role FROM ends GROUP BY node""")
def degree_roles(t):
    from ..operators.profiles import class_role

    return graph.degrees(views.fk_edges(t)).withColumn("role", class_role(F.col("fan_in"), F.col("fan_out")))


def _parts_of_walk(t, key=views._key):
    edges = views.fk_edges(t, key).where("relation IN ('CALLS', 'INSTANTIATES')")
    internal = views.symbols(t, key).where("kind = 'function'").select(F.col("qname").alias("node"))
    identity = internal.select("node", F.col("node").alias("scc"))
    return edges, internal, flow.transition_table(edges, internal, identity)


_WALK = f"""{FK}, {SYM}, fn AS (SELECT qname FROM sym WHERE kind = 'function'), e AS (SELECT src, dst FROM fk WHERE relation IN ('CALLS', 'INSTANTIATES') AND src IN (SELECT qname FROM fn)),
tp AS (SELECT src, dst, dst NOT IN (SELECT qname FROM fn) AS absorbed, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS p FROM e),
m0 AS (SELECT src AS node, dst AS sink, p AS mass FROM tp WHERE absorbed),
m1 AS (SELECT tp.src AS node, sink, sum(p * mass) AS mass FROM tp JOIN m0 ON tp.dst = m0.node WHERE NOT absorbed GROUP BY 1, 2),
m2 AS (SELECT tp.src AS node, sink, sum(p * mass) AS mass FROM tp JOIN m1 ON tp.dst = m1.node WHERE NOT absorbed GROUP BY 1, 2),
m3 AS (SELECT tp.src AS node, sink, sum(p * mass) AS mass FROM tp JOIN m2 ON tp.dst = m2.node WHERE NOT absorbed GROUP BY 1, 2),
m AS (SELECT node, sink, sum(mass) AS mass FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3) GROUP BY node, sink)"""


@query(f"WITH {_WALK} SELECT src, count(*)::BIGINT AS n, round(sum(p), 6) AS p, count(*) FILTER (absorbed)::BIGINT AS sinks FROM tp GROUP BY src")
def transition_matrix(t):
    _, _, table = _parts_of_walk(t)
    return table.groupBy("src").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("p"), F.count_if("absorbed").alias("sinks"))


_EFFECT = "CASE substr(sink, 3)::INT % 6 WHEN 0 THEN 'IO_NETWORK' WHEN 1 THEN 'IO_STORAGE' WHEN 2 THEN 'UI_RENDER' WHEN 3 THEN 'ASSERT_SIGNAL' WHEN 4 THEN 'PROC_LIFECYCLE' ELSE 'PURE_LEAF' END"


def _egress(table):
    effect = F.element_at(F.array(*(F.lit(d) for d in flow.DIMENSIONS)), (F.substring("sink", 3, 20).cast("int") % 6 + 1))
    return flow.absorption_by_effect(table, effect)


@query(f"WITH {_WALK} SELECT node, " + ", ".join(f"round(sum(CASE WHEN {_EFFECT} = '{d}' THEN mass ELSE 0 END) + 1e-9, 6) AS {d.lower()}" for d in flow.DIMENSIONS) + " FROM m GROUP BY node")
def effect_egress(t):
    return _egress(_parts_of_walk(t)[2]).select("node", *(F.round(F.col(d.lower()) + 1e-9, 6).alias(d.lower()) for d in flow.DIMENSIONS))


@query(f"""WITH {_WALK}, i0 AS (SELECT 'o:' || o_orderkey AS node, o_orderstatus AS category, 1.0::DOUBLE AS mass FROM orders),
i1 AS (SELECT tp.dst AS node, category, sum(mass * p) AS mass FROM i0 JOIN tp ON tp.src = i0.node WHERE NOT absorbed GROUP BY 1, 2),
i2 AS (SELECT tp.dst AS node, category, sum(mass * p) AS mass FROM i1 JOIN tp ON tp.src = i1.node WHERE NOT absorbed GROUP BY 1, 2)
SELECT node, category, round(sum(mass), 6) AS mass FROM (SELECT * FROM i0 UNION ALL SELECT * FROM i1 UNION ALL SELECT * FROM i2) GROUP BY 1, 2""")
def ingress_by_category(t):
    _, _, table = _parts_of_walk(t, views.number)
    entries = t("orders").select(views.number("o:", "o_orderkey").alias("node"), F.col("o_orderstatus").alias("category"))
    return flow.ingress(table, entries).select(views.named(F.col("node")).alias("node"), "category", F.round("mass", 6).alias("mass"))


@query(f"""WITH RECURSIVE {FK}, {SYM}, f(node, h) AS (SELECT qname, 0 FROM sym WHERE kind = 'function' AND qname NOT IN (SELECT dst FROM fk) UNION SELECT dst, h + 1 FROM f JOIN fk ON src = node),
b(node, h) AS (SELECT qname, 0 FROM sym WHERE kind = 'class' UNION SELECT src, h + 1 FROM b JOIN fk ON dst = node),
fm AS (SELECT node, min(h) AS h FROM f GROUP BY node), bm AS (SELECT node, min(h) AS h FROM b GROUP BY node), mx AS (SELECT greatest((SELECT max(h) FROM fm), 1) AS mf, greatest((SELECT max(h) FROM bm), 1) AS mb)
SELECT qname AS node, round(coalesce(fm.h, mf + 1)::DOUBLE / (coalesce(fm.h, mf + 1) + coalesce(bm.h, mb + 1)), 4) AS depth FROM sym CROSS JOIN mx LEFT JOIN fm ON fm.node = qname LEFT JOIN bm ON bm.node = qname WHERE kind = 'function'""")
def relative_depth(t):
    s = views.symbols(t)
    node = F.col("qname").alias("node")
    return flow.relative_depth(views.fk_edges(t), s.where("kind = 'function'").select(node), s.where("kind = 'class'").select(node))


@query(f"""WITH RECURSIVE {TR}, nodes AS (SELECT src AS node FROM tr UNION SELECT dst FROM tr), cnt AS (SELECT count(*)::DOUBLE AS c FROM nodes), ways AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS o FROM tr),
pr(k, node, rank, change) AS (SELECT 0, node, 1 / c, c FROM nodes, cnt UNION ALL SELECT k + 1, node, new, sum(abs(new - rank)) OVER () FROM (
  SELECT p.k, p.node, p.rank, (0.15 + 0.85 * loose) / c + 0.85 * coalesce(got, 0) AS new FROM pr p CROSS JOIN cnt LEFT JOIN (SELECT dst, sum(q.rank / o) AS got FROM pr q JOIN ways ON ways.src = q.node GROUP BY dst) g ON g.dst = p.node
  CROSS JOIN (SELECT coalesce(sum(rank), 0) AS loose FROM pr WHERE node NOT IN (SELECT src FROM tr)) l WHERE p.change >= c * 1e-6))
SELECT node, round(rank, 8) AS rank FROM pr WHERE k = (SELECT max(k) FROM pr)""")
def pagerank(t):
    edges = written(views.transitions(t))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graph.pagerank(nodes, edges).withColumn("rank", F.round("rank", 8))


@query(f"""WITH RECURSIVE {TR}, reach(a, b) AS (SELECT src, dst FROM tr UNION SELECT a, dst FROM reach JOIN tr ON src = b WHERE string_split(dst, ':')[2] = string_split(a, ':')[2])
SELECT n.node, coalesce(least(n.node, min(r.b)), n.node) AS scc FROM (SELECT src AS node FROM tr UNION SELECT dst FROM tr) n LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) r ON r.a = n.node GROUP BY n.node""")
def strong_components(t):
    return graph.strong_components(views.transitions(t))


@query(f"""WITH RECURSIVE {TR}, und AS (SELECT src AS a, dst AS b FROM tr UNION SELECT dst, src FROM tr), r(a, b) AS (SELECT a, a FROM und UNION SELECT r.a, und.b FROM r JOIN und ON und.a = r.b),
c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)
SELECT split_part(component, ':', 1) AS user_id, count(*)::BIGINT AS nodes, component FROM c GROUP BY component""")
def weak_components(t):
    found = graph.components(views.transitions(t))
    return found.groupBy("component").agg(F.count("*").alias("nodes"), F.first(F.substring_index("component", ":", 1)).alias("user_id")).select("user_id", "nodes", "component")


@query(f"WITH RECURSIVE {FK}, p(node, depth) AS (SELECT src, 0 FROM fk UNION SELECT dst, depth + 1 FROM p JOIN fk ON src = node) SELECT node, max(depth)::INTEGER AS depth FROM p GROUP BY node")
def critical_path_depth(t):
    return graph.longest_path(views.fk_edges(t))


@query()
def betweenness(t):
    """Choke index of users' transition graph among event types and users (brute force in tests)."""
    steps = t("events").select(F.concat_ws(":", F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.col("event_type").alias("dst"))
    back = t("events").select(F.col("event_type").alias("src"), F.concat_ws(":", F.lit("u"), (F.col("user_id") + 1).cast("string")).alias("dst"))
    edges = written(steps.unionByName(back).distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graph.betweenness(nodes, edges)


_PI = "pi{k} AS (SELECT n.node, 0.15 / c + 0.85 * (SELECT coalesce(sum(rank), 0) FROM pi{j} WHERE node NOT IN (SELECT src FROM inn)) / c + 0.85 * coalesce(sum(q.rank / d.o), 0) AS rank FROM fnodes n CROSS JOIN fcnt LEFT JOIN inn ON inn.dst = n.node LEFT JOIN pi{j} q ON q.node = inn.src LEFT JOIN fdeg d ON d.src = inn.src GROUP BY n.node, c)"
_INNER = "inn AS (SELECT DISTINCT src, dst FROM e WHERE dst IN (SELECT qname FROM fn)), fnodes AS (SELECT qname AS node FROM fn), fcnt AS (SELECT count(*)::DOUBLE AS c FROM fnodes), fdeg AS (SELECT src, count(*)::DOUBLE AS o FROM inn GROUP BY src), pi0 AS (SELECT node, 1 / c AS rank FROM fnodes, fcnt), " + ", ".join(_PI.format(k=k, j=k - 1) for k in range(1, 11))
_MASS = ", ".join(f"sum(CASE WHEN {_EFFECT} = '{d}' THEN mass * rank ELSE 0 END) AS {d.lower()}" for d in flow.DIMENSIONS)
_SHARE = ", ".join(f"round({d.lower()} / (" + " + ".join(x.lower() for x in flow.DIMENSIONS) + f"), 5) AS {d.lower()}" for d in flow.DIMENSIONS)


@query(f"WITH {_WALK}, {_INNER}, total AS (SELECT {_MASS} FROM m JOIN pi10 USING (node)) SELECT {_SHARE} FROM total")
def global_sink_mass(t):
    """Rank-weighted effect masses of the whole graph, one row."""
    edges, internal, table = _parts_of_walk(t)
    inner = written(edges.join(internal.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    ranks = graph.pagerank(internal, inner, rounds=10)
    return flow.sink_mass(_egress(table), ranks).select(*(F.round(d.lower(), 5).alias(d.lower()) for d in flow.DIMENSIONS))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey * 7 + 3) % 2000 AS dst, 1 AS k FROM part UNION ALL SELECT p_partkey, (p_partkey * 13 + 5) % 2000, 2 FROM part),
s AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY k) AS pos FROM e),
a(node, anc, path, seen, depth) AS (SELECT src, dst, printf('%06d', pos), [src, dst], 1 FROM s UNION ALL SELECT node, s.dst, path || printf('%06d', pos), list_append(seen, s.dst), depth + 1 FROM a JOIN s ON s.src = a.anc WHERE depth < 10 AND NOT list_contains(seen, s.dst))
SELECT node, anc AS ancestor, (row_number() OVER (PARTITION BY node ORDER BY p))::INTEGER AS rank FROM (SELECT node, anc, min(path) AS p FROM a GROUP BY 1, 2)""")
def mro_ancestors(t):
    k = F.col("p_partkey")
    edges = t("part").select(k.alias("src"), F.explode(F.array(F.struct(((k * 7 + 3) % 2000).alias("dst"), F.lit(1).alias("k")), F.struct(((k * 13 + 5) % 2000).alias("dst"), F.lit(2).alias("k")))).alias("e")).select("src", "e.dst", "e.k")
    return graph.ancestors(edges, F.col("k"))


@query()
def graph_metrics(t):
    """Isolated share, largest component and diameter estimate (brute force in tests)."""
    nodes = views.symbols(t).select(F.col("qname").alias("node"))
    return graph.graph_metrics(written(views.fk_edges(t)), nodes)


@query(f"""WITH {FK}, ind AS (SELECT src, count(*) AS n FROM (SELECT dst AS src FROM fk) GROUP BY src), c AS (SELECT fk.src, fk.dst, {_COST} * sqrt((1 + ln(greatest(coalesce(a.n, 0) - 1, 0) + 1)) * (1 + ln(greatest(coalesce(b.n, 0) - 1, 0) + 1))) * CASE WHEN relation = 'CALLS' THEN 0.5 ELSE 1 END AS cost FROM fk LEFT JOIN ind a ON a.src = fk.src LEFT JOIN ind b ON b.src = fk.dst)
SELECT split_part(src, ':', 1) || split_part(dst, ':', 1) AS kind, count(*)::BIGINT AS n, round(sum(cost), 3) AS cost FROM c GROUP BY 1""")
def undirected_costs(t):
    from ..functions import scores

    edges = views.fk_edges(t)
    fan = edges.groupBy(F.col("dst").alias("k")).agg(F.count("*").alias("n"))
    df = edges.join(fan.withColumnsRenamed({"k": "src", "n": "nu"}), "src", "left").join(fan.withColumnsRenamed({"k": "dst", "n": "nv"}), "dst", "left").fillna(0, ["nu", "nv"])
    cost = scores.undirected_cost(F.col("relation"), F.lit("CALL"), F.lit(False), F.col("relation") == "CALLS", F.lit(False), F.col("nu"), F.col("nv"))
    kind = F.concat(F.substring_index("src", ":", 1), F.substring_index("dst", ":", 1))
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(cost), 3).alias("cost"))
