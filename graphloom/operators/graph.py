"""Graph algorithms over edge tables: bounded iteration, many queries in one job.

Edges are (src, dst, ...). Every round is written to the shared folder, so lineage
stays short; only counts come to the driver. Node sets, distances and labels are
tables of their own throughout.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import shared_dir, sized, written, written_by
from .groups import each_group

#: Edges of a component that one task may hold; larger ones are worked on as tables.
COMPONENT_EDGES = 200_000
#: Queries whose reach is kept as the bits of one number for each node.
TOGETHER = 63


def oriented(edges: DataFrame, direction: str = "forward") -> DataFrame:
    """Edges as they are walked: forward, reverse or both."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    edges = edges.select("src", "dst", *rest)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return {"forward": edges, "reverse": back, "both": edges.unionByName(back)}[direction]


def bfs(edges: DataFrame, sources: DataFrame, direction: str = "forward", max_hops: int | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """(query, node, hops): hops of each node from its query's sources (query, node), which have 0.

    Walks until nothing new is found, or max_hops if given. Nodes of blocked (node) are reached but not
    walked on from. All queries advance together. What is found at a hop is a folder of one table,
    so that every round reads what is known by one scan. A short frontier is sent to the edges.
    """
    start = written(sources.select("query", "node").distinct())
    queries = written(start.select("query").distinct())
    if 1 < queries.count() <= TOGETHER:
        index, levels = _reach_bits(edges, start, queries, direction, max_hops, blocked)
        return spread_bits(levels, index).select("query", "node", "hops")
    spark = edges.sparkSession
    steps = written_by(oriented(edges.select("src", "dst"), direction), "src")
    base = shared_dir(spark)
    start.write.parquet(f"{base}/hops=0")
    plain = StructType([StructField(f.name, f.dataType) for f in start.schema])
    read = lambda path: spark.read.schema(plain).parquet(path)
    everything = lambda: spark.read.schema(StructType([*plain.fields, StructField("hops", IntegerType())])).option("basePath", base).parquet(base)
    for hop in count(1):
        frontier = read(f"{base}/hops={hop - 1}")
        if max_hops is not None and hop > max_hops or not (found := frontier.count()):
            return everything()
        at = frontier if blocked is None or hop == 1 else frontier.join(blocked, "node", "left_anti")
        near = steps.join(sized(at, found), F.col("node") == F.col("src")).select("query", F.col("dst").alias("node")).distinct()
        near.join(everything().drop("hops"), ["query", "node"], "left_anti").write.parquet(f"{base}/hops={hop}")


def _reach_bits(edges: DataFrame, start: DataFrame, queries: DataFrame, direction: str, max_hops: int | None, blocked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, bit) of up to TOGETHER queries, and (node, mask, hops): the queries that reach a node first at these hops, as bits. A node has one row a hop, however many queries reach it."""
    spark = edges.sparkSession
    steps = written_by(oriented(edges.select("src", "dst"), direction), "src")
    index = written(queries.select("query", F.expr("shiftleft(1L, cast(row_number() OVER (ORDER BY query) - 1 AS int))").alias("bit")))  # TOGETHER rows
    base = shared_dir(spark)
    first = start.join(F.broadcast(index), "query").groupBy("node").agg(F.bit_or("bit").alias("mask"))
    first.write.parquet(f"{base}/hops=0")
    plain = StructType([StructField(f.name, f.dataType) for f in first.schema])
    everything = lambda: spark.read.schema(StructType([*plain.fields, StructField("hops", IntegerType())])).option("basePath", base).parquet(base)
    for hop in count(1):
        frontier = spark.read.schema(plain).parquet(f"{base}/hops={hop - 1}")
        if max_hops is not None and hop > max_hops or not (found := frontier.count()):
            return index, everything()
        at = frontier if blocked is None or hop == 1 else frontier.join(blocked, "node", "left_anti")
        near = steps.join(sized(at, found), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.bit_or("mask").alias("mask"))
        known = everything().groupBy("node").agg(F.bit_or("mask").alias("known"))
        new = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        near.join(known, "node", "left").select("node", new.alias("mask")).where("mask <> 0").write.parquet(f"{base}/hops={hop}")


def spread_bits(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (mask, ...) once for each query of their mask, with query."""
    return rows.join(F.broadcast(index), F.col("mask").bitwiseAND(F.col("bit")) != 0).drop("mask", "bit")  # TOGETHER rows


def ego(edges: DataFrame, sources: DataFrame, hops: int, direction: str = "forward") -> DataFrame:
    """(query, src, dst): edges whose ends are both within hops of a query's sources (query, node)."""
    plain = edges.select("src", "dst").distinct()
    start = written(sources.select("query", "node").distinct())
    queries = written(start.select("query").distinct())
    if queries.count() > TOGETHER:
        near = written(bfs(edges, sources, direction, hops).select("query", "node"))
        return plain.join(near.withColumnRenamed("node", "src"), "src").join(near.withColumnRenamed("node", "dst"), ["query", "dst"]).select("query", "src", "dst")
    index, levels = _reach_bits(edges, start, queries, direction, hops)
    near = written(levels.groupBy("node").agg(F.bit_or("mask").alias("mask")))
    ends = plain.join(near.select(F.col("node").alias("src"), F.col("mask").alias("a")), "src").join(near.select(F.col("node").alias("dst"), F.col("mask").alias("b")), "dst")
    both = ends.select("src", "dst", F.col("a").bitwiseAND(F.col("b")).alias("mask")).where("mask <> 0")
    return spread_bits(both, index).select("query", "src", "dst")


def distances(edges: DataFrame, sources: DataFrame, cutoff: float, direction: str = "forward") -> DataFrame:
    """(query, node, dist): cheapest cost over edges (src, dst, cost) from any source, up to cutoff inclusive; sources themselves are left out.

    Costs must not be negative. Runs until no distance falls. Both directions: the smaller of the two
    walks' distances, not walks that turn.
    """
    if direction == "both":
        ways = [distances(edges, sources, cutoff, d) for d in ("forward", "reverse")]
        return ways[0].unionByName(ways[1]).groupBy("query", "node").agg(F.min("dist").alias("dist"))
    steps = written_by(oriented(edges.select("src", "dst", "cost"), direction).groupBy("src", "dst").agg(F.min("cost").alias("cost")), "src")
    _no_negative(steps)
    start = sources.select("query", "node").distinct()
    best = written(start.withColumn("dist", F.lit(0.0)))
    moved = best
    while True:
        near = moved.join(steps, F.col("node") == F.col("src")).select("query", F.col("dst").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"))
        offered = near.where(F.col("dist") <= cutoff).groupBy("query", "node").agg(F.min("dist").alias("offer"))
        new = written(best.join(offered, ["query", "node"], "full").select("query", "node", F.least("dist", "offer").alias("dist"), (F.col("dist").isNull() | (F.col("offer") < F.col("dist"))).alias("moved")))
        moved = new.where("moved").select("query", "node", "dist")
        best = new.select("query", "node", "dist")
        if not moved.limit(1).count():
            return best.join(start, ["query", "node"], "left_anti")


def _no_negative(steps: DataFrame) -> None:
    if steps.where("cost < 0").limit(1).count():
        raise ValueError("costs must not be negative")


def confirmed_reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(query, node, dist, confirmed): undirected cheapest walks over (src, dst, cost, confirmed), and whether the walk uses a confirmed edge; at equal cost one that does is taken.

    Costs must not be negative. Runs until no walk gets better; each round walks on only from where one did.
    """
    steps = written(oriented(edges.select("src", "dst", "cost", "confirmed"), "both"))
    _no_negative(steps)
    best = written(sources.select("query", "node", F.struct(F.lit(0.0).alias("dist"), F.lit(True).alias("plain")).alias("at")).distinct())
    moved = best
    while True:
        way = F.struct((F.col("at.dist") + F.col("cost")).alias("dist"), (F.col("at.plain") & ~F.col("confirmed")).alias("plain"))
        offered = moved.join(steps, F.col("node") == F.col("src")).select("query", F.col("dst").alias("node"), way.alias("at")).groupBy("query", "node").agg(F.min("at").alias("offer"))
        new = written(best.join(offered, ["query", "node"], "full").select("query", "node", F.least("at", "offer").alias("at"), (F.col("at").isNull() | (F.col("offer") < F.col("at"))).alias("moved")))
        moved = new.where("moved").select("query", "node", "at")
        best = new.select("query", "node", "at")
        if not moved.limit(1).count():
            return best.select("query", "node", "at.dist", (~F.col("at.plain")).alias("confirmed")).join(sources, ["query", "node"], "left_anti")


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), a < b, each once, as numbers of their ends, and the ends by number: (id, name). Numbers are hashes; where two names have the same, all are hashed anew."""
    plain = edges.select("src", "dst").where("src <> dst")
    for seed in count():
        number = lambda c, seed=seed: F.xxhash64(F.col(c), F.lit(seed))
        ends = plain.select(F.explode(F.array("src", "dst")).alias("node"))
        names = written(ends.groupBy(number("node").alias("id")).agg(F.min("node").alias("name"), F.max("node").alias("other")))
        if not names.where("name <> other").limit(1).count():
            a, b = number("src"), number("dst")
            return written(plain.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()), names.select("id", "name")


def _joined(links: DataFrame) -> DataFrame:
    """(node, label) of links (a, b) that one task holds: one label for all that are linked."""

    def run(batches):
        import pyarrow as pa

        up: dict = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in list(up)], pa.int64())], ["node", "label"])

    return links.coalesce(1).mapInArrow(run, "node long, label long")


def components(edges: DataFrame, component_edges: int = COMPONENT_EDGES) -> DataFrame:
    """(node, component): the smallest node of each weakly connected component.

    Nodes are hashes, so that a shuffle carries numbers and their order is as good as random. In each round a
    node takes the smallest of its own and its neighbours' numbers as its label; links between different labels,
    each once, are what is left, which is a share of what was. What is left at component_edges is joined in one task.
    """
    left, names = _numbered(edges)
    steps = []
    while left.count() > component_edges:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        steps.append(written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))))
        of = lambda end, new: steps[-1].select(F.col("node").alias(end), F.col("label").alias(new))
        ends = left.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y")
        left = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    labels = written(_joined(left))
    for step in reversed(steps):
        last = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = written(step.join(last, "label", "left").select("node", F.coalesce("last", "label").alias("label")))
    found = written(names.join(labels.withColumnRenamed("node", "id"), "id").select("name", "label"))
    first = found.groupBy("label").agg(F.min("name").alias("component"))
    return found.join(first, "label").select(F.col("name").alias("node"), "component")


def _tarjan(out: dict) -> dict:
    """Node -> smallest node of its strongly connected component; iterative."""
    index, low, stack, on, label, count = {}, {}, [], set(), {}, 0
    for start in sorted(out):
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = count = count + 1
        stack.append(start)
        on.add(start)
        while work:
            node, succ = work[-1]
            for nxt in succ:
                if nxt not in index:
                    index[nxt] = low[nxt] = count = count + 1
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        on.discard(members[-1])
                    first = min(members)
                    label.update(dict.fromkeys(members, first))
    return label


def strong_components(edges: DataFrame, component_edges: int = COMPONENT_EDGES) -> DataFrame:
    """(node, scc): the smallest node of each strongly connected component.

    Weak components of up to component_edges edges are solved each in one task. In larger ones nodes
    on no cycle are trimmed, then components are split off by forward and backward reach from the
    smallest nodes, as tables, until none are left.
    """
    plain = written(edges.select("src", "dst").distinct())
    nodes = plain.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    weak = components(plain)
    placed = written(plain.where("src <> dst").join(weak.withColumnRenamed("node", "src"), "src").select("component", "src", "dst"))
    size = written(placed.groupBy("component").agg(F.count("*").alias("n")))
    small = placed if not size.where(F.col("n") > component_edges).limit(1).count() else placed.join(size.where(F.col("n") <= component_edges), "component", "left_semi")

    def solve(rows):
        out: dict = {}
        for _, a, b in rows:
            out.setdefault(a, []).append(b)
            out.setdefault(b, [])
        return _tarjan(out).items()

    node_type = plain.schema["src"].dataType.simpleString()
    found = each_group(small.select("component", "src", "dst"), "component", solve, f"node {node_type}, scc {node_type}")
    if size.where(F.col("n") > component_edges).limit(1).count():
        rest = placed.join(size.where(F.col("n") > component_edges), "component", "left_semi").select("src", "dst")
        found = found.unionByName(_split_by_reach(rest))
    return nodes.join(found, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def _split_by_reach(edges: DataFrame) -> DataFrame:
    """Strong components of a large graph: each round colours nodes by the largest node that reaches them; those that reach back to their colour are its component."""
    left, done = written(edges.select("src", "dst").distinct()), []
    while left.limit(1).count():
        while True:  # trim nodes without edges in or out
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            kept = written(inner.select("src", "dst"))
            if kept.count() == left.count():
                break
            left = kept
        if not left.limit(1).count():
            break
        colour = written(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            near = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("near"))
            new = written(colour.join(near, "node", "left").select("node", F.greatest("colour", "near").alias("colour"), (F.col("near") > F.col("colour")).alias("moved")))
            colour = new.select("node", "colour")
            if not new.where("moved").limit(1).count():
                break
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        back = bfs(written(inside.select("src", "dst")), colour.where("node = colour").select(F.col("colour").alias("query"), "node"), "reverse")
        members = written(back.select("node", F.col("query").alias("colour")))
        named = members.groupBy("colour").agg(F.min("node").alias("scc")).join(members, "colour").select("node", "scc")
        done.append(written(named))
        gone = members.select("node")
        left = written(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    empty = edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).where(F.lit(False))
    return reduce(DataFrame.unionByName, done, empty)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int | None = None, tol: float = 1e-6) -> DataFrame:
    """(node, rank): power iteration over nodes (node) and edges, each edge once; nodes without a way out spread over all.

    Without a number of rounds, until the ranks' changes sum to less than tol a node, which a damping below 1 always reaches.
    """
    n = nodes.count()
    steps = edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    degree = steps.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    steps = written(steps)
    rank = written(nodes.join(degree, "node", "left").select("node", "out", F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in count() if rounds is None else range(rounds):
        loose = rank.where("out IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("x")).first().x
        sent = steps.join(rank.where("out IS NOT NULL").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("share")), "src")
        got = sent.groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        settled = F.lit((1 - damping) / max(n, 1) + damping * loose / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))
        new = written(rank.join(got, "node", "left").select("node", "out", settled.alias("rank"), F.abs(settled - F.col("rank")).alias("change")))
        rank = new.drop("change")
        if rounds is None and new.agg(F.coalesce(F.sum("change"), F.lit(0.0)).alias("x")).first().x < max(n, 1) * tol:
            break
    return rank.select("node", "rank")


def longest_path(edges: DataFrame) -> DataFrame:
    """(node, depth): edges on the longest path that ends in each node of a DAG; a cycle is an error."""
    plain = written_by(edges.select("src", "dst").distinct(), "src")
    depth = written(plain.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("depth", F.lit(0)))
    nodes, moved = depth.count(), depth
    for _ in range(nodes):  # a path of more edges than nodes has a cycle
        near = moved.join(plain, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((F.max("depth") + 1).alias("near"))
        new = written(depth.join(near, "node", "left").select("node", F.greatest("depth", "near").alias("depth"), (F.coalesce(F.col("near") > F.col("depth"), F.lit(False))).alias("moved")))
        depth = new.select("node", "depth")
        moved = new.where("moved").select("node", "depth")
        if not moved.limit(1).count():
            return depth
    if nodes:
        raise ValueError("a cycle: longest paths need a DAG")
    return depth


def betweenness(nodes: DataFrame, edges: DataFrame, exact_nodes: int | None = 300, samples: int = 25) -> DataFrame:
    """(node, choke): share of shortest paths through each node, normalised, 6 digits.

    Exact up to exact_nodes nodes (None: always); beyond, from the samples nodes with the smallest hashes, scaled up.
    Counts of shortest paths go outwards level by level for all sources at once, dependencies back.
    """
    n = nodes.count()
    steps = written(edges.select("src", "dst").where("src <> dst").distinct().join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    exact = exact_nodes is None or n <= exact_nodes
    sources = nodes if exact else nodes.orderBy(F.xxhash64("node"), "node").limit(samples)
    levels = [written(sources.select(F.col("node").alias("query"), "node", F.lit(1.0).alias("paths")))]
    while True:
        known = reduce(DataFrame.unionByName, levels).select("query", "node")
        near = levels[-1].join(steps, F.col("node") == F.col("src")).groupBy("query", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = written(near.join(known, ["query", "node"], "left_anti"))
        if not level.limit(1).count():
            break
        levels.append(level)
    scores, below = [], None
    for level in reversed(levels[1:]):
        if below is None:
            dep = level.withColumn("dep", F.lit(0.0))
        else:
            near = below.select("query", F.col("node").alias("dst"), ((1 + F.col("dep")) / F.col("paths")).alias("unit")).join(steps, "dst").groupBy("query", F.col("src").alias("node")).agg(F.sum("unit").alias("unit"))
            dep = level.join(near, ["query", "node"], "left").select("query", "node", "paths", F.coalesce(F.col("paths") * F.col("unit"), F.lit(0.0)).alias("dep"))
        below = written(dep)
        scores.append(below.select("node", "dep"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if not exact:
        scale *= n / min(samples, n)
    if not scores:
        return nodes.select("node", F.lit(0.0).alias("choke"))
    total = reduce(DataFrame.unionByName, scores).groupBy("node").agg(F.sum("dep").alias("dep"))
    return nodes.join(total, "node", "left").select("node", F.round(F.coalesce("dep", F.lit(0.0)) * scale, 6).alias("choke"))


def ancestors(edges: DataFrame, order: Column, max_depth: int = 10) -> DataFrame:
    """(node, ancestor, rank): ancestors over EXTENDS-like edges (src, dst) in depth-first pre-order, siblings by order, each once, up to max_depth.

    Of several ways of one length to an ancestor only the first can lead to the first place of anything
    above it, so each round keeps one way for each node and ancestor. Nodes that nothing extends and that have the
    same bases in the same order share their ancestors: one of them is walked from.
    """
    step = written(edges.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy(order)).alias("pos")))  # one class's bases
    bases = step.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("bases"))
    inner = step.select(F.col("dst").alias("src"), F.lit(True).alias("inner")).distinct()
    bases = written(bases.join(inner, "src", "left"))
    outer = bases.where("inner IS NULL").select("src", "bases")
    alike = outer.join(outer.groupBy("bases").agg(F.min("src").alias("by")), "bases").select("src", "by")
    alike = written(alike.unionByName(bases.where("inner").select("src", F.col("src").alias("by"))))
    walked = step.join(alike.where("src = by").select("src"), "src", "left_semi")
    path = lambda pos: F.format_string("%06d", pos)
    first = lambda df: written(df.groupBy("node", "ancestor").agg(F.min(F.struct("path", "seen")).alias("b")).select("node", "ancestor", "b.path", "b.seen"))
    levels = [first(walked.select(F.col("src").alias("node"), F.col("dst").alias("ancestor"), path(F.col("pos")).alias("path"), F.array("src", "dst").alias("seen")))]
    for _ in range(max_depth - 1):
        near = levels[-1].join(step, F.col("ancestor") == F.col("src")).where(~F.array_contains("seen", F.col("dst")))
        level = first(near.select("node", F.col("dst").alias("ancestor"), F.concat("path", path(F.col("pos"))).alias("path"), F.concat("seen", F.array("dst")).alias("seen")))
        if not level.limit(1).count():
            break
        levels.append(level)
    best = reduce(DataFrame.unionByName, (x.select("node", "ancestor", "path") for x in levels)).groupBy("node", "ancestor").agg(F.min("path").alias("path"))
    ranked = written(best.select("node", "ancestor", F.row_number().over(Window.partitionBy("node").orderBy("path")).alias("rank")))
    return alike.join(ranked.withColumnRenamed("node", "by"), "by").select(F.col("src").alias("node"), "ancestor", "rank")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) over distinct edges."""
    each = edges.select("src", "dst").distinct()
    ends = each.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def graph_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, isolated share, size of the largest weak component, diameter estimate by two sweeps on it."""
    weak = components(edges)
    joined = nodes.join(weak, "node", "left")
    counts = joined.agg(F.count("*").alias("nodes"), F.count_if(F.col("component").isNull()).alias("isolated"))
    largest = weak.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    inside = written(weak.join(F.broadcast(largest), "component").select("node", "component", "size"))  # one row is sent
    part = edges.join(inside.select(F.col("node").alias("src")), "src", "left_semi")
    one = lambda df: df.select(F.lit(0).alias("query"), "node")
    far = bfs(part, one(inside.orderBy("node").limit(1)), "both").orderBy(F.desc("hops"), "node").limit(1)
    sweep = bfs(part, one(far), "both").agg(F.max("hops").alias("diameter"))
    share = F.round(F.col("isolated") / F.col("nodes"), 4).alias("isolated_ratio")
    return counts.join(F.broadcast(inside.agg(F.max("size").alias("largest")))).join(F.broadcast(sweep)).select("nodes", share, "largest", "diameter")  # single rows


def sized_nodes(df: DataFrame) -> DataFrame:
    return sized(df, df.count())
