"""Context packages as text: XML, Markdown and JSON in a fixed order, and XML read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cdata, escaped_attribute

SCHEMA_VERSION, RENDER_SLACK = 3, 1.05
SEVERITY = {"error": 2, "warning": 1, "info": 0}
MAX_DEPTH, MAX_ELEMENTS = 100, 100_000


def _attributes(**values: Column) -> Column:
    """Attributes by name, null ones left out."""
    parts = [F.coalesce(F.concat(F.lit(f' {k}="'), escaped_attribute(values[k].cast("string")), F.lit('"')), F.lit("")) for k in sorted(values)]
    return F.concat(*parts)


def node_order() -> Column:
    """The seed first, then by distance and name."""
    return F.struct((F.col("role") != "seed").alias("a"), F.col("distance").alias("b"), F.col("id").alias("c"))


def render_nodes(nodes: DataFrame) -> DataFrame:
    """(query, text, n): a package's nodes; nodes: query, id, role, distance, kind, file, start, end, body (null for a manifest)."""
    body = F.when(F.col("body").isNotNull(), F.concat(F.lit("<body>"), cdata(F.col("body")), F.lit("</body>"))).otherwise("")
    element = F.concat(F.lit("<node"), _attributes(id=F.col("id"), role=F.col("role"), distance=F.round("distance", 4), kind=F.col("kind"), file=F.col("file"), start=F.col("start"), end=F.col("end")), F.lit(">"), body, F.lit("</node>"))
    each = nodes.select("query", F.struct(node_order().alias("o"), element.alias("x")).alias("e"))  # a package is within its budget
    return each.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), "\n").alias("text"), F.count("*").alias("n"))


def render_edges(edges: DataFrame) -> DataFrame:
    """(query, text): a package's edges (query, src, dst, relation) by from, to and type."""
    element = F.concat(F.lit("<edge"), _attributes(**{"from": F.col("src"), "to": F.col("dst"), "type": F.col("relation")}), F.lit("/>"))
    each = edges.select("query", F.struct("src", "dst", "relation", element.alias("x")).alias("e"))
    return each.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), "\n").alias("text"))


def render_warnings(warnings: DataFrame) -> DataFrame:
    """(query, text): warnings (query, code, severity) by falling severity and code."""
    rank = F.lit(0)
    for name, value in SEVERITY.items():
        rank = F.when(F.col("severity") == name, -value).otherwise(rank)
    element = F.concat(F.lit("<warning"), _attributes(code=F.col("code"), severity=F.col("severity")), F.lit("/>"))
    each = warnings.select("query", F.struct(rank.alias("r"), "code", element.alias("x")).alias("e"))
    return each.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), "\n").alias("text"))


def render_xml(packages: DataFrame, nodes: DataFrame, edges: DataFrame, warnings: DataFrame) -> DataFrame:
    """(query, xml): packages (query, seed, budget, used) with their parts and a sha256 of what is rendered.

    A package over its budget has the warning BUDGET_OVERFLOW besides its own.
    """
    over = packages.where("used > budget").select("query", F.lit("BUDGET_OVERFLOW").alias("code"), F.lit("warning").alias("severity"))
    told = render_warnings(warnings.select("query", "code", "severity").unionByName(over))
    text = lambda df, name: df.select("query", F.col("text").alias(name))
    joined = packages.join(text(render_nodes(nodes), "nodes"), "query", "left").join(text(render_edges(edges), "edges"), "query", "left").join(text(told, "warnings"), "query", "left")
    part = lambda c, name: F.concat(F.lit(f"<{name}>\n"), F.coalesce(F.concat(F.col(c), F.lit("\n")), F.lit("")), F.lit(f"</{name}>\n"))
    body = F.concat(part("nodes", "nodes"), part("edges", "edges"), part("warnings", "warnings"))
    head = F.concat(F.lit("<context"), _attributes(budget=F.col("budget"), seed=F.col("seed"), used=F.col("used"), version=F.lit(SCHEMA_VERSION)), F.lit(">\n"))
    return joined.select("query", F.concat(head, body, F.lit("<trailer"), _attributes(sha256=F.sha2(body, 256), tokens=F.col("used")), F.lit("/>\n</context>\n")).alias("xml"))


def parse_context(xml: str) -> dict:
    """A rendered package as a dict; entities, deep nesting and too many elements are errors."""
    import xml.etree.ElementTree as ET

    if "<!DOCTYPE" in xml or "<!ENTITY" in xml:
        raise ValueError("document types and entities aren't accepted")
    root, count = None, 0
    parser = ET.XMLPullParser(events=("start", "end"))
    parser.feed(xml)
    parser.close()
    depth = 0
    for event, element in parser.read_events():
        depth += 1 if event == "start" else -1
        count += event == "start"
        root = element if root is None else root
        if depth > MAX_DEPTH or count > MAX_ELEMENTS:
            raise ValueError("the document is too deep or too large")
    if root is None or root.tag != "context" or root.get("version") != str(SCHEMA_VERSION):
        raise ValueError("not a context of this version")
    return {
        "seed": root.get("seed"), "budget": int(root.get("budget")), "used": int(root.get("used")),
        "nodes": [{**n.attrib, "body": n.findtext("body")} for n in root.iterfind("nodes/node")], "edges": [dict(e.attrib) for e in root.iterfind("edges/edge")],
        "warnings": [dict(w.attrib) for w in root.iterfind("warnings/warning")], "sha256": root.find("trailer").get("sha256"),
    }


def render_markdown(packages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, markdown): a heading, then each node's heading and fenced body, in order."""
    element = F.concat(F.lit("## "), F.col("id"), F.lit(" ("), F.col("role"), F.lit(", "), F.round("distance", 2).cast("string"), F.lit(")\n"), F.coalesce(F.concat(F.lit("```\n"), F.col("body"), F.lit("\n```\n")), F.lit("")))
    each = nodes.select("query", F.struct(node_order().alias("o"), element.alias("x")).alias("e"))
    text = each.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), "\n").alias("text"))
    return packages.join(text, "query", "left").select("query", F.concat(F.lit("# "), "seed", F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("markdown"))


def detail_level(nodes: DataFrame, level: str) -> DataFrame:
    """nodes at a level: full, manifest (no bodies) or summary (no nodes)."""
    if level == "full":
        return nodes
    if level == "manifest":
        return nodes.withColumn("body", F.lit(None).cast("string"))
    if level == "summary":
        return nodes.where(F.lit(False))
    raise ValueError(f"unknown detail level {level!r}")


def induced_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends a query's nodes (query, id) have."""
    ids = nodes.select("query", "id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src").join(ids.withColumnRenamed("id", "dst"), ["query", "dst"]).select("query", "src", "dst", "relation")


def causal_paths(edges: DataFrame, nodes: DataFrame, longest: int = 6) -> DataFrame:
    """(query, path array): from the seed to the best sink within the package, longest nodes at most.

    edges: query, src, dst; nodes: query, id, role, distance, mask. Breadth first over names in order. The
    best sink shares most substance bits with the seed, then is nearest, then first by name; without
    sinks it is the deepest node. A package is small, so each is one group.
    """
    from ..functions.bits import SUBSTANCE_SINKS

    marked = nodes.select("query", F.lit(0).alias("t"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), "role", "distance", "mask")
    links = edges.select("query", F.lit(1).alias("t"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("long").alias("mask"))

    def walk(pdf):
        import pandas as pd

        seed, mask, distance, out = None, {}, {}, {}
        for r in pdf.itertuples():
            if r.t:
                out.setdefault(r.a, set()).add(r.b)
            else:
                mask[r.a], distance[r.a] = int(r.mask or 0), r.distance
                seed = r.a if r.role == "seed" else seed
        parent, order = {seed: None}, [seed]
        for at in order:
            for nxt in sorted(out.get(at, ())):
                if nxt in mask and nxt not in parent:
                    parent[nxt] = at
                    order.append(nxt)
        depth = {}
        for n in order:
            depth[n] = 0 if parent[n] is None else depth[parent[n]] + 1
        sinks = [n for n in order[1:] if mask[n] & SUBSTANCE_SINKS and depth[n] < longest]
        if sinks:
            end = min(sinks, key=lambda n: (-(mask[n] & mask[seed] & SUBSTANCE_SINKS).bit_count(), distance[n], n))
        else:
            end = max((n for n in order if depth[n] < longest), key=lambda n: (depth[n], n))
        path = []
        while end is not None:
            path.append(end)
            end = parent[end]
        return pd.DataFrame({"query": [pdf["query"].iat[0]], "path": [path[::-1]]})

    kind = nodes.schema["query"].dataType.simpleString()
    return marked.unionByName(links).groupBy("query").applyInPandas(walk, f"query {kind}, path array<string>")


def debug_json(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(json): a line for each node with its edges, in order of names; a dump of a whole graph is as many lines as nodes."""
    out = edges.select("src", F.struct("dst", "relation").alias("e")).groupBy(F.col("src").alias("qname")).agg(F.array_sort(F.collect_list("e")).alias("edges"))  # a node's own edges
    return symbols.join(out, "qname", "left").orderBy("qname").select(F.to_json(F.struct(*symbols.columns, "edges")).alias("json"))
