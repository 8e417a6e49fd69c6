"""Edges between types and calls that names alone don't give: heritage, embedding, promoted and inherited methods, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import bfs
from .joins import resolve_references


def heritage_edges(clauses: DataFrame, imports: DataFrame, symbols: DataFrame, wildcards: DataFrame) -> DataFrame:
    """(src, dst, relation) of clauses (qname, file, module, base, relation) whose base, by import, module or wildcard, is a class or interface.

    base: a dotted reference, whose first part is resolved; symbols: qname, module, name, kind.
    """
    asked = clauses.select("file", "module", F.substring_index("base", ".", 1).alias("root")).distinct().withColumn("ref_id", F.concat_ws("\u0001", "file", "module", "root"))
    roots = resolve_references(asked, imports, symbols.select("module", "name"), wildcards).select("ref_id", "target")
    keyed = clauses.withColumn("ref_id", F.concat_ws("\u0001", "file", "module", F.substring_index("base", ".", 1))).join(roots, "ref_id")
    rest = F.when(F.contains("base", F.lit(".")), F.expr("substring(base, instr(base, '.'))")).otherwise("")
    types = symbols.where(F.col("kind").isin("class", "interface")).select(F.col("qname").alias("dst"))
    return keyed.select(F.col("qname").alias("src"), F.concat("target", rest).alias("dst"), "relation").join(types, "dst", "left_semi").select("src", "dst", "relation").distinct()


def type_names(asked: DataFrame, types: DataFrame) -> DataFrame:
    """(module, name, qname) of asked (module, name): a type of the module itself, else the only one of that name anywhere; types: module, name, qname."""
    only = types.groupBy("name").agg(F.min("qname").alias("q1"), F.max("qname").alias("q2")).where("q1 = q2").select("name", F.col("q1").alias("only"))
    own = types.groupBy("module", "name").agg(F.min("qname").alias("own"))
    return asked.select("module", "name").distinct().join(own, ["module", "name"], "left").join(only, "name", "left").select("module", "name", F.coalesce("own", "only").alias("qname")).where("qname IS NOT NULL")


def embed_edges(embeds: DataFrame, types: DataFrame) -> DataFrame:
    """(src, dst, relation EMBEDS) of embeds (module, name, embedded) whose embedded type is known, by type_names; types: module, name, qname."""
    known = type_names(embeds.select("module", F.col("embedded").alias("name")), types).select("module", F.col("name").alias("embedded"), F.col("qname").alias("dst"))
    own = types.select("module", "name", F.col("qname").alias("src"))
    return embeds.join(own, ["module", "name"]).join(known, ["module", "embedded"]).select("src", "dst", F.lit("EMBEDS").alias("relation")).distinct()


def promoted_methods(asked: DataFrame, embeds: DataFrame, methods: DataFrame) -> DataFrame:
    """(struct, method, target, ambiguous) of asked (struct, method): the method of the nearest embedded type that has it; none if two at one depth do.

    embeds: src, dst; methods: struct, method, qname. A struct's own methods aren't promoted.
    """
    reach = bfs(embeds, asked.select(F.col("struct").alias("query"), F.col("struct").alias("node")).distinct()).where("hops > 0")
    held = reach.join(methods.withColumnRenamed("struct", "node"), "node").select(F.col("query").alias("struct"), "method", "hops", "qname")
    by_depth = held.groupBy("struct", "method", "hops").agg(F.min("qname").alias("qname"), F.count("*").alias("n"))
    best = by_depth.groupBy("struct", "method").agg(F.min(F.struct("hops", "n", "qname")).alias("b"))
    alone = F.col("b.n") == 1
    return asked.distinct().join(best, ["struct", "method"], "left").select("struct", "method", F.when(alone, F.col("b.qname")).alias("target"), F.coalesce(~alone, F.lit(False)).alias("ambiguous"))


def inherited_methods(asked: DataFrame, ancestors: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, method, target) of asked (class, method): the method of the nearest ancestor that defines it, as super() finds it; ancestors: node, ancestor, rank; methods: class, method, qname."""
    up = asked.distinct().join(ancestors.select(F.col("node").alias("class"), "ancestor", "rank"), "class")
    held = up.join(methods.select(F.col("class").alias("ancestor"), "method", "qname"), ["ancestor", "method"])
    best = held.groupBy("class", "method").agg(F.min_by("qname", "rank").alias("target"))
    return asked.distinct().join(best, ["class", "method"], "left")


def generic_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls (call, base, indexed) with target and kind: a name with an index before its arguments is a generic function if it is a known one, else an item of a table."""
    known = functions.select(F.col("name").alias("base"), F.col("qname").alias("target")).distinct()
    kind = F.when(F.col("target").isNotNull(), "CALLS").when(F.col("indexed"), "SUBSCRIPT_DISPATCH").otherwise("UNRESOLVED")
    return calls.join(known, "base", "left").select("call", "target", kind.alias("kind"))


def permits_wildcard(name: Column, listed: Column, partial: Column) -> Column:
    """Whether 'import *' brings a name: as the module's static list says, or, without one or with one made at run time, unless it begins with _."""
    return F.when(listed.isNotNull() & ~F.coalesce(partial, F.lit(False)), F.array_contains(listed, name)).otherwise(~name.startswith("_"))


def instance_types(bindings: DataFrame) -> DataFrame:
    """(scope, variable, class, ambiguous): the class that each variable was bound to last; bindings: scope, variable, class, pos."""
    return bindings.groupBy("scope", "variable").agg(F.max_by("class", "pos").alias("class"), (F.count_distinct("class") > 1).alias("ambiguous"))


def named_once(symbols: DataFrame) -> DataFrame:
    """symbols (qname, kind, file_ord, start) with id: a name taken again gets '#2' and so on; an implementation takes the name before an interface."""
    w = Window.partitionBy("qname").orderBy((F.col("kind") == "interface").cast("int"), "file_ord", "start")  # definitions of one name
    k = F.row_number().over(w)
    return symbols.withColumn("id", F.when(k == 1, F.col("qname")).otherwise(F.concat("qname", F.lit("#"), k.cast("string"))))


def visibility_violations(edges: DataFrame, symbols: DataFrame, private: DataFrame) -> DataFrame:
    """(target, caller_module, callers): modules other than its own that use a private symbol (id); symbols: qname, module."""
    own = lambda key, module: symbols.select(F.col("qname").alias(key), F.col("module").alias(module))
    used = edges.join(private.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").join(own("src", "caller_module"), "src").join(own("dst", "own"), "dst")
    return used.where("caller_module <> own").groupBy(F.col("dst").alias("target"), "caller_module").agg(F.count("*").alias("callers"))


def transitive_callers(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, direct, transitive): callers of the callers of seeds (id)."""
    direct = edges.join(seeds.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("seed"), F.col("src").alias("direct")).distinct()
    # both sides are distinct, so their triples are too and needn't be shuffled again
    return direct.join(edges.select(F.col("dst").alias("direct"), F.col("src").alias("transitive")).distinct(), "direct").select("seed", "direct", "transitive")


def resolution_ratio(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row (ratio, calls): the share of calls (target) whose target is a known symbol (qname), 4 digits; 1 without calls."""
    known = symbols.select(F.col("qname").alias("target"), F.lit(1).alias("hit")).distinct()
    return calls.join(known, "target", "left").agg(F.coalesce(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4), F.lit(1.0)).alias("ratio"), F.count("*").alias("calls"))
