"""Runtime traces: aggregation, reconciliation with the static graph, and merged state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import environment_weight

# Limits of trust and of runs that show it, names of anonymous code, statements that write.
LOW_TRUST, HIGH_TRUST, LEAST_RUNS = 0.5, 0.9, 10
ANONYMOUS = r"<(lambda|listcomp|setcomp|dictcomp|genexpr)>"
WRITE_VERBS = ("INSERT", "UPDATE", "DELETE", "REPLACE", "MERGE", "UPSERT")


def merge_environments(traces: DataFrame) -> DataFrame:
    """(env, caller, callee, count, errors) summed over traces."""
    return traces.groupBy("env", "caller", "callee").agg(F.sum("count").alias("count"), F.sum("errors").alias("errors"))


def aggregate_edges(merged: DataFrame) -> DataFrame:
    """(caller, callee, total_hits, total_errors, weighted, breakdown map) over environments, which are few."""
    return merged.groupBy("caller", "callee").agg(
        F.sum("count").alias("total_hits"), F.sum("errors").alias("total_errors"), F.sum(environment_weight(F.col("env")) * F.col("count")).alias("weighted"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("env", "count")))).alias("breakdown"),
    )


def node_observations(edges: DataFrame, aggregated: DataFrame) -> DataFrame:
    """(node, total_hits, observed) of nodes that static edges lead to."""
    hits = edges.select(F.col("src").alias("caller"), F.col("dst").alias("callee")).distinct().join(aggregated, ["caller", "callee"], "left")
    return hits.groupBy(F.col("callee").alias("node")).agg(F.coalesce(F.sum("total_hits"), F.lit(0)).alias("total_hits")).withColumn("observed", F.col("total_hits") > 0)


def route_events(events: DataFrame, symbols: DataFrame, edges: DataFrame, named: Callable[[Column], Column] | None = None) -> DataFrame:
    """events (caller, callee, source, ...) with route: confirmed, discovered, orphan_callee or unresolved, and orphan_reason.

    Both names are looked up among symbols (qname), the pair among static edges (src, dst). Names may be numbers, of
    which named gives the names. A name's leaf is looked up last, so that no other lookup carries it.
    """
    named = named or (lambda node: node)
    known = lambda c: symbols.select(F.col("qname").alias(c), F.lit(True).alias(f"{c}_known")).distinct()
    pairs = edges.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), F.lit(True).alias("static")).distinct()
    leaves = symbols.select(F.substring_index(named(F.col("qname")), ".", -1).alias("leaf"), F.lit(True).alias("leaf_known")).distinct()
    met = events.join(known("caller"), "caller", "left").join(known("callee"), "callee", "left").join(pairs, ["caller", "callee"], "left")
    df = met.withColumn("leaf", F.substring_index(named(F.col("callee")), ".", -1)).join(leaves, "leaf", "left")
    route = F.when(F.col("caller_known").isNull(), "unresolved").when(F.col("callee_known").isNull(), "orphan_callee").when(F.col("static"), "confirmed").otherwise("discovered")
    reason = orphan_reason(named(F.col("caller")), named(F.col("callee")), F.col("source"), F.col("leaf_known"))
    return df.select(*events.columns, route.alias("route"), F.when(route.isin("unresolved", "orphan_callee"), reason).alias("orphan_reason"))


def orphan_reason(caller: Column, callee: Column, source: Column, leaf_known: Column) -> Column:
    return (
        F.when(callee.isNull(), "NO_STATIC_MATCH").when(callee.rlike(ANONYMOUS) | F.coalesce(caller, F.lit("")).rlike(ANONYMOUS), "ANONYMOUS_CLOSURE").when(caller.isNull(), "NO_STATIC_MATCH")
        .when(leaf_known, "AMBIGUOUS_SIGNATURE").when(source == "otel", "NATIVE_OR_C_EXTENSION").otherwise("DYNAMIC_DISPATCH")
    )


def trust(routed: DataFrame) -> DataFrame:
    """One row: events, matched, trust_score (1 for none) and whether it is low or high."""
    counts = routed.agg(F.count("*").alias("events"), F.count_if(F.col("route").isin("confirmed", "discovered")).alias("matched"))
    score = F.round(F.when(F.col("events") > 0, F.col("matched") / F.col("events")).otherwise(1.0), 4)
    return counts.withColumn("trust_score", score).withColumns({"low_trust": F.col("trust_score") < LOW_TRUST, "high_trust": F.col("trust_score") >= HIGH_TRUST})


def never_observed(events: DataFrame, edges: DataFrame, routed: DataFrame, least: int = LEAST_RUNS) -> DataFrame:
    """(src, dst): static CALLS edges whose caller ran at least least times and that no event confirmed."""
    busy = events.where("caller IS NOT NULL").groupBy(F.col("caller").alias("src")).agg(F.count("*").alias("runs")).where(F.col("runs") >= least)
    seen = routed.where("route = 'confirmed'").select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()
    return edges.where("relation = 'CALLS'").select("src", "dst").distinct().join(busy, "src", "left_semi").join(seen, ["src", "dst"], "left_anti")


def overlay(edges: DataFrame, aggregated: DataFrame) -> DataFrame:
    """edges with hits, errors and status: ERROR_SINK with errors, ACTIVE with hits, else UNOBSERVED."""
    joined = edges.join(aggregated.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "total_hits", "total_errors"), ["src", "dst"], "left")
    hits, errors = F.coalesce("total_hits", F.lit(0)), F.coalesce("total_errors", F.lit(0))
    return joined.withColumns({"hits": hits, "errors": errors, "status": F.when(errors > 0, "ERROR_SINK").when(hits > 0, "ACTIVE").otherwise("UNOBSERVED")}).drop("total_hits", "total_errors")


def merge_state(state: DataFrame, run: DataFrame) -> DataFrame:
    """Edge state after a run: (caller, callee, kind, count). Kinds only rise: unobserved, fuzzy, discovered, confirmed; counts add up."""
    order = {"unobserved": 0, "fuzzy": 1, "discovered": 2, "confirmed": 3}
    rank = F.lit(-1)
    for k, v in order.items():
        rank = F.when(F.col("kind") == k, v).otherwise(rank)
    both = state.select("caller", "callee", "kind", "count").unionByName(run.select("caller", "callee", "kind", "count")).withColumn("rank", rank)
    return both.groupBy("caller", "callee").agg(F.max_by("kind", "rank").alias("kind"), F.sum("count").alias("count"))


def validate_manifest(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(trace, accepted, reasons) of manifests (trace, commit, files map<path, sha>) against current (path, sha, commit): equal commit, equal hashes."""
    commit = current.agg(F.max("commit").alias("now_commit"))
    each = manifest.select("trace", "commit", F.explode_outer("files").alias("path", "sha"))
    joined = each.join(current.select("path", F.col("sha").alias("now")), "path", "left").join(F.broadcast(commit))  # one row
    summed = joined.groupBy("trace").agg((F.max("commit") != F.max("now_commit")).alias("other_commit"), F.count_if(F.col("path").isNotNull() & ~F.col("sha").eqNullSafe(F.col("now"))).alias("other_files"))
    reasons = F.array_compact(F.array(F.when(F.col("other_commit"), "commit"), F.when(F.col("other_files") > 0, "files")))
    return summed.select("trace", (F.size(reasons) == 0).alias("accepted"), F.array_join(reasons, "; ").alias("reasons"))


def normal_kind(kind: Column) -> Column:
    """Canonical name of a span's kind, a number or a string."""
    up = F.upper(kind.cast("string"))
    numbers = {"0": "UNSPECIFIED", "1": "INTERNAL", "2": "SERVER", "3": "CLIENT", "4": "PRODUCER", "5": "CONSUMER"}
    out = F.regexp_replace(up, "^SPAN_KIND_", "")
    for k, v in numbers.items():
        out = F.when(up == k, v).otherwise(out)
    return F.coalesce(F.when(up.rlike(r"^\d+$") & ~up.isin(*numbers), "UNSPECIFIED").otherwise(out), F.lit("UNSPECIFIED"))


def infer_sink(attributes: Column, kind: Column) -> Column:
    """struct<tag, detail> of a span's attributes (map of strings): database verb, messaging side, or an outgoing call."""
    at = lambda k: F.nullif(F.coalesce(attributes[k], F.lit("")), F.lit(""))
    has = lambda *keys: F.coalesce(F.arrays_overlap(F.map_keys(attributes), F.array(*(F.lit(k) for k in keys))), F.lit(False))
    verb = F.upper(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(at("db.statement"), F.lit("")), r"^\s*(\S+)", 1), F.lit("")), at("db.operation"), F.lit("")))
    db = F.struct(F.when(verb.isin(*WRITE_VERBS), "#db_write").otherwise("#db_read").alias("tag"), F.coalesce(at("db.statement"), at("db.operation"), at("db.system")).alias("detail"))
    side = F.when(normal_kind(kind) == "PRODUCER", "#event_producer").when(normal_kind(kind) == "CONSUMER", "#event_consumer")
    queue = F.struct(side.alias("tag"), F.when(side.isNotNull(), F.coalesce(at("messaging.destination"), at("messaging.system"))).alias("detail"))
    out = F.struct(F.lit("#external_io").alias("tag"), F.coalesce(at("http.url"), at("rpc.method"), at("net.peer.name")).alias("detail"))
    none = F.struct(F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("detail"))
    outgoing = (normal_kind(kind) == "CLIENT") & has("http.method", "http.url", "rpc.method", "rpc.system", "net.peer.name")
    return F.when(has("db.statement", "db.system", "db.operation"), db).when(has("messaging.system", "messaging.destination"), queue).when(outgoing, out).otherwise(none)


def spans_to_events(spans: DataFrame) -> DataFrame:
    """(caller, callee, source, sink_tag, detail) from spans (trace, span_id, parent_id, kind, attributes map): a call where parent and span have code, a sink where attributes tell one."""
    symbol = F.when((F.coalesce(F.col("attributes")["code.namespace"], F.lit("")) != "") & (F.coalesce(F.col("attributes")["code.function"], F.lit("")) != ""), F.concat_ws(".", F.col("attributes")["code.namespace"], F.col("attributes")["code.function"])).otherwise(F.nullif(F.col("attributes")["code.function"], F.lit("")))
    own = spans.withColumns({"symbol": symbol, "sink": infer_sink(F.col("attributes"), F.col("kind"))})
    parent = own.select("trace", F.col("span_id").alias("parent_id"), F.col("symbol").alias("parent_symbol"))
    joined = own.join(parent, ["trace", "parent_id"], "left")
    nothing = F.lit(None).cast("string")
    calls = joined.where("parent_symbol IS NOT NULL AND symbol IS NOT NULL").select(F.col("parent_symbol").alias("caller"), F.col("symbol").alias("callee"), F.lit("otel").alias("source"), nothing.alias("sink_tag"), nothing.alias("detail"))
    sinks = joined.where("sink.tag IS NOT NULL").select(F.coalesce("parent_symbol", "symbol").alias("caller"), nothing.alias("callee"), F.lit("otel").alias("source"), F.col("sink.tag").alias("sink_tag"), F.col("sink.detail").alias("detail"))
    return calls.unionByName(sinks)
