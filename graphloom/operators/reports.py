"""Reports over runs of retrieval engines: summaries, failures, scores of answers, and their sinks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .metrics import bootstrap_mean, latest_by_key

KEYS = ("task", "engine", "budget")


def engine_summary(cells: DataFrame, metrics: list[str]) -> DataFrame:
    """(engine, cells, one mean for each metric, nulls left out)."""
    return cells.groupBy("engine").agg(F.count("*").alias("cells"), *(F.avg(m).alias(m) for m in metrics))


def success_summary(cells: DataFrame, value: str = "tsr", resamples: int = 10_000) -> DataFrame:
    """(engine, budget, mean, low, high): mean success with its bootstrap interval."""
    return bootstrap_mean(cells.select("engine", "budget", value), ["engine", "budget"], value, resamples)


def failures(cells: DataFrame, own: str, baselines: list[str], oracle: str, value: str = "tsr", gap: float = 0.2) -> DataFrame:
    """(task, budget, own, oracle, below, under_oracle): cells in which own is below any of the baselines, or over gap below the oracle."""
    wide = cells.groupBy("task", "budget").pivot("engine", list(dict.fromkeys([own, *baselines, oracle]))).agg(F.avg(value))
    below = F.coalesce(F.greatest(*(F.col(b) for b in baselines), F.lit(None).cast("double")) > F.col(own), F.lit(False))
    under = F.coalesce(F.col(own) < F.col(oracle) - gap, F.lit(False))
    return wide.select("task", "budget", F.col(own).alias("own"), F.col(oracle).alias("oracle"), below.alias("below"), under.alias("under_oracle")).where("below OR under_oracle")


def diagnostics(cells: DataFrame, metrics: list[str]) -> DataFrame:
    """(engine, metric, mean): a row for each engine and metric that has values, from one pass."""
    long = cells.unpivot("engine", metrics, "metric", "value").where("value IS NOT NULL")
    return long.groupBy("engine", "metric").agg(F.avg("value").alias("mean"))


def diagnostics_table(cells: DataFrame, metrics: list[str]) -> str:
    """The diagnostics as a Markdown table, engines down and metrics across; '-' where an engine has no value."""
    found = {(r.engine, r.metric): r["mean"] for r in diagnostics(cells, metrics).collect()}  # engines times metrics
    lines = ["| engine | " + " | ".join(metrics) + " |", "|" + "---|" * (len(metrics) + 1)]
    for engine in sorted({e for e, _ in found}):
        lines.append(f"| {engine} | " + " | ".join("-" if (engine, m) not in found else f"{found[engine, m]:.3f}" for m in metrics) + " |")
    return "\n".join(lines)


def write_results(new: DataFrame, path: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Merges rows into the JSON lines at path by keys, the new ones winning; the rows written. The old ones are set aside first, so a failed write loses none."""
    spark = new.sparkSession
    try:
        old = spark.read.schema(new.schema).json(path)
        rows = new.withColumn("age_", F.lit(1)).unionByName(old.withColumn("age_", F.lit(0)))
    except Exception as missing:  # there is no report yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = new.withColumn("age_", F.lit(1))
    kept = written(latest_by_key(rows, list(keys), "age_").drop("age_"))
    kept.write.mode("overwrite").json(path)
    return kept


def write_markdown(path: str, title: str, sections: dict[str, str], spark) -> str:
    """A Markdown report of titled sections, as one text file under path; its text."""
    body = "\n\n".join([f"# {title}", *(f"## {name}\n\n{text}" for name, text in sections.items())])
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return body


def latency(run: Callable[[], DataFrame], index: Callable[[], object], warm_runs: int = 3) -> dict[str, float]:
    """Seconds of indexing and a first query, and the mean of warm_runs further ones."""
    began = time.perf_counter()
    index()
    run().count()
    cold = time.perf_counter() - began
    began = time.perf_counter()
    for _ in range(warm_runs):
        run().count()
    return {"cold": cold, "warm": (time.perf_counter() - began) / max(1, warm_runs)}


def rubric_score(answer: Column, seed: Column, neighbours: Column) -> Column:
    """1 if an answer names the seed's last part as a word, less 1 if it says that a neighbour is, replaces or equals it."""
    leaf = lambda x: F.substring_index(x, ".", -1)
    word = lambda x: F.concat(F.lit(r"(?i)\b"), x, F.lit(r"\b"))
    joined = F.exists(neighbours, lambda n: F.regexp_like(answer, F.concat(word(leaf(n)), F.lit(r"\s+(?:is|replaces|equals|is the same as)\s+"), word(leaf(seed)))))
    return F.regexp_like(answer, word(leaf(seed))).cast("int") - joined.cast("int")


def debug_score(named: Column, path: Column, candidates: Column, coverage: Column) -> Column:
    """coverage of the path by an answer's names in order, or 0 if it names a candidate that isn't on the path."""
    return F.when(F.size(F.array_except(F.array_intersect(named, candidates), path)) > 0, 0.0).otherwise(coverage)


def preserved_semantics(items: DataFrame, weights: tuple[float, ...] = (1.0, 0.75, 0.5, 0.25)) -> DataFrame:
    """(query, preserved): percent of the most that a query's candidates could keep, by the resolution of those packed; items: query, level (null: not packed)."""
    worth = F.lit(0.0)
    for level, weight in enumerate(weights):
        worth = F.when(F.col("level") == level, weight).otherwise(worth)
    return items.groupBy("query").agg(F.round(100 * F.sum(worth) / (F.count("*") * weights[0]), 1).alias("preserved"))


def packing_efficiency(items: DataFrame) -> DataFrame:
    """(query, ratio): summed 1 / (1 + distance) of packed nodes over the bound of a fractional packing, at most 1; items: query, distance, bound, seed boolean."""
    value = F.sum(F.when(F.col("seed"), 0.0).otherwise(1 / (1 + F.col("distance"))))
    return items.groupBy("query").agg(value.alias("v"), F.max("bound").alias("bound")).select("query", F.when(F.col("bound") > 0, F.least(F.col("v") / F.col("bound"), F.lit(1.0))).otherwise(1.0).alias("ratio"))


def dependencies(edges: DataFrame, most: int = 8, compact_from: int = 5) -> DataFrame:
    """(src, shown, more_pure, more_other) of edges (src, dst, critical boolean, hits, pure boolean): all names of up to compact_from dependencies, else the most critical, then most hit, then first by name, and how many are left."""
    w = Window.partitionBy("src").orderBy(F.desc("critical"), F.desc("hits"), "dst")  # one symbol's callees
    ranked = edges.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("src"))})
    shown = (F.col("n") <= compact_from) | (F.col("k") <= most)
    names = F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("k", "dst")))), lambda x: x["dst"])
    return ranked.groupBy("src").agg(names.alias("shown"), F.count_if(~shown & F.col("pure")).alias("more_pure"), F.count_if(~shown & ~F.col("pure")).alias("more_other"))


def in_scope(candidates: DataFrame, reached: DataFrame) -> DataFrame:
    """candidates (query, seed, id, module, seed_module) that are the seed, reached by calls (query, id), or of the seed's package (three first parts of the module)."""
    near = reached.select("query", "id", F.lit(True).alias("near_")).distinct()
    joined = candidates.join(near, ["query", "id"], "left")
    same = F.substring_index("module", ".", 3) == F.substring_index("seed_module", ".", 3)
    return joined.where((F.col("id") == F.col("seed")) | F.col("near_") | same).drop("near_")


def sorted_violations(violations: DataFrame) -> DataFrame:
    """Violations by type, file and symbol."""
    return violations.orderBy("type", "file", "symbol")


def graph_status(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, symbols, modules, calls): symbols and modules by kind, and the calls that lead from them."""
    calls = edges.where("relation IN ('CALLS', 'INSTANTIATES')").groupBy(F.col("src").alias("qname")).agg(F.count("*").alias("n"))
    return symbols.join(calls, "qname", "left").groupBy("kind").agg(F.count("*").alias("symbols"), F.count_distinct("module").alias("modules"), F.coalesce(F.sum("n"), F.lit(0)).alias("calls"))


def symbols_by_tag(tags: DataFrame, tag: str, observed: DataFrame) -> DataFrame:
    """(tag, symbol, invocations) of symbols (symbol, tags array) with a tag, and how often each was seen to run (symbol)."""
    calls = observed.groupBy("symbol").agg(F.count("*").alias("n"))
    held = tags.where(F.array_contains("tags", tag)).select("symbol")
    return held.join(calls, "symbol", "left").select(F.lit(tag).alias("tag"), "symbol", F.coalesce("n", F.lit(0)).alias("invocations"))
