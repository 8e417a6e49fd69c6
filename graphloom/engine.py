"""The embedding interface: an index of a repository and seed-and-budget queries over it."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scores, text
from .functions.bits import compose_mask
from .operators import compress, graph, joins, packing, profiles, reports, surface, tagging
from .plans.tag_filter import QueryValidationError, tag_filter
from .sources import files, other_languages, python_source
from .storage import written

TASK_TYPES = ("implement", "debug", "blast", "architecture", "redundancy")
SNAPSHOT_VERSION = 1


@runtime_checkable
class CompressionProvider(Protocol):
    """Texts of definitions at four resolutions: (qname, l0, l1, l2, l3), as compress.compress gives them."""

    def __call__(self, files: DataFrame, definitions: DataFrame) -> DataFrame: ...


class RetrievalEngine(ABC):
    """An engine that benchmarks can ask: packages of (query, id, ord) for queries."""

    @abstractmethod
    def retrieve(self, *queries: Query) -> DataFrame: ...


class SymbolNotFoundError(LookupError):
    """A seed that isn't there; candidates are names like it."""

    def __init__(self, seed: str, candidates: list[str]):
        self.seed, self.candidates = seed, candidates
        super().__init__(f"seed symbol {seed!r} not found" + (f"; similar: {', '.join(candidates)}" if candidates else ""))


@dataclass(frozen=True)
class Query:
    """One seed or several, a token budget, a task and how far to look."""

    seed: str | None = None
    seeds: tuple[str, ...] = ()
    budget: int = 4000
    task_type: str = "implement"
    d_max: float = 5.0

    def __post_init__(self):
        if bool(self.seed) == bool(self.seeds):
            raise QueryValidationError("give either a seed or seeds")
        if not 1 <= self.budget <= 128_000:
            raise QueryValidationError("the budget must be from 1 to 128000")
        if self.task_type not in TASK_TYPES:
            raise QueryValidationError(f"unknown task type {self.task_type!r}")
        if self.d_max <= 0:
            raise QueryValidationError("d_max must be positive")

    def resolved(self) -> tuple[str, ...]:
        return (self.seed,) if self.seed else self.seeds


@dataclass
class Engine(RetrievalEngine):
    """Symbols, edges and masks of one repository, as tables; queries of many seeds run in one job."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    sinks: DataFrame | None = None
    _before: list[Callable] = field(default_factory=list)
    _after: list[Callable] = field(default_factory=list)

    @classmethod
    def from_repo(cls, spark: SparkSession, root: str, snapshot: str | None = None) -> Engine:
        """Indexes a source tree, or loads its snapshot if that is of the same files."""
        sources = written(files.read_sources(spark, root))
        if snapshot and (held := files.load_snapshot(spark, snapshot, SNAPSHOT_VERSION, sources)):
            return cls(held["files"], held["symbols"], held["edges"])
        parsed = written(python_source.parse_files(sources.where("language = 'python'")))
        others = sources.where("language <> 'python'").select("path", "module", "language", F.col("content").alias("source"))
        symbols = written(python_source.symbols_of(parsed).unionByName(other_languages.symbols(others), allowMissingColumns=True))
        edges = written(python_source.edges_of(parsed).unionByName(other_languages.type_edges(others, symbols), allowMissingColumns=True))
        listed = sources.select("path", "module", "language", "sha", "content").join(parsed.select("path", "error"), "path", "left")
        out = cls(written(listed), symbols, edges)
        if snapshot:
            files.save_snapshot({"files": out.files, "symbols": out.symbols, "edges": out.edges}, snapshot, SNAPSHOT_VERSION)
        return out

    def register_before(self, callback: Callable) -> None:
        """callback(queries) is told of each request before it runs."""
        self._before.append(callback)

    def register_after(self, callback: Callable) -> None:
        """callback(result) is told of each result."""
        self._after.append(callback)

    def masks(self) -> DataFrame:
        """(qname, module, cost, verification, mask): form and output of each definition, roles by degree, sinks by what it calls."""
        calls = self.edges.where("relation IN ('CALLS', 'INSTANTIATES')")
        spark = self.symbols.sparkSession
        chains = calls.select(F.col("src").alias("caller"), F.lit("python").alias("language"), F.col("dst").alias("chain"), F.lit(None).cast("string").alias("target"))
        direct = tagging.sink_bits(chains, tagging.default_registry(spark) if self.sinks is None else self.sinks)
        facts = self.symbols.select("qname", "n_statements", (F.size("mutations") > 0).alias("mutates"))
        df = self.symbols.join(tagging.substance(direct, calls, facts).withColumnRenamed("mask", "substance"), "qname", "left")
        df = df.withColumn("exported", text.visibility(F.col("name"), F.lit("python"), F.lit(True)) == "public")
        roles = profiles.role_bits(df.where("kind <> 'class'").select("qname", "substance", "exported"), calls)
        body = self.files.select("path", "content")
        df = df.join(roles, "qname", "left").join(body, "path", "left")
        cost = F.greatest(text.fallback_token_count(text.line_range(F.col("content"), F.col("start"), F.col("end"))), F.lit(1))
        return df.select("qname", "path", "module", "kind", "start", "end", cost.alias("cost"), text.is_test_file(F.col("path")).alias("verification"), compose_mask(F.col("substance"), F.col("form"), F.col("output"), F.col("role_mask")).alias("mask"), text.line_range(F.col("content"), F.col("start"), F.col("end")).alias("body"))

    def check_seeds(self, seeds: tuple[str, ...]) -> None:
        spark = self.symbols.sparkSession
        asked = spark.createDataFrame([(s,) for s in seeds], "query string")
        lost = [r.query for r in asked.join(self.symbols.select(F.col("qname").alias("query")), "query", "left_anti").collect()]  # of the asked seeds
        if lost:
            like = joins.similar_names(self.symbols.select("qname"), asked.where(F.col("query") == lost[0])).orderBy("rank").collect()
            raise SymbolNotFoundError(lost[0], [r.qname for r in like])

    def retrieve(self, *queries: Query) -> DataFrame:
        """(query, id, role, distance, kind, file, start, end, cost, body) of each query's package; queries are numbered as given."""
        for callback in self._before:
            callback(tuple(queries))
        self.check_seeds(tuple({s for q in queries for s in q.resolved()}))
        spark = self.symbols.sparkSession
        asked = spark.createDataFrame([(i, s, q.budget, q.d_max) for i, q in enumerate(queries) for s in q.resolved()], "query int, node string, budget int, d_max double")
        calls = self.edges.select("src", "dst", "relation").distinct()
        cost = calls.withColumn("cost", scores.edge_cost(scores.relation_weight(F.col("relation"))))
        found = graph.distances(cost, asked.select("query", "node"), max(q.d_max for q in queries))
        seed = asked.groupBy("query").agg(F.min("node").alias("seed"), F.first("budget").alias("budget"), F.first("d_max").alias("d_max"))
        near = found.join(seed, "query").where("dist <= d_max").select("query", F.col("node").alias("qname"), F.col("dist").alias("distance"))
        own = asked.select("query", F.col("node").alias("qname"), F.lit(0.0).alias("distance"))
        site = self.edges.where("relation IN ('CALLS', 'INSTANTIATES')").groupBy("src", "dst").agg(F.max(F.col("bound_to").isNotNull()).alias("unpacks"), F.max(F.col("n_args") > 0).alias("args"), F.first("relation").alias("relation"))
        up = asked.select("query", F.col("node").alias("dst")).join(site, "dst").select("query", F.col("src").alias("qname"), (1 / scores.upstream_weight(F.col("relation"), F.col("unpacks"), F.col("args"))).alias("upstream"), F.col("unpacks").alias("preserving"))
        up = up.groupBy("query", "qname").agg(F.min("upstream").alias("upstream"), F.max("preserving").alias("preserving"))
        reach = own.unionByName(near).groupBy("query", "qname").agg(F.min("distance").alias("distance")).join(up, ["query", "qname"], "full")
        facts = written(self.masks())
        succ = calls.groupBy(F.col("src").alias("qname")).agg(F.collect_set("dst").alias("successors"))
        candidates = reach.join(facts, "qname").join(succ, "qname", "left").join(F.broadcast(seed), "query")  # the asked queries
        candidates = candidates.withColumn("preserving", F.coalesce("preserving", F.lit(False)))
        columns = ["query", "seed", "budget", "qname", "distance", "upstream", "preserving", "mask", "cost", "module", "verification", "successors"]
        picked = packing.select_submodular(candidates.select(*columns))
        direct = calls.select(F.col("src").alias("seed"), F.col("dst").alias("qname"), F.lit(True).alias("direct")).distinct()
        out = picked.join(candidates, ["query", "qname"]).join(direct, ["seed", "qname"], "left")
        role = packing.role_in_package(F.col("qname"), F.col("seed"), F.coalesce("direct", F.lit(False)), F.col("distance"), F.col("upstream"))
        result = written(out.select("query", F.col("qname").alias("id"), role.alias("role"), F.coalesce("distance", "upstream").alias("distance"), "kind", F.col("path").alias("file"), "start", "end", "cost", "mask", "body", "ord"))
        for callback in self._after:
            callback(result)
        return result

    def retrieve_requested(self, seed: str, requested: list[str], universe: DataFrame | None = None) -> DataFrame:
        """(id, ord) of requested names within the universe (qname), once each in order, and the seed's direct callees after them."""
        spark = self.symbols.sparkSession
        known = self.symbols.select("qname") if universe is None else universe.select("qname")
        asked = spark.createDataFrame([(n, i) for i, n in enumerate([seed, *requested])], "qname string, ord int")
        direct = self.edges.where((F.col("src") == seed) & F.col("relation").isin("CALLS", "INSTANTIATES")).select(F.col("dst").alias("qname"), F.lit(len(requested) + 1).alias("ord"))
        return asked.unionByName(direct).groupBy("qname").agg(F.min("ord").alias("ord")).join(known.distinct(), "qname", "left_semi").select(F.col("qname").alias("id"), "ord").orderBy("ord", "id")

    def retrieve_two_pass(self, query: Query, choose: Callable[[list[str]], list[str]]) -> DataFrame:
        """The names that choose picks from a manifest of candidates, in order."""
        lines = self.manifest(query.resolved()[0]).collect()  # one seed's manifest
        return self.retrieve_requested(query.resolved()[0], choose([r.line for r in lines]))

    def retrieve_three_pass(self, query: Query, choose: Callable[[list[str]], list[str]], externals: DataFrame, choose_external: Callable[[list[str]], list[str]]) -> tuple[DataFrame, DataFrame]:
        """What retrieve_two_pass gives, and of externals (name, cost, body) those that choose_external picks from their names, first come within a share of the budget.

        externals is what one query may choose from, by name; the choice comes back as (id, ord).
        """
        spark = self.symbols.sparkSession
        picked = self.retrieve_two_pass(query, choose)
        names = [r.name for r in externals.select("name").orderBy("name").collect()]  # one query's offer
        wanted = spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(choose_external(names)))], "name string, ord int")
        budget = spark.range(1).select(scores.split_external_budget(F.lit(query.budget)).alias("b")).first().b
        fitted = packing.first_fit(wanted.join(externals, "name").select(F.lit(0).alias("query"), F.lit(budget).alias("budget"), "ord", F.col("name").alias("qname"), "cost"))
        return picked, fitted.where("admitted").select(F.col("qname").alias("id"), "ord")

    def compressed(self, result: DataFrame, provider: CompressionProvider = compress.compress) -> DataFrame:
        """result (query, id, ...) with the texts l0 to l3 of its definitions and their estimated costs c0 to c3."""
        calls = self.edges.where("relation IN ('CALLS', 'INSTANTIATES')").groupBy(F.col("src").alias("qname")).agg(F.array_sort(F.collect_set("dst")).alias("calls"))
        found = self.symbols.join(result.select(F.col("id").alias("qname")).distinct(), "qname", "left_semi").join(calls, "qname", "left")
        sources = self.files.select("path", "language", F.col("content").alias("source"))
        texts = compress.with_costs(provider(sources, found.select("qname", "path", "name", "start", "end", F.array().cast("array<string>").alias("tags"), "calls")))
        return result.join(texts.withColumnRenamed("qname", "id"), "id", "left")

    def build_package(self, queries: list[Query], result: DataFrame | None = None) -> DataFrame:
        """Packages whose text keeps to the budget: retrieved nodes with body and cost, the farthest transitive ones as stubs where all would not fit.

        result: what retrieve or, with a query, role and distance, a request gave; by default what the queries retrieve.
        """
        spark = self.symbols.sparkSession
        rows = self.compressed(result if result is not None else self.retrieve(*queries))
        budgets = spark.createDataFrame([(i, q.budget) for i, q in enumerate(queries)], "query int, budget int")
        priced = rows.join(F.broadcast(budgets), "query").withColumns({"full_cost": F.coalesce("c0", "cost"), "stub_cost": F.coalesce("c3", "cost")})  # a row for each query
        fitted = compress.enforce_budget(priced)
        body = F.when(F.col("stub"), F.col("l3")).otherwise(F.coalesce("l0", "body"))
        return fitted.withColumns({"body": body, "cost": F.when(F.col("stub"), F.col("stub_cost")).otherwise(F.col("full_cost"))}).drop("full_cost", "stub_cost", "budget")

    def build_package_requested(self, query: Query, requested: list[str], universe: DataFrame | None = None) -> DataFrame:
        """The package of the names requested for a query's seed, in their order, and the seed's callees; what doesn't fit its budget as stubs."""
        seed = query.resolved()[0]
        self.check_seeds((seed,))
        direct = self.edges.where((F.col("src") == seed) & F.col("relation").isin("CALLS", "INSTANTIATES")).select(F.col("dst").alias("id"), F.lit("callee").alias("called")).distinct()
        rows = self.retrieve_requested(seed, requested, universe).join(self.masks().withColumnRenamed("qname", "id"), "id").join(direct, "id", "left")
        role = F.when(F.col("id") == seed, "seed").otherwise(F.coalesce("called", F.lit("transitive")))
        return self.build_package([query], rows.select(F.lit(0).alias("query"), "id", role.alias("role"), F.col("ord").cast("double").alias("distance"), "kind", F.col("path").alias("file"), "start", "end", "cost", "mask", "body", "ord"))

    def warnings(self, package: DataFrame, queries: list[Query]) -> DataFrame:
        """(query, code, severity): packages over their budget, with stubs, or of nothing but the seed."""
        spark = self.symbols.sparkSession
        budgets = spark.createDataFrame([(i, q.budget) for i, q in enumerate(queries)], "query int, budget int")
        sums = package.groupBy("query").agg(F.sum("cost").alias("used"), F.count("*").alias("nodes"), F.max("stub").alias("stubbed")).join(F.broadcast(budgets), "query")
        told = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for c, code, severity in ((F.col("used") > F.col("budget") * 1.05, "BUDGET_OVERFLOW", "high"), (F.col("stubbed"), "BODY_STUBBED", "low"), (F.col("nodes") == 1, "ISOLATED_SEED", "low")))))
        return sums.select("query", F.explode(told).alias("w")).select("query", "w.code", "w.severity")

    def explain(self, query: Query, detail: str = "full") -> DataFrame:
        """(query, xml) of a package with its warnings, at a level of detail: full, manifest (no bodies) or summary (no nodes)."""
        package = written(self.build_package([query]))
        spark = self.symbols.sparkSession
        heads = spark.createDataFrame([(0, query.resolved()[0], query.budget)], "query int, seed string, budget int")
        packages = heads.join(package.groupBy("query").agg(F.sum("cost").alias("used")), "query")
        edges = surface.induced_edges(package, self.edges.select("src", "dst", "relation").distinct())
        return surface.render_xml(packages, surface.detail_level(package, detail), edges, self.warnings(package, [query]))

    def manifest(self, seed: str, hops: int = 3) -> DataFrame:
        """(qname, line): candidates within hops of the seed, or of its package prefix, with kind and what they call."""
        spark = self.symbols.sparkSession
        reach = graph.bfs(self.edges.where("relation IN ('CALLS', 'INSTANTIATES')"), spark.createDataFrame([(0, seed)], "query int, node string"), max_hops=hops)
        prefix = self.symbols.where(F.col("qname") == seed).select(text.prefix3(F.col("module")).alias("p"))
        near = self.symbols.withColumn("p", text.prefix3(F.col("module"))).join(F.broadcast(prefix), "p", "left_semi").select("qname")  # one row
        chosen = reach.select(F.col("node").alias("qname")).union(near).distinct()
        df = self.symbols.join(chosen, "qname", "left_semi").join(packing.outgoing_names(self.edges), "qname", "left")
        params = F.array_join(F.transform("params", lambda p: text.parameter_text(p["name"], p["type"], p["default"])), ", ")
        line = F.concat_ws("|", "qname", "kind", F.concat(F.lit("("), params, F.lit(")")), F.concat(F.lit("calls=["), F.coalesce(F.array_join("calls", ","), F.lit("")), F.lit("]")))
        return df.select("qname", line.alias("line")).orderBy("qname")

    def render(self, result: DataFrame, queries: list[Query], fmt: str = "xml") -> DataFrame:
        """(query, xml or markdown) of retrieved packages."""
        spark = self.symbols.sparkSession
        heads = spark.createDataFrame([(i, q.resolved()[0], q.budget) for i, q in enumerate(queries)], "query int, seed string, budget int")
        packages = heads.join(result.groupBy("query").agg(F.sum("cost").alias("used")), "query")
        if fmt == "markdown":
            return surface.render_markdown(packages, result)
        edges = surface.induced_edges(result, self.edges.select("src", "dst", "relation").distinct())
        none = spark.createDataFrame([], "query int, code string, severity string")
        return surface.render_xml(packages, result, edges, none)

    def find_symbols(self, expression: str) -> DataFrame:
        """(qname, path) of the symbols that a tag expression holds for."""
        return self.masks().where(tag_filter(expression, F.col("mask"), F.col("verification"))).select("qname", "path").orderBy("qname")

    def status_by_kind(self) -> DataFrame:
        return reports.graph_status(self.symbols, self.edges)

    def status(self) -> DataFrame:
        """One row: files, errors, symbols, edges by relation."""
        f = self.files.agg(F.count("*").alias("files"), F.count("error").alias("errors"))
        s = self.symbols.agg(F.count("*").alias("symbols"))
        e = self.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("relation") == "CALLS").alias("calls"))
        return f.join(F.broadcast(s)).join(F.broadcast(e))  # single rows


class Repositories:
    """Engines by root, made when first asked for; the least lately used goes when there are more than most."""

    def __init__(self, spark: SparkSession, most: int = 8, snapshots: str | None = None):
        self.spark, self.most, self.snapshots = spark, most, snapshots
        self._held: OrderedDict[str, Engine] = OrderedDict()

    def get_or_index(self, root: str) -> Engine:
        if root not in self._held:
            self._held[root] = Engine.from_repo(self.spark, root, self.snapshots and f"{self.snapshots}/{text_key(root)}")
            if len(self._held) > self.most:
                self._held.popitem(last=False)
        self._held.move_to_end(root)
        return self._held[root]

    def reindex(self, root: str) -> Engine:
        """The engine of root over its files as they are now."""
        self._held.pop(root, None)
        return self.get_or_index(root)


def text_key(root: str) -> str:
    import hashlib

    return hashlib.md5(root.encode()).hexdigest()
