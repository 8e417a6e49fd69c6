"""Budgeted selection: greedy packers per seed, in grouped Arrow functions.

Selection is a sequence of choices within one seed, so seeds are worked on side by
side. What a group needs is its own candidates: a bounded neighbourhood of the seed
with distances, masks and costs, made by joins before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.bits import SUBSTANCE_SINKS
from .groups import each_group

IMMUNE_DISTANCE, STREAK, SCOPE_DISTANCE, UPSTREAM_CAP, GENERATION_CAP = 1.0, 10, 2.0, 3, 2
UPSTREAM_HOPS, UPSTREAM_BONUS, SAFE_BONUS = 1.5, 1.30, 1.25


def outgoing_names(edges: DataFrame, most: int = 12) -> DataFrame:
    """(qname, calls): the first names, in order, that a symbol calls, sentinels left out."""
    each = edges.where(F.col("relation").isin("CALLS", "INSTANTIATES") & ~F.col("dst").startswith("<")).select("src", "dst").distinct()
    ranked = each.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("k") <= most)
    return ranked.groupBy(F.col("src").alias("qname")).agg(F.array_sort(F.collect_list("dst")).alias("calls"))


class Candidate:
    __slots__ = ("distance", "mask", "cost", "module", "verification", "successors")

    def __init__(self, distance, mask, cost, module, verification, successors):
        self.distance, self.mask, self.cost, self.module, self.verification, self.successors = distance, int(mask or 0), int(cost or 0), module or "", bool(verification), sorted(successors if successors is not None else ())


class GreedyPacker:
    """One seed's selection by value density: decay by distance times a bonus for new bits, over cost."""

    def __init__(self, nodes: dict[str, Candidate], seed: str, budget: int, max_hops: float = 6.0, beta: float = scores.BETA, delta_max: int = scores.DELTA_MAX, upstream: dict[str, float] | None = None, preserving: frozenset[str] = frozenset(), scoped: bool = True):
        if beta * delta_max >= SAFE_BONUS:
            raise ValueError("the bonus for new bits could outrank a hop")
        self.nodes, self.seed, self.budget, self.max_hops, self.beta, self.delta_max = nodes, seed, budget, max_hops, beta, delta_max
        self.upstream, self.preserving, self.scoped = upstream or {}, preserving, scoped
        own = nodes.get(seed)
        self.cost, self.covered = (own.cost, own.mask) if own else (0, 0)
        self.picked, self.chosen, self.frontier, self.streak = [seed], {seed}, set(), 0
        self.distance = {n: c.distance for n, c in nodes.items() if c.distance is not None}

    def in_scope(self, name: str) -> bool:
        if not self.scoped or self.distance[name] <= SCOPE_DISTANCE:
            return True
        own, other = self.nodes[self.seed], self.nodes[name]
        near = own.module and other.module and own.module.split(".")[:3] == other.module.split(".")[:3]
        return bool(near or own.mask & other.mask & SUBSTANCE_SINKS)

    def mismatched(self, name: str) -> bool:
        return self.scoped and not self.nodes[self.seed].verification and self.nodes[name].verification

    def novelty(self, name: str) -> int:
        return (self.nodes[name].mask & ~self.covered).bit_count()

    def best(self, pool, streak_counts: bool) -> str | None:
        """The densest that fits; ties go to the first name."""
        choice, top = None, -1.0
        nodes, distance, room, free, preserving = self.nodes, self.distance, self.budget - self.cost, ~self.covered, self.preserving
        tired, checked = streak_counts and self.streak >= STREAK, self.scoped and not nodes[self.seed].verification
        beta, most = self.beta, self.delta_max
        for name in pool:
            c = nodes[name]
            if c.cost > room or checked and c.verification:
                continue
            new, far = (c.mask & free).bit_count(), distance[name]
            if tired and not new and far > IMMUNE_DISTANCE:
                continue
            d = (1 + beta * (new if new < most else most)) / (1 + far) ** 2 * (UPSTREAM_BONUS if name in preserving else 1.0) / (c.cost if c.cost > 1 else 1)
            if d > top or d == top and name < choice:
                choice, top = name, d
        return choice

    def admit(self, name: str) -> None:
        if self.novelty(name):
            self.streak = 0
        elif self.distance[name] > IMMUNE_DISTANCE:
            self.streak += 1
        self.picked.append(name)
        self.chosen.add(name)
        self.cost += self.nodes[name].cost
        self.covered |= self.nodes[name].mask
        self.frontier.discard(name)

    def discover(self, name: str) -> set[str]:
        new = {s for s in self.nodes[name].successors if s in self.distance and s not in self.chosen and s not in self.frontier and self.nodes[s].distance is not None and self.nodes[s].distance <= self.max_hops and self.nodes[s].cost > 0 and self.in_scope(s)}
        self.frontier |= new
        return new

    def cascade(self, first: set[str]) -> None:
        """Up to two of each newly discovered generation, oldest generation first."""
        waiting = [first] if first else []
        while waiting:
            generation = waiting.pop(0)
            for _ in range(min(len(generation), GENERATION_CAP)):
                name = self.best(generation & self.frontier, False)
                if name is None:
                    break
                self.admit(name)
                generation = generation - {name}
                if found := self.discover(name):
                    waiting.append(found)

    def run(self) -> list[str]:
        if self.seed not in self.nodes:
            return self.picked
        first = self.discover(self.seed)
        near = sorted((d, n) for n, d in self.upstream.items() if d <= UPSTREAM_HOPS and n in self.nodes and self.nodes[n].cost > 0)[:UPSTREAM_CAP]
        for d, name in near:
            self.distance[name] = min(d, self.distance.get(name, d))
            self.frontier.add(name)
        self.cascade(first)
        while self.frontier and (name := self.best(self.frontier, True)) is not None:
            self.admit(name)
            self.cascade(self.discover(name))
        for name in self.nodes[self.seed].successors:  # what is one hop away and fits
            c = self.nodes.get(name)
            if c and name not in self.picked and c.distance is not None and c.distance <= IMMUNE_DISTANCE and c.cost > 0 and self.cost + c.cost <= self.budget and not self.mismatched(name):
                self.picked.append(name)
                self.cost += c.cost
                self.covered |= c.mask
        if near:
            name = near[0][1]
            if name not in self.picked and self.cost + self.nodes[name].cost <= self.budget and not self.mismatched(name):
                self.picked.append(name)
        return self.picked


def select_submodular(candidates: DataFrame, max_hops: float = 6.0, scoped: bool = True) -> DataFrame:
    """(query, qname, ord, running_cost): greedy selection for each query.

    candidates: query, seed, budget, qname, distance (null for callers only), upstream (distance of a caller or
    null), preserving, mask, cost, module, verification, successors array. One row of each query is the seed.
    """

    columns = ["query", "seed", "budget", "qname", "distance", "upstream", "preserving", "mask", "cost", "module", "verification", "successors"]

    def pack(rows):
        missing = lambda x: x is None or x != x
        nodes, upstream, preserving = {}, {}, set()
        for _, _, _, qname, distance, up, kept, mask, cost, module, verification, successors in rows:
            nodes[qname] = Candidate(None if missing(distance) else distance, mask, cost, module, verification, successors)
            if not missing(up):
                upstream[qname] = up
            if kept:
                preserving.add(qname)
        query, seed, budget = rows[0][:3]
        used = 0
        for i, name in enumerate(GreedyPacker(nodes, seed, int(budget), max_hops, upstream=upstream, preserving=frozenset(preserving), scoped=scoped).run()):
            used += nodes[name].cost if name in nodes else 0
            yield query, name, i, used

    kind = candidates.schema["query"].dataType.simpleString()
    return each_group(callers_within_cap(candidates).select(*columns), "query", pack, f"query {kind}, qname string, ord int, running_cost long")


def callers_within_cap(candidates: DataFrame) -> DataFrame:
    """candidates without callers that can't be chosen: those that the seed doesn't reach and that aren't among its nearest few; so a seed with many callers is no large group."""
    able = (F.col("upstream") <= UPSTREAM_HOPS) & (F.col("cost") > 0)
    w = Window.partitionBy("query").orderBy(F.when(able, 0).otherwise(1), "upstream", "qname")
    reached = candidates.where("distance IS NOT NULL OR qname = seed OR upstream IS NULL")
    callers = candidates.where("upstream IS NOT NULL").withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= UPSTREAM_CAP).drop("k_")  # a rank filter, applied before the shuffle too
    return reached.unionByName(callers.where("distance IS NULL AND qname <> seed"))


def first_fit(requests: DataFrame) -> DataFrame:
    """(query, qname, ord, admitted, running_cost): requests (query, budget, ord, qname, cost) in order; what doesn't fit is skipped and later ones still may."""

    def fit(rows):
        used = 0
        for query, budget, order, name, cost in rows:
            ok = budget is not None and cost is not None and used + cost <= budget
            used += cost if ok else 0
            yield query, name, order, ok, used

    kind, name = requests.schema["query"].dataType.simpleString(), requests.schema["qname"].dataType.simpleString()
    return each_group(requests.select("query", "budget", F.col("ord").cast("int").alias("ord"), "qname", "cost"), "query", fit, f"query {kind}, qname {name}, ord int, admitted boolean, running_cost long", [F.asc_nulls_last("ord")])


def pack_by_distance(candidates: DataFrame, swaps: int = 5, attempts: int = 20) -> DataFrame:
    """(query, qname, resolution, cost): seeds first, then by distance; each item at the best resolution that fits, from what its distance asks for down to 3; the first that doesn't fit at all ends it; then swaps.

    candidates: query, budget, qname, distance (0: the seed), protected, c0..c3 (cost at each resolution).
    """

    def pack(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["distance", "qname"], ignore_index=True)
        budget, used, items, rest = int(pdf["budget"].iat[0]), 0, [], []
        rows = pdf.to_dict("records")
        for i, r in enumerate(rows):
            first = 0 if r["distance"] == 0 else 1 if r["distance"] <= 0.25 else 2 if r["distance"] <= 0.55 else 3
            level = next((k for k in range(first, 4) if used + r[f"c{k}"] <= budget), None)
            if level is None:
                if r["distance"] == 0:
                    level = 3  # a seed is never left out
                else:
                    rest = rows[i:]
                    break
            used += r[f"c{level}"]
            items.append((r, level))
        done = tried = 0
        for r in rest:  # a nearer item that was left out for the farthest unprotected one
            if tried >= attempts or done >= swaps:
                break
            tried += 1
            out = max((x for x in items if not x[0]["protected"] and x[0]["distance"] > r["distance"]), key=lambda x: (x[0]["distance"], x[0]["qname"]), default=None)
            if out is None:
                continue
            free = budget - used + out[0][f"c{out[1]}"]
            if r["c3"] <= free:
                items.remove(out)
                items.append((r, 3))
                used += r["c3"] - out[0][f"c{out[1]}"]
                done += 1
        return pd.DataFrame([(r["query"], r["qname"], k, int(r[f"c{k}"])) for r, k in items], columns=["query", "qname", "resolution", "cost"])

    kind = candidates.schema["query"].dataType.simpleString()
    return candidates.groupBy("query").applyInPandas(pack, f"query {kind}, qname string, resolution int, cost long")


def degrade_to_fit(budget: Column, *costs: Column) -> Column:
    """The first resolution whose cost is within budget, else the last."""
    out = None
    for k, c in enumerate(costs):
        out = F.when(c <= budget, k) if out is None else out.when(c <= budget, k)
    return out.otherwise(len(costs) - 1)


def role_in_package(name: Column, seed: Column, direct: Column, distance: Column, upstream: Column) -> Column:
    far = F.lit(float("inf"))
    return F.when(name == seed, "seed").when(F.coalesce(upstream, far) <= F.when(upstream.isNotNull(), F.coalesce(distance, far)).otherwise(-1.0), "caller").when(direct, "callee").otherwise("transitive")


def preserved_share(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, preserved): weights of the packed resolutions over the number of candidates, in per cent."""
    weight = F.element_at(F.array(*map(F.lit, (1.0, 0.8, 0.5, 0.2))), F.col("resolution") + 1)
    total = candidates.groupBy("query").agg(F.count("*").alias("n"))
    return items.groupBy("query").agg(F.sum(weight).alias("w")).join(total, "query").select("query", F.round(100 * F.col("w") / F.col("n"), 1).alias("preserved"))
