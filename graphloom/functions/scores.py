"""Scores, weights and costs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How strongly each relation ties two symbols.
RELATION_WEIGHTS = {"CALLS": 1.0, "INSTANTIATES": 1.0, "OVERRIDES": 0.90, "EXTENDS": 0.85, "EMBEDS": 0.85, "IMPLEMENTS": 0.80}
# Confidence of tentative calls, gains and penalties of edges, costs of tags and hops, trust of environments, names of logging calls.
TENTATIVE = {"TENTATIVE_CALL": 0.60, "TENTATIVE_DYNAMIC_CALL": 0.65}
UNOBSERVED, CONFIRMED, HIGH_TRUST = 0.50, 0.5, 0.5
DATA_FLOW_GAIN, GUARD_GAIN = 0.25, 0.15
UNPACK_GAIN, ARGS_GAIN = 0.30, 0.20
BETA, DELTA_MAX = 0.10, 10
LAMBDA, MAX_HOPS, TAG_MARGIN = 0.7, 10.0, 0.5
MAX_TAG_DISTANCE, UNTAGGED_DISTANCE = 5.0, 2.5
ENVIRONMENT_WEIGHTS = {"unit": 0.25, "integration": 0.5, "e2e": 0.75, "staging": 0.85, "prod": 1.0, "production": 1.0}
OTHER_ENVIRONMENT = 0.5
LOGGING_LEAVES = ("debug", "info", "warn", "warning", "error", "log", "trace", "critical")


def lookup(key: Column, values: dict, default) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def relation_weight(relation: Column) -> Column:
    return lookup(relation, RELATION_WEIGHTS, 1.0)


def topological_decay(distance: Column) -> Column:
    return 1.0 / F.pow(1.0 + distance, F.lit(2.0))


def candidate_value(distance: Column, mask: Column, covered: Column, beta: float = BETA, delta_max: int = DELTA_MAX) -> Column:
    """Decay by distance, times a bonus for bits not yet covered."""
    novel = F.bit_count(mask.bitwiseAND(F.bitwise_not(covered)))
    return topological_decay(distance) * (1.0 + beta * F.least(novel, F.lit(delta_max)))


def causal_edge_weight(relation: Column, data_flow: Column, guard: Column) -> Column:
    return relation_weight(relation) * (1.0 + DATA_FLOW_GAIN * data_flow + GUARD_GAIN * guard)


def edge_cost(weight: Column) -> Column:
    """Reciprocal of the weight; that of the weakest relation for weights that aren't positive."""
    return F.when(weight <= 0, F.lit(1.0 / min(RELATION_WEIGHTS.values()))).otherwise(1.0 / weight)


def hub_penalty(in_degree: Column) -> Column:
    return 1.0 + F.log1p(F.greatest(in_degree - 1, F.lit(0)))


def undirected_cost(relation: Column, kind: Column, unobserved: Column, confirmed: Column, high_trust: Column, in_u: Column, in_v: Column) -> Column:
    """A hop's cost: reciprocal of the composed weight, dearer at hubs, cheaper where runs confirmed it."""
    weight = relation_weight(relation) * lookup(kind, TENTATIVE, 1.0) * F.when(unobserved, UNOBSERVED).otherwise(1.0)
    cost = F.sqrt(hub_penalty(in_u) * hub_penalty(in_v)) / weight
    return cost * F.when(confirmed & high_trust, CONFIRMED * HIGH_TRUST).when(confirmed, CONFIRMED).otherwise(1.0)


def hybrid_distance(hops: Column, tag_distance: Column) -> Column:
    """Share of the hop horizon, and a tag term that stays below half a hop; 1 at most."""
    cap = TAG_MARGIN * LAMBDA / MAX_HOPS
    return F.least(LAMBDA * hops / MAX_HOPS + cap * F.least(tag_distance / MAX_TAG_DISTANCE, F.lit(1.0)), F.lit(1.0))


def resolution_for_distance(distance: Column) -> Column:
    return F.when(distance <= 0.25, 1).when(distance <= 0.55, 2).otherwise(3)


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Similarity of two arrays as sets. Tags take 0 for two empty sets, name tokens 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def semantic_topology_score(distance: Column, a: Column, b: Column, alpha: float = 0.2) -> Column:
    return topological_decay(distance) * (1.0 + alpha * jaccard(a, b))


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), "[._]"), lambda x: x != ""))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def polymorphic_score(namespace: Column, arity: Column, locality: Column) -> Column:
    return 0.50 * namespace + 0.35 * arity + 0.15 * locality


def arity_match(parameters: Column, arguments: Column) -> Column:
    return F.coalesce((parameters == arguments).cast("double"), F.lit(0.0))


def locality(file: Column, module: Column, caller_file: Column, caller_module: Column) -> Column:
    """1 in the same file, 0.6 in the same top package, 0.2 elsewhere."""
    same = F.substring_index(module, ".", 1) == F.substring_index(caller_module, ".", 1)
    return F.when(file == caller_file, 1.0).when(same, 0.6).otherwise(0.2)


def namespace_match(module: Column, caller_module: Column, imports: Column, wildcards: Column) -> Column:
    """1 if the module is the caller's, is related by prefix to an imported target, or is imported whole."""
    related = F.exists(imports, lambda t: (t == module) | t.startswith(F.concat(module, F.lit("."))) | module.startswith(F.concat(t, F.lit("."))))
    return F.when((module == caller_module) | related | F.array_contains(wildcards, module), 1.0).otherwise(0.0)


def synonym_multiplier(return_bound: Column, role: Column, callee: Column) -> Column:
    """Calls whose result is returned count more, assertion subjects a little more, logging less."""
    leaf = F.lower(F.substring_index(callee, ".", -1)).isin(*LOGGING_LEAVES)
    return F.when(return_bound, 1.5).when(role == "assertion_subject", 1.2).when(leaf, 0.5).otherwise(1.0)


def hybrid_edge_weight(distance: Column, executions: Column, alpha: float, beta: Column) -> Column:
    """Static rank times a logarithmic boost by executions; distances under 1 and negative counts are errors."""
    weight = (1.0 / distance.cast("double")) * (1.0 + alpha * beta * F.log1p(executions.cast("double")))
    wrong = F.when(distance < 1, F.raise_error(F.lit("distance must be 1 or more"))).when(executions < 0, F.raise_error(F.lit("executions must not be negative")))
    return wrong.otherwise(weight)


def environment_weight(environment: Column) -> Column:
    return lookup(environment, ENVIRONMENT_WEIGHTS, OTHER_ENVIRONMENT)


def upstream_weight(relation: Column, unpacks: Column, arguments: Column) -> Column:
    return relation_weight(relation) * (1.0 + UNPACK_GAIN * unpacks.cast("double") + ARGS_GAIN * arguments.cast("double"))


def split_external_budget(budget: Column, share: float = 0.125, least: int = 256, most: int = 1024) -> Column:
    """Tokens for external context; rounding is half to even."""
    return F.least(F.greatest(F.bround(budget * F.lit(share)).cast("long"), F.lit(least)), F.lit(most), budget)


def max_dominant_distance(beta: float = BETA, delta_max: int = DELTA_MAX) -> int:
    """The largest whole distance at which one hop less beats any bonus."""
    d = 0
    while ((2 + d) / (1 + d)) ** 2 > 1 + beta * delta_max:
        d += 1
    return d - 1
