"""The feature coordinate: named bits of one long, over four axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and places of the bits.
FEATURE_BITS = {
    "SINK_NETWORK_IO": 0, "SINK_DATABASE_IO": 1, "SINK_FILESYSTEM_IO": 2, "SINK_PROCESS_IO": 3, "SINK_TIME_IO": 4, "SINK_RANDOMNESS": 5, "SINK_PURE_COMPUTE": 6,
    "FORM_LINEAR": 10, "FORM_RETRY_LOOP": 11, "FORM_BRANCH_DISPATCH": 12, "FORM_PIPELINE": 13, "FORM_GUARD_EARLY_EXIT": 14, "FORM_VALIDATOR": 15, "FORM_BATCH_LOOP": 16, "FORM_WRAPPED_TRY": 17, "FORM_RECURSIVE": 18, "FORM_ASYNC_CONCURRENT": 19,
    "OUTPUT_PREDICATE": 25, "OUTPUT_COMMAND": 26, "OUTPUT_QUERY": 27, "OUTPUT_FACTORY": 28, "OUTPUT_TRANSFORMER": 29, "OUTPUT_AGGREGATOR": 30, "OUTPUT_FLUENT": 31, "OUTPUT_ASYNC_DEFERRED": 32, "OUTPUT_GUARD": 33,
    "ROLE_ENTRYPOINT": 35, "ROLE_ORCHESTRATOR": 36, "ROLE_ADAPTER": 37, "ROLE_LEAF_UTILITY": 38, "ROLE_BRIDGE": 39, "ROLE_PUBLIC_API": 40, "ROLE_LEAF_SERVICE": 41,
}
AXES = ("SINK_", "FORM_", "OUTPUT_", "ROLE_")
#: Sinks that open a scope: network, database, file system, process.
SUBSTANCE_SINKS = 0b1111
IMPURE_SINKS = 0b111111


def bit(name: str) -> int:
    return 1 << FEATURE_BITS[name]


def compose_mask(*axes: Column) -> Column:
    """The axes' masks or-ed into one long; null axes count as 0."""
    out = F.lit(0).cast("long")
    for axis in axes:
        out = out.bitwiseOR(F.coalesce(axis.cast("long"), F.lit(0).cast("long")))
    return out


def describe_mask(mask: Column, axis: str = "") -> Column:
    """Names of the known bits that are set, in the order of the bits; those of one axis if given."""
    known = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(1 << b).cast("long").alias("bit")) for n, b in FEATURE_BITS.items() if n.startswith(axis)))
    return F.transform(F.filter(known, lambda b: b["bit"].bitwiseAND(mask) != 0), lambda b: b["name"])


def axis_labels(mask: Column, axis: str) -> Column:
    """Names of an axis without its prefix, by commas; NONE if there are none."""
    names = F.transform(describe_mask(mask, axis), lambda n: F.substring(n, len(axis) + 1, 64))
    return F.when(F.size(names) > 0, F.array_join(names, ",")).otherwise("NONE")


def output_kind(mask: Column) -> Column:
    """The first output bit's name in lower case, or null."""
    return F.lower(F.substring(F.get(describe_mask(mask, "OUTPUT_"), F.lit(0)), len("OUTPUT_") + 1, 64))
