"""Checks of request parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.joins import similar_names
from .plans.tag_filter import QueryValidationError

LEAST_BUDGET, MOST_BUDGET, LONGEST_NAME = 1, 128_000, 512


def token_budget(value: int) -> int:
    if not LEAST_BUDGET <= value <= MOST_BUDGET:
        raise QueryValidationError(f"the budget must be from {LEAST_BUDGET} to {MOST_BUDGET}")
    return value


def symbol_name(name: str) -> str:
    if not name or len(name) > LONGEST_NAME or not re.fullmatch(r"[\w.$#<>:\-/\[\]*]+", name):
        raise QueryValidationError(f"not a symbol name: {name!r}")
    return name


def tag_name(tag: str) -> str:
    if not re.fullmatch(r"#[a-z][a-z0-9_]*", tag):
        raise QueryValidationError(f"not a tag: {tag!r}")
    return tag


def symbol_named(symbols: DataFrame, name: str) -> str:
    """The qualified name that name is, or the only one whose last part it is; else an error with names like it."""
    found = symbols.where((F.col("qname") == name) | (F.substring_index("qname", ".", -1) == name)).select("qname").orderBy(F.col("qname") != name, "qname").limit(2).collect()
    if found and (found[0].qname == name or len(found) == 1):
        return found[0].qname
    asked = symbols.sparkSession.createDataFrame([(name,)], "query string")
    like = [r.qname for r in similar_names(symbols.select("qname"), asked).orderBy("rank").collect()]  # five at most
    raise QueryValidationError(f"symbol {name!r} is {'ambiguous' if found else 'unknown'}" + (f"; similar: {', '.join(like)}" if like else ""))
