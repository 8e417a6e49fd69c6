"""Boolean tag expressions as Catalyst predicates: #a AND NOT (#b OR #c)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bits import AXES, FEATURE_BITS


class QueryValidationError(ValueError):
    """A query that can't be run as it is written."""


def tag_bits() -> dict[str, int]:
    """Tag name -> bit: the bits' names without axis, lower-cased; _io may be left out where that is free."""
    plain = {name.removeprefix(axis).lower(): b for name, b in FEATURE_BITS.items() for axis in AXES if name.startswith(axis)}
    return {n.removesuffix("_io"): b for n, b in plain.items() if n.endswith("_io")} | plain


def _tokens(expression: str) -> list[str]:
    out, at = [], 0
    while at < len(expression):
        m = re.compile(r"\s+|[()]|#?\w+").match(expression, at)
        if not m or re.fullmatch(r"\d\w*", m[0]):
            raise QueryValidationError(f"unexpected {expression[at]!r} at {at} in {expression!r}")
        if m[0].strip():
            out.append(m[0])
        at = m.end()
    return out


def tag_filter(expression: str, mask: Column, is_test: Column | None = None) -> Column:
    """The predicate of an expression over a feature mask; NOT binds closer than AND, AND closer than OR.

    Keywords are upper case. #test asks is_test; an unknown tag is false.
    """
    if not expression or not expression.strip():
        raise QueryValidationError("empty tag filter")
    waiting, known = _tokens(expression)[::-1], tag_bits()

    def peek() -> str | None:
        return waiting[-1] if waiting else None

    def either() -> Column:
        out = both()
        while peek() == "OR":
            waiting.pop()
            out = out | both()
        return out

    def both() -> Column:
        out = negated()
        while peek() == "AND":
            waiting.pop()
            out = out & negated()
        return out

    def negated() -> Column:
        if peek() == "NOT":
            waiting.pop()
            return ~negated()
        token = waiting.pop() if waiting else None
        if token == "(":
            out = either()
            if not waiting or waiting.pop() != ")":
                raise QueryValidationError(f"unbalanced parentheses in {expression!r}")
            return out
        if token in (None, ")", "AND", "OR", "NOT"):
            raise QueryValidationError(f"unexpected {token or 'end'} in {expression!r}")
        name = token.removeprefix("#").lower()
        if name == "test":
            return F.lit(False) if is_test is None else is_test
        return mask.bitwiseAND(F.lit(1 << known[name])) != 0 if name in known else F.lit(False)

    out = either()
    if waiting:
        raise QueryValidationError(f"unexpected {peek()!r} after the end of {expression!r}")
    return out
