"""Helpers for expressions written as SQL text.

The functions of this package take and return SQL expressions, for use in
`selectExpr`, `F.expr` and inside lambdas. One parse of a long text is far
cheaper to set up than thousands of calls that build the same tree.
"""

from __future__ import annotations

from collections.abc import Iterable


def lit(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values: Iterable[str]) -> str:
    """Array of string literals; typed when empty."""
    items = [lit(v) for v in values]
    return f"array({', '.join(items)})" if items else "cast(array() AS array<string>)"


def any_of(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"


def case(branches: Iterable[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {otherwise} END"


def struct(**members: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in members.items()) + ")"


def first_value(expression: str, name: str, body: str) -> str:
    """`body` with `name` bound to the value of `expression`, evaluated once."""
    return f"transform(array({expression}), {name} -> {body})[0]"


def listed(*conditional: str) -> str:
    """Array of those values that are not NULL, in order."""
    return f"array_compact(array({', '.join(conditional)}))"
