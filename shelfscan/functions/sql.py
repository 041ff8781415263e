"""Small helpers for composing SQL expression text.

Functions in this package take and return SQL text, so a whole nested expression is
one call into Spark: ``df.selectExpr(f"{parse_price('raw')} AS price")``. An argument
is a column name or any SQL expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

_names = count()


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body(value)`` with ``value`` worked out once per row."""
    name = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def each(array: str, body: Callable[[str], str]) -> str:
    name = f"v{next(_names)}"
    return f"transform({array}, {name} -> {body(name)})"


def only(array: str, cond: Callable[[str], str]) -> str:
    name = f"v{next(_names)}"
    return f"filter({array}, {name} -> {cond(name)})"


def some(array: str, cond: Callable[[str], str]) -> str:
    name = f"v{next(_names)}"
    return f"exists({array}, {name} -> {cond(name)})"


def first(array: str) -> str:
    return f"try_element_at({array}, 1)"


def when(cond: str, value: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN {cond} THEN {value} ELSE {otherwise} END"


def coalesce(*values: str) -> str:
    return f"coalesce({', '.join(values)})"


def in_list(value: str, texts: Iterable[str]) -> str:
    return f"({value}) IN ({', '.join(lit(t) for t in texts)})"


def matches(text: str, pattern: str) -> str:
    return f"({text} RLIKE {lit(pattern)})"


def replaced(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(by)})"


def extract(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {lit(pattern)}, {group})"


def extract_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, {group})"


def struct(**fields: str) -> str:
    inner = ", ".join(f"{lit(name)}, {value}" for name, value in fields.items())
    return f"named_struct({inner})"
