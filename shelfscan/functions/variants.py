"""Reading dynamic JSON values the way a script with truthiness reads them."""

from __future__ import annotations

from shelfscan.functions.scalars import parse_price, parse_price_number, py_strip
from shelfscan.functions.sql import coalesce, let, lit, struct, when


def field(v: str, name: str) -> str:
    return f"try_variant_get({v}, {lit(f'$["{name}"]')}, 'variant')"


def as_text(v: str) -> str:
    return f"try_variant_get({v}, '$', 'string')"


def as_array(v: str) -> str:
    """Items of a JSON array; NULL where the value is none."""
    return f"try_variant_get({v}, '$', 'array<variant>')"


def kind_of(v: str) -> str:
    return f"schema_of_variant({v})"


def is_text(v: str) -> str:
    return f"coalesce({kind_of(v)} = 'STRING', false)"


# A value's kind spells out all that is in it; these two look at its outermost level alone.
def is_object(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'struct<>') IS NOT NULL)"


def is_array(v: str) -> str:
    return f"({as_array(v)} IS NOT NULL)"


def _is_numeric(kind: str) -> str:
    return f"coalesce({kind} RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)', false)"


def is_number(v: str) -> str:
    return _is_numeric(kind_of(v))


def _read(v: str) -> str:
    """Kind and text of a value, each worked out once."""
    return struct(kind=kind_of(v), text=as_text(v))


def _truthy(v: str, r: str) -> str:
    return (
        f"CASE WHEN {r}.text IS NULL THEN false "
        f"WHEN {r}.kind = 'STRING' THEN {r}.text <> '' "
        f"WHEN {_is_numeric(f'{r}.kind')} THEN try_variant_get({v}, '$', 'double') <> 0 "
        f"ELSE {r}.text NOT IN ('false', '[]', '{{}}') END"
    )


def truthy(v: str) -> str:
    """False for missing, null, '', 0, false, [] and {}."""
    return let(_read(v), lambda r: _truthy(v, r))


def truthy_or_null(v: str) -> str:
    return let(v, lambda x: when(truthy(x), x))


def first_truthy(v: str, *names: str) -> str:
    return coalesce(*[truthy_or_null(field(v, n)) for n in names])


def _spelled(r: str) -> str:
    """Text of a scalar; booleans and whole floats are written as a script writes them."""
    return (
        f"CASE WHEN {r}.kind = 'BOOLEAN' THEN initcap({r}.text) "
        f"WHEN startswith({r}.kind, 'DECIMAL') AND NOT contains({r}.text, '.') THEN concat({r}.text, '.0') "
        f"ELSE {r}.text END"
    )


def scalar_text(v: str) -> str:
    """Trimmed text of a value; NULL where the value is falsy."""
    return let(v, lambda x: let(_read(x), lambda r: when(_truthy(x, r), py_strip(_spelled(r)))))


def variant_price(v: str) -> str:
    """Price of a JSON value: numbers as they are, texts parsed."""

    def price(x: str) -> str:
        number = f"try_variant_get({x}, '$', 'double')"
        flag = f"CAST(try_variant_get({x}, '$', 'boolean') AS DOUBLE)"
        return (
            f"CASE WHEN {is_number(x)} THEN {parse_price_number(number)} "
            f"WHEN {kind_of(x)} = 'BOOLEAN' THEN {flag} ELSE {parse_price(as_text(x))} END"
        )

    return let(v, price)
