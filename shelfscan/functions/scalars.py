"""Text, price, availability and id functions (SQL text in, SQL text out)."""

from __future__ import annotations

from shelfscan import rules
from shelfscan.functions.sql import coalesce, extract, let, lit, when


#: Unicode's white space, and the four separators that scripts trim too.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def py_strip(s: str) -> str:
    """Trim blanks of every kind, not only the space character."""
    return f"trim(BOTH {lit(BLANKS)} FROM {s})"


def blank_to_null(s: str) -> str:
    return f"nullif({s}, '')"


def parse_price(raw: str) -> str:
    """First number in a price text; thousands commas are dropped."""
    digits = extract(f"replace({raw}, ',', '')", rules.PRICE_NUMBER)
    return f"try_cast({blank_to_null(digits)} AS DOUBLE)"


def parse_price_number(raw: str) -> str:
    """A price that is already a number: negative ones are dropped."""
    return when(f"{raw} >= 0", f"CAST({raw} AS DOUBLE)")


def normalise_availability(raw: str) -> str:
    table = "map(" + ", ".join(lit(x) for pair in rules.AVAILABILITY.items() for x in pair) + ")"
    return f"coalesce(try_element_at({table}, lower({py_strip(raw)})), 'unknown')"


def make_product_id(pid: str, url: str) -> str:
    hashed = f"left(md5(CAST({url} AS BINARY)), {rules.PRODUCT_ID_HASH_LENGTH})"
    return coalesce(blank_to_null(py_strip(pid)), hashed)


def currency_of(text: str) -> str:
    whens = " ".join(
        f"WHEN contains({text}, {lit(sym)}) THEN {lit(code)}" for sym, code in rules.CURRENCY_SYMBOLS.items()
    )
    return f"CASE {whens} END"


def plain_number(p: str) -> str:
    """A number's shortest text; an exponent only below 0.0001 and from 1e16 on."""
    fixed = f"regexp_replace(regexp_replace(CAST(CAST({p} AS DECIMAL(38, 21)) AS STRING), '0+$', ''), '[.]$', '.0')"
    text = f"CAST({p} AS STRING)"
    power = f"CAST(regexp_extract({text}, 'E(-?[0-9]+)$', 1) AS INT)"
    scientific = (
        f"concat(regexp_replace(split_part({text}, 'E', 1), '[.]0$', ''), 'e', if({power} < 0, '-', '+'), "
        f"lpad(abs({power}), greatest(2, length(abs({power}))), '0'))"
    )
    return f"if(abs({p}) >= 0.0001 AND abs({p}) < 1e16, {fixed}, {scientific})"


def price_label(price: str) -> str:
    return let(
        price,
        lambda p: when(f"{p} IS NULL OR {p} = 0", "'price on request'", f"concat('$', {plain_number(f'CAST({p} AS DOUBLE)')})"),
    )


def mentions(text: str, phrases: list[str]) -> str:
    """True where any of the phrases is a substring."""
    return "(" + " OR ".join(f"contains({text}, {lit(p)})" for p in phrases) + ")"
