"""Products from JSON-LD. Row-local: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfscan import schemas
from shelfscan.functions import markup as M
from shelfscan.functions import scalars as S
from shelfscan.functions import variants as V
from shelfscan.functions.sql import each, extract, extract_all, first, let, only, replaced, some, struct, when

NO_SPECS = "CAST(map() AS MAP<STRING, STRING>)"
NO_VARIANTS = f"CAST(array() AS ARRAY<{schemas.VARIANT_ITEM}>)"


def ld_json_blocks(html: str) -> str:
    """Texts of the JSON-LD scripts of a page, in order."""

    def is_ld(block: str) -> str:
        start_tag = extract(block, "^<[^>]*+>", 0)
        return f"NOT startswith({block}, '<!') AND {M.attr(start_tag, 'type')} = 'application/ld+json'"

    blocks = only(extract_all(html, M.COMMENT_OR_SCRIPT), is_ld)
    texts = each(blocks, lambda b: replaced(b, r"(?is)^<[^>]*+>|</script\s*+>\z", ""))
    return when(f"contains({html}, 'application/ld+json')", texts, "CAST(array() AS ARRAY<STRING>)")


def ld_items(value: str) -> str:
    """The items a JSON-LD value stands for: a list, the list under @graph, or the object itself."""
    graph = V.field(value, "@graph")
    return (
        f"CASE WHEN {V.is_array(value)} THEN {V.as_array(value)} "
        f"WHEN {graph} IS NOT NULL THEN {V.as_array(graph)} "
        f"WHEN {V.is_object(value)} THEN array({value}) END"
    )


def has_type(item: str, name: str) -> str:
    def named(kind: str) -> str:
        one = lambda t: f"{V.is_text(t)} AND {V.as_text(t)} = '{name}'"
        return when(V.is_array(kind), some(V.as_array(kind), one), one(kind))

    return f"({V.is_object(item)} AND coalesce({let(V.field(item, '@type'), named)}, false))"


def page_ld_items(html: str) -> str:
    """All JSON-LD items of a page, in document order; unreadable blocks are passed over."""
    per_block = each(ld_json_blocks(html), lambda b: let(f"try_parse_json({b})", ld_items))
    return f"flatten({only(per_block, lambda items: f'{items} IS NOT NULL')})"


def ld_products(html: str) -> str:
    return only(page_ld_items(html), lambda i: has_type(i, "Product"))


def ld_first_product(html: str) -> str:
    return first(ld_products(html))


def ld_image(v: str) -> str:
    head = when(V.is_array(v), f"try_variant_get({v}, '$[0]', 'variant')", v)

    def address(x: str) -> str:
        return (
            f"CASE WHEN {V.is_object(x)} THEN {V.as_text(V.first_truthy(x, 'url', 'contentUrl'))} "
            f"WHEN {V.is_text(x)} THEN {V.as_text(x)} END"
        )

    return let(head, address)


def ld_brand(v: str) -> str:
    named = V.scalar_text(V.field(v, "name"))
    return f"CASE WHEN {V.is_object(v)} THEN {named} WHEN {V.is_text(v)} THEN {V.as_text(v)} END"


def last_wins_map(pairs: str) -> str:
    """Map of (k, v) pairs: keys in order of first sight, each with its last value."""

    def built(p: str) -> str:
        keys = f"array_distinct({p}.k)"
        last = lambda k: f"element_at(reverse({p}.v), CAST(array_position(reverse({p}.k), {k}) AS INT))"
        return f"map_from_arrays({keys}, {each(keys, last)})"

    return let(pairs, built)


def ld_specs(item: str) -> str:
    pairs = each(
        only(V.as_array(V.field(item, "additionalProperty")), V.is_object),
        lambda p: struct(k=V.scalar_text(V.field(p, "name")), v=V.scalar_text(V.field(p, "value"))),
    )
    stated = only(pairs, lambda p: f"{p}.k <> '' AND {p}.v <> ''")
    return let(stated, lambda s: when(f"size({s}) > 0", last_wins_map(s), NO_SPECS))


def ld_offers(item: str) -> str:
    """Offers as an array of (price, high, currency, availability), objects only."""

    def offers(raw: str) -> str:
        return f"CASE WHEN {V.is_array(raw)} THEN {V.as_array(raw)} WHEN {V.truthy(raw)} THEN array({raw}) END"

    return each(
        only(let(V.field(item, "offers"), offers), V.is_object),
        lambda o: struct(
            price=V.variant_price(f"coalesce({V.truthy_or_null(V.field(o, 'price'))}, {V.field(o, 'lowPrice')})"),
            high=V.variant_price(V.field(o, "highPrice")),
            currency=V.scalar_text(V.field(o, "priceCurrency")),
            availability=S.normalise_availability(V.as_text(V.field(o, "availability"))),
        ),
    )


def _first_stated(values: str) -> str:
    return first(only(values, lambda x: f"{x} IS NOT NULL"))


def product_struct(**fields: str) -> str:
    """All product fields in their order; a field not given is NULL."""
    typed = {n: fields.get(n, f"CAST(NULL AS {t})") for n, t in schemas.PRODUCT_FIELDS}
    return struct(**typed)


def ld_product(item: str, url: str) -> str:
    """Product struct of one JSON-LD Product."""
    pid = V.scalar_text(V.first_truthy(item, "productID", "@id", "identifier"))
    name = f"coalesce({V.scalar_text(V.field(item, 'name'))}, '')"
    parts = struct(offers=ld_offers(item), name=name, sku=V.scalar_text(V.field(item, "sku")), pid=pid)

    def product(p: str) -> str:
        known = first(only(f"{p}.offers.availability", lambda a: f"{a} <> 'unknown'"))
        return product_struct(
            url=url,
            id=S.make_product_id(f"coalesce(nullif({p}.pid, ''), {p}.sku)", url),
            name=f"{p}.name",
            brand=ld_brand(V.field(item, "brand")),
            sku=f"{p}.sku",
            price=_first_stated(f"{p}.offers.price"),
            listPrice=_first_stated(f"{p}.offers.high"),
            currency=_first_stated(f"{p}.offers.currency"),
            # A listed product without a known state counts as available.
            availability=f"coalesce({known}, {when(f'{p}.name <> {chr(39) * 2}', "'in_stock'", "'unknown'")})",
            image=ld_image(V.field(item, "image")),
            description=V.scalar_text(V.field(item, "description")),
            specs=ld_specs(item),
            variants=NO_VARIANTS,
        )

    return let(parts, product)
