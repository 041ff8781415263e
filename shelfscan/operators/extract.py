"""One product per page: JSON-LD, then meta tags, then the structure of the page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan import rules
from shelfscan.functions import scalars as S
from shelfscan.functions.sql import coalesce, each, extract, first, let, lit, matches, only, replaced, struct, when
from shelfscan.operators import html as H
from shelfscan.operators.classify import page_signals, rows_where
from shelfscan.operators.html import slice_to, span_text
from shelfscan.operators.jsonld import (
    NO_SPECS,
    NO_VARIANTS,
    last_wins_map,
    ld_first_product,
    ld_product,
    product_struct,
)

# -- reading a page tree -----------------------------------------------------


def first_h1() -> str:
    return span_text("h1")


def meta_value(prop: str) -> str:
    """Content of the first meta tag with that property, else of the first with that name."""
    found = [first(only("metas", lambda m, a=a: f"{m}.{a} = {lit(prop)}")) for a in ("property", "name")]
    return S.blank_to_null(S.py_strip(f"{coalesce(*found)}.content"))


def itemprop_tag(prop: str) -> str:
    return first(only("itemprops", lambda t: f"{t}.prop = {lit(prop)}"))


def itemprop_value(prop: str) -> str:
    return let(
        itemprop_tag(prop), lambda t: coalesce(S.blank_to_null(f"{t}.content"), S.blank_to_null(span_text(t)))
    )


# -- meta tags ---------------------------------------------------------------


def with_meta_product(trees: DataFrame) -> DataFrame:
    """Adds ``meta``: the product the meta and itemprop tags state, or NULL."""
    about = itemprop_tag("description")
    parts = {
        "og_product": f"coalesce(contains(lower({meta_value('og:type')}), 'product'), false)",
        "name": coalesce(meta_value("og:title"), meta_value("twitter:title"), S.blank_to_null(first_h1())),
        "price": S.parse_price(
            coalesce(meta_value("og:price:amount"), meta_value("product:price:amount"), itemprop_value("price"))
        ),
        "stated": coalesce(meta_value("og:availability"), itemprop_value("availability")),
        "sku": itemprop_value("sku"),
    }
    trees = trees.selectExpr("*", f"{struct(**parts)} AS m")
    product = product_struct(
        url="url",
        id=S.make_product_id("m.sku", "url"),
        name="m.name",
        brand=let(itemprop_tag("brand"), span_text),
        sku="m.sku",
        price="m.price",
        currency=coalesce(
            meta_value("og:price:currency"), meta_value("product:price:currency"), itemprop_value("priceCurrency")
        ),
        availability=when("m.stated IS NULL", "'in_stock'", S.normalise_availability("m.stated")),
        image=coalesce(meta_value("og:image"), meta_value("twitter:image")),
        description=let(
            about,
            lambda t: when(
                f"{t} IS NOT NULL", span_text(t), coalesce(meta_value("og:description"), meta_value("description"))
            ),
        ),
        specs=NO_SPECS,
        variants=NO_VARIANTS,
    )
    found = when("m.name IS NOT NULL AND (m.og_product OR m.price IS NOT NULL)", product)
    return trees.selectExpr("*", f"{found} AS meta").drop("m")


# -- page structure ----------------------------------------------------------


def price_element() -> str:
    """(text, price) of the first price-like element whose price is not zero."""
    texts = each("prices", lambda e: span_text(e))
    parsed = each(texts, lambda t: struct(text=t, price=S.parse_price(t)))
    return first(only(parsed, lambda p: f"{p}.price > 0"))


def label_value(label: str) -> str:
    """What stands beside an SKU label: the next element's text, else the rest of its own."""
    beside = f"if({label}.beside IS NULL, NULL, struct({label}.sk0 AS k0, {label}.sk1 AS k1))"
    nearby = S.blank_to_null(coalesce(f"{label}.script", let(beside, span_text)))
    own = let(f"if({label}.held, struct({label}.pk0 AS k0, {label}.pk1 AS k1), NULL)", lambda p: S.py_strip(replaced(span_text(p), rules.SKU_LABEL, "")))
    found = coalesce(nearby, S.blank_to_null(own))
    return let(found, lambda v: when(f"length({v}) <= {rules.SKU_LENGTH_LIMIT}", v))


def label_sku() -> str:
    """Value of the first SKU label that has a usable one; later labels are read only if need be."""

    def chosen(usable: str) -> str:
        rest = f"slice({usable}, 2, size({usable}))"
        others = first(only(each(rest, label_value), lambda v: f"{v} IS NOT NULL"))
        return coalesce(
            when(f"size({usable}) > 0", let(first(usable), label_value)), when(f"size({usable}) > 1", others)
        )

    return let(only("labels", lambda n: f"{n}.at <= {rules.LABEL_START_LIMIT}"), chosen)


def page_image() -> str:
    """First image that names a product in its address or text, else the first image's src."""
    telling = only(
        "imgs",
        lambda i: f"{i}.src IS NOT NULL AND (contains(lower({i}.src), 'product') "
        f"OR coalesce(contains(lower({i}.alt), 'product'), false))",
    )
    return coalesce(f"{first(telling)}.src", f"{first('imgs')}.plain_src")


def heading_paragraph() -> str:
    """Text of the first paragraph that starts after the first h1."""
    return let(first(only("ps", lambda p: f"{p}.pos > h1.pos")), span_text)


def table_pairs() -> str:
    """Two-cell rows of tables as (k, v). Rows of inner tables come after all outer ones."""

    def in_table(row: str) -> str:
        return f"struct({row}.inside AS table, {row}.pos AS pos, {row}.c0 AS c0)"

    def cell(row: str, n: int) -> str:
        return let(f"try_element_at(cells, {row}.c0 + {n})", span_text)

    two_cells = only("trs", lambda r: f"coalesce({r}.c1, size(cells)) - {r}.c0 = 2")
    rows = only(each(two_cells, in_table), lambda r: f"{r}.table IS NOT NULL")
    pairs = each(f"array_sort({rows})", lambda r: struct(k=cell(r, 1), v=cell(r, 2)))
    return only(pairs, lambda p: f"{p}.k <> '' AND {p}.v <> '' AND length({p}.k) < {rules.SPEC_KEY_LIMIT}")


def definition_pairs() -> str:
    """The n-th dt with the n-th dd of every dl."""

    def of_list(dl: str) -> str:
        terms, values = slice_to("dts", f"{dl}.dt0", f"{dl}.dt1"), slice_to("dds", f"{dl}.dd0", f"{dl}.dd1")
        zipped = f"zip_with({terms}, {values}, (a, b) -> if(a IS NULL OR b IS NULL, NULL, struct(a, b)))"
        whole = only(zipped, lambda z: f"{z} IS NOT NULL")
        return each(whole, lambda z: struct(k=span_text(f"{z}.a"), v=span_text(f"{z}.b")))

    return only(f"flatten({each('dls', of_list)})", lambda p: f"{p}.k <> '' AND {p}.v <> ''")


def page_specs() -> str:
    """Table rows, then definition lists; a later key replaces an earlier one."""
    pairs = f"concat({table_pairs()}, {definition_pairs()})"
    return when("size(trs) > 0 OR size(dls) > 0", last_wins_map(pairs), NO_SPECS)


def page_brand() -> str:
    tagged = let(itemprop_tag("brand"), lambda t: when(f"{t} IS NOT NULL", f"struct({t}.pos, {t}.k0, {t}.k1)"))
    span = f"coalesce({tagged}, brand_class, brand_id)"
    stated = when(matches("page_text", rules.BRAND_PHRASE), f"trim({extract('page_text', rules.BRAND_PHRASE)})")
    return let(span, lambda s: when(f"{s} IS NOT NULL", S.blank_to_null(span_text(s)), stated))


def with_structure_product(trees: DataFrame, needed: str = "true") -> DataFrame:
    """Adds ``structure``: the product read off headings, labels, tables and lists, or NULL."""
    name = S.blank_to_null(first_h1())
    trees = trees.selectExpr("*", f"{when(needed, "array_join(texts, ' ')")} AS page_text")
    offered = f"{matches('page_text', rules.OFFER_LANGUAGE)} OR {matches('page_text', rules.SKU_LABEL)}"
    gate = f"coalesce({name} IS NOT NULL AND ({offered}), false)"
    trees = trees.selectExpr("*", f"{when(gate, struct(name=name, price=price_element(), sku=label_sku()))} AS s")
    product = product_struct(
        url="url",
        id=S.make_product_id("s.sku", "url"),
        name="s.name",
        brand=page_brand(),
        sku="s.sku",
        price="s.price.price",
        currency=S.currency_of("s.price.text"),
        availability=when(S.mentions("lower(page_text)", rules.SOLD_OUT_PHRASES), "'out_of_stock'", "'in_stock'"),
        image=page_image(),
        description=coalesce(
            S.blank_to_null(heading_paragraph()), meta_value("description"), meta_value("og:description")
        ),
        specs=page_specs(),
        variants=NO_VARIANTS,
    )
    return trees.selectExpr("*", f"{when('s IS NOT NULL', product)} AS structure").drop("s", "page_text")


# -- the three strategies together -------------------------------------------


def judge_pages(pages: DataFrame, keep: tuple[str, ...] = (), url: str = "url", html: str = "html", classified: bool = True) -> DataFrame:
    """(``keep`` columns, url, is_product, rule, ld_item, html): what a page is, in one pass over its body.

    ``html`` stays only where it is still to be shredded: for product pages without JSON-LD. ``classified=False`` takes
    every page for a product page.
    """
    screened = pages.selectExpr("*", f"{ld_first_product(html)} AS ld_item")
    if classified:
        screened = page_signals(screened, html, ld_known="(ld_item IS NOT NULL)")
    else:
        screened = screened.selectExpr("*", "true AS is_product", "CAST(NULL AS STRING) AS rule")
    others = [c for c in keep if c != "url"]
    return screened.selectExpr(*others, f"{url} AS url", "is_product", "rule", "ld_item", f"if(is_product AND ld_item IS NULL, {html}, NULL) AS html")


def products_of(judged: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep`` columns, strategy, 13 product fields) of judged pages.

    Row by row: no page is shuffled.
    """
    others = [c for c in keep if c != "url"]
    trees = H.page_trees(rows_where(judged, "is_product", [*others, "url", "ld_item", "html"]))
    out = with_structure_product(with_meta_product(trees).selectExpr("*", "ld_item IS NULL AND meta IS NULL AS unread"), needed="unread")
    strategy = "CASE WHEN ld_item IS NOT NULL THEN 'jsonld' WHEN meta IS NOT NULL THEN 'meta' ELSE 'heuristic' END"
    product = when("ld_item IS NOT NULL", ld_product("ld_item", "url"), "coalesce(meta, structure)")
    shown = out.selectExpr(*others, f"{strategy} AS strategy", f"{product} AS product")
    return shown.selectExpr(*others, "strategy", "inline(if(product IS NULL, NULL, array(product)))")


def extract_products(
    pages: DataFrame,
    keep: tuple[str, ...] = (),
    url: str = "url",
    html: str = "html",
    classified: bool = True,
) -> DataFrame:
    """(``keep`` columns, strategy, 13 product fields) of every page that holds a product.

    One row of ``pages`` per (``keep`` columns, url). ``classified=False`` skips the test for product pages.
    """
    return products_of(judge_pages(pages, keep, url, html, classified), keep)


def drop_nameless(products: DataFrame) -> DataFrame:
    return products.filter(F.col("name") != "")
