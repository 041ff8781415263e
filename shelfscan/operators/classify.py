"""Is a page the page of one product? Row-local signals and their ordered decision."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfscan import rules
from shelfscan.functions import markup as M
from shelfscan.functions.scalars import blank_to_null, py_strip
from shelfscan.functions.sql import coalesce, first, matches, only, when
from shelfscan.operators.jsonld import ld_first_product

SIGNALS = ["ld_product", "og_product", "n_h1", "n_price_el", "is_listing", "has_sku_label", "has_offer", "has_table"]


def meta_of_tags(tags: str, prop: str) -> str:
    """Content of the first meta tag with that property, else of the first with that name."""

    def first_with(attribute: str) -> str:
        return first(only(tags, lambda t: f"{M.attr(t, attribute)} = '{prop}'"))

    return blank_to_null(py_strip(M.attr(coalesce(first_with("property"), first_with("name")), "content")))


def page_signals(pages: DataFrame, html: str = "html", ld_known: str | None = None) -> DataFrame:
    """Adds the signals, ``is_product`` and ``rule`` to every page.

    ``ld_known`` may pass the JSON-LD verdict in where it is already worked out.
    A signal is read only where the ones before it have not decided, and is NULL or
    false otherwise.
    """
    ld = ld_known or f"({ld_first_product(html)} IS NOT NULL)"
    og_type = when("contains(clean, 'og:type')", meta_of_tags(M.tags_with("clean", "meta"), "og:type"))
    steps = [
        {"ld_product": ld},
        {"clean": when("NOT ld_product", M.without_raw_blocks(html))},
        {"og_product": f"coalesce(contains(lower({og_type}), 'product'), false)"},
        {
            "n_h1": when("NOT (ld_product OR og_product)", M.count_tags("clean", "h1")),
            "n_price_el": when("NOT (ld_product OR og_product)", M.count_class_matches("clean", "price")),
        },
        {"is_listing": f"coalesce(n_price_el > {rules.LISTING_PRICE_ELEMENTS} AND n_h1 <> 1, false)"},
        {
            "has_sku_label": when(
                "NOT (ld_product OR og_product OR is_listing)", matches(M.text_nodes(html), rules.SKU_LABEL), "false"
            )
        },
        {
            "has_offer": when(
                "n_h1 = 1 AND NOT (is_listing OR has_sku_label)",
                matches(M.page_text("clean"), rules.OFFER_LANGUAGE),
                "false",
            )
        },
        {
            "has_table": when(
                "n_h1 = 1 AND NOT (is_listing OR has_sku_label OR has_offer)",
                f"{M.count_tags('clean', 'table')} > 0",
                "false",
            )
        },
        {
            "rule": "CASE WHEN ld_product THEN 'ld_product' WHEN og_product THEN 'og_product' "
            "WHEN is_listing THEN 'listing' WHEN has_sku_label THEN 'sku_label' "
            "WHEN has_offer THEN 'offer' WHEN has_table THEN 'spec_table' ELSE 'none' END"
        },
        {"is_product": "rule NOT IN ('listing', 'none')"},
    ]
    for step in steps:
        pages = pages.selectExpr("*", *[f"{value} AS {name}" for name, value in step.items()])
    return pages.drop("clean")


def classify_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return page_signals(pages, html).select(key, "is_product", "rule")


def rows_where(df: DataFrame, cond: str, columns: list[str]) -> DataFrame:
    """``columns`` of the rows that hold ``cond``.

    One generated row per kept row. A plain filter would be pushed below the signals and
    make Spark work them out once for the filter and once for the result.
    """
    return df.selectExpr(f"inline({when(cond, f'array(struct({', '.join(columns)}))')})")
