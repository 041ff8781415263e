"""robots.txt files and sitemap documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.functions.scalars import py_strip
from shelfscan.functions.sql import each, lit, only
from shelfscan.operators.groups import first_seen

_LOCS = "ARRAY<STRUCT<loc: STRING>>"
# The root's own entries, and those of lists that stand below another root.
SITEMAP_XML = f"url {_LOCS}, sitemap {_LOCS}, urlset ARRAY<STRUCT<url: {_LOCS}>>, sitemapindex ARRAY<STRUCT<sitemap: {_LOCS}>>"

SITEMAP_MARKS = ["<urlset", "<sitemapindex", ":urlset", ":sitemapindex"]


def robots_sitemaps(responses: DataFrame) -> DataFrame:
    """(site, url, pos): sitemaps that robots.txt names, once each, in order."""
    lines = responses.filter("status = 200 AND url = concat(site, '/robots.txt')").selectExpr(
        "site", r"posexplode(split(body, '\\R')) AS (pos, line)"
    )
    named = lines.filter("startswith(lower(line), 'sitemap:')").selectExpr(
        "site", f"{py_strip("substr(line, 9)")} AS url", "CAST(pos AS BIGINT) AS pos"
    )
    return first_seen(named, ["site", "url"], "pos")


def parse_sitemaps(responses: DataFrame) -> DataFrame:
    """(site, url, children, locs) of the responses that are sitemap XML; bad XML gives nothing."""

    def texts(items: str) -> str:
        trimmed = each(f"{items}.loc", py_strip)
        return f"coalesce({only(trimmed, lambda x: f"{x} <> ''")}, array())"

    def both(item: str, below: str) -> str:
        return f"concat(coalesce(x.{item}, array()), coalesce(flatten(filter(x.{below}.{item}, l -> l IS NOT NULL)), array()))"

    looks_xml = " OR ".join(f"contains(body, {lit(mark)})" for mark in SITEMAP_MARKS)
    return (
        responses.filter(f"status = 200 AND ({looks_xml})")
        .select("site", "url", F.from_xml("body", SITEMAP_XML, {"ignoreNamespace": "true"}).alias("x"))
        .selectExpr("site", "url", f"{both('sitemap', 'sitemapindex')} AS maps", f"{both('url', 'urlset')} AS pages")
        .selectExpr("site", "url", f"{texts('maps')} AS children", f"{texts('pages')} AS locs")
    )
