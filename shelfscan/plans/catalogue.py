"""From an archive of responses to the catalogues of all its sites."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan import rules
from shelfscan.operators import catalogue as C
from shelfscan.operators import discovery as D
from shelfscan.operators.extract import drop_nameless, judge_pages, products_of
from shelfscan.session import stage
from shelfscan.sources.archive import ResponseArchive, store_responses


@dataclass
class CatalogueRun:
    """All tables of one run; each is lazy until it is written."""

    urls: DataFrame
    candidates: DataFrame
    routes: DataFrame
    products: DataFrame
    header: DataFrame
    frontier: DataFrame

    @property
    def catalogues(self) -> DataFrame:
        return C.assemble_catalogues(self.header, self.products)

    @property
    def counters(self) -> DataFrame:
        return C.crawl_counters(self.urls, self.candidates, self.products)


def discover_urls(
    sites: DataFrame, archive: ResponseArchive, max_pages: int | None = None, url_lists: DataFrame | None = None
) -> DataFrame:
    """(site, url, kind, source, pos) by the first rung of the ladder that gives any URL."""
    api = D.api_product_urls(archive.responses("api"), max_pages)
    sitemaps = D.sitemap_urls(sites, archive.responses("robots", "sitemap"), max_pages).selectExpr("*", "'sitemap' AS source")
    api, sitemaps = stage(api, "api-urls"), stage(sitemaps, "sitemap-urls")
    # Sites that these rungs solve need no further reading: their home pages are left out.
    solved = api.select("site").union(sitemaps.select("site")).distinct()
    categories = D.category_links(archive.homes(without=solved))
    shop = D.category_product_urls(categories, archive.pages(), max_pages).selectExpr("*", "'categories' AS source")
    seeds = stage(D.links_of_homes(archive.homes(drawn=True, without=solved), max_pages), "seeds")
    links = D.nav_expand(seeds, archive.responses(of=seeds), max_pages).selectExpr("*", "'general' AS kind", "'links' AS source")
    rungs = [api, sitemaps, shop, links]
    if url_lists is not None:
        listed = D.cap_per_site(url_lists, max_pages).selectExpr("*", "'general' AS kind", "'list' AS source")
        rungs.insert(0, listed)
    return D.discovery_ladder(*rungs)


def wanted_urls(sites: DataFrame, archive: ResponseArchive, candidates: DataFrame) -> DataFrame:
    """(site, url, wanted_by): what the reader would fetch at this point."""
    home = sites.selectExpr("site", "concat(site, '/') AS url", "'home' AS wanted_by")
    robots = sites.selectExpr("site", "concat(site, '/robots.txt') AS url", "'robots' AS wanted_by")
    maps = D.sitemap_entry_points(sites, archive.responses("robots")).selectExpr("site", "url", "'sitemap' AS wanted_by")
    children = D.parse_sitemaps(archive.responses("sitemap")).selectExpr("site", "explode(children) AS url", "'sitemap' AS wanted_by")
    first_pages = ", ".join(f"'{prefix}1'" for prefix, _ in rules.API_ENDPOINTS)
    api = sites.selectExpr("site", f"explode(array({first_pages})) AS path").selectExpr(
        "site", "concat(site, path) AS url", "'api' AS wanted_by"
    )
    categories = D.category_links(archive.homes()).selectExpr(
        "site", "url", "'category' AS wanted_by"
    )
    pages = candidates.selectExpr("site", "url", "if(hop = 0, 'candidate', 'embedded') AS wanted_by")
    out = home
    following = D.next_pages(archive.responses("api"), archive.responses("sitemap"), archive.homes(), archive.pages())
    for more in (robots, maps, children, api, categories, pages, following):
        out = out.unionByName(more)
    return out


def read_catalogues_of(
    sites: DataFrame,
    fetches: DataFrame | ResponseArchive,
    read_at: datetime,
    max_pages: int | None = None,
    url_lists: DataFrame | None = None,
    status_lost: bool = False,
) -> CatalogueRun:
    """The whole way: screen, discover, choose, classify, extract (two hops), assemble.

    ``fetches`` is an archive, or responses that are laid out as one first. ``max_pages`` limits the URLs of a site and
    kind; a site that loses some is ``partial``, not ``complete``, and its header counts them. The chosen candidates and
    what their pages are is staged, as several later steps read it; a candidate's body is read and judged once.
    """
    archive = fetches if isinstance(fetches, ResponseArchive) else store_responses(fetches)
    urls = stage(discover_urls(sites, archive, max_pages, url_lists), "urls")
    dropped = None
    if max_pages is not None:
        found = discover_urls(sites, archive, None, url_lists).groupBy("site").count()
        kept = urls.groupBy("site").agg(F.count("*").alias("kept"))
        dropped = found.join(kept, "site", "left").selectExpr("site", "count - coalesce(kept, 0L) AS n_dropped")
    first = stage(D.dedupe_candidates(D.select_candidates(urls)), "candidates")
    routes = stage(archive.routes(first), "routes")
    judged = stage(judged_candidates(archive, routes), "judged")

    # Pages that are no product page are searched for embedded product URLs: one more hop.
    second = stage(D.second_hop(judged.filter("NOT is_product"), first, paths="paths"), "second-hop")
    more_routes = stage(archive.routes(second), "second-routes")
    more = judged_candidates(archive, more_routes)

    candidates = first.unionByName(second)
    all_routes = routes.unionByName(more_routes)
    products = drop_nameless(products_of(judged.unionByName(more), PAGE_KEYS))
    products = stage(products, "products")
    header = C.read_header(sites, urls, products, read_at, status_lost, dropped)
    missing = D.frontier(wanted_urls(sites, archive, candidates), archive.chosen)
    missing = missing.unionByName(D.pages_to_render(all_routes))
    return CatalogueRun(urls, candidates, all_routes, products, header, missing)


PAGE_KEYS = ("site", "url", "pos", "hop")


def judged_candidates(archive: ResponseArchive, routes: DataFrame) -> DataFrame:
    """What each readable candidate is, with the paths that are written as JSON into pages of no product."""
    pages = archive.read(routes.select(*PAGE_KEYS, "at"), "at")
    judged = judge_pages(pages.withColumn("source", F.col("html")), (*PAGE_KEYS, "source"))
    return judged.selectExpr("*", f"if(is_product, NULL, {D.embedded_paths('source')}) AS paths").drop("source")
