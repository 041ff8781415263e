"""URL discovery over the archive, for all sites at once.

``screened`` is the output of ``screen_responses``: (site, url, status, body, rendered,
route, reason, html). A URL that the reader would fetch next is looked up there; what
the archive lacks is returned by ``frontier``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscan import rules
from shelfscan.functions import urls as U
from shelfscan.functions.sql import extract, extract_all, lit, matches, replaced, when
from shelfscan.operators.groups import attach, first_per_group, first_seen, numbered, page_runs
from shelfscan.session import stage
from shelfscan.sources.fetches import api_call, parse_api_pages
from shelfscan.sources.sitemaps import parse_sitemaps, robots_sitemaps

# Sorts after every real position.
LAST = 9223372036854775807
# Fixed sitemap paths come after everything robots.txt names.
AFTER_ROBOTS = 1 << 40


def cap_per_site(urls: DataFrame, n: int | None = None, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """The first ``n`` URLs of each site in discovery order; all where ``n`` is None."""
    return first_per_group(urls, list(keys), ["pos", "url"], n, ["url", "pos"])


# -- sitemaps ----------------------------------------------------------------


def sitemap_entry_points(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """(site, url, pos): sitemaps from robots.txt, then the usual paths, each once."""
    paths = "array(" + ", ".join(lit(p) for p in rules.SITEMAP_PATHS) + ")"
    usual = sites.selectExpr("site", f"posexplode({paths}) AS (i, path)").selectExpr(
        "site", "concat(site, path) AS url", f"{AFTER_ROBOTS} + i AS pos"
    )
    return first_seen(robots_sitemaps(responses).unionByName(usual), ["site", "url"], "pos")


def expand_sitemaps(entry_points: DataFrame, documents: DataFrame) -> DataFrame:
    """(site, url, path): every sitemap reachable from the entry points, in visiting order.

    ``path`` orders a depth-first walk that reads each document once: it is the smallest
    path of child positions that leads there without a cycle. Each round extends only
    the paths that the last round found or improved, and the walk ends when none is.
    """
    edges = documents.filter(f"NOT {U.is_product_feed('url')}").selectExpr(
        "site", "url", "posexplode(children) AS (i, child)"
    )
    best = entry_points.selectExpr("site", "url", "array(pos) AS path", "array(url) AS trail")
    fresh = best
    while True:
        steps = (
            fresh.join(edges, ["site", "url"])
            .filter("NOT array_contains(trail, child)")
            .selectExpr(
                "site", "child AS url", "array_append(path, CAST(i AS BIGINT)) AS path", "array_append(trail, child) AS trail"
            )
        )
        offers = steps.groupBy("site", "url").agg(F.min(F.struct("path", "trail")).alias("offer"))
        merged = best.join(offers, ["site", "url"], "full").selectExpr(
            "site",
            "url",
            "coalesce(path IS NULL OR offer.path < path, false) AS improved",
            "if(path IS NULL OR offer.path < path, offer.path, path) AS path",
            "if(path IS NULL OR offer.path < path, offer.trail, trail) AS trail",
        )
        merged = stage(merged, "sitemap-walk")
        best = merged.drop("improved")
        fresh = merged.filter("improved").drop("improved")
        if fresh.isEmpty():
            return best.select("site", "url", "path")


def feed_documents(documents: DataFrame) -> DataFrame:
    """Product feed documents with URLs: (site, url, template, page, n, locs); no template where unnumbered."""
    template = replaced("url", r"([&?]page=)\d+", "$1{}")
    page = f"try_cast({extract('url', rules.FEED_PAGE)} AS BIGINT)"
    docs = documents.filter(f"{U.is_product_feed('url')} AND size(locs) > 0").selectExpr(
        "site", "url", f"{template} AS template", f"{page} AS page", "CAST(size(locs) AS BIGINT) AS n", "locs"
    )
    numbered = "coalesce(replace(template, '{}', CAST(page AS STRING)) = url AND page IS NOT NULL, false)"
    return docs.selectExpr(
        "site", "url", f"if({numbered}, template, NULL) AS template", f"if({numbered}, page, NULL) AS page", "n", "locs"
    )


def paged_feed_runs(feeds: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each visited product feed gives, and all feed pages with the run they belong to.

    A feed is read from its own page on, until a page is missing, unreadable or empty;
    without a page number only the document itself is read. The first result is (site,
    url, template, stop, before0, n): last page of the run, URLs of the run's pages before
    this one, and URLs from this one on.
    """
    pages = page_runs(
        docs.filter("template IS NOT NULL").select("site", "template", "page", "n", "url"), ["site", "template"]
    )
    totals = pages.filter("page = stop").selectExpr("site", "template", "stop", "before + n AS total")
    starts = feeds.join(pages.select("site", "url", "template", "stop", "before"), ["site", "url"])
    numbered = attach(starts, totals, ["site", "template", "stop"], ["url"]).selectExpr(
        "site", "url", "template", "stop", "before AS before0", "total - before AS n"
    )
    single = feeds.join(docs.filter("template IS NULL").select("site", "url", "n"), ["site", "url"]).selectExpr(
        "site", "url", "CAST(NULL AS STRING) AS template", "CAST(NULL AS BIGINT) AS stop", "0L AS before0", "n"
    )
    return numbered.unionByName(single), pages


def visit_budget(docs: DataFrame, n: int | None = None) -> DataFrame:
    """Sitemaps read before ``n`` URLs were collected, with the position of their first URL.

    ``docs`` is (site, url, path, n). A document's own URLs come after those of its
    children. The running sum has a row per sitemap document with URLs, not per URL; with
    ``n`` at most that many of a site's take part.
    """
    filled = docs.filter("n > 0").selectExpr("*", f"array_append(path, {LAST}L) AS own")
    filled = first_per_group(filled, ["site"], ["own"], n, ["url"])
    moments = filled.selectExpr("site", "url", "n", "explode(array(struct(path AS at, 0L AS adds), struct(own AS at, n AS adds))) AS m")
    so_far = Window.partitionBy("site").orderBy("m.at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        moments.withColumn("collected", F.coalesce(F.sum("m.adds").over(so_far), F.lit(0)))
        .groupBy("site", "url")
        .agg(F.min("collected").alias("at_visit"), F.max("collected").alias("pos0"))
        .filter(F.lit(True) if n is None else F.col("at_visit") < n)
        .select("site", "url", "pos0")
    )


def sitemap_urls(sites: DataFrame, responses: DataFrame, n: int | None = None) -> DataFrame:
    """(site, url, kind, pos): page URLs of all sitemaps, product feeds apart; with ``n`` at most so many of a kind."""
    documents = stage(parse_sitemaps(responses), "sitemaps")
    walk = expand_sitemaps(sitemap_entry_points(sites, responses), documents)
    feeds = walk.filter(U.is_product_feed("url"))
    docs = feed_documents(documents)
    runs, pages = paged_feed_runs(feeds.select("site", "url"), docs)
    plain = documents.filter(f"NOT {U.is_product_feed('url')}").selectExpr("site", "url", "CAST(size(locs) AS BIGINT) AS n")
    counted = walk.join(plain.unionByName(runs.select("site", "url", "n")), ["site", "url"])
    visited = visit_budget(counted, n)

    general = visited.join(documents, ["site", "url"]).filter(f"NOT {U.is_product_feed('url')}").selectExpr(
        "site", "'general' AS kind", "pos0", "posexplode(locs) AS (i, loc)"
    )
    run = visited.join(runs, ["site", "url"])
    # Of a run only the pages that can still hold one of the first n URLs are read.
    starts = run.filter("template IS NOT NULL").select("site", "template", "stop", "before0", "pos0")
    paged = (
        attach(pages.select("site", "template", "stop", "page", "before"), starts, ["site", "template", "stop"], ["page"])
        .filter("before >= before0" + ("" if n is None else f" AND before - before0 < {n}"))
        .join(docs.select("site", "template", "page", "locs"), ["site", "template", "page"])
        .selectExpr("site", "'product' AS kind", "pos0 + before - before0 AS pos0", "posexplode(locs) AS (i, loc)")
    )
    single = run.filter("template IS NULL").join(docs.select("site", "url", "locs"), ["site", "url"]).selectExpr(
        "site", "'product' AS kind", "pos0", "posexplode(locs) AS (i, loc)"
    )
    found = general.unionByName(paged).unionByName(single).selectExpr("site", "loc AS url", "kind", "pos0 + i AS pos")
    return cap_per_site(found, n, ("site", "kind"))


# -- REST product lists ------------------------------------------------------


def api_page_run(responses: DataFrame) -> DataFrame:
    """(site, rank, page, links): API pages from 1 on, until one fails, is empty or short."""
    calls = responses.filter("status = 200").selectExpr("*", f"{api_call()} AS c").filter("c IS NOT NULL")
    pages = parse_api_pages(calls).filter("size(items) > 0").selectExpr(
        "site", "c.rank AS rank", "c.page AS page", "CAST(size(items) AS BIGINT) AS n", "links"
    )
    pages = stage(pages, "api-pages")
    keys = ["site", "rank"]
    narrow = pages.select(*keys, "page", "n")
    runs = page_runs(narrow, keys, last=F.col("n") < rules.API_PAGE_SIZE)
    first_run = runs.filter("page = 1").select(*keys, "stop")
    kept = attach(runs.select(*keys, "page", "stop"), first_run, [*keys, "stop"], ["page"])
    return pages.join(kept.select(*keys, "page"), [*keys, "page"]).select(*keys, "page", "links")


def api_product_urls(responses: DataFrame, n: int | None = None) -> DataFrame:
    """(site, url, kind, source, pos): the links of the best endpoint that gives any."""
    links = stage(api_page_run(responses).selectExpr("site", "rank", "page", "posexplode(links) AS (i, url)"), "api-links")
    best = links.groupBy("site").agg(F.min("rank").alias("best"))
    chosen = attach(links, best, ["site"], ["url", "page", "i"]).filter("rank = best")
    names = "element_at(array(" + ", ".join(lit(name) for _, name in rules.API_ENDPOINTS) + "), rank + 1)"
    placed = numbered(chosen, ["site"], "page", ["i"])
    return placed.filter(F.lit(True) if n is None else F.col("pos") < n).selectExpr(
        "site", "url", "'product' AS kind", f"{names} AS source", "pos"
    )


# -- category pages ----------------------------------------------------------


def home_pages(screened: DataFrame) -> DataFrame:
    return screened.filter("url = concat(site, '/')")


def category_links(homes: DataFrame) -> DataFrame:
    """(site, url): category pages that a home page links to, in no order."""
    links = extract_all("html", rules.CATEGORY_HREF, 1)
    return homes.selectExpr("site", f"explode({links}) AS href").selectExpr(
        "site", f"{U.url_join('site', 'href')} AS url"
    ).distinct()


def _category_page() -> str:
    before, after = rules.CATEGORY_PAGE_SUFFIX
    pattern = r"^(.*)\Q" + before + r"\E([1-9][0-9]*)\Q" + after + r"\E\z"
    number = f"try_cast({extract('url', pattern, 2)} AS BIGINT)"
    return when(
        matches("url", pattern),
        f"named_struct('category', {extract('url', pattern, 1)}, 'page', {number})",
        "named_struct('category', url, 'page', 0L)",
    )


def category_pages(categories: DataFrame, screened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First places of the links of category pages, and the pages read: 0, 1, ... while a page has a new link.

    (site, category, url, page, i) and (site, category, page, stop).
    """
    pages = (
        screened.filter("html IS NOT NULL AND contains(url, '/c/')")
        .selectExpr("site", f"{_category_page()} AS c", f"{extract_all('html', rules.CATEGORY_PRODUCT_HREF, 1)} AS hrefs")
        .selectExpr("site", "c.category AS category", "c.page AS page", "hrefs")
    )
    wanted = attach(pages, categories.selectExpr("site", "url AS category"), ["site", "category"], ["page"])
    links = wanted.selectExpr(
        "site", "category", "page", "posexplode(hrefs) AS (i, href)"
    ).selectExpr("site", "category", "page", "i", f"{U.url_join('site', 'href')} AS url")
    first = links.groupBy("site", "category", "url").agg(F.min(F.struct("page", "i")).alias("at"))
    first = stage(first.selectExpr("site", "category", "url", "at.page AS page", "at.i AS i"), "category-links")
    keys = ["site", "category"]
    fresh = first.groupBy(*keys, "page").agg(F.count("*").alias("n"))
    runs = page_runs(fresh, keys)
    first_run = runs.filter("page = 0").select(*keys, "stop")
    return first, attach(runs.select(*keys, "page", "stop"), first_run, [*keys, "stop"], ["page"])


def category_product_urls(categories: DataFrame, screened: DataFrame, n: int | None = None) -> DataFrame:
    """(site, url, kind, pos): product links of category pages 0, 1, ... while a page has a new one."""
    first, read = category_pages(categories, screened)
    reached = first.join(read.select("site", "category", "page"), ["site", "category", "page"])
    unique = reached.groupBy("site", "url").agg(F.min(F.struct("category", "page", "i")).alias("at"))
    placed = numbered(unique, ["site"], "struct(at.category AS category, at.page AS page)", ["at"])
    return placed.filter(F.lit(True) if n is None else F.col("pos") < n).selectExpr("site", "url", "'product' AS kind", "pos")


# -- links of pages ----------------------------------------------------------


def page_links(pages: DataFrame, keys: tuple[str, ...] = ("site",), site: str = "site", html: str = "html") -> DataFrame:
    """(keys, url, pos): links of a page to its own site, each once, in order."""
    hrefs = pages.selectExpr(*keys, f"{site} AS base", f"posexplode({extract_all(html, rules.HREF, 1)}) AS (i, href)")
    links = hrefs.filter(U.is_followable("href")).selectExpr(
        *keys, "base", f"{U.strip_fragment(U.url_join('base', 'href'))} AS url", "CAST(i AS BIGINT) AS i"
    )
    return first_seen(links.filter(U.same_site("url", U.host_of("base"))), [*keys, "url"], "i")


def home_links(screened: DataFrame, n: int | None = None) -> DataFrame:
    """(site, url, pos): links of the home page, as the browser saw it if that is archived."""
    homes = home_pages(screened).selectExpr("site", "coalesce(rendered, html) AS html").filter("html IS NOT NULL")
    return links_of_homes(homes, n)


def links_of_homes(homes: DataFrame, n: int | None = None) -> DataFrame:
    """(site, url, pos): links of home pages (site, html)."""
    return cap_per_site(page_links(homes), n)


def nav_expand(seeds: DataFrame, responses: DataFrame, n: int | None = None) -> DataFrame:
    """(site, url, pos): the seeds, and where a site has few of them also the links of their pages."""
    per_site = seeds.groupBy("site").agg(F.count("*").alias("n_seeds"))
    few = per_site.filter(F.col("n_seeds") < rules.NAV_SEED_LIMIT).select("site")
    ordered = seeds.selectExpr("site", "url", "struct(0 AS hop, pos AS seed, 0L AS i) AS at")
    opened = attach(seeds, few, ["site"], ["url"]).selectExpr("site", "url", "pos AS seed")
    bodies = responses.filter("status = 200").select("site", "url", "body").join(opened.hint("shuffle_hash"), ["site", "url"])
    links = page_links(bodies.select("site", "seed", "body"), ("site", "seed"), html="body")
    grown = ordered.unionByName(links.selectExpr("site", "url", "struct(1 AS hop, seed, pos AS i) AS at"))
    unique = grown.groupBy("site", "url").agg(F.min("at").alias("at"))
    placed = numbered(unique, ["site"], "struct(at.hop AS hop, at.seed DIV 1024 AS seed)", ["at"])
    return placed.filter(F.lit(True) if n is None else F.col("pos") < n).select("site", "url", "pos")


# -- putting the sources together --------------------------------------------


def discovery_ladder(*sources: DataFrame) -> DataFrame:
    """Of several (site, url, kind, source, pos) sources, best first, the first that has any URL for a site.

    The rows are staged, as the best rung of a site is found by one small aggregation over them.
    """
    ranked = [s.selectExpr("site", "url", "kind", "source", "pos", f"{i} AS rung") for i, s in enumerate(sources)]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more)
    rows = stage(rows, "rungs")
    best = rows.groupBy("site").agg(F.min("rung").alias("best"))
    return attach(rows, best, ["site"], ["url", "pos"]).filter("rung = best").drop("rung", "best")


def select_candidates(urls: DataFrame) -> DataFrame:
    """(site, url, pos): product URLs as they are; else those that look like products, if enough; else all."""
    marked = urls.selectExpr("*", f"{U.looks_like_product_url('url')} AS likely")
    facts = marked.groupBy("site").agg(
        F.expr("count_if(kind = 'product')").alias("n_product"),
        F.expr("count_if(kind <> 'product' AND likely)").alias("n_likely"),
    )
    chosen = (
        "CASE WHEN n_product > 0 THEN kind = 'product' "
        f"WHEN n_likely >= {rules.MIN_PATTERN_MATCHES} THEN likely ELSE true END"
    )
    return attach(marked, facts, ["site"], ["url", "pos"]).filter(chosen).select("site", "url", "pos")


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """(site, url, pos, hop): each URL once, at its first position."""
    return first_seen(candidates, ["site", "url"], "pos").withColumn("hop", F.lit(0))


def embedded_paths(html: str = "html") -> str:
    return extract_all(html, rules.EMBEDDED_URL, 1)


def embedded_product_urls(pages: DataFrame, keys: tuple[str, ...] = ("site", "url"), paths: str | None = None) -> DataFrame:
    """(keys, link, i): product URLs written as JSON into a page, once per page, in order.

    ``paths`` names a column of ``embedded_paths`` where these are known already.
    """
    found = pages.selectExpr(*keys, f"{U.host_of('url')} AS host", f"posexplode({paths or embedded_paths()}) AS (i, path)")
    links = found.selectExpr(*keys, "concat('https://', host, path) AS link", "CAST(i AS BIGINT) AS i")
    likely = links.filter(U.looks_like_product_url("link"))
    return likely.groupBy(*keys, "link").agg(F.min("i").alias("i"))


def second_hop(other_pages: DataFrame, candidates: DataFrame, paths: str | None = None) -> DataFrame:
    """(site, url, pos, hop=1): URLs embedded in non-product pages that are no candidates yet.

    ``other_pages`` is (site, url, pos, html or ``paths``). ``pos`` of a new URL is that of the page
    it was first found in.
    """
    links = embedded_product_urls(other_pages, ("site", "url", "pos"), paths)
    found = links.selectExpr("site", "link AS url", "struct(pos, i) AS at").groupBy("site", "url").agg(F.min("at").alias("at"))
    new = found.join(candidates.select("site", "url"), ["site", "url"], "left_anti")
    return new.selectExpr("site", "url", "at.pos AS pos", "1 AS hop")


def next_pages(api: DataFrame, maps: DataFrame, homes: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, url, wanted_by): the page after each run of API, feed and category pages that did not end by itself.

    API responses, sitemap responses, home pages and all readable pages are given.
    """
    calls = api.filter("status = 200").selectExpr("*", f"{api_call()} AS c").filter("c IS NOT NULL")
    listed = parse_api_pages(calls).filter("size(items) > 0").selectExpr("site", "c.rank AS rank", "c.page AS page", "CAST(size(items) AS BIGINT) AS n")
    runs = page_runs(listed, ["site", "rank"], last=F.col("n") < rules.API_PAGE_SIZE)
    ends = attach(runs.filter("page = stop"), runs.filter("page = 1").select("site", "rank", "stop"), ["site", "rank", "stop"], ["page"])
    prefixes = "element_at(array(" + ", ".join(lit(prefix) for prefix, _ in rules.API_ENDPOINTS) + "), rank + 1)"
    after_api = ends.filter(f"n >= {rules.API_PAGE_SIZE}").selectExpr("site", f"concat(site, {prefixes}, page + 1) AS url", "'api' AS wanted_by")

    feeds = feed_documents(parse_sitemaps(maps)).filter("template IS NOT NULL")
    feed_runs = page_runs(feeds.select("site", "template", "page", "n"), ["site", "template"])
    after_feed = feed_runs.filter("page = stop").selectExpr("site", "replace(template, '{}', CAST(page + 1 AS STRING)) AS url", "'sitemap' AS wanted_by")

    reached = category_pages(category_links(homes), pages)[1]
    before, after = rules.CATEGORY_PAGE_SUFFIX
    after_category = reached.filter("page = stop").selectExpr("site", f"concat(category, {lit(before)}, page + 1, {lit(after)}) AS url", "'category' AS wanted_by")
    return after_api.unionByName(after_feed).unionByName(after_category)


def pages_to_render(routes: DataFrame) -> DataFrame:
    """(site, url, wanted_by): archived pages that only a browser can show, without a rendered body (``at`` is NULL)."""
    return routes.filter("route = 'needs_render' AND at IS NULL").selectExpr("site", "url", "'render' AS wanted_by").distinct()


def frontier(wanted: DataFrame, responses: DataFrame) -> DataFrame:
    """(site, url, wanted_by): wanted URLs that the archive lacks. ``wanted`` has the same columns."""
    missing = wanted.join(responses.select("site", "url"), ["site", "url"], "left_anti")
    return missing.groupBy("site", "url").agg(F.min("wanted_by").alias("wanted_by"))
