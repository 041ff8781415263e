"""Discovery over small archives."""

import json
from html import escape

import pytest

from shelfscan import rules
from shelfscan.operators import discovery as D
from shelfscan.operators import groups as G
from shelfscan.operators.screen import resolve_attempts, screen_responses
from shelfscan.sources.fetches import url_list_source
from shelfscan.sources.sites import read_sites
from shelfscan.sources.sitemaps import parse_sitemaps, robots_sitemaps

S = "https://s.example"
NS = "http://www.sitemaps.org/schemas/sitemap/0.9"


def urlset(*locs):
    return f'<?xml version="1.0"?><urlset xmlns="{NS}">' + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"


def index(*locs):
    return f'<sitemapindex xmlns="{NS}">' + "".join(f"<sitemap><loc>{escape(x)}</loc></sitemap>" for x in locs) + "</sitemapindex>"


def fetches(spark, rows):
    """rows: (url, body) or (url, body, status[, attempt, error, via])."""
    full = []
    for r in rows:
        url, body, *rest = r
        status, attempt, error, via = (list(rest) + [200, 0, None, "http"][len(rest):])[:4]
        full.append((S, url if url.startswith("http") else S + url, attempt, status, body, error, via))
    return spark.createDataFrame(
        full, "site STRING, url STRING, attempt INT, status INT, body STRING, error STRING, via STRING"
    ).selectExpr("site", "url", "attempt", "CAST(NULL AS TIMESTAMP) AS fetched_at", "status", "body", "error", "via")


def archive(spark, rows, max_attempts=None):
    return screen_responses(resolve_attempts(fetches(spark, rows), max_attempts))


def sites(spark):
    return read_sites(spark, [S])


def following(found):
    readable = found.filter("html IS NOT NULL")
    return D.next_pages(found.filter("role = 'api'"), found.filter("role = 'sitemap'"), readable.filter("role = 'home'"), readable)


def in_order(df):
    return [r.url for r in df.orderBy("pos").collect()]


def test_sites(spark):
    got = read_sites(spark, ["www.a.example", "https://www.a.example/x", " ", "http://b.example/"]).collect()
    assert sorted(r.site for r in got) == ["http://b.example", "https://www.a.example"]


@pytest.mark.parametrize("limit", [None, rules.MAX_ATTEMPTS])
def test_attempts(spark, limit):
    """All attempts count; with the reader's own limit, those beyond it do not."""
    got = archive(spark, [
        ("/a", "late", 200, 1), ("/a", "", 429, 0),
        ("/b", None, None, 0, "timeout"), ("/b", None, 429, 1), ("/b", "fourth", 200, 3),
        ("/c", "no", 404), ("/d", "no", 503, 0), ("/d", "drawn", 200, 0, None, "render"),
        ("/e", "Just a moment <h1>"), ("/f", "<body></body>"), ("/g", "ok <h1>"), ("/g", "second <h1>", 200, 1),
    ], limit)
    rows = {r.url[len(S):]: (r.route, r.reason, r.html) for r in got.collect()}
    assert rows == {
        "/a": ("accept", "ok", "late"), "/b": ("needs_render", "no response", None) if limit else ("accept", "ok", "fourth"), "/c": ("drop", "status", None),
        "/d": ("needs_render", "blocked", "drawn"), "/e": ("needs_render", "challenge", None),
        "/f": ("needs_render", "shell", None), "/g": ("accept", "ok", "ok <h1>"),
    }


def test_robots_and_entry_points(spark):
    found = archive(spark, [("/robots.txt", f"User-agent: *\r\nSITEMAP: {S}/b.xml \nsitemap:{S}/a.xml\nSitemap: {S}/b.xml\n Sitemap: no\nSitemap:{S}/sitemap.xml")])
    assert in_order(robots_sitemaps(found)) == [f"{S}/b.xml", f"{S}/a.xml", f"{S}/sitemap.xml"]
    entries = in_order(D.sitemap_entry_points(sites(spark), found))
    rest = [S + p for p in rules.SITEMAP_PATHS if p != "/sitemap.xml"]
    assert entries == [f"{S}/b.xml", f"{S}/a.xml", f"{S}/sitemap.xml"] + rest


def test_bad_sitemaps_give_nothing(spark):
    docs = parse_sitemaps(archive(spark, [
        ("/1", urlset(" a ", "")), ("/2", "<urlset><url><loc>cut"), ("/3", "<html><urlset></html>"), ("/4", ""), ("/5", "<urlset/>"),
        ("/6", '<urlset><url><loc>x</loc><image:image xmlns:image="i"><image:loc>y</image:loc></image:image></url></urlset>'), ("/7", urlset("z"), 404),
    ]))
    got = {r.url[-1]: r.locs for r in docs.collect() if r.locs}
    assert got == {"1": ["a"], "6": ["x"]}


def test_walk_order_matches_a_recursive_reader(spark):
    graph = {
        "/r.xml": ["/a.xml", "/b.xml", "/r.xml"], "/a.xml": ["/c.xml", "/missing.xml", "/b.xml"], "/b.xml": ["/d.xml", "/a.xml"],
        "/c.xml": ["/a.xml"], "/d.xml": ["/e.xml", "/c.xml"], "/e.xml": ["/r.xml"],
    }
    rows = [("/robots.txt", f"Sitemap: {S}/r.xml")] + [(u, index(*[S + c for c in cs])) for u, cs in graph.items()]
    found = archive(spark, rows)
    entries = D.sitemap_entry_points(sites(spark), found)
    walk = D.expand_sitemaps(entries, parse_sitemaps(found)).collect()

    seen = []

    def visit(url):
        if url not in seen:
            seen.append(url)
            for child in graph.get(url[len(S):], []):
                visit(S + child)

    for e in in_order(entries):
        visit(e)
    assert [r.url for r in sorted(walk, key=lambda r: r.path)] == seen


def test_sitemap_urls_and_budget(spark):
    rows = [
        ("/robots.txt", f"Sitemap: {S}/i.xml\nSitemap: {S}/x.php?type=products&page=2"),
        ("/i.xml", index(f"{S}/1.xml", f"{S}/2.xml", f"{S}/3.xml")),
        ("/1.xml", urlset("u1", "u2")), ("/2.xml", urlset("u3", "u4")), ("/3.xml", urlset("u5")),
        ("/x.php?type=products&page=1", urlset("p1")), ("/x.php?type=products&page=2", urlset("p2", "p3")),
        ("/x.php?type=products&page=3", urlset("p4")), ("/x.php?type=products&page=4", urlset()), ("/x.php?type=products&page=5", urlset("p6")),
        ("/sitemap.xml", urlset("g1")), ("/sitemap.php", urlset("g2")),
    ]
    found = archive(spark, rows)

    def urls(n):
        got = D.sitemap_urls(sites(spark), found, n).orderBy("kind", "pos").collect()
        return [r.url for r in got if r.kind == "general"], [r.url for r in got if r.kind == "product"]

    assert urls(5000) == (["u1", "u2", "u3", "u4", "u5", "g1", "g2"], ["p2", "p3", "p4"])
    # Three URLs are reached inside 2.xml, which is read to its end; nothing after it is read.
    assert urls(3) == (["u1", "u2", "u3"], [])
    assert urls(6) == (["u1", "u2", "u3", "u4", "u5"], ["p2", "p3", "p4"])
    assert urls(2) == (["u1", "u2"], [])


def test_feed_listed_page_by_page(spark):
    """An index that lists every page of a feed makes each one start a run of its own."""
    pages = [f"{S}/f?type=products&page={i}" for i in (1, 2, 3)]
    rows = [("/sitemap.xml", index(*pages, f"{S}/single?type=products"))] + [(p, urlset(f"p{i}")) for i, p in enumerate(pages, 1)]
    rows.append(("/single?type=products", urlset("q1", "q2")))
    got = in_order(D.sitemap_urls(sites(spark), archive(spark, rows)))
    assert got == ["p1", "p2", "p3", "p2", "p3", "p3", "q1", "q2"]


def api_list(*links):
    return json.dumps([{"permalink": x} for x in links])


def test_api(spark):
    one, two = "/api/products?limit=100&page=", "/wp-json/wc/v2/products?per_page=100&page="
    rows = [
        (two + "1", json.dumps([{"permalink": 5, "url": "no"}, {"permalink": "", "url": 0, "link": "/x"}, 7, {}] * 25)),
        (two + "2", api_list("/y")), (two + "3", api_list("/never")), (two + "01", api_list("/odd")),
        (one + "1", api_list("/z")), ("/wp-json/wc/v3/products?per_page=100&page=1", "{}"),
    ]
    got = D.api_product_urls(archive(spark, rows)).orderBy("pos").collect()
    assert [r.url for r in got] == ["/x"] * 25 + ["/y"] and {r.source for r in got} == {"WooCommerce v2"}
    for stop in ("{}", "[]", "[broken", "null"):
        cut = [rows[0], (two + "2", stop), (two + "3", api_list("/never"))]
        assert D.api_product_urls(archive(spark, cut)).count() == 25
    assert D.api_product_urls(archive(spark, [(two + "2", api_list("/only second"))])).count() == 0
    assert in_order(D.api_product_urls(archive(spark, rows), 3)) == ["/x"] * 3


def test_url_lists(spark):
    bodies = ['{"links":["a",5,"b"]}', '{"links":[],"urls":["c"]}', '["d",null]', '{"x":1}', "bad", '"text"']
    rows = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "site STRING, body STRING")
    assert sorted((r.site, r.url) for r in url_list_source(rows).collect()) == [("0", "a"), ("0", "b"), ("1", "c"), ("2", "d")]


def test_categories(spark):
    page = lambda *ids: "<h1>x</h1>" + "".join(f'<a href="/n/p/{i}">' for i in ids)
    q = "?q=%3Arelevance&page={}&pageSize=96"
    rows = [
        ("/", "<h1>x</h1><a href=\"/b/c/2\"><a href=\"/a/c/1?k=v\"><a href='/no/c/3'><a href=\"/no/c/x\">"),
        ("/a/c/1?k=v", page(1, 2)), ("/a/c/1?k=v" + q.format(1), page(2, 3)), ("/a/c/1?k=v" + q.format(2), page(1, 2, 3)), ("/a/c/1?k=v" + q.format(3), page(9)),
        ("/b/c/2", page(3, 4)), ("/b/c/2" + q.format(2), page(8)),
    ]
    found = archive(spark, rows)
    cats = D.category_links(D.home_pages(found))
    assert sorted(r.url for r in cats.collect()) == [f"{S}/a/c/1?k=v", f"{S}/b/c/2"]
    assert in_order(D.category_product_urls(cats, found)) == [f"{S}/n/p/{i}" for i in (1, 2, 3, 4)]


def test_links_and_nav(spark):
    home = "<h1>x</h1>" + "".join(f'<a href="{h}">' for h in ["/one", "two/x", "#f", "/one", "mailto:a@b", "https://else.example/", "https://f.example/?u=s.example", "/ab", "tel:1"])
    rows = [("/", home), ("/one", '<a href="/three"><a href="/ab"><a href="/one">'), ("/ab", '<a href="/four">', 404), ("/two/x", '<a href="/five">')]
    found = archive(spark, rows)
    seeds = D.home_links(found)
    first = [f"{S}/one", f"{S}/two/x", "https://f.example/?u=s.example", f"{S}/ab"]
    assert in_order(seeds) == first
    assert in_order(D.nav_expand(seeds, found)) == first + [f"{S}/three", f"{S}/five"]
    many = archive(spark, [("/", "<h1>" + "".join(f'<a href="/l{i}">' for i in range(20))), ("/l1", '<a href="/more">')])
    assert D.nav_expand(D.home_links(many), many).count() == 20
    assert in_order(D.nav_expand(seeds, found, 2)) == first[:2]


def test_ladder_and_candidates(spark):
    def urls(site, kind, source, *paths):
        return [(site, p, kind, source, i) for i, p in enumerate(paths)]

    schema = "site STRING, url STRING, kind STRING, source STRING, pos BIGINT"
    a = spark.createDataFrame(urls("A", "product", "api", "/blog/x"), schema)
    b = spark.createDataFrame(urls("A", "general", "map", "/p/1") + urls("B", "general", "map", "https://b/p/1", "https://b/p/2", "https://b/x", "https://b/p/1")
                              + urls("C", "general", "map", *[f"https://c/p/{i}" for i in range(5)], "https://c/x"), schema)
    chosen = D.discovery_ladder(a, b)
    assert {(r.site, r.source) for r in chosen.collect()} == {("A", "api"), ("B", "map"), ("C", "map")}
    picked = D.dedupe_candidates(D.select_candidates(chosen))
    got = {}
    for r in picked.orderBy("site", "pos").collect():
        got.setdefault(r.site, []).append(r.url)
    assert got == {"A": ["/blog/x"], "B": ["https://b/p/1", "https://b/p/2", "https://b/x"], "C": [f"https://c/p/{i}" for i in range(5)]}


def test_embedded_and_second_hop(spark):
    html = '{"url" : "/products/abc","url":"/blog/products/1","url":"\\/products\\/x", "url":"/p/1","url":"/products/abc"}'
    pages = spark.createDataFrame([(S, f"http://m.s.example/list{i}", i, html) for i in (2, 1)], "site STRING, url STRING, pos BIGINT, html STRING")
    known = spark.createDataFrame([(S, "https://m.s.example/p/1")], "site STRING, url STRING")
    got = D.second_hop(pages, known).collect()
    assert [(r.url, r.pos, r.hop) for r in got] == [("https://m.s.example/products/abc", 1, 1)]


def test_frontier(spark):
    wanted = spark.createDataFrame([(S, "/a", "x"), (S, "/b", "x"), (S, "/b", "w")], "site STRING, url STRING, wanted_by STRING")
    have = spark.createDataFrame([(S, "/a")], "site STRING, url STRING")
    assert [tuple(r) for r in D.frontier(wanted, have).collect()] == [(S, "/b", "w")]


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_first_per_group_with_a_hot_group(spark, n):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', concat('s', id % 500)) AS site", "id AS pos", "concat('u', id) AS url")
    got = D.cap_per_site(rows, n)
    want = rows.selectExpr("*", "row_number() OVER (PARTITION BY site ORDER BY pos) AS rn").filter(f"rn <= {n}").drop("rn")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_page_runs(spark):
    pages = [p for p in range(1, 30_000) if p % 7919 != 0]
    rows = spark.createDataFrame([("k", p, 2) for p in pages] + [("m", 5, 1)], "k STRING, page BIGINT, n BIGINT")
    got = {(r.k, r.page): (r.stop, r.before) for r in G.page_runs(rows, ["k"]).filter("page % 4000 = 5 OR k = 'm' OR page = 29999").collect()}
    before = lambda p: 2 * sum(1 for q in pages if q < p)
    stop = lambda p: next((g - 1 for g in (7919, 15838, 23757) if g > p), 29999)
    for (k, p), found in got.items():
        assert found == ((5, 0) if k == "m" else (stop(p), before(p)))
    assert len(got) > 7


def test_prefixed_and_nested_sitemaps(spark):
    prefixed = f'<s:urlset xmlns:s="{NS}"><s:url><s:loc>{S}/x</s:loc></s:url></s:urlset>'
    nested = f'<feed><urlset xmlns="{NS}"><url><loc>{S}/y</loc></url><url><loc>{S}/z</loc></url></urlset></feed>'
    found = archive(spark, [("/a.xml", prefixed), ("/b.xml", nested)])
    got = {r.url[len(S):]: r.locs for r in parse_sitemaps(found).collect()}
    assert got == {"/a.xml": [f"{S}/x"], "/b.xml": [f"{S}/y", f"{S}/z"]}


def test_next_pages_of_runs_that_go_on(spark):
    """A full API page and a feed page ask for the next one; a short API page does not."""
    prefixes = [p for p, _ in rules.API_ENDPOINTS]
    items = json.dumps([{"id": i, "permalink": f"{S}/p/{i}"} for i in range(rules.API_PAGE_SIZE)])
    feed = "/sitemap_products.xml?type=products&page=1"
    found = archive(spark, [(prefixes[0] + "1", items), (prefixes[0] + "2", items), (prefixes[1] + "1", items[:200].rsplit(",", 1)[0] + "]"), (feed, urlset("/q"))])
    wanted = {(r.url[len(S):], r.wanted_by) for r in following(found).collect()}
    assert (prefixes[0] + "3", "api") in wanted and (prefixes[1] + "2", "api") not in wanted
    assert (feed.replace("page=1", "page=2"), "sitemap") in wanted
