"""A small archive of three sites."""

S = "https://www.s.example"


def page(name, price="5"):
    return (
        '<html><body><h1>x</h1><script type="application/ld+json">'
        f'{{"@type":"Product","name":{name},"offers":{{"price":{price}}}}}</script></body></html>'
    )


def site_archive(spark):
    locs = ["/p/1", "/p/2", "/p/3", "/p/list", "/p/1", "/p/gone", "/p/blocked"]
    urlset = "<urlset>" + "".join(f"<url><loc>{S}{x}</loc></url>" for x in locs) + "</urlset>"
    listing = '<h1>a</h1><h1>b</h1><script>[{"url":"/products/hidden"},{"url":"/p/2"}]</script>'
    rows = [
        (S, "/robots.txt", 200, f"Sitemap: {S}/map.xml"), (S, "/map.xml", 200, urlset), (S, "/p/1", 200, page('"One"')),
        (S, "/p/2", 200, page('"Two"', "null")), (S, "/p/3", 200, page('"Quo\\"ted é"')), (S, "/p/list", 200, listing),
        (S, "/products/hidden", 200, page('"Hidden"')), (S, "/p/blocked", 403, "no"),
        ("https://news.example", "/", 200, '<h1>News</h1><a href="/story">s</a>'), ("https://news.example", "/story", 200, "<h1>Story</h1>"),
    ]
    df = spark.createDataFrame(rows, "site STRING, path STRING, status INT, body STRING")
    return df.selectExpr(
        "site", "concat(site, path) AS url", "0 AS attempt", "CAST(NULL AS TIMESTAMP) AS fetched_at", "status", "body",
        "CAST(NULL AS STRING) AS error", "'http' AS via",
    )
