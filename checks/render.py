"""Pages, responses and sites that Spark derives from the given tables.

Every ``part`` row becomes one page (or one response of an archive), so the work of a
query grows with the table, and the expected result is plain SQL on ``part``.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscan.session import prepare, spread

FILLER = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor. " * 3

#: All names of character references, with their semicolon or, old ones, without.
REFERENCES = sorted(html5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part``, dealt out before a page is made of each narrow row.

    A file has as many splits as its bytes allow, but rows in as few as it has row groups; and a page costs far more than its row.
    """
    part = table(spark, sf_dir, "part")
    return part.repartition(3 * spark.sparkContext.defaultParallelism, "p_partkey")


def _price(c: str = "p_retailprice") -> Column:
    """Price text with at most two decimals, the same in every engine."""
    return F.format_string("%.2f", F.col(c))


def brand_number() -> Column:
    return F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2))


def site() -> Column:
    """Sites grow in number with the table, not in size: one per brand and 10 000 parts."""
    bucket = F.floor(F.col("p_partkey") / 10000).cast("string")
    return F.concat(F.lit("https://www.shop"), brand_number(), F.lit("-"), bucket, F.lit(".example"))


def product_url() -> Column:
    return F.concat(site(), F.lit("/products/"), F.col("p_partkey").cast("string"))


def jsonld_page() -> Column:
    item = F.concat(
        F.lit('{"@context":"https://schema.org","@type":"Product","name":"'), F.col("p_name"),
        F.lit('","sku":"P-'), F.col("p_partkey"), F.lit('","brand":{"@type":"Brand","name":"'), F.col("p_brand"),
        F.lit('"},"image":["https://img.example/'), F.col("p_partkey"), F.lit('.jpg","x.jpg"],"description":"A '),
        F.col("p_type"), F.lit(' part","additionalProperty":[{"name":"Size","value":"old"},{"name":"Type","value":"'),
        F.col("p_type"), F.lit('"},{"name":"Size","value":'), F.col("p_size"),
        F.lit('},{"name":"","value":"x"},5],"offers":{"@type":"Offer","price":"'), _price(),
        F.lit('","highPrice":'), F.format_string("%.2f", F.col("p_retailprice") * 2),
        F.lit(',"priceCurrency":"USD","availability":"https://schema.org/'),
        F.when(F.col("p_size") % 2 == 0, "InStock").otherwise("OutOfStock"), F.lit('"}}'),
    )
    graph = F.concat(F.lit('{"@graph":[{"@type":"WebPage","name":"x"},'), item, F.lit("]}"))
    block = F.when(F.col("p_size") % 3 == 0, graph).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit("[3,"), item, F.lit("]"))
    ).otherwise(item)
    return F.concat(
        F.lit("<html><head><script type='application/ld+json'>{broken</script><!-- <script type=\"application/ld+json\">"
              "{\"@type\":\"Product\",\"name\":\"hidden\"}</script> --><script type=\"application/ld+json\">"),
        block, F.lit("</script></head><body><h1>Other heading</h1><p>"), F.lit(FILLER), F.lit("</p></body></html>"),
    )


def meta_page() -> Column:
    return F.concat(
        F.lit('<html><head><title>t</title><meta property="og:type" content="og:Product"><meta name="og:title" content="wrong">'
              "<META content='"), F.col("p_name"), F.lit("' property='og:title'>"
              '<meta property="og:image" content="https://img.example/'), F.col("p_partkey"),
        F.lit('.jpg?a=1&amp;b=2"><meta property="product:price:currency" content="EUR">'
              '<meta property="og:description" content="A > '), F.col("p_type"),
        F.lit('"></head><body><h1>Heading</h1><span itemprop="price">'), _price(),
        F.lit('</span><div itemprop="brand"> <b>'), F.col("p_brand"), F.lit("</b> </div><i itemprop=sku content=M-"),
        F.col("p_partkey"), F.lit("></i><link itemprop='availability' href='x'><p>"), F.lit(FILLER),
        F.lit("</p></body></html>"),
    )


def structure_page() -> Column:
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Shop</title><style>.price{color:red}</style></head><body><div><h1>"),
        F.col("p_name"), F.lit(" <em>"), F.col("p_type"),
        F.lit("</em></h1><script>var price='<h1>';</script><img src='/px.gif'><img data-src='/product/"), F.col("p_partkey"),
        F.lit(".png' alt=''><div class='Price old'>0</div><div class='was now-price' id='x'><b>$</b>"),
        F.format_string("%,.2f", F.col("p_retailprice")),
        F.lit("</div><dl><dt>SKU:<dd>H-"), F.col("p_partkey"), F.lit("<dt>Colour<dd>red</dl><p>About the <b>"),
        F.col("p_type"), F.lit("</b> part<ul><li class='brand-name'>"), F.col("p_brand"),
        F.lit("<li>two</ul><table><tr><td>Size<td>"), F.col("p_size"),
        F.lit("<tr><th>Type</th><td>"), F.col("p_type"), F.lit("</td></tr><tr><td>a<td>b<td>c</table><p>"),
        F.when(F.col("p_size") % 2 == 0, "Add&nbsp;to cart").otherwise("Sold out"), F.lit("</div></body></html>"),
    )


def listing_page() -> Column:
    cell = F.concat(F.lit('<div class="card"><span class="price">$'), _price(), F.lit("</span></div>"))
    return F.concat(
        F.lit("<html><body><h1>A</h1><h1>B</h1>"), F.repeat(cell, 6),
        F.lit('<p>Add to cart, SKU: 5</p><script>var d=[{"url": "/products/hidden-'), F.col("p_partkey"),
        F.lit('"},{"url":"\\/products\\/no"},{"url":"/blog/none"}]</script></body></html>'),
    )


def article_page() -> Column:
    return F.concat(
        F.lit("<html><body><h1>News</h1><!-- plain --><p>"), F.lit(FILLER), F.col("p_name"), F.lit("</body></html>")
    )


def challenge_page() -> Column:
    return F.concat(F.lit("<html><head><title>Just a moment</title></head><body><h1>"), F.col("p_name"), F.lit("</h1></body></html>"))


def shell_page() -> Column:
    return F.concat(
        F.lit('<html><body><div id="root" data-k="'), F.col("p_partkey"), F.lit('"></div><script>'), F.lit(FILLER),
        F.lit("</script></body></html>"),
    )


# Template by p_partkey % 7.
TEMPLATES = ["jsonld", "meta", "structure", "listing", "article", "challenge", "shell"]


def page_template() -> Column:
    k = F.col("p_partkey") % len(TEMPLATES)
    return F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (k + 1).cast("int"))


def page_html(template: Column) -> Column:
    makers = [jsonld_page(), meta_page(), structure_page(), listing_page(), article_page(), challenge_page(), shell_page()]
    html = F.lit(None).cast("string")
    for name, maker in zip(TEMPLATES, makers):
        html = F.when(template == name, maker).otherwise(html)
    return html


def rendered_pages(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """(page_id, site, url, template, html): one page per part; all of one template, or a mix."""
    template = F.lit(only) if only else page_template()
    return parts(spark, sf_dir).select(
        F.col("p_partkey").alias("page_id"), site().alias("site"), product_url().alias("url"),
        template.alias("template"), page_html(template).alias("html"),
    )


def _pages(spark: SparkSession, sf_dir: str, html: Column) -> DataFrame:
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("page_id"), site().alias("site"), product_url().alias("url"), html.alias("html"))


def reference_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two character references by name a part, in text and attributes: before a blank, run on, before an equals sign."""
    name = f"element_at(split('{' '.join(REFERENCES)}', ' '), CAST(n % {len(REFERENCES)} AS INT) + 1)"
    named = parts(spark, sf_dir).selectExpr("p_partkey", "explode(array(2 * p_partkey, 2 * p_partkey + 1)) AS n").selectExpr("p_partkey", f"concat('&', {name}) AS r")
    html = """concat('<p title="', r, ' x">a ', r, ' b</p><i title="q', r, '=1', r, 'zq9">y', r, 'zq9</i>')"""
    return named.selectExpr("p_partkey AS page_id", "substr(r, 2) AS name", f"{html} AS html")


def crosswise_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose tags are crossed, stray or never closed."""
    size = F.col("p_size").cast("string")
    return _pages(spark, sf_dir, _texts(
        "<body></i><div><b>", F.col("p_name"), "<i>", F.col("p_type"), "</b>x</i>y</div></div></p><p>a<ul><li>", F.col("p_brand"),
        "</ul>b</p>c<table><tr><td>k<p>v", size, "</div>z</td><td>w", F.col("p_brand"), "<tr><td>", F.col("p_brand"),
        "</table><h2>open<em>", F.col("p_partkey").cast("string"), "</h2>r</em><h3>last<u>q",
    ))


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with many SKU labels and tables within tables."""
    far = "<div><span>SKU:</span><i>" + "far too long for a number " * 5 + "</i></div>"
    return _pages(spark, sf_dir, _texts(
        "<h1>T</h1>", far * 12, "<ul><li><b>Part #</b><em>N", F.col("p_partkey").cast("string"),
        "</em></ul><div>SKU: later</div><table><tr><td>a<td>outer<tr><td>c<td>out<tr><td><table><tr><td>a<td>middle<tr><td>b<td>",
        F.col("p_brand"), "<tr><th><table><tr><td>a<td>", F.col("p_type"), "</table><tr><td>d<td>", F.col("p_size").cast("string"),
        "</table><tr><td>e<td>late<tr><td>b<td>too early</table>",
    ))


# Bodies of pages and the rule that decides on them.
OFFERS = {
    "offer": ("<h1>N</h1><p>Please request a <b>quote</b></p>", "offer"),
    "offer_of_many": ("<h1>N</h1><h1>M</h1><p>Add to cart</p>", "none"),
    "offer_in_script": ("<h1>N</h1><script>Buy now</script>", "none"),
    "table": ("<h1>N</h1><table><tr><td>k<td>v</table>", "spec_table"),
    "table_of_many": ("<h1>N</h1><h1>M</h1><table><tr><td>k</table>", "none"),
    "offer_and_table": ("<h1>N</h1>Buy&nbsp;now<table></table>", "offer"),
    "grid": ('<p class="price">1</p>' * 6 + "<p>Add to cart</p><table></table>", "listing"),
    "grid_of_one": ("<h1>N</h1>" + '<p class="price">1</p>' * 6 + "<p>Add to cart</p>", "offer"),
    "label": ("<h1>N</h1>Model # 5, add to cart<table></table>", "sku_label"),
}


def offer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = F.array(*[F.lit(body) for body, _ in OFFERS.values()])
    return _pages(spark, sf_dir, _texts("<html><body>", F.element_at(bodies, (F.col("p_partkey") % len(OFFERS) + 1).cast("int")), "</body></html>"))


# -- an archive of responses --------------------------------------------------

# How a site can be read, by brand number % 5.
KINDS = ["api", "sitemap", "feed", "categories", "links"]


def _texts(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _collected(rows: DataFrame, keys: list[str], piece: Column, sep: str = "") -> DataFrame:
    """(keys, text): pieces of one small document, in order. Keys must keep groups small."""
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rn", piece.alias("piece")))).alias("p"))
    return grouped.select(*keys, F.array_join(F.col("p.piece"), sep).alias("text"))


def site_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their site, kind of site, number within the site (at most some hundred) and page URL."""
    # Dealt out to all shuffle partitions: a few narrow rows turn into many pages and documents, so bytes say little of the work.
    part = spread(table(spark, sf_dir, "part").withColumn("site", site()), "site")
    part = part.withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in KINDS]), (brand_number().cast("int") % 5 + 1)))
    rn = F.row_number().over(Window.partitionBy("site").orderBy("p_partkey")) - 1
    path = F.when(F.col("kind") == "categories", "/x/p/").otherwise("/products/")
    return part.withColumn("rn", rn).withColumn("url", _texts(F.col("site"), path, F.col("p_partkey").cast("string")))


def rendered_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(site().alias("site")).distinct()


def rendered_fetches(
    spark: SparkSession, sf_dir: str, with_pages: bool = True, with_docs: bool = True, with_hidden: bool = True
) -> DataFrame:
    """An archive: discovery documents of every site, and a page for every part."""
    parts = site_parts(spark, sf_dir)
    sets = []
    if with_docs:
        sets.append(_documents(parts))
    if with_pages:
        sets.extend(_page_responses(parts, with_hidden))
    rows = sets[0]
    for more in sets[1:]:
        rows = rows.unionByName(more)
    return rows.select(
        "site", "url", "attempt", F.lit(None).cast("timestamp").alias("fetched_at"), "status", "body",
        F.lit(None).cast("string").alias("error"), "via",
    )


def _documents(parts: DataFrame) -> DataFrame:
    """robots, sitemaps, API lists, home pages, categories and hubs."""
    of = lambda kind: parts.filter(F.col("kind") == kind)
    link = F.col("url")
    urlset = lambda c: _texts('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', c, "</urlset>")
    index = lambda c: _texts('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', c, "</sitemapindex>")
    loc = _texts("<url><loc> ", link, " </loc></url>")
    docs = []

    def add(rows: DataFrame, url: Column, body: Column) -> None:
        docs.append(rows.select("site", url.alias("url"), body.alias("body")))

    # REST lists of 100 items, the link under one of three names.
    item = (
        F.when(F.col("rn") % 3 == 0, _texts('{"permalink":"', link, '"}'))
        .when(F.col("rn") % 3 == 1, _texts('{"permalink":"","url":"', link, '"}'))
        .otherwise(_texts('{"url":null,"link":"', link, '"}'))
    )
    pages = _collected(of("api").withColumn("n", F.floor(F.col("rn") / 100) + 1), ["site", "n"], item, ",")
    add(pages, _texts(F.col("site"), "/api/products?limit=100&page=", F.col("n").cast("string")), _texts("[", F.col("text"), "]"))
    # robots.txt, an index and its urlsets of 30; the index also names itself.
    maps = of("sitemap").withColumn("n", F.floor(F.col("rn") / 30))
    add(maps.select("site").distinct(), _texts(F.col("site"), "/robots.txt"), _texts("User-agent: *\r\nSITEMAP: ", F.col("site"), "/maps/all.xml\n"))
    child = lambda n: _texts("<sitemap><loc>", F.col("site"), "/maps/", n, ".xml</loc></sitemap>")
    listed = _collected(maps.groupBy("site", "n").agg(F.min("rn").alias("rn")), ["site"], child(F.col("n").cast("string")))
    add(listed, _texts(F.col("site"), "/maps/all.xml"), index(_texts(child(F.lit("all")), F.col("text"))))
    add(_collected(maps, ["site", "n"], loc), _texts(F.col("site"), "/maps/", F.col("n").cast("string"), ".xml"), urlset(F.col("text")))
    # Product feed pages of 20.
    feed = _collected(of("feed").withColumn("n", F.floor(F.col("rn") / 20) + 1), ["site", "n"], loc)
    add(feed, _texts(F.col("site"), "/xmlsitemap.php?type=products&page=", F.col("n").cast("string")), urlset(F.col("text")))
    # Categories of 40, in two pages of 20.
    shop = of("categories").withColumn("c", F.floor(F.col("rn") / 40)).withColumn("n", F.floor(F.col("rn") % 40 / 20))
    name = _texts("/group/c/", F.col("c").cast("string"))
    home = _collected(shop.groupBy("site", "c").agg(F.min("rn").alias("rn")), ["site"], _texts('<a href="', name, '">x</a>'))
    add(home, _texts(F.col("site"), "/"), _texts("<html><body><h1>Shop</h1>", F.col("text"), "</body></html>"))
    hrefs = _collected(shop, ["site", "c", "n"], _texts('<a href="/x/p/', F.col("p_partkey").cast("string"), '">x</a>'))
    paged = F.when(F.col("n") == 0, _texts(F.col("site"), name)).otherwise(
        _texts(F.col("site"), name, "?q=%3Arelevance&page=", F.col("n").cast("string"), "&pageSize=96")
    )
    add(hrefs, paged, _texts("<html><body><h1>Group</h1>", F.col("text"), "</body></html>"))
    # A home page with ten links to hubs, which link to the products.
    hubs = of("links").withColumn("h", F.col("rn") % 10)
    homes = _collected(hubs.groupBy("site", "h").agg(F.min("rn").alias("rn")), ["site"], _texts('<a href="/hub/', F.col("h").cast("string"), '">x</a>'))
    add(homes, _texts(F.col("site"), "/"), _texts('<html><body><h1>Shop</h1><a href="mailto:a@b">m</a><a href="https://else.example/">o</a>', F.col("text"), "</body></html>"))
    linked = _collected(hubs, ["site", "h"], _texts('<a href="/products/', F.col("p_partkey").cast("string"), '">x</a>'))
    add(linked, _texts(F.col("site"), "/hub/", F.col("h").cast("string")), _texts("<html><body><h1>Hub</h1>", F.col("text"), "</body></html>"))

    found = docs[0]
    for more in docs[1:]:
        found = found.unionByName(more)
    return _responses(found)


def _responses(rows: DataFrame, via: str = "http", attempt: int = 0, status: Column | None = None) -> DataFrame:
    return rows.select(
        "site", "url", "body", (F.lit(200) if status is None else status).alias("status"), F.lit(via).alias("via"),
        F.lit(attempt).alias("attempt"),
    )


def _page_responses(parts: DataFrame, with_hidden: bool) -> list[DataFrame]:
    """Pages of all parts: one in ten is first turned away, script shells were also drawn by a browser."""
    pages = parts.withColumn("template", page_template())
    pages = pages.withColumn("body", page_html(F.col("template")))
    turned_away = F.when(F.col("p_partkey") % 10 == 9, 429).otherwise(200)
    out = [
        _responses(pages, status=turned_away),
        _responses(pages.filter("p_partkey % 10 = 9"), attempt=1),
        _responses(pages.filter("template = 'shell'").withColumn("body", structure_page()), via="render"),
    ]
    if with_hidden:
        hidden = _texts(F.col("site"), "/products/hidden-", F.col("p_partkey").cast("string"))
        listed = pages.filter("template = 'listing'").withColumn("url", hidden).withColumn("body", jsonld_page())
        out.append(_responses(listed))
    return out
