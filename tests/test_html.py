"""Page shredding, classification and the three extraction strategies on small pages."""

import pytest

from shelfscan.operators import html as H
from shelfscan.operators.classify import classify_pages
from shelfscan.operators.extract import extract_products


def pages_of(spark, *bodies):
    rows = [(i, f"https://s.example/p/{i}", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")


def texts(spark, body, where, sep=""):
    rows = H.element_texts(pages_of(spark, body), where, sep=sep).orderBy("pos").collect()
    return [r.text for r in rows]


def test_tokens_rebuild_the_page(spark):
    body = """<!DOCTYPE html><?x?><p a="1>2">a < b<BR/><!-- <p> --><script>if(a<b){"</p>"}</script ><style>p{}</style><x-y>t</x-y> 1 <2"""
    rows = H.html_tokens(pages_of(spark, body)).orderBy("pos").collect()
    assert "".join(r.tok for r in rows) == body
    assert [r.kind for r in rows] == [
        "doctype", "doctype", "open", "text", "void", "comment", "raw", "raw", "open", "text", "close", "text"]
    assert rows[3].tok == "a < b"


def test_element_text(spark):
    assert texts(spark, "<h1>A <b>B</b></h1><p>x", "tag = 'h1'") == ["AB"]
    assert texts(spark, "<h1>A <b>B</b></h1>", "tag = 'h1'", sep=" ") == ["A B"]
    assert texts(spark, "<div>a<div>b</div>c</div>d", "tag = 'div'") == ["abc", "b"]
    assert texts(spark, "</div><div>a</div>b", "tag = 'div'") == ["a"]
    assert texts(spark, "<h1>a<script>s</script><style>t</style><!-- c --><template>u</template>v</h1>", "tag = 'h1'") == ["av"]
    assert texts(spark, "<h1>&nbsp;A&amp;B </h1>", "tag = 'h1'") == ["A&B"]


def test_implied_end_tags(spark):
    assert texts(spark, "<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul>f", "tag = 'li'") == ["a", "bcd", "c", "e"]
    assert texts(spark, "<table><tr><td>a<th>b<tr><td>c<table><tr><td>i</table>d</table>x", "tag IN ('td', 'th')") == ["a", "b", "cid", "i"]
    assert texts(spark, "<table><tbody><tr><td>a<tr><td>b</tbody><tfoot><tr><td>c</table>", "tag = 'tr'") == ["a", "b", "c"]
    assert texts(spark, "<dl><dt>a<dd>b<dl><dt>x<dd>y</dl><dt>c<dd>d</dl>z", "tag IN ('dt', 'dd')") == ["a", "bxy", "x", "y", "c", "d"]
    assert texts(spark, "<div><p>a<b>b</b><p>c</div>d", "tag = 'p'") == ["ab", "c"]


CLASSES = [
    ('<script type="application/ld+json">{"@type":["Thing","Product"]}</script>', "ld_product"),
    ('<script type="application/ld+json">{"@type":"http://schema.org/Product"}</script>', "none"),
    ('<script type="application/ld+json">{"@type":"ProductGroup"}</script>', "none"),
    ('<script type="application/ld+json">[{"@type":"X"},{"@graph":[{"@type":"Product"}]}]</script>', "none"),
    ('<script type="application/ld+json">{"@graph":[1,{"@type":"Product"}]}</script>', "ld_product"),
    ('<!-- <script type="application/ld+json">{"@type":"Product"}</script> -->', "none"),
    ('<meta property="og:type" content="OG:PRODUCT.item">', "og_product"),
    ('<meta name="og:type" content="product">', "og_product"),
    ('<meta property="og:type"><meta name="og:type" content="product">', "none"),
    ('<p class="price">1</p>' * 6 + "sku", "listing"),
    ('<p class="price">1</p>' * 5 + "sku", "sku_label"),
    ("<h1>x</h1>" + '<p class="price">1</p>' * 6 + "sku", "sku_label"),
    ("<!-- Part # 5 -->", "sku_label"),
    ("<script>var sku = 1</script>", "none"),
    ("item<b>#</b>", "none"),
    ("Item&nbsp;#", "sku_label"),
    ("<h1>x</h1><p>Add&nbsp;to <b>cart</b></p>", "offer"),
    ("<h1>x</h1><h1>y</h1><p>Add to cart</p>", "none"),
    ("<h1>x</h1><template>Add to cart</template>", "none"),
    ("<h1>x</h1><table><tr></table>", "spec_table"),
    ("<h1>x</h1><!-- <table> -->", "none"),
    ("", "none"),
]


def test_classification(spark):
    rows = classify_pages(pages_of(spark, *[b for b, _ in CLASSES])).orderBy("page_id").collect()
    assert [r.rule for r in rows] == [rule for _, rule in CLASSES]
    assert all(r.is_product == (r.rule not in ("listing", "none")) for r in rows)


def ld(body):
    return f'<script type="application/ld+json">{body}</script>'


def products(spark, *bodies, classified=True):
    found = extract_products(pages_of(spark, *bodies), keep=("page_id",), classified=classified)
    rows = found.selectExpr("*", "map_keys(specs) AS spec_keys").collect()
    return {r.page_id: r for r in rows}


def test_jsonld(spark):
    got = products(
        spark,
        ld('{"@type":"Product","name":" A ","@id":"#x","brand":"","image":{"contentUrl":"i.png"},"offers":[5,{"price":0,"lowPrice":"1,200.50",'
           '"highPrice":2000},{"price":7,"priceCurrency":" usd ","availability":"PreOrder"}]}'),
        ld('{"@type":"Product","name":"B","productID":0,"identifier":"id-9","sku":77,"brand":{"name":"Z"},"image":["a.png"],"description":"<b>d</b>",'
           '"additionalProperty":[{"name":"k","value":"1"},{"name":"j","value":2},{"name":"k","value":"3"},{"name":"n","value":0}],"offers":{"price":-3,"availability":"Discontinued"}}'),
        ld("{broken") + ld('{"@type":"Product","name":"","name":"C","offers":{}}') + ld('{"@type":"Product","name":"D"}'),
        ld('{"@type":"Product"}') + '<meta property="og:title" content="T"><meta property="og:type" content="product">',
    )
    a, b, c, d = (got[i] for i in range(4))
    assert (a.name, a.id, a.brand, a.image, a.price, a.listPrice, a.currency, a.availability) == (
        "A", "#x", "", "i.png", 1200.5, 2000.0, "usd", "out_of_stock")
    assert (b.id, b.sku, b.brand, b.image, b.description, b.price, b.availability) == ("id-9", "77", "Z", "a.png", "<b>d</b>", None, "in_stock")
    assert b.specs == {"k": "3", "j": "2"} and b.spec_keys == ["k", "j"]
    assert c.name == "C" and len(c.id) == 16 and c.variants == [] and c.specs == {}
    # A JSON-LD product without a name wins over the meta tags and is dropped later.
    assert (d.name, d.strategy, d.availability) == ("", "jsonld", "unknown")


def test_meta(spark):
    got = products(
        spark,
        '<meta property="og:type" content="product"><meta name="twitter:title" content=" T "><meta property="og:description" content="od">'
        '<meta property="og:availability" content="maybe"><span itemprop="brand"> </span>',
        '<h1>H <i>x</i></h1>sku<b itemprop="price" content="">from 1,5</b><b itemprop="priceCurrency">GBP</b><i itemprop="sku">S<b>1</b></i>'
        '<link itemprop="availability" content="InStock"><p itemprop="description"></p><meta name="description" content="no">',
        '<meta property="og:title" content=""><meta name="og:title" content="hidden"><h1></h1>sku',
        '<meta property="og:title" content="only a title"> sku',
    )
    a, b = got[0], got[1]
    assert (a.strategy, a.name, a.price, a.availability, a.brand, a.description) == ("meta", "T", None, "unknown", "", "od")
    assert (b.strategy, b.name, b.price, b.currency, b.sku, b.id, b.availability, b.description) == (
        "meta", "Hx", 15.0, "GBP", "S1", "S1", "in_stock", "")
    assert 2 not in got and 3 not in got


def test_structure(spark):
    got = products(
        spark,
        "<h1>A <b>B</b></h1><img src=px.gif><img src=a.png alt='The Product'><span>SKU:</span><span>X-1</span><div class=price>0</div>"
        "<div id=sale-price>£1,299.50</div><table><tr><td>k<td>v<tr><td>1<td>2<td>3</table><dl><dt>k<dd>w<dt>m<dd>n<dt>left</dl><p> first <p>second",
        "<h1>N</h1><p>SKU: X-2</p>brand: Acme &amp; Co. Out of Stock<meta name=description content=md>",
        "<body><h1>N</h1><p></p><meta property='og:description' content=od><!-- sku --><div class=brand></div><p>Buy now. Brand: No</p>",
        "<h1>N</h1><div>" + "x " * 20 + "sku: far away</div><li>Part no: <b>P9</b>",
        "<h1>N</h1><span>SKU</span><span>" + "y" * 81 + "</span><div><b>Item #</b><br><i>no</i></div><div>Model # M1</div>",
        "<p>SKU: no heading</p>",
    )
    a, b, c, d, e = (got[i] for i in range(5))
    assert (a.strategy, a.name, a.sku, a.price, a.currency, a.image, a.description) == (
        "heuristic", "AB", "X-1", 1299.5, "GBP", "a.png", "first")
    assert dict(a.specs) == {"k": "w", "m": "n"}
    assert (b.sku, b.brand, b.availability, b.description, b.price) == ("X-2", "Acme & Co", "out_of_stock", "SKU: X-2", None)
    assert (c.sku, c.brand, c.description) == ("NBuy now. Brand: No", None, "od")
    assert d.sku == "P9"
    assert e.sku == "M1"
    assert 5 not in got


def test_nested_tables_win(spark):
    body = "<h1>N</h1>sku<table><tr><td>a<td>outer<tr><td><table><tr><td>b<td>inner</table><tr><td>b<td>late</table>"
    assert dict(products(spark, body)[0].specs) == {"a": "outer", "b": "inner"}


def test_page_without_product_gives_nothing(spark):
    assert products(spark, "<h1>News</h1><p>text", "") == {}


@pytest.mark.parametrize("n", [400])
def test_large_page(spark, n):
    body = "<h1>N</h1><p>SKU: A1</p><table>" + "".join(f"<tr><td>k{i}<td>v{i}" for i in range(n)) + "</table>"
    got = products(spark, body)[0]
    assert got.specs == {f"k{i}": f"v{i}" for i in range(n)} and got.spec_keys[:3] == ["k0", "k1", "k2"]


def test_crosswise_nesting(spark):
    """What closes what: an end tag takes the elements inside along, a start tag those that cannot hold it."""
    assert texts(spark, "<b><i>x</b>y</i>z", "tag IN ('b', 'i')") == ["x", "x"]
    assert texts(spark, "<div><b>a</div>b</b>c", "tag IN ('div', 'b')") == ["a", "a"]
    assert texts(spark, "<p>a<ul><li>b</ul>c</p>d", "tag IN ('p', 'ul')") == ["a", "b"]
    assert texts(spark, "<table><tr><td>a</div></p>b<div>c</td>d</table>e", "tag IN ('td', 'div')") == ["abc", "c"]
    assert texts(spark, "<div>a<table><tr><td>b</div>c</table>d</div>e", "tag IN ('div', 'table')") == ["abcd", "bc"]
    assert texts(spark, "<h1>a<h2>b</h1>c", "tag IN ('h1', 'h2')") == ["ab", "b"]
    assert texts(spark, "<a>x<a>y</a>z", "tag = 'a'") == ["x", "y"]
    assert texts(spark, "<ul><li>a<b>b<li>c</ul>", "tag = 'li'") == ["abc", "c"]
    assert texts(spark, "</b></table>x<html><p>y</html>z", "tag = 'p'") == ["y"]


def test_parents_and_siblings():
    from shelfscan.operators.tree import Page

    page = Page("<div>a<p>b<br><i>c</i></p><script>s</script><p>d</div><span>e")
    names = {i: t for i, t in enumerate(page.tags) if page.kinds[i] in ("open", "void", "raw")}
    parents = [(t, names.get(page.parent[i])) for i, t in names.items()]
    assert parents == [("div", None), ("p", "div"), ("br", "p"), ("i", "p"), ("script", "div"), ("p", "div"), ("span", None)]
    beside = [names.get(page.beside[i]) for i in names]
    assert beside == ["span", "script", "i", None, "p", None, None]


def test_random_trees_against_a_plain_reading():
    """On well nested pages without optional end tags: extents, parents and siblings as brackets give them."""
    import random

    from shelfscan.operators.tree import Page

    r = random.Random(3)
    for _ in range(60):
        parts, open_tags, want, last = [], [], {}, {}
        for _ in range(120):
            step = r.random()
            if step < 0.4 and len(open_tags) < 30:
                i, above = len(parts), open_tags[-1] if open_tags else -1
                if above in last:
                    want[last[above]][1] = i
                last[above] = i
                want[i] = [above, None, None]
                open_tags.append(i)
                parts.append(f"<{r.choice(['section', 'em', 'x-y', 'article'])}>")
            elif step < 0.7 and open_tags:
                i = open_tags.pop()
                want[i][2] = len(parts)
                parts.append(parts[i].replace("<", "</"))
            elif not parts or parts[-1][0] == "<":
                parts.append(r.choice(["text", " ", "a&amp;b"]))
        page = Page("".join(parts))
        assert page.toks == parts
        assert {i: [page.parent[i], page.beside[i], page.end[i]] for i in want} == want


def seconds(body):
    import time

    from shelfscan.operators.tree import Page

    start = time.perf_counter()
    page = Page(body)
    page.rows([[] for _ in range(24)])
    return time.perf_counter() - start, page


def test_time_grows_with_the_page():
    """2 000 labels or 500 tables within each other cost no more than as many other tokens."""
    few = "<p>SKU: 1</p>" + "<div><b>x</b></div>" * 10000
    many = "<p>SKU: 1</p>" * 2000 + "<div><b>x</b></div>" * 9000
    assert seconds(many)[0] < 4 * seconds(few)[0] + 0.2
    rows = "<tr><td>k<td>v"
    nested = ("<table>" + rows * 10 + "<tr><td>") * 500 + "</table>" * 500
    flat = ("<table>" + rows * 10 + "<tr><td></table>") * 500
    (slow, page), (fast, _) = seconds(nested), seconds(flat)
    assert slow < 8 * fast + 0.3
    assert [page.inside[i] is not None for i, t in enumerate(page.tags) if t == "tr" and page.kinds[i] == "open"] == [True] * 5500


def test_many_labels_and_deep_tables(spark):
    """The first usable label counts; rows of inner tables come last, in linear time."""
    labels = "<div><span>SKU:</span><i>" + "y" * 90 + "</i></div>"
    body = "<h1>N</h1>" + labels * 1500 + "<span>SKU:</span><b>Z-9</b>"
    deep = "<h1>N</h1>sku" + "".join(f"<table><tr><td>a<td>{i}<tr><td>k{i}<td>{i}<tr><td>" for i in range(60)) + "</table>" * 60
    got = products(spark, body, deep)
    assert got[0].sku == "Z-9"
    assert got[1].specs == {"a": "59"} | {f"k{i}": str(i) for i in range(60)}


def test_pages_are_read_once_and_after_they_are_dealt_out(spark):
    """Spark makes filters of its own from a generator; the reading of a page must not be copied into them."""
    pages = pages_of(spark, "<p>a", "<p>b").repartition(5, "page_id")
    for df in (H.element_texts(pages, "tag = 'p'"), H.html_elements(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert sum(line.strip(" :+-").startswith("ArrowEvalPython") for line in plan.splitlines()) == 1
        assert plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM", plan.index("ArrowEvalPython"))


def test_a_batch_is_held_as_rows_in_runs_of_few_pages():
    import pyarrow as pa

    from shelfscan.operators.tree import CHARACTERS, PAGES, _read_batches

    short, long = ["<p>a"] * (2 * PAGES + 1), ["<p>" + "a" * CHARACTERS, None]
    made = list(_read_batches(iter([(pa.array(short + long), pa.array([True] * (2 * PAGES + 3)))])))
    assert [len(x) for x in made] == [PAGES, PAGES, 1, 1, 1]
    assert [len(x.as_py()["elements"]) for x in made[-1]] == [0] and [len(x.as_py()["notes"]) for x in made[-2]] == [1]


def test_pages_of_one_key_count_as_one(spark):
    pages = pages_of(spark, "<p>a</p>").union(pages_of(spark, "<p>a</p>"))
    rows = H.element_texts(pages, "tag = 'p' AND tok <> 'tag'")
    assert [(r.page_id, r.pos, r.tag, r.text) for r in rows.collect()] == [(0, 0, "p", "a")] * 2


def test_labels_far_from_the_start_of_a_text_do_not_count(spark):
    got = products(spark, "<h1>N</h1><b>" + "x" * 31 + " SKU:</b><i>1</i>", "<h1>N</h1><b>" + "x" * 29 + " SKU:</b><i>2</i><p>sku 3")
    assert [got[i].sku for i in (0, 1)] == [None, "2"]


def test_parts_are_dealt_out_before_pages_are_made(spark, tmp_path):
    from checks import render

    spark.range(50).selectExpr("id AS p_partkey", "'n' AS p_name", "'Brand#1' AS p_brand", "'T' AS p_type", "1 AS p_size", "1D AS p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    n = 3 * spark.sparkContext.defaultParallelism
    for made in (render.reference_pages(spark, str(tmp_path)), render.crosswise_pages(spark, str(tmp_path)), render.rendered_pages(spark, str(tmp_path))):
        assert made.rdd.getNumPartitions() == n


def test_sites_are_dealt_out_and_sides_of_a_union_have_their_own_tasks(spark, tmp_path):
    from checks import render

    spark.range(50).selectExpr("id AS p_partkey", "'n' AS p_name", "concat('Brand#', id % 25) AS p_brand", "'T' AS p_type", "1 AS p_size", "1D AS p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    parts = render.site_parts(spark, str(tmp_path))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts.rdd.getNumPartitions() == n
    assert parts.filter("rn = 0").union(parts.filter("rn = 1")).rdd.getNumPartitions() == 2 * n


def test_extractors_get_only_what_they_look_at(spark):
    """Plain elements and texts without a label take no row, in Python or in Spark, however many a page has."""
    from shelfscan.operators.tree import page_parts

    plain, label = "<div><b>x</b></div>" * 300, "<p>S&#75;U: 1<br/>"
    rows = "<table><tr><td>k<td class='c'>v</table><dl><dt>t<dd>d</dl><h1>n</h1><script>a='='</script>"
    row = pages_of(spark, plain + label + rows + "<!-- model # --><img>", None).select(page_parts().alias("n")).collect()
    n = row[0].n
    assert [t.tag for t in n.tags] == ["td", "h1", "img"] and [x.tok for x in n.labels] == ["S&#75;U: 1", "<!-- model # -->"]
    assert [len(x) for x in (n.ps, n.cells, n.dts, n.dds, n.trs, n.dls)] == [1, 2, 1, 1, 1, 1]
    assert (n.trs[0].c0, n.trs[0].c1, n.dls[0].dt1, n.dls[0].dd1) == (0, 2, 1, 1) and len(n.texts) == 300 + 6
    assert all(x == [] for x in row[1].n)
