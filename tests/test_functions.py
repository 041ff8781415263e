import hashlib
from html import unescape
from urllib.parse import urljoin, urlparse

import pytest

from shelfscan.functions import markup as M
from shelfscan.functions import scalars as S
from shelfscan.functions import urls as U
from shelfscan.functions import variants as V


def column(spark, values, expression, name="v"):
    """Results of an expression over many values at once, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {name} STRING")
    return [r.x for r in rows.selectExpr("i", f"{expression} AS x").orderBy("i").collect()]


def test_parse_price(spark):
    raw = ["24.99", "1,599", "$10.50 - $20", "1.234,56 €", "call", "-5", None, " 12. ", ""]
    assert column(spark, raw, S.parse_price("v")) == [24.99, 1599.0, 10.5, 1.23456, None, 5.0, None, 12.0, None]


def test_variant_price(spark):
    raw = ["-5", "5", "0", "12.50", '"-5"', '"1,299.5 USD"', "null", "true", '["7"]']
    got = column(spark, raw, V.variant_price("try_parse_json(v)"))
    assert got == [None, 5.0, 0.0, 12.5, 5.0, 1299.5, None, 1.0, 7.0]


def test_availability(spark):
    raw = ["https://schema.org/InStock", " In Stock ", "PreOrder", "discontinued", "discontinue", None,
           "LimitedAvailability", "https://schema.org/SoldOut", " instock "]
    assert column(spark, raw, S.normalise_availability("v")) == [
        "in_stock", "in_stock", "out_of_stock", "unknown", "out_of_stock", "unknown", "in_stock", "unknown", "in_stock"]


def test_product_id(ev):
    url = "https://s.example/é"
    assert ev(S.make_product_id("pid", "url"), pid=" A-1 ", url=url) == "A-1"
    for blank in ("  ", None):
        assert ev(S.make_product_id("CAST(pid AS STRING)", "url"), pid=blank or "", url=url) == hashlib.md5(url.encode()).hexdigest()[:16]


def test_currency_label_strip(spark):
    assert column(spark, ["€ 5 or $ 6", "£1", "¥", "₹ 3", "5"], S.currency_of("v")) == ["USD", "GBP", "JPY", "INR", None]
    assert column(spark, ["  x y\n", "\x1c x", "x", " "], S.py_strip("v")) == ["x y", "x", "x", ""]
    assert column(spark, ["0", "12.5", None], S.price_label("CAST(v AS DOUBLE)")) == [
        "price on request", "$12.5", "price on request"]


def test_sites(spark):
    raw = ["www.walmart.com", "https://wwe.com/x?y", " http://a.b/c ", "HTTP://x.com", "https://www.example.com:8080#f"]
    sites = column(spark, raw, U.normalise_site("v"))
    assert sites == ["https://www.walmart.com", "https://wwe.com", "http://a.b", "https://HTTP:", "https://www.example.com:8080"]
    assert column(spark, sites, U.site_domain("v")) == [urlparse(s).netloc.lstrip("www.") for s in sites]
    assert column(spark, sites[:1], U.site_domain("v")) == ["almart.com"]
    assert column(spark, ["https://a.b/c", "noslash"], U.rate_key("v")) == ["a.b", "noslash"]
    assert column(spark, ["https://a.b/c"], U.host_of("v")) == ["a.b"]


def test_product_urls(spark):
    paths = ["/partner/x", "/part/x", "/P/1.PDF", "/a.b/product", "/product?x=/blog", "/teams-kit/shop", "/x", "/p/1",
             "/shop/a;x=blog", "/PRODUCTS/a.b/c.JPG", ""]
    got = column(spark, ["https://s.example" + p for p in paths], U.looks_like_product_url("v"))
    assert got == [False, True, False, True, True, False, False, True, True, False, False]
    assert column(spark, ["/a.b/c", "/a.PDF", "/a.b.c", "/"], U.url_extension("v")) == ["", ".pdf", ".c", ""]


@pytest.mark.parametrize("base", ["https://s.example", "http://www.s.example:81"])
def test_url_join_agrees_with_the_standard_library(spark, base):
    hrefs = ["/a/b", "a/b", "../x", "/a/../../b", "/a/./b/..", "//o.example/p?q", "?q=1", "https://o.example/x",
             "http://o.example/x", "mailto:a@b", "/a?x=1&y=/../z", "/a//b", "a//b", "./", "..", "/a/b/../", "/x?", "tel:1", "a:b",
             "HTTPS://O.example/Y", "/a;p=1/..;x", "x/.", ";x", "a/b;c/d;e?f"]
    assert column(spark, hrefs, U.url_join(f"'{base}'", "v")) == [urljoin(base, h) for h in hrefs]


def test_links_kept(spark):
    assert column(spark, ["javascript:x", "mailto:a", "tel:1", "data:x", "/a", "Mailto:a"], U.is_followable("v")) == [
        False, False, False, False, True, True]
    assert column(spark, ["https://f.example/share?u=https://s.example/", "https://o.example/"],
                  U.same_site("v", "'s.example'")) == [True, False]
    assert column(spark, ["a#b", "a"], U.strip_fragment("v")) == ["a", "a"]


def test_loose_references_agree_with_the_standard_library(spark):
    texts = ["a &amp b", "&notit; &notin; &notin", "AT&T &copy2024&reg", "&#146;&#x80;&#129;", "&ampamp;", "&zzz; &zzz &", "&NotEqualTilde;", "&Aacute&aacutex"]
    assert column(spark, texts, M.html_unescape("v", "text")) == [unescape(t) for t in texts]
    links = ["?a=1&copy=2&lt=3", "?a&reg", "x&copyright y", "x&copy y", "?q=&amp;b&eacute;", "&notit;", "&notin;="]
    right = ["?a=1&copy=2&lt=3", "?a®", "x&copyright y", "x© y", "?q=&bé", "&notit;", "∉="]
    assert column(spark, links, M.html_unescape("v", "attribute")) == right


def test_unescape_agrees_with_the_standard_library(spark):
    texts = ["a &amp; b", "&lt;&gt;&quot;", "&nbsp;x", "&#8364;&#x20AC;", "&euro;&eacute;", "no entity", "&", "a&b;c", "&frac14;", "&#128512;"]
    assert column(spark, texts, M.html_unescape("v")) == [unescape(t) for t in texts]
    assert column(spark, ["&unknown; &#0; &#xD800; &#65 &amp"], M.html_unescape("v")) == ["&unknown;   A &amp"]


def test_attributes(spark):
    tags = ["<a class=x href='y'>", "<a title=\"class='no'\" CLASS = \"Yes > no\">", "<a data-class='n'>", "<a class>",
            "<a class=''>", "<br class=a/>", "<a class='1' class='2'>", '<a "stray" class="s&amp;t">', "<a classy='1'>"]
    assert column(spark, tags, M.attr("v", "class")) == ["x", "Yes > no", None, None, "", "a/", "1", "s&t", None]


def test_screening_text(spark):
    long_text = "word " * 60
    pages = ["<html><body><div id=root></div><script>" + long_text + "</script></body>", "<body>" + long_text + "</body>",
             "<body><h1>x</h1></body>", "no body", "<BODY>x", "<body><STYLE>" + long_text + "</STYLE>short"]
    assert column(spark, pages, M.is_csr_shell("v")) == [True, False, False, False, False, True]
    assert column(spark, ["x Just a moment y", "just a moment", "window.isBotPage=1"], M.is_challenge("v")) == [True, False, True]
    assert column(spark, ["<p>no</p><body a='1'> A <b>B</b>\n<script>x</script></body>"], M.visible_text("v")) == ["A B"]


def test_truthiness(spark):
    raw = ["null", '""', "0", "0.0", "false", "[]", "{}", '"0"', '" a "', "1", "1.0", "12.50", "true", "[1]", '{"a":1}', '" "']
    assert column(spark, raw, V.scalar_text("try_parse_json(v)")) == [
        None, None, None, None, None, None, None, "0", "a", "1", "1.0", "12.5", "True", "[1]", '{"a":1}', ""]


def test_markup_survives_long_input(spark):
    pages = ["<a " + "x='1' " * 60_000 + ">t</a>", "<script>" + "x" * 1_000_000, "<!--" + "y" * 1_000_000, "<p " + '"' * 100_001]
    assert column(spark, pages, M.count_tags(M.without_raw_blocks("v"), "h1")) == [0, 0, 0, 0]
    joined = column(spark, pages, f"array_join(regexp_extract_all(v, {chr(39)}{M.TOKEN.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}{chr(39)}, 0), '') = v")
    assert joined == [True] * 4


def test_padded_references_and_apostrophes(ev):
    assert ev(M.html_unescape("t"), t="O&apos;Neil &#00000065;&#x000041;") == "O'Neil AA"


def test_price_labels_are_plain(ev):
    for p, want in [(12500000.0, "$12500000.0"), (0.0005, "$0.0005"), (5.0, "$5.0"), (1e16, "$1e+16"), (0.00001, "$1e-05"), (19.99, "$19.99"), (0.0, "price on request")]:
        assert ev(S.price_label("CAST(t AS DOUBLE)"), t=repr(p)) == want
