"""Every registered query with the SQL that gives the same rows.

Queries read the given tables as they are, or pages and responses that Spark renders
from ``part`` (see ``render``); the SQL of the latter runs on ``part`` directly.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import render as R
from shelfscan import rules, schemas
from shelfscan.functions import markup as M
from shelfscan.functions import scalars as S
from shelfscan.functions import urls as U
from shelfscan.functions.sql import each, extract_all
from shelfscan.operators import catalogue as C
from shelfscan.operators import classify, discovery as D, extract as X, html as H, jsonld as J, screen
from shelfscan.operators.tree import page_nodes
from shelfscan.plans.catalogue import CatalogueRun, read_catalogues_of
from shelfscan.session import shared_folder, spread, stage
from shelfscan.sources.archive import open_responses, store_responses
from shelfscan.sources.catalogues import catalogue_filename, catalogue_lines, read_catalogues, write_catalogues, write_products
from shelfscan.sources.fetches import fetches_of_pages, parse_api_pages, read_pages, url_list_source
from shelfscan.sources.fetches import read_fetches as fetch_table
from shelfscan.sources.sites import clean_sites
from shelfscan.sources.sitemaps import parse_sitemaps, robots_sitemaps
from shelfscan.streaming.products import stream_products

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
READ_AT = datetime(2026, 1, 1)


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# -- pieces of SQL ------------------------------------------------------------


def strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


NETLOC = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
SITE_OF_PAGE = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
PATH = "lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1))"
EXT = f"regexp_extract({PATH}, '([.][^./]*)$', 1)"


def has_any(text: str, fragments) -> str:
    return "(" + " OR ".join(f"contains({text}, '{f}')" for f in fragments) + ")"


LIKELY = f"({EXT} NOT IN ({strings(rules.SKIP_EXTENSIONS)}) AND NOT {has_any(PATH, rules.SKIP_URL_FRAGMENTS)} AND {has_any(PATH, rules.PRODUCT_URL_SIGNALS)})"

SITE = "'https://www.shop' || split_part(p_brand, '#', 2) || '-' || CAST(p_partkey // 10000 AS VARCHAR) || '.example'"
PRICE = "CAST(printf('%.2f', p_retailprice) AS DOUBLE)"
# Parts with site, kind of site, number in the site and page URL.
PARTS = f"""
parts AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY p_partkey) - 1 AS rn,
         site || CASE WHEN kind = 3 THEN '/x/p/' ELSE '/products/' END || CAST(p_partkey AS VARCHAR) AS url
  FROM (SELECT *, {SITE} AS site, CAST(split_part(p_brand, '#', 2) AS INT) % 5 AS kind FROM part))"""

URL_TRAPS = [
    "/partner/", "/part/", "/blog/shop/", "/P/", "/a.b/product", "/x?q=/product/", "/teams-kit/", "/shop/f.PDF;v=",
    "/Catalogue/x.y/", "/login/item/", "/goods#/blog/",
]


def trap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, url): one URL per part, of several shapes."""
    traps = F.array(*[F.lit(t) for t in URL_TRAPS])
    trap = F.element_at(traps, (F.col("p_partkey") % len(URL_TRAPS) + 1).cast("int"))
    return R.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(R.site(), trap, F.col("p_partkey").cast("string")).alias("url")
    )


TRAPS = f"""traps AS (SELECT p_partkey, {SITE} || list_extract([{strings(URL_TRAPS)}], CAST(p_partkey % {len(URL_TRAPS)} + 1 AS INT)) || CAST(p_partkey AS VARCHAR) AS raw FROM part),
urls AS (SELECT p_partkey, raw AS url FROM traps)"""
TRAP_PATH = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), ';[^/]*$', '')"
TRAP_EXT = f"regexp_extract({TRAP_PATH}, '([.][^./]*)$', 1)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    R.prepare(spark)
    return read_pages(spark, f"{sf_dir}/pages.parquet")


# -- B: URLs ------------------------------------------------------------------


@query(f"SELECT DISTINCT {SITE_OF_PAGE} AS site FROM pages")
def read_sites(spark, sf_dir):
    return clean_sites(R.table(spark, sf_dir, "pages"), "url")


@query(f"SELECT page_id, {SITE_OF_PAGE} AS site FROM pages")
def normalise_site(spark, sf_dir):
    return R.table(spark, sf_dir, "pages").selectExpr("page_id", f"{U.normalise_site('url')} AS site")


@query(f"SELECT page_id, ltrim({NETLOC}, 'w.') AS domain FROM pages")
def site_domain(spark, sf_dir):
    return R.table(spark, sf_dir, "pages").selectExpr("page_id", f"{U.site_domain('url')} AS domain")


@query(f"SELECT page_id, ltrim({NETLOC}, 'w.') || '_catalogue.json' AS file FROM pages")
def catalogue_file(spark, sf_dir):
    return R.table(spark, sf_dir, "pages").selectExpr("page_id", f"{catalogue_filename('url')} AS file")


@query("SELECT page_id, split_part(url, '/', 3) AS rate_key, split_part(split_part(url, '//', 2), '/', 1) AS host, split_part(url, '#', 1) AS bare FROM pages")
def url_parts(spark, sf_dir):
    return R.table(spark, sf_dir, "pages").selectExpr(
        "page_id", f"{U.rate_key('url')} AS rate_key", f"{U.host_of('url')} AS host", f"{U.strip_fragment('url')} AS bare"
    )


@query(f"""WITH {TRAPS} SELECT p_partkey, {TRAP_EXT} AS ext, {TRAP_EXT} IN ({strings(rules.SKIP_EXTENSIONS)}) AS skip_ext,
{has_any(TRAP_PATH, rules.SKIP_URL_FRAGMENTS)} AS skip_fragment, {has_any(TRAP_PATH, rules.PRODUCT_URL_SIGNALS)} AS signal FROM urls""")
def url_rules(spark, sf_dir):
    return trap_urls(spark, sf_dir).selectExpr("p_partkey", f"{U.url_path('url')} AS path").selectExpr(
        "p_partkey", f"{U.url_extension('path')} AS ext", f"{U.has_skip_extension('path')} AS skip_ext",
        f"{U.has_skip_fragment('path')} AS skip_fragment", f"{U.has_product_signal('path')} AS signal",
    )


@query(f"""WITH {TRAPS} SELECT p_partkey, {TRAP_EXT} NOT IN ({strings(rules.SKIP_EXTENSIONS)}) AND NOT {has_any(TRAP_PATH, rules.SKIP_URL_FRAGMENTS)}
AND {has_any(TRAP_PATH, rules.PRODUCT_URL_SIGNALS)} AS likely FROM urls""")
def looks_like_product_url(spark, sf_dir):
    return trap_urls(spark, sf_dir).selectExpr("p_partkey", f"{U.looks_like_product_url('url')} AS likely")


HREFS = """hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"#\\s]{3,300})"', 1)) AS href,
  generate_subscripts(regexp_extract_all(html, 'href="([^"#\\s]{3,300})"', 1), 1) - 1 AS i FROM pages)"""


@query(f"""WITH {HREFS} SELECT page_id, CAST(i AS BIGINT) AS i, href NOT SIMILAR TO '(javascript|mailto|tel:|data:).*' AS followable,
{SITE_OF_PAGE} || href AS joined, contains({SITE_OF_PAGE} || href, {NETLOC}) AS same_site FROM hrefs""")
def url_join(spark, sf_dir):
    hrefs = R.table(spark, sf_dir, "pages").selectExpr(
        "page_id", f"{U.normalise_site('url')} AS base", f"posexplode({extract_all('html', rules.HREF, 1)}) AS (i, href)"
    )
    joined = hrefs.selectExpr("*", f"{U.url_join('base', 'href')} AS joined")
    return joined.selectExpr(
        "page_id", "CAST(i AS BIGINT) AS i", f"{U.is_followable('href')} AS followable", "joined",
        f"{U.same_site('joined', U.host_of('base'))} AS same_site",
    )


@query(f"""WITH {HREFS} SELECT page_id, {SITE_OF_PAGE} || href AS url, CAST(min(i) AS BIGINT) AS pos FROM hrefs
WHERE href NOT SIMILAR TO '(javascript|mailto|tel:|data:).*' GROUP BY ALL""")
def page_links(spark, sf_dir):
    at_home = pages(spark, sf_dir).selectExpr("page_id", f"{U.normalise_site('url')} AS site", "html")
    return D.page_links(at_home, ("page_id",))


# -- D: screening -------------------------------------------------------------

VISIBLE = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html[strpos(html, '<body'):], "
    "'<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
)


@query(f"SELECT page_id, {VISIBLE} AS visible FROM pages")
def visible_text(spark, sf_dir):
    return pages(spark, sf_dir).selectExpr("page_id", f"{M.visible_text('html')} AS visible")


@query(f"""SELECT page_id, {has_any('html', rules.CHALLENGE_MARKERS)} AS challenge,
NOT contains(html, '<h1') AND contains(html, '<body') AND length({VISIBLE}) < {rules.SHELL_TEXT_LIMIT} AS shell FROM pages""")
def screen_pages(spark, sf_dir):
    return pages(spark, sf_dir).selectExpr(
        "page_id", f"{M.is_challenge('html')} AS challenge", f"{M.is_csr_shell('html')} AS shell"
    )


@query(f"SELECT {SITE_OF_PAGE} AS site, url, CAST(200 AS INT) AS status, md5(html) AS body_hash FROM pages")
def read_fetches(spark, sf_dir):
    fetched = fetches_of_pages(R.table(spark, sf_dir, "pages"))
    return fetched.selectExpr("site", "url", "status", "md5(CAST(body AS BINARY)) AS body_hash")


@query(f"WITH {PARTS} SELECT site, url, CASE WHEN p_partkey % 10 = 9 THEN 2 ELSE 1 END AS attempts, CAST(200 AS INT) AS status, p_partkey % 7 = 6 AS drawn FROM parts")
def resolve_attempts(spark, sf_dir):
    resolved = screen.resolve_attempts(R.rendered_fetches(spark, sf_dir, with_docs=False, with_hidden=False))
    return resolved.selectExpr("site", "url", "attempts", "status", "rendered IS NOT NULL AS drawn")


@query(f"""WITH {PARTS}, wanted AS (
  SELECT site, url, p_partkey AS pos, CASE p_partkey % 7 WHEN 5 THEN 'challenge' WHEN 6 THEN 'shell' ELSE 'ok' END AS reason FROM parts
  UNION ALL SELECT 'https://supplier.example', 'https://supplier.example/' || CAST(s_suppkey AS VARCHAR), s_suppkey, 'not archived' FROM supplier)
SELECT site, url, pos, CASE reason WHEN 'ok' THEN 'accept' WHEN 'not archived' THEN 'missing' ELSE 'needs_render' END AS route, reason,
  reason IN ('ok', 'shell') AS readable FROM wanted""")
def page_routes(spark, sf_dir):
    fetches = R.rendered_fetches(spark, sf_dir, with_docs=False, with_hidden=False)
    screened = screen.screen_responses(screen.resolve_attempts(fetches))
    known = R.site_parts(spark, sf_dir).selectExpr("site", "url", "p_partkey AS pos")
    unknown = R.table(spark, sf_dir, "supplier").selectExpr(
        "'https://supplier.example' AS site", "concat('https://supplier.example/', s_suppkey) AS url", "s_suppkey AS pos"
    )
    routes = screen.page_routes(known.unionByName(unknown).selectExpr("*", "0 AS hop"), screened)
    return routes.selectExpr("site", "url", "pos", "route", "reason", "html IS NOT NULL AS readable")


ROUTES = ORACLES["page_routes"]


@query(ROUTES)
def archive_routes(spark, sf_dir):
    """The same routes from a stored archive, where bodies are read by pointers and never shuffled."""
    stored = store_responses(R.rendered_fetches(spark, sf_dir, with_docs=False, with_hidden=False))
    known = R.site_parts(spark, sf_dir).selectExpr("site", "url", "p_partkey AS pos")
    unknown = R.table(spark, sf_dir, "supplier").selectExpr(
        "'https://supplier.example' AS site", "concat('https://supplier.example/', s_suppkey) AS url", "s_suppkey AS pos"
    )
    routes = stage(stored.routes(known.unionByName(unknown)), "archive-routes")
    read = stored.read(routes.select("site", "url", "at"), "at").selectExpr("site", "url", "length(html) > 0 AS found")
    return routes.join(read, ["site", "url"], "left").selectExpr("site", "url", "pos", "route", "reason", "coalesce(found, false) AS readable")


@query(f"""WITH {PARTS} SELECT site, url, CASE WHEN p_partkey % 10 = 9 THEN 2 ELSE 1 END AS attempts, CAST(200 AS INT) AS status, p_partkey % 7 = 6 AS drawn,
CASE p_partkey % 7 WHEN 5 THEN 'challenge' WHEN 6 THEN 'shell' ELSE 'ok' END AS reason, 'page' AS role FROM parts""")
def archive_runs(spark, sf_dir):
    """Responses that arrive in three runs, opened again as one archive."""
    fetches = R.rendered_fetches(spark, sf_dir, with_docs=False, with_hidden=False)
    folder, buckets = _folder(spark, "archive"), 8
    for i in range(3):
        store_responses(fetches.filter(f"pmod(hash(url, attempt, via), 3) = {i}"), folder, buckets, run=i)
    return open_responses(spark, folder, buckets).chosen.selectExpr("site", "url", "attempts", "status", "seen IS NOT NULL AS drawn", "reason", "role")


# -- E: HTML as tables --------------------------------------------------------

PAGE_TOKENS = r"<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<[!/]?[a-zA-Z][^>]*>|[^<]+"


@query(f"""SELECT page_id, CAST(i - 1 AS INT) AS pos, tok, CASE WHEN tok LIKE '<!--%' THEN 'comment' WHEN tok LIKE '<!%' THEN 'doctype'
WHEN tok LIKE '</%' THEN 'close' WHEN tok SIMILAR TO '<(script|style).*' THEN 'raw' WHEN tok SIMILAR TO '<(meta|br)\\b.*' THEN 'void' WHEN tok LIKE '<%' THEN 'open' ELSE 'text' END AS kind
FROM (SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '{PAGE_TOKENS}', 0, 's') AS t FROM pages))""")
def html_tokens(spark, sf_dir):
    return H.html_tokens(pages(spark, sf_dir)).select("page_id", "pos", "tok", "kind")


DECODED = "trim(replace(replace(replace(replace({}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'))"


@query(f"SELECT page_id, {DECODED.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS text FROM pages")
def first_h1(spark, sf_dir):
    return H.element_texts(pages(spark, sf_dir), "tag = 'h1'").select("page_id", "text")


@query(f"""SELECT page_id, tag, {DECODED.format('raw')} AS text FROM (
  SELECT page_id, 'a' AS tag, unnest(regexp_extract_all(html, '<a href="[^"]*">(.*?)</a>', 1)) AS raw FROM pages
  UNION ALL SELECT page_id, 'li', unnest(regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a></li>', 1)) FROM pages
  UNION ALL SELECT page_id, 'title', regexp_extract(html, '<title>(.*?)</title>', 1) FROM pages)""")
def html_elements(spark, sf_dir):
    return H.element_texts(pages(spark, sf_dir), "tag IN ('a', 'li', 'title')").select("page_id", "tag", "text")


@query("""SELECT p_partkey AS page_id, cell, CAST(n AS BIGINT) AS n FROM part, LATERAL (VALUES
 (1, 'Size'), (2, CAST(p_size AS VARCHAR)), (3, 'Type'), (4, p_type), (5, 'a'), (6, 'b'), (7, 'c'), (8, 'SKU:'), (9, 'H-' || CAST(p_partkey AS VARCHAR)), (10, 'Colour'), (11, 'red'),
 (12, p_brand), (13, 'two')) t(k, cell), LATERAL (SELECT CASE WHEN k <= 7 THEN k + 6 WHEN k <= 11 THEN k - 7 ELSE k - 7 END AS n)""")
def implied_end_tags(spark, sf_dir):
    """Cells, definitions and list items whose end tags are left out, numbered in page order."""
    found = R.rendered_pages(spark, sf_dir, only="structure")
    texts = H.element_texts(found, "tag IN ('td', 'th', 'dt', 'dd', 'li')", key="page_id")
    numbered = texts.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return numbered.selectExpr("page_id", "posexplode(t.text) AS (i, cell)").selectExpr(
        "page_id", "cell", "CAST(i + 1 AS BIGINT) AS n"
    )


REFERENCE_ROWS = ", ".join("({}, {})".format(i, strings([name, html5[name]])) for i, name in enumerate(R.REFERENCES))


@query(f"""WITH names(i, name, c) AS (VALUES {REFERENCE_ROWS}), named AS (SELECT p_partkey, name, c, ends_with(name, ';') AS whole
 FROM part, LATERAL (VALUES (2 * p_partkey), (2 * p_partkey + 1)) t(n), names WHERE i = n % {len(R.REFERENCES)})
SELECT p_partkey AS page_id, name, 'a ' || c || ' b y' || c || 'zq9' AS text, 'a ' || c || ' b|y' || c || 'zq9' AS nodes, c || ' x' AS titled,
CASE WHEN whole THEN 'q' || c || '=1' || c || 'zq9' ELSE 'q&' || name || '=1&' || name || 'zq9' END AS run_on FROM named""")
def character_references(spark, sf_dir):
    """Every name of a character reference, in text (by expression and by tree) and in attributes."""
    pages = R.reference_pages(spark, sf_dir).withColumn("nodes", page_nodes())
    tag = "regexp_extract(html, '(<{}[^>]*>)', 1)"
    return pages.selectExpr(
        "page_id", "name", f"{M.page_text('html')} AS text", "array_join(nodes.texts.txt, '|') AS nodes",
        f"{M.attr(tag.format('p'), 'title')} AS titled", f"{M.attr(tag.format('i'), 'title')} AS run_on",
    )


@query("""SELECT p_partkey AS page_id, tag, text, count(*) AS n FROM part, LATERAL (VALUES ('div', p_name || p_type || 'xy'), ('b', p_name || p_type), ('i', p_type),
 ('p', 'a'), ('ul', p_brand), ('li', p_brand), ('td', 'k' || 'v' || CAST(p_size AS VARCHAR) || 'z'), ('p', 'v' || CAST(p_size AS VARCHAR) || 'z'), ('td', 'w' || p_brand),
 ('h2', 'open' || CAST(p_partkey AS VARCHAR)), ('em', CAST(p_partkey AS VARCHAR)), ('h3', 'lastq'), ('td', p_brand)) t(tag, text) WHERE true GROUP BY ALL""")
def crosswise_elements(spark, sf_dir):
    """Elements closed crosswise, by their parents' end, by what cannot stand in them, or not at all."""
    texts = H.element_texts(R.crosswise_pages(spark, sf_dir), "tag IN ('div', 'b', 'i', 'p', 'ul', 'li', 'td', 'h2', 'em', 'h3')", key="page_id")
    return texts.groupBy("page_id", "tag", "text").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS page_id, 'N' || CAST(p_partkey AS VARCHAR) AS sku, 'a=' || p_type || ';b=' || p_brand || ';c=out;d=' || CAST(p_size AS VARCHAR) || ';e=late' AS specs FROM part""")
def nested_structure(spark, sf_dir):
    """Labels beside and around their values, the first ones too long; tables within tables, the inner ones counting."""
    found = X.extract_products(R.nested_pages(spark, sf_dir), keep=("page_id",))
    return found.selectExpr("page_id", "sku", f"{specs_text()} AS specs")


@query("""SELECT p_partkey AS page_id, p_name AS title, 'og:Product' AS type, 'https://img.example/' || CAST(p_partkey AS VARCHAR) || '.jpg?a=1&b=2' AS image,
'EUR' AS currency, 'A > ' || p_type AS about, printf('%.2f', p_retailprice) AS price, p_brand AS brand, 'M-' || CAST(p_partkey AS VARCHAR) AS sku,
CAST(NULL AS VARCHAR) AS availability, 'Heading' AS h1 FROM part""")
def page_meta(spark, sf_dir):
    trees = H.page_trees(R.rendered_pages(spark, sf_dir, only="meta"))
    return trees.selectExpr(
        "page_id", f"{X.meta_value('og:title')} AS title", f"{X.meta_value('og:type')} AS type", f"{X.meta_value('og:image')} AS image",
        f"{X.meta_value('product:price:currency')} AS currency", f"{X.meta_value('og:description')} AS about",
        f"{X.itemprop_value('price')} AS price", f"{X.itemprop_value('brand')} AS brand", f"{X.itemprop_value('sku')} AS sku",
        f"{X.itemprop_value('availability')} AS availability", f"{X.first_h1()} AS h1",
    )


@query("""SELECT p_partkey AS page_id, CAST(2 AS INT) AS n_blocks, CAST(CASE p_size % 3 WHEN 2 THEN 1 ELSE 2 END AS INT) AS n_items, CAST(1 AS INT) AS n_products FROM part""")
def ld_items(spark, sf_dir):
    found = R.rendered_pages(spark, sf_dir, only="jsonld")
    return found.selectExpr(
        "page_id", f"size({J.ld_json_blocks('html')}) AS n_blocks", f"size({J.page_ld_items('html')}) AS n_items",
        f"size({J.ld_products('html')}) AS n_products",
    )


# -- F: classification --------------------------------------------------------


@query("""SELECT p_partkey AS page_id, list_extract(['ld_product', 'og_product', 'sku_label', 'listing', 'none', 'none', 'none'], CAST(p_partkey % 7 + 1 AS INT)) AS rule, p_partkey % 7 < 3 AS is_product FROM part
UNION ALL SELECT -1 - page_id, 'none', false FROM pages""")
def classify_pages(spark, sf_dir):
    rendered = R.rendered_pages(spark, sf_dir).select("page_id", "html")
    given = pages(spark, sf_dir).selectExpr("-1 - page_id AS page_id", "html")
    return classify.classify_pages(rendered.unionByName(given))


@query("""SELECT p_partkey AS page_id, k = 0 AS ld_product, k = 1 AS og_product, CAST(CASE WHEN k < 2 THEN NULL WHEN k = 3 THEN 2 WHEN k = 6 THEN 0 ELSE 1 END AS INT) AS n_h1,
CAST(CASE WHEN k < 2 THEN NULL WHEN k = 2 THEN 2 WHEN k = 3 THEN 6 ELSE 0 END AS INT) AS n_price_el, k = 3 AS is_listing, k = 2 AS has_sku_label
FROM (SELECT p_partkey, p_partkey % 7 AS k FROM part)""")
def page_signals(spark, sf_dir):
    rendered = R.rendered_pages(spark, sf_dir).select("page_id", "html")
    return classify.page_signals(rendered).select(
        "page_id", "ld_product", "og_product", "n_h1", "n_price_el", "is_listing", "has_sku_label"
    )


OFFERED = list(R.OFFERS)


@query(f"""SELECT p_partkey AS page_id, list_extract([{strings(R.OFFERS[k][1] for k in OFFERED)}], CAST(k + 1 AS INT)) AS rule,
list_extract([{strings(R.OFFERS[k][1] for k in OFFERED)}], CAST(k + 1 AS INT)) IN ('offer', 'spec_table', 'sku_label') AS is_product,
list_extract([{strings(R.OFFERS[k][1] for k in OFFERED)}], CAST(k + 1 AS INT)) = 'offer' AS has_offer,
list_extract([{strings(R.OFFERS[k][1] for k in OFFERED)}], CAST(k + 1 AS INT)) = 'spec_table' AS has_table FROM (SELECT p_partkey, p_partkey % {len(OFFERED)} AS k FROM part)""")
def offer_pages(spark, sf_dir):
    """Pages that only offer language or a table tells from others, with one heading, with several, and as listings."""
    return classify.page_signals(R.offer_pages(spark, sf_dir)).select("page_id", "rule", "is_product", "has_offer", "has_table")


# -- G: extraction ------------------------------------------------------------


def specs_text(specs: str = "specs") -> str:
    """Specs as one text, keys sorted, so that engines without the map type can compare."""
    return f"array_join(array_sort({each(f'map_entries({specs})', lambda e: f"concat({e}.key, '=', {e}.value)")}), ';')"


FIELDS = [c for c in schemas.PRODUCT_COLUMNS if c not in ("specs", "variants")]


def product_columns(*keys: str) -> list[str]:
    return [*keys, "strategy", *FIELDS, f"{specs_text()} AS specs", "size(variants) AS n_variants"]


def product_sql(template: str, url: str, key: str = "p_partkey") -> str:
    """Select list for the product of one template, over ``part``."""
    k = "CAST(p_partkey AS VARCHAR)"
    values = {
        "jsonld": {
            "id": f"'P-' || {k}", "name": "p_name", "brand": "p_brand", "sku": f"'P-' || {k}", "price": PRICE,
            "listPrice": "CAST(printf('%.2f', p_retailprice * 2) AS DOUBLE)", "currency": "'USD'",
            "availability": "CASE WHEN p_size % 2 = 0 THEN 'in_stock' ELSE 'out_of_stock' END",
            "image": f"'https://img.example/' || {k} || '.jpg'", "description": "'A ' || p_type || ' part'",
            "specs": "'Size=' || CAST(p_size AS VARCHAR) || ';Type=' || p_type",
        },
        "meta": {
            "id": f"'M-' || {k}", "name": "p_name", "brand": "p_brand", "sku": f"'M-' || {k}", "price": PRICE,
            "listPrice": "CAST(NULL AS DOUBLE)", "currency": "'EUR'", "availability": "'in_stock'",
            "image": f"'https://img.example/' || {k} || '.jpg?a=1&b=2'", "description": "'A > ' || p_type", "specs": "''",
        },
        "heuristic": {
            "id": f"'H-' || {k}", "name": "p_name || p_type", "brand": "p_brand", "sku": f"'H-' || {k}", "price": PRICE,
            "listPrice": "CAST(NULL AS DOUBLE)", "currency": "'USD'",
            "availability": "CASE WHEN p_size % 2 = 0 THEN 'in_stock' ELSE 'out_of_stock' END",
            "image": f"'/product/' || {k} || '.png'", "description": "'About the' || p_type || 'part'",
            "specs": f"'Colour=red;SKU:=H-' || {k} || ';Size=' || CAST(p_size AS VARCHAR) || ';Type=' || p_type",
        },
    }[template]
    listed = ", ".join(f"{v} AS {'\"listPrice\"' if n == 'listPrice' else n}" for n, v in values.items())
    return f"{key}, '{template}' AS strategy, {url} AS url, {listed}, CAST(0 AS INT) AS n_variants"


PLAIN_URL = f"{SITE} || '/products/' || CAST(p_partkey AS VARCHAR)"


def one_template(template: str) -> Query:
    def run(spark, sf_dir):
        found = X.extract_products(R.rendered_pages(spark, sf_dir, only=template), keep=("page_id",))
        return found.selectExpr(*product_columns("page_id"))

    return run


for _name, _template, _strategy in [
    ("jsonld_products", "jsonld", "jsonld"),
    ("meta_products", "meta", "meta"),
    ("structure_products", "structure", "heuristic"),
]:
    QUERIES[_name] = one_template(_template)
    ORACLES[_name] = f"SELECT {product_sql(_strategy, PLAIN_URL, 'p_partkey AS page_id')} FROM part"


@query(" UNION ALL ".join(
    f"SELECT {product_sql(t, PLAIN_URL, 'p_partkey AS page_id')} FROM part WHERE p_partkey % 7 = {k}"
    for k, t in enumerate(["jsonld", "meta", "heuristic"])
))
def extract_products(spark, sf_dir):
    """All templates mixed: each page by its first strategy that works, other pages give nothing."""
    found = X.extract_products(R.rendered_pages(spark, sf_dir), keep=("page_id",))
    return found.selectExpr(*product_columns("page_id"))


@query("SELECT page_id, CAST(0 AS BIGINT) AS n_products FROM pages")
def articles_hold_no_product(spark, sf_dir):
    """The given pages are articles: a negative control for the whole extraction."""
    given = pages(spark, sf_dir)
    made = X.extract_products(given, keep=("page_id",)).groupBy("page_id").agg(F.count("*").alias("n"))
    return given.select("page_id").join(made, "page_id", "left").selectExpr("page_id", "coalesce(n, 0L) AS n_products")


# -- H: scalars ---------------------------------------------------------------

PRICE_SHAPES = "CASE p_partkey % 5 WHEN 0 THEN '$' || {0} WHEN 1 THEN 'from ' || {0} || ' - 20' WHEN 2 THEN '-' || {0} WHEN 3 THEN 'call' ELSE {0} || ' EUR' END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 <> 3 THEN {PRICE} END AS price FROM part")
def parse_price(spark, sf_dir):
    raw = PRICE_SHAPES.format("format_string('%,.2f', p_retailprice)")
    return R.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{raw} AS raw").selectExpr("p_partkey", f"{S.parse_price('raw')} AS price")


AVAILABLE = list(rules.AVAILABILITY) + ["discontinued", "backorder"]


@query(f"""SELECT p_partkey, CASE WHEN k < {len(rules.AVAILABILITY)} THEN list_extract([{strings(rules.AVAILABILITY.values())}], CAST(k + 1 AS INT)) ELSE 'unknown' END AS availability
FROM (SELECT p_partkey, p_partkey % {len(AVAILABLE)} AS k FROM part)""")
def normalise_availability(spark, sf_dir):
    raw = f"concat(' ', upper(element_at(array({strings(AVAILABLE)}), CAST(p_partkey % {len(AVAILABLE)} + 1 AS INT))), '\\t')"
    return R.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{raw} AS raw").selectExpr(
        "p_partkey", f"{S.normalise_availability('raw')} AS availability"
    )


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'A' || CAST(page_id AS VARCHAR) ELSE md5(url)[:16] END AS id FROM pages")
def make_product_id(spark, sf_dir):
    pid = "CASE page_id % 3 WHEN 0 THEN concat(' A', page_id, ' ') WHEN 1 THEN ' \\n' END"
    return R.table(spark, sf_dir, "pages").selectExpr("page_id", f"{S.make_product_id(pid, 'url')} AS id")


@query("""SELECT doc_id, CASE WHEN contains(text, '$') THEN 'USD' WHEN contains(text, '£') THEN 'GBP' WHEN contains(text, '€') THEN 'EUR' WHEN contains(text, '¥') THEN 'JPY'
WHEN contains(text, '₹') THEN 'INR' END AS currency, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS stripped FROM documents""")
def document_texts(spark, sf_dir):
    """Currency sign and blank trimming over whole texts."""
    return R.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{S.currency_of('text')} AS currency", f"{S.py_strip('text')} AS stripped"
    )


@query(f"SELECT p_partkey, CASE WHEN p_size = 1 OR p_size = 2 THEN 'price on request' ELSE '$' || CAST(CAST(p_retailprice AS DOUBLE) AS VARCHAR) END AS label FROM part")
def price_label(spark, sf_dir):
    price = "CASE p_size WHEN 1 THEN 0D WHEN 2 THEN NULL ELSE p_retailprice END"
    return R.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{S.price_label(price)} AS label")


# -- C: discovery -------------------------------------------------------------


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened discovery documents of all rendered sites."""
    fetches = R.rendered_fetches(spark, sf_dir, with_pages=False)
    return stage(screen.screen_responses(screen.resolve_attempts(fetches)), "archive", partition_by=("role",))


@query(f"SELECT DISTINCT {SITE} AS site, {SITE} || '/maps/all.xml' AS url FROM part WHERE CAST(split_part(p_brand, '#', 2) AS INT) % 5 = 1")
def robots_entries(spark, sf_dir):
    return robots_sitemaps(archive(spark, sf_dir)).select("site", "url")


@query(f"""WITH s AS (SELECT DISTINCT {SITE} AS site, CAST(split_part(p_brand, '#', 2) AS INT) % 5 AS kind FROM part)
SELECT site, site || unnest([{strings(rules.SITEMAP_PATHS)}]) AS url, unnest(range({len(rules.SITEMAP_PATHS)})) + {D.AFTER_ROBOTS} AS pos FROM s
UNION ALL SELECT site, site || '/maps/all.xml', 1 FROM s WHERE kind = 1""")
def sitemap_entry_points(spark, sf_dir):
    return D.sitemap_entry_points(R.rendered_sites(spark, sf_dir), archive(spark, sf_dir))


@query(f"""WITH {PARTS} SELECT DISTINCT site, site || '/maps/' || CAST(rn // 30 AS VARCHAR) || '.xml' AS url, CAST(0 AS INT) AS children,
  CAST(count(*) OVER (PARTITION BY site, rn // 30) AS INT) AS locs FROM parts WHERE kind = 1
UNION ALL SELECT site, site || '/maps/all.xml', CAST(2 + max(rn) // 30 AS INT), 0 FROM parts WHERE kind = 1 GROUP BY site
UNION ALL SELECT DISTINCT site, site || '/xmlsitemap.php?type=products&page=' || CAST(rn // 20 + 1 AS VARCHAR), 0, CAST(count(*) OVER (PARTITION BY site, rn // 20) AS INT) FROM parts WHERE kind = 2""")
def sitemap_documents(spark, sf_dir):
    return parse_sitemaps(archive(spark, sf_dir)).selectExpr("site", "url", "size(children) AS children", "size(locs) AS locs")


@query(f"""WITH {PARTS}, maps AS (SELECT DISTINCT site, rn // 30 AS n FROM parts WHERE kind = 1)
SELECT site, site || '/maps/' || CAST(n AS VARCHAR) || '.xml' AS url, '1.' || CAST(n + 1 AS VARCHAR) AS path FROM maps
UNION ALL SELECT DISTINCT site, site || '/maps/all.xml', '1' FROM maps
UNION ALL SELECT site, site || p, CAST({D.AFTER_ROBOTS} + i AS VARCHAR) FROM (SELECT site, unnest([{strings(rules.SITEMAP_PATHS)}]) AS p, unnest(range({len(rules.SITEMAP_PATHS)})) AS i FROM (SELECT DISTINCT site FROM parts))""")
def expand_sitemaps(spark, sf_dir):
    found = archive(spark, sf_dir)
    walk = D.expand_sitemaps(D.sitemap_entry_points(R.rendered_sites(spark, sf_dir), found), parse_sitemaps(found))
    return walk.selectExpr("site", "url", "array_join(path, '.') AS path")


@query(f"WITH {PARTS} SELECT site, url, CASE kind WHEN 1 THEN 'general' ELSE 'product' END AS kind, CAST(rn AS BIGINT) AS pos FROM parts WHERE kind IN (1, 2)")
def sitemap_urls(spark, sf_dir):
    return D.sitemap_urls(R.rendered_sites(spark, sf_dir), archive(spark, sf_dir)).select("site", "url", "kind", "pos")


@query(f"""WITH {PARTS} SELECT DISTINCT site, site || '/maps/' || CAST(rn // 30 AS VARCHAR) || '.xml' AS url, CAST(30 * (rn // 30) AS BIGINT) AS pos0 FROM parts WHERE kind = 1 AND 30 * (rn // 30) < 45""")
def visit_budget(spark, sf_dir):
    """Sitemaps that are read until 45 URLs of a site are known."""
    found = archive(spark, sf_dir)
    documents = parse_sitemaps(found)
    walk = D.expand_sitemaps(D.sitemap_entry_points(R.rendered_sites(spark, sf_dir), found), documents)
    counted = walk.join(documents.selectExpr("site", "url", "CAST(size(locs) AS BIGINT) AS n"), ["site", "url"])
    return D.visit_budget(counted.filter("contains(url, '/maps/')"), 45)


@query(f"WITH {PARTS} SELECT site, url, CASE kind WHEN 1 THEN 'general' ELSE 'product' END AS kind, CAST(rn AS BIGINT) AS pos FROM parts WHERE kind IN (1, 2) AND rn < 45")
def sitemap_urls_within(spark, sf_dir):
    """The first 45 URLs of a site and kind."""
    return D.sitemap_urls(R.rendered_sites(spark, sf_dir), archive(spark, sf_dir), 45).select("site", "url", "kind", "pos")


@query(f"WITH {PARTS} SELECT site, CAST(rn // 100 + 1 AS BIGINT) AS page, CAST(count(*) AS INT) AS n_items, CAST(count(*) AS INT) AS n_links FROM parts WHERE kind = 0 GROUP BY ALL")
def api_pages(spark, sf_dir):
    lists = archive(spark, sf_dir).filter("contains(url, '/api/products')")
    return parse_api_pages(lists).selectExpr(
        "site", "CAST(split_part(url, 'page=', 2) AS BIGINT) AS page", "size(items) AS n_items", "size(links) AS n_links"
    )


@query(f"WITH {PARTS} SELECT site, url, 'product' AS kind, 'generic-api' AS source, CAST(rn AS BIGINT) AS pos FROM parts WHERE kind = 0")
def api_product_urls(spark, sf_dir):
    return D.api_product_urls(archive(spark, sf_dir))


@query(f"WITH {PARTS} SELECT site, url, CAST(rn AS BIGINT) AS pos FROM parts")
def url_list_source_rows(spark, sf_dir):
    """URL lists in three shapes, one list per site."""
    parts = R.site_parts(spark, sf_dir)
    urls = parts.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("rn", "url"))).alias("u"))
    listed = "to_json(u.url)"
    body = (
        f"CASE length(site) % 3 WHEN 0 THEN concat('{{\"links\":[],\"urls\":', {listed}, '}}') "
        f"WHEN 1 THEN concat('{{\"links\":', {listed}, '}}') ELSE {listed} END"
    )
    return url_list_source(urls.selectExpr("site", f"{body} AS body"))


@query(f"WITH {PARTS} SELECT DISTINCT site, site || '/group/c/' || CAST(rn // 40 AS VARCHAR) AS url FROM parts WHERE kind = 3")
def category_links(spark, sf_dir):
    return D.category_links(D.home_pages(archive(spark, sf_dir)))


# Categories are read in the order of their URLs, so category 10 comes before 2.
@query(f"""WITH {PARTS} SELECT site, url, 'product' AS kind,
row_number() OVER (PARTITION BY site ORDER BY CAST(rn // 40 AS VARCHAR), rn) - 1 AS pos FROM parts WHERE kind = 3""")
def category_product_urls(spark, sf_dir):
    found = archive(spark, sf_dir)
    return D.category_product_urls(D.category_links(D.home_pages(found)), found).select("site", "url", "kind", "pos")


NAV = f"""hubs AS (SELECT DISTINCT site, rn % 10 AS h FROM parts WHERE kind = 4),
nav AS (SELECT site, site || '/hub/' || CAST(h AS VARCHAR) AS url, h AS pos FROM hubs
  UNION ALL SELECT site, url, (SELECT count(*) FROM hubs WHERE hubs.site = p.site) + row_number() OVER (PARTITION BY site ORDER BY rn % 10, rn) - 1 FROM parts p WHERE kind = 4)"""


@query(f"WITH {PARTS}, {NAV} SELECT site, url, CAST(pos AS BIGINT) AS pos FROM nav")
def nav_expand(spark, sf_dir):
    found = archive(spark, sf_dir)
    links = D.nav_expand(D.home_links(found), found)
    # Category shops have a home page as well; their links are another query's subject.
    return links.join(R.site_parts(spark, sf_dir).filter("kind = 'links'").select("site").distinct(), "site", "left_semi")


DISCOVERED = f"""{PARTS}, {NAV}, found AS (SELECT site, url, CASE WHEN kind IN (0, 2, 3) THEN 'product' ELSE 'general' END AS kind,
  list_extract(['generic-api', 'sitemap', 'sitemap', 'categories'], CAST(kind + 1 AS INT)) AS source FROM parts WHERE kind < 4
  UNION ALL SELECT site, url, 'general', 'links' FROM nav)"""


@query(f"WITH {DISCOVERED} SELECT * FROM found")
def discovery_ladder(spark, sf_dir):
    from shelfscan.plans.catalogue import discover_urls

    stored = store_responses(R.rendered_fetches(spark, sf_dir, with_pages=False))
    return discover_urls(R.rendered_sites(spark, sf_dir), stored).select("site", "url", "kind", "source")


@query(f"SELECT site, url, pos FROM (SELECT {SITE_OF_PAGE} AS site, url, page_id AS pos, row_number() OVER (PARTITION BY {SITE_OF_PAGE} ORDER BY page_id) AS rn FROM pages) WHERE rn <= 5")
def cap_per_site(spark, sf_dir):
    urls = R.table(spark, sf_dir, "pages").selectExpr(f"{U.normalise_site('url')} AS site", "url", "page_id AS pos")
    return D.cap_per_site(urls, 5)


@query("SELECT CAST(o_custkey AS VARCHAR) AS site, CAST(o_orderkey AS VARCHAR) AS url, o_orderkey AS pos FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3")
def cap_per_customer(spark, sf_dir):
    """The same cut on a large table: the first three orders of every customer."""
    rows = R.table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS site", "CAST(o_orderkey AS STRING) AS url", "o_orderkey AS pos"
    )
    return D.cap_per_site(rows, 3)


@query("SELECT CAST(l_partkey AS VARCHAR) AS site, CAST(l_suppkey AS VARCHAR) AS url, CAST(min(l_orderkey) AS BIGINT) AS pos, CAST(0 AS INT) AS hop FROM lineitem GROUP BY 1, 2")
def dedupe_candidates(spark, sf_dir):
    rows = R.table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_partkey AS STRING) AS site", "CAST(l_suppkey AS STRING) AS url", "CAST(l_orderkey AS BIGINT) AS pos"
    )
    return D.dedupe_candidates(rows)


@query(f"""WITH {TRAPS}, marked AS (SELECT p_partkey, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, p_partkey % 401 = 0 AS is_product,
 {TRAP_EXT} NOT IN ({strings(rules.SKIP_EXTENSIONS)}) AND NOT {has_any(TRAP_PATH, rules.SKIP_URL_FRAGMENTS)} AND {has_any(TRAP_PATH, rules.PRODUCT_URL_SIGNALS)} AS likely FROM urls),
facts AS (SELECT site, count(*) FILTER (is_product) AS n_product, count(*) FILTER (likely AND NOT is_product) AS n_likely FROM marked GROUP BY site)
SELECT site, url, p_partkey AS pos FROM marked JOIN facts USING (site) WHERE CASE WHEN n_product > 0 THEN is_product WHEN n_likely >= 5 THEN likely ELSE true END""")
def select_candidates(spark, sf_dir):
    urls = trap_urls(spark, sf_dir).selectExpr(
        f"{U.normalise_site('url')} AS site", "url", "if(p_partkey % 401 = 0, 'product', 'general') AS kind", "p_partkey AS pos"
    )
    return D.select_candidates(urls)


HIDDEN_URL = f"{SITE} || '/products/hidden-' || CAST(p_partkey AS VARCHAR)"


@query(f"SELECT p_partkey AS page_id, {HIDDEN_URL} AS link, CAST(0 AS BIGINT) AS i FROM part")
def embedded_product_urls(spark, sf_dir):
    return D.embedded_product_urls(R.rendered_pages(spark, sf_dir, only="listing"), ("page_id",))


@query(f"SELECT {SITE} AS site, {HIDDEN_URL} AS url, p_partkey AS pos, CAST(1 AS INT) AS hop FROM part WHERE p_partkey % 2 = 1")
def second_hop(spark, sf_dir):
    """Half of the embedded URLs are candidates already."""
    listings = R.rendered_pages(spark, sf_dir, only="listing").selectExpr("site", "url", "page_id AS pos", "html")
    known = R.site_parts(spark, sf_dir).filter("p_partkey % 2 = 0").selectExpr(
        "site", "concat(site, '/products/hidden-', p_partkey) AS url"
    )
    return D.second_hop(listings, known)


@query(f"WITH {PARTS} SELECT site, url, 'candidate' AS wanted_by FROM parts WHERE p_partkey % 3 = 0")
def frontier(spark, sf_dir):
    parts = R.site_parts(spark, sf_dir)
    return D.frontier(parts.selectExpr("site", "url", "'candidate' AS wanted_by"), parts.filter("p_partkey % 3 <> 0"))


# -- I: catalogues ------------------------------------------------------------


def run_all(spark: SparkSession, sf_dir: str) -> CatalogueRun:
    return read_catalogues_of(R.rendered_sites(spark, sf_dir), R.rendered_fetches(spark, sf_dir), READ_AT)


def _final(hop: int, template: str, ks: str, url: str) -> str:
    return f"SELECT site, {hop} AS hop, {product_sql(template, url, 'p_partkey')} FROM parts WHERE p_partkey % 7 IN ({ks})"


FINAL = f"""{PARTS}, products AS ({_final(0, 'jsonld', '0', 'parts.url')} UNION ALL {_final(0, 'meta', '1', 'parts.url')}
UNION ALL {_final(0, 'heuristic', '2, 6', 'parts.url')} UNION ALL {_final(1, 'jsonld', '3', HIDDEN_URL)})"""


@query(f"WITH {FINAL} SELECT * EXCLUDE (p_partkey) FROM products")
def catalogue_products(spark, sf_dir):
    """The whole way from an archive to products: discovery, screening, two hops, three strategies."""
    return run_all(spark, sf_dir).products.selectExpr(*product_columns("site", "hop"))


STOCK = "availability = 'in_stock' AND price IS NOT NULL"


@query(f"WITH {FINAL} SELECT site, count(*) AS n_products, sum(CAST({STOCK} AS INT))::BIGINT AS n_in_stock, round(sum(CASE WHEN {STOCK} THEN price END), 2) AS stock_value, count(DISTINCT strategy) AS n_strategies FROM products GROUP BY site")
def catalogue_stock(spark, sf_dir):
    """Of each catalogue: products, those in stock with a price, and their value."""
    rows = run_all(spark, sf_dir).catalogues.selectExpr("site", "explode(products) AS p")
    kinds = F.countDistinct(F.substring("p.id", 1, 1)).alias("n_strategies")
    stock = F.expr("p.availability = 'in_stock' AND p.price IS NOT NULL")
    return rows.groupBy("site").agg(
        F.count("*").alias("n_products"),
        F.count_if(stock).alias("n_in_stock"),
        F.round(F.sum(F.when(stock, F.col("p.price"))), 2).alias("stock_value"),
        kinds,
    )


@query(f"""WITH {FINAL} SELECT site, true AS complete, CAST(NULL AS VARCHAR) AS reason, 'complete' AS status, count(*) AS n_products FROM products GROUP BY site
UNION ALL SELECT 'https://empty.example', false, '{rules.REASON_NO_URLS}', 'no_sitemap', 0""")
def discovery_status(spark, sf_dir):
    empty = spark.range(1).selectExpr("'https://empty.example' AS site")
    run = read_catalogues_of(R.rendered_sites(spark, sf_dir).unionByName(empty), R.rendered_fetches(spark, sf_dir), READ_AT)
    return run.header.selectExpr("site", "complete", "incompleteReason AS reason", "discoveryStatus AS status", "n_products")


def part_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD products of all parts, as catalogue rows."""
    made = X.extract_products(R.rendered_pages(spark, sf_dir, only="jsonld"), keep=("site", "page_id"))
    return stage(made.withColumn("pos", F.col("page_id")).withColumn("hop", F.lit(0)), "part-products")


def part_header(spark: SparkSession, sf_dir: str, products: DataFrame) -> DataFrame:
    sites = R.rendered_sites(spark, sf_dir)
    return C.read_header(sites, products.select("site", "url"), products, READ_AT)


@query(f"SELECT {SITE} AS site, count(*) AS n_products, 'complete' AS status_text FROM part GROUP BY 1")
def catalogue_summary(spark, sf_dir):
    products = part_products(spark, sf_dir)
    return C.catalogue_summary(part_header(spark, sf_dir, products))


@query(f"""SELECT {SITE} AS site, CAST(count(*) AS INT) AS n, CAST(0 AS INT) AS part, CAST(1 AS INT) AS parts, string_agg('P-' || CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1""")
def assemble_catalogues(spark, sf_dir):
    products = part_products(spark, sf_dir)
    made = C.assemble_catalogues(part_header(spark, sf_dir, products), products)
    return made.selectExpr("site", "size(products) AS n", "part", "parts", "array_join(products.id, ',') AS ids")


@query(f"""SELECT site, p_name AS name, '$' || CAST({PRICE} AS VARCHAR) AS price_label, CASE WHEN p_size % 2 = 0 THEN 'in_stock' ELSE 'out_of_stock' END AS availability, 'P-' || CAST(p_partkey AS VARCHAR) AS sku
FROM (SELECT *, {SITE} AS site FROM part) QUALIFY row_number() OVER (PARTITION BY site ORDER BY p_partkey) <= 3""")
def first_products(spark, sf_dir):
    return C.first_products(part_products(spark, sf_dir)).select("site", "name", "price_label", "availability", "sku")


@query("SELECT p_partkey AS page_id, 'Size=' || CAST(p_size AS VARCHAR) AS first_spec, CAST(2 AS INT) AS n FROM part")
def first_specs(spark, sf_dir):
    cut = part_products(spark, sf_dir).selectExpr("page_id", f"{C.first_specs(3)} AS s")
    return cut.selectExpr("page_id", "concat(s[0].key, '=', s[0].value) AS first_spec", "size(s) AS n")


@query(f"SELECT {SITE} AS file_site, count(*) + 2 AS n_pieces, count(*) - 1 AS n_commas FROM part GROUP BY 1")
def catalogue_text(spark, sf_dir):
    products = part_products(spark, sf_dir)
    lines = catalogue_lines(part_header(spark, sf_dir, products), products)
    site = "concat('https://www.', replace(file, '_catalogue.json', '')) AS file_site"
    return lines.selectExpr(site, "value").groupBy("file_site").agg(
        F.count("*").alias("n_pieces"), F.count_if(F.expr("startswith(value, '    ,')")).alias("n_commas")
    )


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT {SITE} AS site, true AS complete, 'P-' || CAST(p_partkey AS VARCHAR) AS id, p_name AS name, {PRICE} AS price FROM part")
def written_catalogues(spark, sf_dir):
    """Documents written and read back, small enough that every site has several."""
    products = part_products(spark, sf_dir)
    folder = _folder(spark, "catalogues")
    write_catalogues(part_header(spark, sf_dir, products), products, folder, per_document=7)
    return read_catalogues(spark, folder).selectExpr("site", "complete", "explode(products) AS p").selectExpr("site", "complete", "p.id", "p.name", "p.price")


@query(f"SELECT {SITE} AS site, 'P-' || CAST(p_partkey AS VARCHAR) AS id, p_name AS name, {PRICE} AS price FROM part")
def written_products(spark, sf_dir):
    folder = _folder(spark, "products")
    write_products(part_products(spark, sf_dir), folder)
    return spark.read.parquet(folder).select("site", "id", "name", "price")


@query(f"SELECT {SITE_OF_PAGE} AS site, url, CAST(200 AS INT) AS status, md5(html) AS body_hash FROM pages")
def stored_fetches(spark, sf_dir):
    """A table of responses written and read back."""
    folder = _folder(spark, "fetches")
    fetches_of_pages(R.table(spark, sf_dir, "pages")).write.parquet(folder)
    return fetch_table(spark, folder).selectExpr("site", "url", "status", "md5(CAST(body AS BINARY)) AS body_hash")


@query(f"""SELECT {SITE} AS site, CAST((row_number() OVER (PARTITION BY {SITE} ORDER BY p_partkey) - 1) // 7 AS INT) AS part, 'P-' || CAST(p_partkey AS VARCHAR) AS id FROM part""")
def parts_in_order(spark, sf_dir):
    """Large sites are cut into parts by position."""
    products = part_products(spark, sf_dir)
    made = C.assemble_catalogues(part_header(spark, sf_dir, products), products, per_row=7)
    return made.selectExpr("site", "part", "explode(products.id) AS id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS site FROM customer WHERE coalesce((SELECT arg_max(o_orderstatus = 'F', o_orderkey) FROM orders WHERE o_custkey = c_custkey), false) = false")
def sites_to_retry(spark, sf_dir):
    """Customers as sites, orders as reads of them: whose last read is missing or not complete."""
    sites = R.table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS site")
    reads = R.table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS site", "o_orderstatus = 'F' AS complete", "o_orderkey AS readAt"
    )
    return C.sites_to_retry(sites, reads)


@query(f"""WITH {DISCOVERED}, urls AS (SELECT site, count(*) AS discovered, sum(CAST(kind = 'product' AS INT))::BIGINT AS product_urls,
  sum(CAST({LIKELY} AS INT))::BIGINT AS pattern_matched, min(source) AS source FROM found GROUP BY site),
made AS (SELECT site, count(*) AS scanned, sum(CAST(p_partkey % 7 = 3 AS INT))::BIGINT AS embedded, sum(CAST(p_partkey % 7 IN (0, 1, 2, 3, 6) AS INT))::BIGINT AS products FROM parts GROUP BY site)
SELECT * FROM urls JOIN made USING (site)""")
def crawl_counters(spark, sf_dir):
    return run_all(spark, sf_dir).counters


# -- S: streaming -------------------------------------------------------------


@query(" UNION ALL ".join(
    f"SELECT {product_sql(t, PLAIN_URL, f'{SITE} AS site')} FROM part WHERE p_partkey % 7 = {k}"
    for k, t in enumerate(["jsonld", "meta", "heuristic"])
))
def stream_catalogue(spark, sf_dir):
    """Parts arrive as a stream, are rendered as responses and leave as products."""
    import uuid

    R.prepare(spark)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/part.parquet").schema
    # Dealt out before a page is made of each narrow row, as a file has rows in as few splits as it has row groups.
    arriving = spread(spark.readStream.schema(schema).parquet(f"{sf_dir}/part[.]parquet"), "p_partkey")
    fetches = arriving.select(
        R.site().alias("site"), R.product_url().alias("url"), F.lit(0).alias("attempt"),
        F.lit(READ_AT).alias("fetched_at"), F.lit(200).alias("status"), R.page_html(R.page_template()).alias("body"),
        F.lit(None).cast("string").alias("error"), F.lit("http").alias("via"),
    )
    stream_products(fetches, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").selectExpr(*product_columns("site"))


@query(" UNION ALL ".join(
    f"SELECT {product_sql(t, PLAIN_URL, f'{SITE} AS site')} FROM part WHERE p_partkey % 7 IN ({ks})"
    for ks, t in (("0", "jsonld"), ("1", "meta"), ("2, 6", "heuristic"))
))
def stream_rendered(spark, sf_dir):
    """Script shells whose rendered bodies arrive one batch later, and attempts that are turned away first."""
    R.prepare(spark)
    folder = _folder(spark, "stream")
    fetches = R.rendered_fetches(spark, sf_dir, with_docs=False, with_hidden=False)
    fetches = fetches.withColumn("url", F.regexp_replace("url", "/x/p/", "/products/")).withColumn("fetched_at", F.lit(READ_AT))
    arriving = spark.readStream.schema(fetches.schema).parquet(f"{folder}/in/*")
    for i, some in enumerate(["via <> 'render'", "via = 'render'"]):
        fetches.filter(some).write.parquet(f"{folder}/in/{i}")
        stream_products(arriving, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").selectExpr(*product_columns("site"))
