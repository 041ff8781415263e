"""Products into catalogues, summaries and lists of sites to read again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan import rules, schemas
from shelfscan.functions.scalars import price_label
from shelfscan.functions.sql import lit
from shelfscan.functions.urls import looks_like_product_url
from shelfscan.operators.groups import attach, first_per_group, numbered

PRODUCTS_PER_ROW = 5_000


def read_header(sites: DataFrame, urls: DataFrame, products: DataFrame, read_at: datetime, status_lost: bool = False, dropped: DataFrame | None = None) -> DataFrame:
    """(site, readAt, complete, incompleteReason, discoveryStatus, n_products, n_dropped) per site.

    ``dropped`` has the URLs (site, n_dropped) that a limit left out.
    ``status_lost`` writes 'complete' for every site, as readers that drop the status do.
    """
    n_urls = urls.groupBy("site").agg(F.count("*").alias("n_urls"))
    n_products = products.groupBy("site").agg(F.count("*").alias("n_products"))
    counted = sites.join(n_urls, "site", "left").join(n_products, "site", "left")
    counted = counted.withColumn("n_dropped", F.lit(0).cast("bigint")) if dropped is None else counted.join(dropped, "site", "left")
    status = (
        "CASE WHEN coalesce(n_products, 0) > 0 AND coalesce(n_dropped, 0) > 0 THEN 'partial' "
        "WHEN coalesce(n_products, 0) > 0 THEN 'complete' "
        "WHEN coalesce(n_urls, 0) = 0 THEN 'no_sitemap' ELSE 'extractor_failure' END"
    )
    reason = (
        f"CASE status WHEN 'no_sitemap' THEN {lit(rules.REASON_NO_URLS)} "
        f"WHEN 'extractor_failure' THEN {lit(rules.REASON_NO_PRODUCTS)} "
        "WHEN 'partial' THEN concat('URL limit: ', n_dropped, ' URLs were not read') END"
    )
    return counted.selectExpr("*", f"{status} AS status").selectExpr(
        "site",
        f"TIMESTAMP '{read_at.isoformat(sep=' ')}' AS readAt",
        "status = 'complete' AS complete",
        f"{reason} AS incompleteReason",
        "'complete' AS discoveryStatus" if status_lost else "status AS discoveryStatus",
        "coalesce(n_products, 0L) AS n_products",
        "coalesce(n_dropped, 0L) AS n_dropped",
    )


def place_products(header: DataFrame, products: DataFrame, per_part: int) -> DataFrame:
    """Adds ``part`` to the products: the first ``per_part`` of a site in order (hop, pos, url), the next, ..."""
    sizes = header.select("site", "n_products")
    sized = attach(products, sizes, ["site"], ["url"])
    small = sized.filter(f"n_products <= {per_part}").withColumn("part", F.lit(0))
    large = numbered(sized.filter(f"n_products > {per_part}"), ["site"], "struct(hop, pos DIV 1024 AS pos)", ["hop", "pos", "url"], "_at")
    large = large.withColumn("part", F.expr(f"CAST(_at DIV {per_part} AS INT)")).drop("_at")
    return small.unionByName(large).drop("n_products")


def assemble_catalogues(header: DataFrame, products: DataFrame, per_row: int = PRODUCTS_PER_ROW) -> DataFrame:
    """One row per site with its products in order (hop, pos, url).

    A site with more than ``per_row`` products is spread over several rows, numbered by
    ``part`` of ``parts`` in that order, so that no row has to hold an unbounded site.
    """
    parts = header.selectExpr("*", f"CAST(greatest(1, ceil(n_products / {per_row})) AS INT) AS parts")
    item = F.struct(F.struct("hop", "pos", "url").alias("at"), F.struct(*schemas.PRODUCT_COLUMNS).alias("product"))
    # The items hold maps, which do not sort; their order key comes first and decides.
    nested = place_products(header, products, per_row).groupBy("site", "part").agg(F.collect_list(item).alias("items"))
    ordered = "array_sort(items, (a, b) -> CASE WHEN a.at < b.at THEN -1 WHEN a.at > b.at THEN 1 ELSE 0 END)"
    rows = parts.withColumn("part", F.expr("explode(sequence(0, parts - 1))"))
    empty = f"CAST(array() AS ARRAY<{schemas.PRODUCT_STRUCT}>)"
    return rows.join(nested, ["site", "part"], "left").selectExpr(
        "site", "readAt", "complete", f"coalesce(transform({ordered}, x -> x.product), {empty}) AS products",
        "incompleteReason", "discoveryStatus", "part", "parts",
    )


def catalogue_summary(header: DataFrame) -> DataFrame:
    """(site, n_products, status_text)."""
    return header.selectExpr(
        "site", "n_products", "if(complete, 'complete', concat('incomplete — ', incompleteReason)) AS status_text"
    )


def first_products(products: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` products of each site with a price label."""
    top = first_per_group(products, ["site"], ["hop", "pos", "url"], n, ["url"])
    return top.selectExpr("site", "hop", "pos", "name", f"{price_label('price')} AS price_label", "availability", "sku")


def first_specs(n: int = 3, specs: str = "specs") -> str:
    return f"slice(map_entries({specs}), 1, {n})"


def sites_to_retry(sites: DataFrame, reads: DataFrame) -> DataFrame:
    """Sites whose latest read is missing or incomplete."""
    latest = reads.groupBy("site").agg(F.max_by("complete", "readAt").alias("complete"))
    return sites.join(latest.filter("complete"), "site", "left_anti")


def crawl_counters(urls: DataFrame, candidates: DataFrame, products: DataFrame) -> DataFrame:
    """Counts per site: discovered, per source, candidates, second-hop pages, products."""
    found = urls.selectExpr("*", f"{looks_like_product_url('url')} AS likely").groupBy("site").agg(
        F.count("*").alias("discovered"),
        F.expr("count_if(kind = 'product')").alias("product_urls"),
        F.expr("count_if(likely)").alias("pattern_matched"),
        F.min("source").alias("source"),
    )
    picked = candidates.groupBy("site").agg(
        F.expr("count_if(hop = 0)").alias("scanned"), F.expr("count_if(hop = 1)").alias("embedded")
    )
    made = products.groupBy("site").agg(F.count("*").alias("products"))
    return (
        found.join(picked, "site", "left")
        .join(made, "site", "left")
        .fillna(0, ["scanned", "embedded", "products"])
    )
