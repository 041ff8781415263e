"""The whole way, the documents it writes, and the stream."""

import json
import os
import tempfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests_support import S, page, site_archive

from shelfscan import rules, schemas
from shelfscan.operators import catalogue as C
from shelfscan.plans.catalogue import read_catalogues_of
from shelfscan.sources.catalogues import read_catalogues, write_catalogues, write_products
from shelfscan.sources.sites import read_sites
from shelfscan.streaming.products import products_of_batch, stream_products


@pytest.fixture(scope="module")
def run(spark):
    sites = read_sites(spark, [S, "https://none.example", "https://news.example"])
    return sites, read_catalogues_of(sites, site_archive(spark), datetime(2026, 1, 2, 3, 4, 5))


def test_products_of_both_hops(run):
    _, r = run
    rows = {x.name: x for x in r.products.collect()}
    assert set(rows) == {"One", "Two", 'Quo"ted é', "Hidden"}
    assert (rows["Hidden"].hop, rows["One"].hop, rows["One"].strategy) == (1, 0, "jsonld")


def test_header_and_summary(run):
    sites, r = run
    got = {x.site: (x.complete, x.incompleteReason, x.discoveryStatus, x.n_products) for x in r.header.collect()}
    assert got == {
        S: (True, None, "complete", 4),
        "https://none.example": (False, rules.REASON_NO_URLS, "no_sitemap", 0),
        "https://news.example": (False, rules.REASON_NO_PRODUCTS, "extractor_failure", 0),
    }
    texts = {x.site: x.status_text for x in C.catalogue_summary(r.header).collect()}
    assert texts[S] == "complete" and texts["https://none.example"].startswith("incomplete — no URLs")
    assert sorted(x.site for x in C.sites_to_retry(sites, r.catalogues).collect()) == ["https://news.example", "https://none.example"]


def test_catalogues_hold_products_in_order(run):
    _, r = run
    rows = {x.site: x for x in r.catalogues.collect()}
    assert [p.name for p in rows[S].products] == ["One", "Two", 'Quo"ted é', "Hidden"]
    assert rows["https://none.example"].products == [] and all(x.parts == 1 for x in rows.values())


def test_large_sites_are_spread_over_rows(run):
    _, r = run
    parts = C.assemble_catalogues(r.header, r.products, per_row=1).filter(f"site = '{S}'").collect()
    assert [p.name for x in sorted(parts, key=lambda x: x.part) for p in x.products] == ["One", "Two", 'Quo"ted é', "Hidden"]
    assert [x.parts for x in parts] == [4] * 4 and {x.part for x in parts} == {0, 1, 2, 3}
    assert sorted(p.name for x in parts for p in x.products) == sorted(["One", "Two", 'Quo"ted é', "Hidden"])


def test_counters_and_first_products(run):
    _, r = run
    c = {x.site: x for x in r.counters.collect()}[S]
    assert (c.discovered, c.scanned, c.embedded, c.products, c.source) == (7, 6, 1, 4, "sitemap")
    top = C.first_products(r.products, 2).orderBy("hop", "pos").collect()
    assert [(x.name, x.price_label) for x in top] == [("One", "$5.0"), ("Two", "price on request")]


def test_routes_and_frontier(run):
    _, r = run
    routes = {x.url[len(S):]: x.route for x in r.routes.filter(f"site = '{S}'").collect()}
    assert routes["/p/gone"] == "missing" and routes["/p/blocked"] == "needs_render" and routes["/p/1"] == "accept"
    wanted = {(x.url, x.wanted_by) for x in r.frontier.filter(f"site = '{S}'").collect()}
    assert (S + "/p/gone", "candidate") in wanted and (S + "/", "home") in wanted and (S + "/robots.txt", "robots") not in wanted


def test_documents(spark, run):
    _, r = run
    folder = tempfile.mkdtemp(prefix="run-")
    write_catalogues(r.header, r.products, folder)
    texts = {}
    for d in Path(folder).glob("file=*"):
        texts[d.name] = "".join(p.read_text() for p in sorted(d.glob("part-*")))
    doc = json.loads(texts["file=s.example_catalogue.json"])
    assert list(doc) == ["site", "readAt", "complete", "products", "incompleteReason", "discoveryStatus"]
    assert doc["readAt"] == "2026-01-02T03:04:05.000000+00:00" and doc["incompleteReason"] is None
    assert [p["name"] for p in doc["products"]] == ["One", "Two", 'Quo"ted é', "Hidden"]
    assert "é" in texts["file=s.example_catalogue.json"] and doc["products"][1]["price"] is None
    assert list(doc["products"][0]) == ["url", "id", "name", "brand", "sku", "price", "listPrice", "currency", "availability", "image", "description", "specs", "variants"]
    empty = json.loads(texts["file=none.example_catalogue.json"])
    assert empty["products"] == [] and empty["incompleteReason"] == rules.REASON_NO_URLS
    back = tempfile.mkdtemp(prefix="run-")
    for name, text in texts.items():
        Path(back, name[5:]).write_text(text)
    assert read_catalogues(spark, back).selectExpr("sum(size(products)) AS n").first().n == 4


def test_products_table(spark, run):
    _, r = run
    folder = tempfile.mkdtemp(prefix="run-")
    write_products(r.products, folder)
    assert spark.read.parquet(folder).filter(f"site = '{S}'").count() == 4


def test_max_pages(spark):
    got = read_catalogues_of(read_sites(spark, [S]), site_archive(spark), datetime(2026, 1, 1), max_pages=2)
    assert sorted(x.name for x in got.products.collect()) == ["One", "Two"]


def test_stream_equals_batch(spark):
    rows = site_archive(spark).withColumn("fetched_at", F.lit(datetime(2026, 1, 1)))
    folder = tempfile.mkdtemp(prefix="run-")
    rows.write.parquet(f"{folder}/in/1")
    rows.write.parquet(f"{folder}/in/2")  # the same responses once more
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*")
    stream_products(stream, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    names = sorted(x.name for x in spark.read.parquet(f"{folder}/out").collect())
    assert names == sorted(x.name for x in products_of_batch(rows).collect())


def test_stored_documents(spark):
    """Counts of stored documents, where the environment names a folder of them."""
    folder = os.environ.get("CATALOGUE_DIR")
    if not folder:
        pytest.skip("CATALOGUE_DIR is not set")
    from shelfscan.functions.scalars import make_product_id

    rows = read_catalogues(spark, folder).selectExpr("site", "discoveryStatus", "explode_outer(products) AS p").selectExpr("site", "p.*")
    got = rows.selectExpr(
        "count(url) AS n", "count(price) AS priced", "count(listPrice) AS listed", "count(nullif(sku, '')) AS sku",
        "count_if(size(specs) > 0) AS specs", "count_if(size(variants) > 0) AS variants", "count_if(availability = 'in_stock') AS stock",
        f"count_if(id = {make_product_id('NULL', 'url')}) AS hashed",
    ).first()
    assert tuple(got) == (46, 43, 3, 28, 10, 0, 28, 18)


def test_documents_of_many_sites_are_whole(spark):
    """Colliding names, sites of several documents and unmerged partitions lose nothing."""
    sites = [f"https://www.s{i}.example" for i in range(12)] + ["https://s3.example", "http://s3.example"]
    rows = [(s, 0, i, f"{s}/p/{i}", f"{s}-{i}", f"N{i}") for k, s in enumerate(sites) for i in range(3 + 5 * (k % 4))]
    products = spark.createDataFrame(rows, "site string, hop int, pos long, url string, id string, name string")
    for name, kind in schemas.PRODUCT_FIELDS:
        if name not in products.columns:
            products = products.withColumn(name, F.expr(f"CAST(NULL AS {kind})"))
    listed = spark.createDataFrame([(s,) for s in sites], "site string")
    header = C.read_header(listed, products.select("site", "url"), products, datetime(2026, 1, 1))
    folder = tempfile.mkdtemp(prefix="run-")
    merge = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_catalogues(header, products, folder, per_document=6)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
    for f in Path(folder).glob("file=*"):
        assert [json.loads(p.read_text())["complete"] for p in f.glob("part-*")] == [True]
    back = read_catalogues(spark, folder).selectExpr("site", "explode(products) AS p").selectExpr("site", "p.id").collect()
    assert sorted(tuple(r) for r in back) == sorted((r[0], r[4]) for r in rows)


def test_limit_is_reported(spark):
    got = read_catalogues_of(read_sites(spark, [S]), site_archive(spark), datetime(2026, 1, 1), max_pages=2)
    row = got.header.filter(f"site = '{S}'").first()
    assert not row.complete and row.discoveryStatus == "partial" and row.n_dropped > 0


def test_pages_to_render_are_wanted(run):
    _, r = run
    wanted = {(x.url, x.wanted_by) for x in r.frontier.filter(f"site = '{S}'").collect()}
    assert (S + "/p/blocked", "render") in wanted


def test_tasks_write_documents_as_sparks_writer_does(spark, monkeypatch):
    """The same folders and bytes, over what was there before, without the files and moves that Spark's writer adds to each."""
    from shelfscan.sources import catalogues as written

    odd = ['a:b#c%d="e"', "q?x*y", "back\\slash {z} [1] ^", "é ü", "tab\there", "plain.json", "", None]
    rows = [(name, 1, 0, n, f"u{n}", value) for name in odd for n, value in enumerate(["one", None, 'two "é"\r', ""])]
    lines = spark.createDataFrame(rows, "file STRING, section INT, hop INT, pos LONG, url STRING, value STRING")
    monkeypatch.setattr(written, "catalogue_lines", lambda *_: lines)
    found = []
    for local in (True, False):
        folder = tempfile.mkdtemp(prefix="run-")
        Path(folder, "file=old.json").mkdir()
        Path(folder, "file=old.json", "part-0.txt").write_text("{}")
        if not local:
            monkeypatch.setattr(written, "mounted", lambda *_: None)
        write_catalogues(None, lines, folder if local else f"file://{folder}")
        found.append({d.name: [p.read_bytes() for p in d.glob("part-*")] for d in Path(folder).glob("file=*")})
        assert bool(list(Path(folder).rglob("*.crc"))) != local and Path(folder, "_SUCCESS").exists() and not Path(folder, "_temporary").exists()
    assert found[0] == found[1] and len(found[0]) == 7 and {len(v) for k, v in found[0].items() if "HIVE" not in k} == {1}


def test_folders_that_tasks_can_write(spark):
    from shelfscan.sources.catalogues import mounted

    assert [mounted(spark, p) for p in ("/a/b", "file:/a/b", "file:///a/b")] == ["/a/b"] * 3
    assert [mounted(spark, p) for p in ("hdfs://h/a", "s3a://b/c", "viewfs://store/in", "file://host/a")] == [None] * 4


def test_documents_that_fail_leave_no_half_folder(spark, monkeypatch):
    from shelfscan.sources import catalogues as written

    lines = spark.range(8).selectExpr("concat('f', id) AS file", "1 AS section", "0 AS hop", "id AS pos", "'u' AS url", "if(id = 5, raise_error('x'), 'v') AS value")
    monkeypatch.setattr(written, "catalogue_lines", lambda *_: lines)
    folder = f"{tempfile.mkdtemp(prefix='run-')}/out"
    with pytest.raises(Exception, match="x"):
        write_catalogues(None, lines, folder)
    assert not Path(folder).exists()
