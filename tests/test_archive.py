"""The stored archive: what it says of responses, and that bodies stay where they lie."""

import re
import tempfile
from datetime import datetime

import pytest
from tests_support import S, site_archive

from shelfscan.operators import discovery
from shelfscan.operators.screen import resolve_attempts, screen_responses
from shelfscan.plans import catalogue
from shelfscan.sources.archive import open_responses, store_responses
from shelfscan.sources.sites import read_sites


def moved_columns(df):
    """Columns of every shuffle of a plan."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [re.findall(r"(\w+)#", m) for m in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", text)]


def fetches(spark):
    rows = [
        (S, "/a", 1, 200, "late", None, "http"), (S, "/a", 0, 429, "", None, "http"),
        (S, "/b", 0, None, None, "timeout", "http"), (S, "/b", 1, 429, None, None, None), (S, "/b", 3, 200, "fourth <h1>", None, None),
        (S, "/c", 0, 404, "no", None, "http"), (S, "/d", 0, 503, "no", None, "http"), (S, "/d", 0, 200, "drawn", None, "render"),
        (S, "/e", 0, 200, "Just a moment <h1>", None, "http"), (S, "/f", 0, 200, "<body></body>", None, "http"),
        (S, "/", 0, 200, "home <h1>", None, "http"), (S, "/", 0, 200, "drawn home", None, "render"), (S, "/", 1, 200, "drawn later", None, "render"),
        (S, "/g", 0, 200, "same", None, "http"), (S, "/g", 0, 200, "same", None, "http"), (S, "/h", 0, None, None, "timeout", "http"),
        (S, "/i", 0, 200, None, None, "http"), (S, "/robots.txt", 0, 200, "Sitemap: x", None, "http"), (S, "/only", 0, 200, "drawn only", None, "render"),
    ]
    df = spark.createDataFrame(rows, "site STRING, path STRING, attempt INT, status INT, body STRING, error STRING, via STRING")
    return df.selectExpr("site", "concat(site, path) AS url", "attempt", "CAST(NULL AS TIMESTAMP) AS fetched_at", "status", "body", "error", "via")


@pytest.fixture(scope="module")
def stored(spark):
    return store_responses(fetches(spark), buckets=3)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_says_the_same_as_screening(spark, stored):
    screened = screen_responses(resolve_attempts(fetches(spark)))
    said = ("url", "attempts", "status", "reason", "route", "role")
    assert rows_of(stored.chosen, *said) == rows_of(screened, *said)
    assert rows_of(stored.pages(), "url", "html") == rows_of(screened.filter("html IS NOT NULL"), "url", "html")
    assert rows_of(stored.responses(), "url", "status", "body") == rows_of(screened.filter("status IS NOT NULL"), "url", "status", "body")
    assert rows_of(stored.homes(drawn=True), "url", "html") == [(S + "/", "drawn home")]
    assert rows_of(stored.homes(), "url", "html") == [(S + "/", "home <h1>")]
    assert stored.homes(without=stored.chosen.select("site").distinct()).count() == 0
    assert rows_of(stored.responses("robots"), "url", "body") == [(S + "/robots.txt", "Sitemap: x")]


def test_bodies_are_not_moved(spark, stored):
    assert moved_columns(stored.pages()) == moved_columns(stored.responses("api")) == moved_columns(stored.chosen.groupBy("site", "url").count()) == []
    routes = stored.routes(stored.chosen.selectExpr("site", "url", "1L AS pos", "0 AS hop").repartition(2))
    moved = moved_columns(catalogue.judged_candidates(stored, routes))
    assert moved and not any({"body", "html", "source"} & set(columns) for columns in moved)


def test_no_step_of_a_run_moves_a_body(spark, monkeypatch):
    moved = []
    for module in (catalogue, discovery):
        real = module.stage

        def noted(df, name, *rest, real=real):
            moved.extend((name, columns) for columns in moved_columns(df))
            return real(df, name, *rest)

        monkeypatch.setattr(module, "stage", noted)
    run = catalogue.read_catalogues_of(read_sites(spark, [S]), site_archive(spark), datetime(2026, 1, 1))
    moved.extend(("frontier", columns) for columns in moved_columns(run.frontier))
    assert {name for name, _ in moved} >= {"urls", "judged", "products"}
    assert [name for name, columns in moved if {"body", "html", "source"} & set(columns)] == []


def test_runs_are_added(spark):
    folder = tempfile.mkdtemp(prefix="run-") + "/archive"
    parts = [fetches(spark).filter(f"pmod(hash(url, attempt), 3) = {i}") for i in range(3)]
    for i, part in enumerate(parts):
        store_responses(part, folder, buckets=4, run=i)
    said = ("url", "attempts", "status", "reason", "route", "role")
    again = open_responses(spark, folder, 4)
    assert rows_of(again.chosen, *said) == rows_of(screen_responses(resolve_attempts(fetches(spark))), *said)
    assert again.rows.select("run").distinct().count() == 3


def test_an_empty_archive(spark):
    none = store_responses(fetches(spark).filter("false"), buckets=2)
    assert none.chosen.count() == none.pages().count() == none.homes().count() == 0
    routes = none.routes(spark.createDataFrame([(S, S + "/x")], "site string, url string")).first()
    assert (routes.route, routes.reason, routes["at"]) == ("missing", "not archived", None)
