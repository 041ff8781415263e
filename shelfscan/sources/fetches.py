"""The archive of fetched responses, and lists that come from elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfscan import rules, schemas
from shelfscan.functions import variants as V
from shelfscan.functions.sql import each, let, lit, matches, only, when
from shelfscan.functions.urls import normalise_site
from shelfscan.session import fill_cores, prepare


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    return prepare(spark).read.schema(schemas.FETCHES).parquet(path)


def read_pages(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """A (key, url, html) table of pages."""
    return fill_cores(prepare(spark).read.parquet(path), key)


def fetches_of_pages(pages: DataFrame) -> DataFrame:
    """A (url, html) table as an archive of successful first attempts."""
    return pages.selectExpr(
        f"{normalise_site('url')} AS site",
        "url",
        "0 AS attempt",
        "CAST(NULL AS TIMESTAMP) AS fetched_at",
        "200 AS status",
        "html AS body",
        "CAST(NULL AS STRING) AS error",
        "'http' AS via",
    )


def url_list_source(df: DataFrame, site: str = "site", body: str = "body") -> DataFrame:
    """(site, url, pos) from JSON lists of URLs: {"links": [...]}, {"urls": [...]} or [...].

    An empty list falls through to the next shape; entries that are no text are dropped.
    """

    def links(v: str) -> str:
        shapes = [V.truthy_or_null(V.field(v, name)) for name in ("links", "urls")]
        return when(V.is_object(v), V.as_array(f"coalesce({', '.join(shapes)})"), V.as_array(v))

    urls = each(only(let(f"try_parse_json({body})", links), V.is_text), V.as_text)
    return df.selectExpr(f"{site} AS site", f"posexplode({urls}) AS (pos, url)").selectExpr(
        "site", "url", "CAST(pos AS BIGINT) AS pos"
    )


def json_body(status: str = "status", body: str = "body") -> str:
    """Parsed body of a successful response, else NULL."""
    return when(f"{status} = 200", f"try_parse_json({body})")


def api_call() -> str:
    """Rank of the endpoint and page number of an API URL, as a struct."""
    whens = []
    for rank, (prefix, _) in enumerate(rules.API_ENDPOINTS):
        rest = f"substr(url, length(site) + {len(prefix) + 1})"
        whens.append(
            f"WHEN startswith(url, concat(site, {lit(prefix)})) AND {matches(rest, r'^[1-9][0-9]*\z')} "
            f"THEN named_struct('rank', {rank}, 'page', try_cast({rest} AS BIGINT))"
        )
    return f"CASE {' '.join(whens)} END"


def api_item_link(item: str) -> str:
    """``permalink``, ``url`` or ``link`` of an API item: the first truthy one, if it is text."""
    value = V.first_truthy(item, "permalink", "url", "link")
    return let(value, lambda v: when(f"{V.is_object(item)} AND {V.is_text(v)}", V.as_text(v)))


def parse_api_pages(fetches: DataFrame) -> DataFrame:
    """Adds ``items`` (NULL where the body is no JSON list) and ``links`` to API responses."""
    parsed = fetches.selectExpr("*", f"{let(json_body(), V.as_array)} AS items")
    links = only(each("items", api_item_link), lambda x: f"{x} IS NOT NULL")
    return parsed.selectExpr("*", f"{links} AS links")


