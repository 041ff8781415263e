"""Which response of a URL counts, and what may be done with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan import rules
from shelfscan.functions import markup as M
from shelfscan.functions.sql import lit, when
from shelfscan.sources.fetches import api_call
from shelfscan.sources.sitemaps import SITEMAP_MARKS


def resolve_attempts(fetches: DataFrame, max_attempts: int | None = None) -> DataFrame:
    """(site, url, attempts, status, body, rendered): one row per fetched URL.

    The first attempt that neither failed nor was turned away with 429 counts, of the
    first ``max_attempts`` where that is given; ``status`` is NULL where none did. ``rendered`` is the body that a browser
    saw, where the archive has one. One aggregation, combined before its shuffle.
    """
    kept = "via <> 'render' AND " + ("" if max_attempts is None else f"attempt < {max_attempts} AND ") + "error IS NULL AND status <> 429"
    order = "struct(attempt, fetched_at, status, xxhash64(body))"
    drawn = "via = 'render' AND error IS NULL AND body IS NOT NULL"
    return (
        fetches.selectExpr("site", "url", "attempt", "fetched_at", "status", "body", "error", "coalesce(via, 'http') AS via")
        .groupBy("site", "url")
        .agg(
            F.expr("count_if(via <> 'render')").alias("attempts"),
            F.expr(f"min_by(struct(status, body), {order}) FILTER (WHERE {kept})").alias("r"),
            F.expr(f"min_by(body, {order}) FILTER (WHERE {drawn})").alias("rendered"),
        )
        .selectExpr("site", "url", "attempts", "r.status AS status", "coalesce(r.body, '') AS body", "rendered")
    )


def route_reason(status: str = "status", body: str = "body") -> str:
    return (
        f"CASE WHEN {status} = 200 THEN CASE WHEN {M.is_challenge(body)} THEN 'challenge' "
        f"WHEN {M.is_csr_shell(body)} THEN 'shell' ELSE 'ok' END "
        f"WHEN {status} IS NULL THEN 'no response' "
        f"WHEN {status} IN ({', '.join(str(s) for s in rules.BLOCKED_STATUSES)}) THEN 'blocked' ELSE 'status' END"
    )


def route_of(reason: str = "reason") -> str:
    return f"CASE {reason} WHEN 'ok' THEN 'accept' WHEN 'status' THEN 'drop' ELSE 'needs_render' END"


def effective_html(route: str = "route", body: str = "body", rendered: str = "rendered") -> str:
    return f"CASE {route} WHEN 'accept' THEN {body} WHEN 'needs_render' THEN {rendered} END"


def response_role(body: str = "body", status: str = "status") -> str:
    """What a response may be read for, so that a stored archive can be split by it.

    Each discovery step then reads its own small part instead of all bodies.
    """
    xml = " OR ".join(f"contains({body}, {lit(mark)})" for mark in SITEMAP_MARKS)
    return (
        "CASE WHEN url = concat(site, '/robots.txt') THEN 'robots' WHEN url = concat(site, '/') THEN 'home' "
        f"WHEN {api_call()} IS NOT NULL THEN 'api' WHEN {status} = 200 AND ({xml}) THEN 'sitemap' ELSE 'page' END"
    )


def screen_responses(responses: DataFrame) -> DataFrame:
    """Adds route, reason, html (NULL where nothing can be read) and role."""
    return (
        responses.selectExpr("*", f"{route_reason()} AS reason")
        .selectExpr("*", f"{route_of()} AS route")
        .selectExpr("*", f"{effective_html()} AS html", f"{response_role()} AS role")
    )


def page_routes(candidates: DataFrame, screened: DataFrame) -> DataFrame:
    """(site, url, pos, hop, route, reason, html) of every candidate; 'missing' where not archived."""
    joined = candidates.join(screened.select("site", "url", "route", "reason", "html"), ["site", "url"], "left")
    return joined.selectExpr(
        "site", "url", "pos", "hop",
        f"{when('route IS NULL', "'missing'", 'route')} AS route",
        f"{when('route IS NULL', "'not archived'", 'reason')} AS reason",
        "html",
    )
