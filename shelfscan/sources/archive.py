"""The archive of responses, laid out so that no later step has to move a body to find it.

Rows are stored in buckets of (site, url), split by role. What can be said of a response by itself (its role, whether
it counts, why it may not be read) is worked out once, when it is stored. Which response of a URL counts is then decided
from a narrow scan that reads no body, in the buckets as they lie; bodies are read by the chosen rows only, through a
join that neither shuffles nor sorts them. New responses are appended as a further run.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.functions.sql import when
from shelfscan.operators.screen import response_role, route_of, route_reason
from shelfscan.session import shared_folder

KEYS = ["site", "url"]
ROLES = ("robots", "home", "api", "sitemap", "page")
COLUMNS = (
    "site STRING, url STRING, run INT, row BIGINT, attempt INT, fetched_at TIMESTAMP, status INT, body_hash BIGINT, "
    "counts BOOLEAN, drawn BOOLEAN, rendered BOOLEAN, reason STRING, body STRING, role STRING"
)


def _marked(fetches: DataFrame, run: int) -> DataFrame:
    """What each response says by itself. ``row`` tells the responses of a URL apart."""
    usable = "NOT rendered AND error IS NULL AND status <> 429"
    return (
        fetches.selectExpr("site", "url", "attempt", "fetched_at", "status", "body", "error", "coalesce(via, 'http') = 'render' AS rendered")
        .selectExpr("*", "coalesce(body, '') AS text", f"coalesce({usable}, false) AS counts")
        .selectExpr("*", f"{route_reason('status', 'text')} AS why", f"{response_role('text')} AS role")
        .selectExpr(
            "site", "url", f"{int(run)} AS run", "monotonically_increasing_id() AS row", "attempt", "fetched_at", "status",
            "xxhash64(body) AS body_hash", "counts", "rendered AND error IS NULL AND body IS NOT NULL AS drawn", "rendered",
            f"{when('counts', 'why')} AS reason", "body", "role",
        )
    )


def _table_name(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


def _register(spark: SparkSession, path: str, buckets: int) -> str:
    name = _table_name("archive")
    spark.sql(f"CREATE TABLE {name} ({COLUMNS}) USING parquet PARTITIONED BY (role) CLUSTERED BY (site, url) INTO {buckets} BUCKETS LOCATION '{path}'")
    for role in ROLES:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (role = '{role}')")
    return name


def store_responses(fetches: DataFrame, path: str | None = None, buckets: int | None = None, run: int = 0) -> "ResponseArchive":
    """Lay ``fetches`` out under ``path`` as one run of an archive; earlier runs there stay.

    The one shuffle of bodies is here. ``buckets`` (the session's number of shuffle partitions where not given) must be
    that of the earlier runs.
    """
    spark = fetches.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _register(spark, path, buckets)
    _marked(fetches.repartition(buckets, *KEYS), run).write.insertInto(name)
    return open_responses(spark, path, buckets)


def open_responses(spark: SparkSession, path: str, buckets: int) -> "ResponseArchive":
    """An archive that was stored before, with the number of buckets that it was stored with."""
    rows = spark.table(_register(spark, path, buckets))
    return ResponseArchive(rows, _chosen(rows, buckets), path, buckets)


def _chosen(rows: DataFrame, buckets: int) -> DataFrame:
    """(site, url, attempts, status, reason, route, role, kept, seen, html): one narrow row per URL.

    The first attempt that neither failed nor was turned away counts. ``kept``, ``seen`` and ``html`` point to the
    response that counts, to the one that a browser drew, and to the one that can be read, as (run, row).
    """
    order = "struct(attempt, fetched_at, status, body_hash, run, row)"
    pointed = (
        rows.groupBy(*KEYS)
        .agg(
            F.expr("count_if(NOT rendered)").alias("attempts"),
            F.expr(f"min_by(struct(run, row, status, reason, role), {order}) FILTER (WHERE counts)").alias("r"),
            F.expr(f"min_by(struct(run, row), {order}) FILTER (WHERE drawn)").alias("seen"),
        )
        .selectExpr("*", f"coalesce(r.reason, {route_reason('CAST(NULL AS INT)', "''")}) AS reason")
        .selectExpr("*", f"{route_of()} AS route", "if(r IS NULL, NULL, struct(r.run AS run, r.row AS row)) AS kept")
        .selectExpr("*", "CASE route WHEN 'accept' THEN kept WHEN 'needs_render' THEN seen END AS html")
        .selectExpr(
            "site", "url", "attempts", "r.status AS status", "reason", "route",
            f"coalesce(r.role, {response_role("''", 'CAST(NULL AS INT)')}) AS role", "kept", "seen", "html",
        )
    )
    spark = rows.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/chosen-{uuid.uuid4().hex}"
    name = _table_name("chosen")
    pointed.write.bucketBy(buckets, *KEYS).option("path", path).saveAsTable(name)
    return spark.table(name)


@dataclass
class ResponseArchive:
    """``rows`` with bodies, and ``chosen``, one narrow row per URL, in the same buckets."""

    rows: DataFrame
    chosen: DataFrame
    path: str
    buckets: int

    def read(self, urls: DataFrame, pointer: str, name: str = "html", roles: tuple[str, ...] = ()) -> DataFrame:
        """``urls`` (site, url, ``pointer`` as (run, row), ...) with the body that ``pointer`` points to as ``name``.

        Only ``urls``, which hold no bodies, are shuffled, to the buckets; each bucket's are hashed and its bodies pass by.
        """
        wanted = urls.filter(f"{pointer} IS NOT NULL").selectExpr("*", f"{pointer}.run AS _run", f"{pointer}.row AS _row").drop(pointer)
        bodies = self.rows.filter(F.col("role").isin(*roles)) if roles else self.rows
        bodies = bodies.selectExpr(*KEYS, "run AS _run1", "row AS _row1", f"coalesce(body, '') AS {name}")
        # Differences, not equalities: the key of the buckets alone is joined on.
        met = bodies.join(wanted.hint("shuffle_hash"), KEYS).filter("_run - _run1 = 0 AND _row - _row1 = 0")
        return met.drop("_run", "_row", "_run1", "_row1")

    def _of_roles(self, roles: tuple[str, ...]) -> DataFrame:
        return self.chosen.filter(F.col("role").isin(*roles)) if roles else self.chosen

    def responses(self, *roles: str, of: DataFrame | None = None) -> DataFrame:
        """(site, url, body, attempts, status, reason, route, role) of the responses that count, of these roles.

        With ``of`` only those of its URLs (site, url): they are found among the narrow rows, before any body is met.
        """
        chosen = self._of_roles(roles).drop("seen", "html")
        if of is not None:
            chosen = chosen.join(of.select(*KEYS), KEYS, "left_semi")
        return self.read(chosen, "kept", "body", roles)

    def pages(self, *roles: str) -> DataFrame:
        """(site, url, html, attempts, status, reason, route, role) of what can be read, as fetched or as drawn."""
        # A drawn body lies under the role that its own text gives it, so all roles are looked through.
        return self.read(self._of_roles(roles).withColumnRenamed("html", "at").drop("seen", "kept"), "at")

    def homes(self, drawn: bool = False, without: DataFrame | None = None) -> DataFrame:
        """(site, url, html) of home pages that can be read, but those of the sites in ``without``.

        With ``drawn`` as a browser drew them if that is archived, also where the plain page can be read.
        """
        homes = self.chosen.filter("role = 'home'").selectExpr(*KEYS, f"{'coalesce(seen, html)' if drawn else 'html'} AS at")
        if without is not None:
            homes = homes.join(without, "site", "left_anti")
        return self.read(homes, "at", roles=("home",))

    def routes(self, urls: DataFrame) -> DataFrame:
        """``urls`` (site, url, ...) with route, reason and ``at``, where their HTML lies; 'missing' where not archived."""
        known = urls.join(self.chosen.select(*KEYS, "route", "reason", F.col("html").alias("at")), KEYS, "left")
        return known.withColumns({"reason": F.expr("if(route IS NULL, 'not archived', reason)"), "route": F.coalesce("route", F.lit("missing"))})
