"""Secret scans by linking the parts of a credential.

Strong parts (a named assignment, an access identifier, a long hex run) are always reported. Weak ones
(a bare key-like run, a user name, an endpoint) are candidates: they are reported only where
complementary parts stand within ``reach`` code points in the same document, from the end of one to the
start of the other, found by an interval join over position bins. A part is in every bin it touches; bins
carry one row per part role, so a text full of parts costs no pairs. A weak part over a strong one is no
candidate, but for endpoints: an address with a secret inside is linked to it.

Everything is DataFrame or SQL. Null or empty text has no spans; repeated rows give repeated rows; a
null ``doc_id`` stays null. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.common import staged
from shelfscan.llm.spans import by_start, matches, quoted, written

NAMED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
BASE = ["assign", "access", "hex"]
WEAK = ["key", "user", "endpoint"]
#: Weak parts: a 40-character run with digits and both cases, a named user, an address.
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
USER = r"""(?i:user(?:_?name|_?id)?|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""(?i:https?|s3|postgres(?:ql)?|mysql|redis|mongodb|amqp|ftp)://[^\x00-\x20"'<>]+"""
#: What a part can stand for, and which other roles a weak one needs near it.
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "user": "identifier", "endpoint": "endpoint"}
NEEDS = {"key": "'identifier', 'endpoint'", "user": "'secret'", "endpoint": "'secret'"}


def _base(text: str) -> str:
    long_value = f"char_length(regexp_extract(s.found, {quoted('^' + NAMED + '(' + VALUE + ')$')}, 1)) >= 6"
    return f"""concat(
      {matches(text, NAMED + VALUE, 'assign', f"{text} rlike {quoted('(?i:passw|secret|token|api_?key)')}", long_value)},
      {matches(text, 'AKIA[A-Z0-9]+', 'access', f"contains({text}, 'AKIA')", 'char_length(s.found) >= 20')},
      {matches(text, '[0-9a-f]{24,}', 'hex', f"{text} rlike '[0-9a-f]{{24}}'")})"""


def _weak(text: str) -> str:
    mixed = "s.found rlike '[0-9]' AND s.found rlike '[a-z]' AND s.found rlike '[A-Z]'"
    return f"""concat(
      {matches(text, KEY, 'key', f"{text} rlike '[A-Za-z0-9+/]{{40}}'", mixed)},
      {matches(text, USER, 'user', f"{text} rlike {quoted('(?i:user|login|client_?id|account_?id)')}")},
      {matches(text, ENDPOINT, 'endpoint', f"contains({text}, '://')")})"""


def find_parts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``_row``, ``doc_id``, spans ``base`` and weak candidates ``weak``, without text."""
    parts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", F.expr(_base("t")).alias("base"), F.expr(_weak("t")).alias("weak")
    )
    apart = "w.kind = 'endpoint' OR NOT exists(base, b -> b.start < w.end AND w.start < b.end)"
    bare = "transform({}, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))"
    return parts.withColumn("weak", F.expr(f"if(size(weak) = 0 OR size(base) = 0, weak, filter(weak, w -> {apart}))")).select(
        "_row", "doc_id", F.expr(bare.format("base")).alias("base"), F.expr(bare.format("weak")).alias("weak")
    )


def link_parts(parts: DataFrame, reach: int = 200) -> DataFrame:
    """``_row`` and the ``linked`` weak spans: those with complementary parts at most ``reach`` code points away."""
    roles = "CASE p.kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLES.items()) + " END"
    each = (
        parts.filter("size(weak) > 0 AND size(weak) + size(base) > 1")
        .select("_row", F.expr("explode(concat(base, weak)) AS p"))
        .selectExpr("_row", "p", f"{roles} AS role")
    )
    bins = each.selectExpr("_row", "p", "role", f"explode(sequence(p.start DIV {reach}, p.end DIV {reach})) AS bin")
    bins = bins.groupBy("_row", "bin", "role").agg(F.expr("min(p.start) AS first"), F.expr("max(p.end) AS last"))
    wants = "CASE p.kind " + " ".join(f"WHEN '{k}' THEN array({n})" for k, n in NEEDS.items()) + " END"
    around = f"explode(sequence(greatest(0L, p.start - {reach}) DIV {reach}, (p.end + {reach}) DIV {reach})) AS bin"
    weak = each.filter(F.col("p.kind").isin(WEAK)).selectExpr("_row", "p", f"explode({wants}) AS role").selectExpr("_row", "p", "role", around)
    # A bin holds one end of the reach at most, so first and last of different parts tell no untruth.
    near = weak.join(bins, ["_row", "bin", "role"]).filter(f"last >= p.start - {reach} AND first <= p.end + {reach}")
    return near.groupBy("_row").agg(F.collect_set("p").alias("linked"))


def secret_scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``base`` and ``linked`` spans (kind, start, end; code points, end exclusive)."""
    parts = staged(find_parts(docs), "secret-parts")
    return parts.join(link_parts(parts, reach), "_row", "left").selectExpr("doc_id", "base", f"coalesce(linked, CAST(array() AS {'array<struct<kind: string, start: bigint, end: bigint>>'})) AS linked")


def secret_digest(docs: DataFrame, reach: int = 200) -> DataFrame:
    found = secret_scan(docs, reach)
    return found.selectExpr(
        "doc_id",
        *[f"CAST(size(filter(base, s -> s.kind = '{k}')) AS bigint) AS n_{k}" for k in BASE],
        f"sha2({written(by_start('base', BASE))}, 256) AS base_sha256",
        f"{written(by_start('concat(base, linked)', BASE + WEAK))} AS spans",
        "CAST(size(linked) AS bigint) AS n_linked",
    )
