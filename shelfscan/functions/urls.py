"""URL functions (SQL text in, SQL text out)."""

from __future__ import annotations

import re

from shelfscan import rules
from shelfscan.functions.scalars import py_strip
from shelfscan.functions.sql import extract, in_list, let, lit, matches, replaced, when

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def _any_of(fragments: list[str]) -> str:
    return "(" + "|".join(re.escape(f) for f in fragments) + ")"


def normalise_site(url: str) -> str:
    """``scheme://host`` of an address; https where no scheme is given."""
    full = let(py_strip(url), lambda u: when(matches(u, "^https?://"), u, f"concat('https://', {u})"))
    return extract(full, r"^(https?://[^/?#]*)")


def netloc(url: str) -> str:
    return extract(url, _SCHEME + r"//([^/?#]*)")


def url_path(url: str) -> str:
    """Path without query, fragment and the parameters of its last segment."""
    return replaced(extract(url, _SCHEME + r"(?://[^/?#]*)?([^?#]*)"), r";[^/]*\z", "")


def site_domain(url: str) -> str:
    """Host without leading ``w`` and ``.`` characters (a character set, not a prefix)."""
    return f"trim(LEADING 'w.' FROM {netloc(url)})"


def rate_key(url: str) -> str:
    return f"coalesce(try_element_at(split({url}, '/'), 3), {url})"


def host_of(base: str) -> str:
    return f"split_part(split_part({base}, '//', 2), '/', 1)"


def url_extension(path: str) -> str:
    return extract(f"lower({path})", r"(\.[^./]*)\z")


def has_skip_extension(path: str) -> str:
    return in_list(url_extension(path), rules.SKIP_EXTENSIONS)


def has_skip_fragment(path: str) -> str:
    return matches(f"lower({path})", _any_of(rules.SKIP_URL_FRAGMENTS))


def has_product_signal(path: str) -> str:
    return matches(f"lower({path})", _any_of(rules.PRODUCT_URL_SIGNALS))


def looks_like_product_url(url: str) -> str:
    path = url_path(url)
    return f"(NOT {has_skip_extension(path)} AND NOT {has_skip_fragment(path)} AND {has_product_signal(path)})"


def strip_fragment(url: str) -> str:
    return f"split_part({url}, '#', 1)"


def is_followable(href: str) -> str:
    return f"(NOT {matches(href, '^' + _any_of(rules.UNFOLLOWED_SCHEMES))})"


def same_site(url: str, host: str) -> str:
    return f"contains({url}, {host})"


def is_product_feed(url: str) -> str:
    return f"contains({url}, {lit(rules.PRODUCT_FEED_MARK)})"


def _drop_dot_segments(path: str) -> str:
    kept = (
        f"aggregate(split({path}, '/'), CAST(array() AS ARRAY<STRING>), (acc, seg) -> "
        "CASE WHEN seg = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
        "WHEN seg = '.' THEN acc ELSE array_append(acc, seg) END)"
    )
    tail = when(matches(path, r"/\.\.?\z"), "'/'", "''")
    return let(
        f"concat(array_join({kept}, '/'), {tail})", lambda p: when(f"startswith({p}, '/')", p, f"concat('/', {p})")
    )


def url_join(base: str, href: str) -> str:
    """Resolve ``href`` against a site root (``scheme://host``, no path)."""
    base_scheme = extract(base, "^([^:]+):")
    scheme = f"lower({extract(href, '^([A-Za-z][A-Za-z0-9+.-]*):')})"

    def resolved(rest: str) -> str:
        # Parameters of the last segment take no part in resolving.
        path = extract(rest, "^((?:[^?#;]|;(?=[^?#]*/))*+)")
        # A relative path loses its empty inner segments, a rooted one keeps them.
        rooted = when(f"startswith({path}, '/')", path, f"concat('/', {replaced(path, '(?<=/)/+(?=.)', '')})")
        clean = let(rooted, lambda p: when(matches(p, r"/\.\.?(/|\z)"), _drop_dot_segments(p), p))
        suffix = f"substr({rest}, length({path}) + 1)"
        return (
            f"CASE WHEN startswith({rest}, '//') THEN concat({base_scheme}, ':', {rest}) "
            f"WHEN {path} = '' AND NOT startswith({rest}, ';') THEN concat({base}, {suffix}) ELSE concat({base}, {clean}, {suffix}) END"
        )

    rest = when(f"{scheme} = ''", href, f"substr({href}, length({scheme}) + 2)")
    tidy = replaced(rest, r"\?(#|\z)", "$1")
    return when(f"{scheme} NOT IN ('', {base_scheme})", href, let(tidy, resolved))
