"""HTML text functions (SQL text in, SQL text out). Patterns are possessive, so page text of any length is safe."""

from __future__ import annotations

import json
from html import unescape
from html.entities import html5, name2codepoint

from shelfscan import rules
from shelfscan.functions.scalars import mentions, py_strip
from shelfscan.functions.sql import each, extract, extract_all, in_list, let, lit, matches, replaced, when

_COMMENT = r"<!--.*?(?:-->|\z)"
_SCRIPT = r"<script\b[^>]*+>.*?(?:</script\s*+>|\z)"
_STYLE = r"<style\b[^>]*+>.*?(?:</style\s*+>|\z)"
_TAGS = (
    r"""</?[a-z][^<>"']*+(?:(?:"[^"]*+"|'[^']*+')[^<>"']*+)*+>""",
    r"</?[a-z][^>]*+>",
    r"<[!?][^>]*+>",
)
_TAG = "|".join(_TAGS)
_TEXT = r"(?:[^<]++|<(?!/?[a-z]|[!?]))++"


def _any_of(*patterns: str) -> str:
    """Any of the patterns, which all start with ``<``: stated once, so that a search tries the alternatives only there."""
    return f"(?is)<(?:{'|'.join(p.removeprefix('<') for p in patterns)})"


TOKEN = f"(?is){_COMMENT}|{_SCRIPT}|{_STYLE}|{_TAG}|{_TEXT}|<"
RAW_BLOCK = _any_of(_COMMENT, _SCRIPT, _STYLE)
TAG = _any_of(*_TAGS)
COMMENT_OR_SCRIPT = _any_of(_COMMENT, _SCRIPT)

NODE_BREAK = "\u0001"

# A map is searched from its start, so the names that pages use come first.
_NAMES = sorted((name[:-1] for name in html5 if name.endswith(";")), key=lambda name: name not in name2codepoint)
_ENTITIES = json.dumps({name: html5[name + ";"] for name in _NAMES})
#: Names that need no semicolon, longer ones first.
LOOSE_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
_LOOSE = json.dumps({name: html5[name] for name in LOOSE_NAMES})
# What numbers of the C1 controls stand for.
_CONTROLS = "".join(unescape(f"&#{n};") for n in range(128, 160))

_ATTR_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]*+)"""


def tag_name(tok: str) -> str:
    return f"lower({extract(tok, '^</?([a-zA-Z][^ \\t\\r\\n\\f/>]*+)')})"


def _attr_prefix(name: str) -> str:
    """Everything up to and including ``name`` inside one tag, skipping whole attributes."""
    return (
        r"<[a-z][^\s/>]*+(?:[\s/]++(?!" + name + r"(?:[\s=/>]))[^\s=/>]++"
        r"(?:\s*+=\s*+" + _ATTR_VALUE + r")?+)*+[\s/]++" + name
    )


def attr(tok: str, name: str, low: str | None = None) -> str:
    """Decoded value of an attribute; NULL where the tag has no such value. ``low`` is the tag in lower case where that is known."""
    pattern = "(?is)^" + _attr_prefix(name) + r"\s*+=\s*+(" + _ATTR_VALUE + ")"

    def value(raw: str) -> str:
        bare = when(f"left({raw}, 1) IN ('\"', '\\'')", f"substr({raw}, 2, length({raw}) - 2)", raw)
        return when(f"{raw} <> ''", html_unescape(bare, "attribute"))

    # Most tags lack most attributes; a plain search is much cheaper than the pattern.
    return when(f"contains({tok}, '=') AND contains({low or f'lower({tok})'}, {lit(name)})", let(extract(tok, pattern), value))


def html_unescape(s: str, where: str | None = None) -> str:
    """Decode ``&name;``, ``&#n;`` and ``&#xh;``; unknown names stay as they are.

    In a "text" the longest old name at the start of a run is decoded without a semicolon too, in an "attribute" only one
    that is the whole run and stands before no equals sign.
    """

    def char(number: str) -> str:
        valid = f"{number} > 0 AND {number} < 1114112 AND NOT {number} BETWEEN 55296 AND 57343"
        plain = f"decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32')"
        return f"CASE WHEN {number} BETWEEN 128 AND 159 THEN substr({lit(_CONTROLS)}, CAST({number} - 127 AS INT), 1) WHEN {valid} THEN {plain} ELSE '' END"

    def named(name: str, names: str) -> str:
        return f"try_element_at(from_json({lit(names)}, 'map<string,string>'), {name})"

    def loose(piece: str) -> str:
        if where == "text":
            start = extract(piece, f"^&({'|'.join(LOOSE_NAMES)})")
            return let(start, lambda n: when(f"{n} <> ''", f"concat({named(n, _LOOSE)}, substr({piece}, length({n}) + 2))", piece))
        if where == "attribute":
            name = f"substr({piece}, 2)"
            return when(in_list(name, LOOSE_NAMES), named(name, _LOOSE), piece)
        return piece

    def decode(piece: str) -> str:
        name = extract(piece, "^&(#?[0-9a-zA-Z]++);?")
        decimal = f"try_cast({extract(piece, '^&#0*([0-9]{1,7});?$')} AS BIGINT)"
        hexadecimal = f"try_cast(conv(nullif({extract(piece, '^&#[xX]0*([0-9a-fA-F]{1,6});?$')}, ''), 16, 10) AS BIGINT)"
        return (
            f"CASE WHEN NOT startswith({piece}, '&') THEN {piece} "
            f"WHEN startswith({piece}, '&#') THEN {let(f'coalesce({decimal}, {hexadecimal}, 0)', char)} "
            f"WHEN endswith({piece}, ';') THEN coalesce({named(name, _ENTITIES)}, {loose(piece)}) ELSE {loose(piece)} END"
        )

    # Before an equals sign a name in an attribute is part of an address.
    after = "[;=]?" if where == "attribute" else ";?"
    pieces = rf"&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[a-zA-Z][a-zA-Z0-9]*+{after}|[^&]++|&"
    return let(
        s, lambda t: when(f"contains({t}, '&')", f"array_join({each(extract_all(t, pieces), decode)}, '')", t)
    )


def without_raw_blocks(html: str) -> str:
    """HTML with comments, scripts and styles replaced by a node break."""
    return replaced(html, RAW_BLOCK, NODE_BREAK)


def page_text(clean_html: str) -> str:
    """Visible text of HTML from which the raw blocks are already removed.

    Text nodes are trimmed, empty ones dropped, the rest joined by one space.
    """
    template = r"(?is)<template\b.*?(?:</template\s*+>|\z)"
    shown = when(matches(clean_html, "(?i)<template"), replaced(clean_html, template, NODE_BREAK), clean_html)
    nodes = html_unescape(replaced(shown, TAG, NODE_BREAK), "text")
    return py_strip(replaced(nodes, r"(?U)[\s\x1c-\x1f]*+\x01[\s\x01\x1c-\x1f]*+", " "))


def text_nodes(html: str) -> str:
    """All text and comment nodes (no script or style), parted by a node break."""
    pattern = _any_of(r"<!--(.*?)(?:-->|\z)", _SCRIPT, _STYLE, *_TAGS)
    return html_unescape(replaced(html, pattern, f"{NODE_BREAK}$1{NODE_BREAK}"), "text")


def count_tags(clean_html: str, tag: str) -> str:
    return f"regexp_count({clean_html}, {lit(rf'(?i)<{tag}[\s/>]')})"


def tags_with(clean_html: str, tag: str) -> str:
    """All opening tags of one name, in document order."""
    pattern = (
        rf"""(?is)<{tag}(?=[\s/>])[^<>"']*+(?:(?:"[^"]*+"|'[^']*+')[^<>"']*+)*+>"""
        rf"""|<{tag}(?=[\s/>])[^>]*+>"""
    )
    return extract_all(clean_html, pattern)


def count_class_matches(clean_html: str, word: str) -> str:
    """Number of opening tags whose class attribute holds a plain word."""
    value = rf"""(?:"[^"]*?{word}|'[^']*?{word}|[^\s"'>]*?{word})"""
    return f"regexp_count({clean_html}, {lit('(?is)' + _attr_prefix('class') + r'\s*+=\s*+' + value)})"


def is_challenge(body: str) -> str:
    return mentions(body, rules.CHALLENGE_MARKERS)


def visible_text(body: str) -> str:
    """Text from ``<body`` on, without script and style blocks and tags, blanks collapsed."""
    part = f"substr({body}, nullif(locate('<body', {body}), 0))"
    part = replaced(part, r"(?is)<script[^>]*+>.*?</script>", " ")
    part = replaced(part, r"(?is)<style[^>]*+>.*?</style>", " ")
    part = replaced(part, r"<[^>]++>", " ")
    return py_strip(replaced(part, r"(?U)[\s\x1c-\x1f]+", " "))


def is_csr_shell(body: str) -> str:
    return (
        f"CASE WHEN contains({body}, '<h1') OR NOT contains({body}, '<body') THEN false "
        f"ELSE length({visible_text(body)}) < {rules.SHELL_TEXT_LIMIT} END"
    )
