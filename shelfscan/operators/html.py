"""HTML pages as tables: tokens, elements and trees.

``html_tokens`` shreds a page with one pattern into tokens in document order. Elements come from the pass over a page's
tokens (see ``tree``), which knows each one's extent and the running count of text nodes at its start and end, so its
text is a slice of the page's text array.

``page_trees`` adds to every page the elements that the extractors look at, as small arrays in document order. It works
row by row: no page is shuffled, exploded or put together again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan import rules
from shelfscan.functions import markup as M
from shelfscan.functions.scalars import blank_to_null
from shelfscan.functions.sql import each, extract_all, in_list, let, lit, matches, only, replaced, when
from shelfscan.operators.tree import VOID_TAGS, page_nodes, page_parts
from shelfscan.session import ship, spread


def html_tokens(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, kind, tag, tok): comments, raw blocks, tags and text runs in document order.

    With ``keep`` columns a page without HTML still gives one row, with NULL tokens.
    """
    explode = "posexplode_outer" if keep else "posexplode"
    tokens = pages.selectExpr(key, *keep, f"{explode}({extract_all(html, M.TOKEN)}) AS (pos, tok)")
    tag = when("startswith(tok, '<')", blank_to_null(M.tag_name("tok")))
    kind = (
        "CASE WHEN tok IS NULL THEN NULL WHEN startswith(tok, '<!--') THEN 'comment' "
        "WHEN startswith(tok, '<!') OR startswith(tok, '<?') THEN 'doctype' WHEN tag IS NULL THEN 'text' "
        "WHEN startswith(tok, '</') THEN 'close' WHEN tag IN ('script', 'style') THEN 'raw' "
        f"WHEN {in_list('tag', sorted(VOID_TAGS))} OR endswith(tok, '/>') THEN 'void' ELSE 'open' END"
    )
    return tokens.selectExpr("*", f"{tag} AS tag").selectExpr("*", f"{kind} AS kind")


def html_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Elements with their extent: (key, pos, end, lvl, tag, tok, kind, k0, k1, ...).

    ``k0``/``k1`` count the page's visible text nodes before the start and before the
    end; the other pairs count table cells, dt and dd. An element without an end runs
    to the end of the page (``end`` and ``k1`` are NULL there).
    """
    ship(pages.sparkSession)
    nodes = pages.select(key, page_nodes(html).alias("nodes")).selectExpr(key, "inline(nodes.elements)")
    return nodes.select(
        key, "pos", "end", "lvl", "tag", "tok", "kind", "k0", "k1", "cell0", "cell1", "dt0", "dt1", "dd0", "dd1", "inside"
    )


def slice_to(items: str, start: str, end: str) -> str:
    """Items number start+1 .. end; to the last one where ``end`` is NULL."""
    return f"slice({items}, {start} + 1, greatest(coalesce({end}, size({items})) - {start}, 0))"


def span_text(span: str, texts: str = "texts", sep: str = "") -> str:
    """Text of an element; NULL where there is no such element."""
    return when(f"{span} IS NOT NULL", f"array_join({slice_to(texts, f'{span}.k0', f'{span}.k1')}, {lit(sep)})")


def _of(e: str, cond: str) -> str:
    """``cond`` over tag, tok, kind and lvl as one over the fields of ``e``; quoted text stays as it is."""
    return re.sub(r"'(?:[^'\\]|\\.)*'|\b(tag|tok|kind|lvl)\b", lambda m: f"{e}.{m[1]}" if m[1] else m[0], cond)


def element_texts(pages: DataFrame, where: str, key: str = "page_id", html: str = "html", sep: str = "") -> DataFrame:
    """(key, pos, tag, text) of the elements that hold ``where`` (over tag, tok, kind, lvl).

    A page is shuffled as one row with what is wanted of it; pages of one key count as one.
    """
    ship(pages.sparkSession)
    wanted = f"transform({only('nodes.elements', lambda e: _of(e, where))}, e -> struct(e.pos, e.tag, e.k0, e.k1))"
    rows = pages.select(key, page_nodes(html).alias("nodes")).selectExpr(key, "nodes.texts AS t", f"{wanted} AS e")
    return (
        spread(rows, key)
        .groupBy(key)
        .agg(F.expr("sort_array(flatten(collect_list(t)))").alias("t"), F.expr("sort_array(flatten(collect_list(e)))").alias("e"))
        .selectExpr(key, "t.txt AS texts", "explode(e) AS e")
        .selectExpr(key, "e.pos AS pos", "e.tag AS tag", f"{span_text('e', sep=sep)} AS text")
    )


def page_trees(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with their text nodes and the elements that matter, as arrays in document order.

    A page without HTML gets empty arrays.
    """
    ship(pages.sparkSession)
    columns = pages.columns
    pages = pages.withColumn("nodes", page_parts(html))

    # Attributes are read only where the name occurs in the tag.
    def attribute(e: str, name: str) -> str:
        return M.attr(f"{e}.tok", name, f"{e}.low")

    def lowered(e: str) -> str:
        return f"struct({e}.pos, {e}.tag, {e}.tok, {e}.k0, {e}.k1, if(contains({e}.tok, '='), lower({e}.tok), '') AS low)"

    def seen(e: str) -> str:
        read = ", ".join(f"{attribute(e, name)} AS {name}" for name in ("class", "id", "itemprop", "content"))
        a = when(f"{e}.low <> ''", f"struct({read})")
        return f"struct({e}.pos, {e}.tag, {e}.tok, {e}.low, {e}.k0, {e}.k1, {a} AS a)"

    def comment(n: str) -> str:
        return replaced(f"{n}.tok", r"^<!--|-->\z", "")

    def label(n: str) -> str:
        node = f"CASE {n}.kind WHEN 'text' THEN {M.html_unescape(f'{n}.tok', 'text')} WHEN 'comment' THEN {comment(n)} END"
        # A label counts only near the start of its text, so the rest of a long one is not searched.
        near = lambda t: when(matches(t, f"(?s)^.{{0,{rules.LABEL_START_LIMIT}}}?(?:{rules.SKU_LABEL})"), f"regexp_instr({t}, {lit(rules.SKU_LABEL)}) - 1")
        at = let(node, near)
        return f"struct({n}.pos, {at} AS at, {n}.held, {n}.pk0, {n}.pk1, {n}.beside, {n}.sk0, {n}.sk1, {n}.script)"

    found = pages.selectExpr(
        *columns,
        "nodes.texts.txt AS texts",
        f"{each(each('nodes.tags', lowered), seen)} AS tags",
        f"{only(each('nodes.labels', label), lambda x: f'{x}.at >= 0')} AS labels",
        *[f"nodes.{name} AS {name}" for name in ("ps", "cells", "dts", "dds", "trs", "dls")],
    )

    def listed(cond: str, *fields: str) -> str:
        """The tags ``e`` that hold ``cond``."""
        return f"transform(filter(tags, e -> {cond}), e -> struct(e.pos, {', '.join(fields)}))"

    def first_span(cond: str) -> str:
        return f"try_element_at({listed(cond, 'e.k0', 'e.k1')}, 1)"

    price_like = "coalesce(e.a.class, e.a.id) IS NOT NULL AND " + matches("concat(coalesce(e.a.class, ''), ' ', coalesce(e.a.id, ''))", rules.PRICE_CLASS)
    src = f"coalesce({', '.join(blank_to_null(attribute('e', a)) for a in ('src', 'data-src', 'data-zoom-image'))})"
    arrays = {
        "h1": first_span("e.tag = 'h1'"),
        "metas": listed("e.tag = 'meta'", f"{attribute('e', 'property')} AS property", f"{attribute('e', 'name')} AS name", "e.a.content AS content"),
        "itemprops": listed("e.a.itemprop IS NOT NULL", "e.a.itemprop AS prop", "e.a.content AS content", "e.k0", "e.k1"),
        "prices": listed(price_like, "e.k0", "e.k1"),
        "brand_class": first_span(matches("e.a.class", rules.BRAND_ATTRIBUTE)),
        "brand_id": first_span(matches("e.a.id", rules.BRAND_ATTRIBUTE)),
        "imgs": listed("e.tag = 'img'", f"{src} AS src", f"{attribute('e', 'src')} AS plain_src", f"{attribute('e', 'alt')} AS alt"),
    }
    return found.selectExpr(*columns, "texts", "labels", "ps", "cells", "dts", "dds", "trs", "dls", *[f"{value} AS {name}" for name, value in arrays.items()])
