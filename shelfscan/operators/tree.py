"""The tree of a page by one pass over its tokens with a stack of open elements.

Pages leave end tags out, close what was never opened and nest tags crosswise. The rules are those of the common
forgiving parsers: a start tag first closes what cannot hold it, an end tag closes everything up to its element unless
something stronger stands between, and is ignored otherwise. Along the way every element learns its extent, parent's
text, next sibling and innermost table, so nothing has to be searched for afterwards; a page costs time in proportion
to its tokens and their depth. Each row of a batch is one page, spread by Spark; nothing is kept between pages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscan import rules
from shelfscan.functions import markup as M

# Element names of the HTML standard, by how their end is found.
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# An open element (left) that is the innermost one is closed by these start tags.
CLOSED_BY = {
    "a": "a fieldset table td th",
    "address": "dd dl dt form li ul",
    "b": "center p td th",
    "big": "p",
    "caption": "col colgroup tbody tfoot thead tr",
    "colgroup": "colgroup tbody tfoot thead tr",
    "dd": "dt",
    "dir": "dd dl dt form ul",
    "dl": "form li",
    "dt": "dd dl",
    "font": "center td th",
    "form": "form",
    **{h: "fieldset form li p table" for h in HEADINGS},
    "head": "a abbr acronym address b bdo big blockquote body br center cite code dd dfn dir div dl dt em fieldset font form frameset "
    "h1 h2 h3 h4 h5 h6 hr i iframe img kbd li listing map menu ol p pre q s samp small span strike strong sub sup table tt u ul var xmp",
    "i": "center",
    "legend": "fieldset",
    "li": "li",
    "menu": "dd dl dt form ul",
    "ol": "form",
    "option": "optgroup option",
    "p": "address blockquote body caption center col colgroup dd dir div dl dt frameset h1 h2 h3 h4 h5 h6 head hr li listing menu "
    "multicol ol p pre table tbody td tfoot th title tr ul xmp",
    "pre": "dd dl dt fieldset form li table ul",
    "s": "p",
    "small": "p",
    "span": "td th",
    "strike": "p",
    "tbody": "tbody tfoot",
    "td": "tbody td tfoot th tr",
    "tfoot": "tbody",
    "th": "tbody td tfoot th tr",
    "thead": "tbody tfoot",
    "title": "body frameset",
    "tr": "tbody tfoot tr",
    "tt": "p",
    "u": "p td th",
    "ul": "address form menu ol pre",
}
_CLOSED_BY = {name: frozenset(by.split()) for name, by in CLOSED_BY.items()}
_NOTHING: frozenset[str] = frozenset()
# An end tag does not reach past an open element of more strength; all others have 100.
STRENGTH = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}

FIELDS = {
    "texts": "pos INT, txt STRING",
    "elements": "pos INT, kind STRING, tag STRING, tok STRING, end INT, lvl INT, k0 INT, k1 INT, cell0 INT, cell1 INT, "
    "dt0 INT, dt1 INT, dd0 INT, dd1 INT, inside INT",
    "notes": "pos INT, kind STRING, tok STRING, held BOOLEAN, pk0 INT, pk1 INT, beside INT, sk0 INT, sk1 INT, script STRING",
}
_SPAN = "pos INT, k0 INT, k1 INT"
#: What the extractors look at: elements by name with counts alone, and ``tags`` whose attributes are read.
PARTS = {
    "texts": "txt STRING",
    "tags": "pos INT, tag STRING, tok STRING, k0 INT, k1 INT",
    "labels": FIELDS["notes"],
    **dict.fromkeys(("ps", "cells", "dts", "dds"), _SPAN),
    "trs": "pos INT, c0 INT, c1 INT, inside INT",
    "dls": "pos INT, dt0 INT, dt1 INT, dd0 INT, dd1 INT",
}
_SPANS = {"p": "ps", "td": "cells", "th": "cells", "dt": "dts", "dd": "dds"}
#: Elements that are looked at without any attribute too.
_ALWAYS = frozenset(("h1", "meta", "img"))
#: Pages, and characters of them, that are held as rows at once, whatever the size of a batch.
PAGES, CHARACTERS = 256, 1 << 20
_ELEMENTS = ("open", "void", "raw")
_OPEN = (None,) * 4
#: Kinds of tokens shorter than this are remembered, as pages repeat their tags.
_KNOWN = 48

_TOKEN = re.compile(M.TOKEN.replace(r"\z", r"\Z"), re.ASCII)
_NAME = re.compile(r"</?([a-zA-Z][^ \t\r\n\f/>]*)")
_ENTITY = re.compile(r"&(?:#([0-9]+);?|#[xX]([0-9a-fA-F]+);?|([a-zA-Z][a-zA-Z0-9]*;?))")
_LONGEST_LOOSE = len(M.LOOSE_NAMES[0])
#: Finds at least the labels that Spark finds, in texts without other letters and without references to such.
_LABEL = re.compile(rules.SKU_LABEL.replace("(?iU)", "(?i)"))
_SCRIPT_TAGS = re.compile(r"^<[^>]*>|</[a-z]+\s*>\Z", re.IGNORECASE | re.DOTALL | re.ASCII)


def _decoded(m: re.Match) -> str:
    decimal, hexadecimal, name = m.groups()
    if name:
        if name in html5:
            return html5[name]
        starts = (name[:k] for k in range(_LONGEST_LOOSE, 1, -1))
        start = next((s for s in starts if s in html5), None)
        return m[0] if start is None else html5[start] + name[len(start) :]
    digits = (decimal or hexadecimal).lstrip("0")
    code = int(digits or "0", 10 if decimal else 16) if len(digits) <= (7 if decimal else 6) else 0
    if 128 <= code < 160:
        return unescape(f"&#{code};")
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else ""


def kind_of(tok: str) -> tuple[str, str | None]:
    """Kind and tag name of a token."""
    if tok[0] != "<":
        return "text", None
    if tok.startswith("<!--"):
        return "comment", None
    if tok[1:2] in ("!", "?"):
        return "doctype", None
    found = _NAME.match(tok)
    if not found:
        return "text", None
    tag = found[1].lower()
    if tok[1] == "/":
        return "close", tag
    if tag in ("script", "style"):
        return "raw", tag
    return ("void" if tag in VOID_TAGS or tok.endswith("/>") else "open"), tag


@lru_cache(maxsize=4096)
def _known_kind(tok: str) -> tuple[str, str | None]:
    return kind_of(tok)


class Page:
    """Columns of the tokens of one page, in document order."""

    def __init__(self, html: str) -> None:
        self.toks = _TOKEN.findall(html)
        n = len(self.toks)
        self.kinds: list[str] = []
        self.tags: list[str | None] = []
        self.texts: list[str | None] = [None] * n
        self.shown = [False] * n
        self.end: list[int | None] = [None] * n
        self.level = [0] * n
        self.parent = [-1] * n
        self.beside: list[int | None] = [None] * n
        self.inside: list[int | None] = [None] * n
        # Texts, cells, dt and dd up to each token.
        self.counts: list[tuple[int, int, int, int]] = []
        self._read()

    def _read(self) -> None:
        kinds, tags, texts, end, counts = self.kinds, self.tags, self.texts, self.end, self.counts
        stack: list[int] = []
        tables: list[int] = []
        last_child: dict[int, int] = {}
        text = cell = dt = dd = templates = 0
        count = (0, 0, 0, 0)

        def close(i: int) -> None:
            nonlocal templates
            j = stack.pop()
            end[j] = i
            if tables and tables[-1] == j:
                tables.pop()
            templates -= tags[j] == "template"

        for i, tok in enumerate(self.toks):
            kind, tag = _known_kind(tok) if len(tok) < _KNOWN else kind_of(tok)
            kinds.append(kind)
            tags.append(tag)
            if kind == "text":
                shown = (_ENTITY.sub(_decoded, tok) if "&" in tok else tok).strip()
                texts[i] = shown
                if shown and not templates:
                    self.shown[i] = True
                    text += 1
                    count = (text, cell, dt, dd)
            elif kind == "close":
                strength = STRENGTH.get(tag, 100)
                for j in reversed(stack):
                    if tags[j] == tag:
                        while stack[-1] != j:
                            close(i)
                        close(i)
                        break
                    if STRENGTH.get(tags[j], 100) > strength:
                        break
            elif kind in _ELEMENTS:
                while stack and tag in _CLOSED_BY.get(tags[stack[-1]], _NOTHING):
                    close(i)
                above = stack[-1] if stack else -1
                if above in last_child:
                    self.beside[last_child[above]] = i
                last_child[above] = i
                self.level[i] = len(stack) + 1
                if kind == "open":
                    if tag in ("td", "th", "dt", "dd"):
                        cell += tag in ("td", "th")
                        dt += tag == "dt"
                        dd += tag == "dd"
                        count = (text, cell, dt, dd)
                    templates += tag == "template"
                    if tables:
                        self.inside[i] = tables[-1]
                    if tag == "table":
                        tables.append(i)
                else:
                    end[i] = i
            self.parent[i] = stack[-1] if stack else -1
            if kind == "open":
                stack.append(i)
            counts.append(count)

    def rows(self, add: list[list[tuple]], noted: bool = True) -> None:
        """Append the shown texts, the elements and, where ``noted``, the texts and comments, as rows of ``FIELDS``."""
        texts, elements, notes = add[:3]
        counts, end, tags, toks = self.counts, self.end, self.tags, self.toks
        for i, kind in enumerate(self.kinds):
            if kind in _ELEMENTS:
                k0, c0, t0, d0 = counts[i]
                stop = end[i]
                k1, c1, t1, d1 = _OPEN if stop is None else counts[stop]
                elements.append((i, kind, tags[i], toks[i], stop, self.level[i], k0, k1, c0, c1, t0, t1, d0, d1, self.inside[i]))
                continue
            if self.shown[i]:
                texts.append((i, self.texts[i]))
            if noted and kind in ("text", "comment"):
                notes.append((i, kind, toks[i], *self._around(i)))

    def parts(self, add: dict[str, list[tuple]]) -> None:
        """Append what the extractors look at, as rows of ``PARTS``; other elements, and texts that hold no label, are left out."""
        texts, listed, labels, trs, dls = add["texts"], add["tags"], add["labels"], add["trs"], add["dls"]
        counts, end, tags, toks, shown = self.counts, self.end, self.tags, self.toks, self.shown
        for i, kind in enumerate(self.kinds):
            if kind == "text" or kind == "comment":
                tok = toks[i]
                if shown[i]:
                    texts.append((self.texts[i],))
                if "&" in tok or not tok.isascii() or _LABEL.search(tok):
                    labels.append((i, kind, tok, *self._around(i)))
            elif kind == "open" or kind == "void":
                tag, stop = tags[i], end[i]
                start, last = counts[i], _OPEN if stop is None else counts[stop]
                if tag in _SPANS:
                    add[_SPANS[tag]].append((i, start[0], last[0]))
                elif tag == "tr":
                    trs.append((i, start[1], last[1], self.inside[i]))
                elif tag == "dl":
                    dls.append((i, start[2], last[2], start[3], last[3]))
                if tag in _ALWAYS or "=" in toks[i]:
                    listed.append((i, tag, toks[i], start[0], last[0]))

    def _around(self, i: int) -> tuple:
        """Of a text or comment: whether it is held, the text range of its element, and what stands beside that."""
        p = self.parent[i]
        if p < 0:
            return (None,) * 7
        counts, end, s = self.counts, self.end, self.beside[p]
        held = (True, counts[p][0], None if end[p] is None else counts[end[p]][0])
        if s is None:
            return *held, None, None, None, None
        script = _SCRIPT_TAGS.sub("", self.toks[s]).strip() if self.kinds[s] == "raw" else None
        return *held, s, counts[s][0], None if end[s] is None else counts[end[s]][0], script


_KINDS = {"INT": (T.IntegerType(), pa.int32()), "STRING": (T.StringType(), pa.string()), "BOOLEAN": (T.BooleanType(), pa.bool_())}


def _split(tables: dict[str, str]) -> dict[str, list[list[str]]]:
    return {part: [f.split(" ") for f in fields.split(", ")] for part, fields in tables.items()}


def _type(tables: dict[str, str]) -> T.StructType:
    """A page as a struct of lists."""
    listed = {part: T.ArrayType(T.StructType([T.StructField(name, _KINDS[kind][0]) for name, kind in fields])) for part, fields in _split(tables).items()}
    return T.StructType([T.StructField(part, kind) for part, kind in listed.items()])


def _listed(fields: list[list[str]], rows: list[tuple], offsets: list[int]) -> pa.Array:
    """Rows of all pages as one list a page."""
    columns = zip(*rows) if rows else [()] * len(fields)
    arrays = [pa.array(c, _KINDS[kind][1]) for c, (_, kind) in zip(columns, fields)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, [name for name, _ in fields]))


def _structs(tables: dict[str, str], pages: Iterable[Callable[[dict[str, list[tuple]]], None]]) -> pa.Array:
    """One struct a page, each of which appends its rows."""
    rows: dict[str, list[tuple]] = {part: [] for part in tables}
    offsets = {part: [0] for part in tables}
    for append in pages:
        append(rows)
        for part, some in rows.items():
            offsets[part].append(len(some))
    fields = _split(tables)
    return pa.StructArray.from_arrays([_listed(fields[part], rows[part], offsets[part]) for part in tables], list(tables))


def _read_pages(pages: Iterable[str | None], noted: Iterable[bool | None]) -> pa.Array:
    return _structs(FIELDS, (lambda add, html=html, wanted=wanted: Page(html or "").rows(list(add.values()), bool(wanted)) for html, wanted in zip(pages, noted)))


def _few(html: pa.Array, noted: pa.Array) -> Iterator[tuple[list[str | None], list[bool | None]]]:
    """A batch in runs of at most ``PAGES`` pages and, but for a single longer page, ``CHARACTERS`` characters."""
    pages: list[str | None] = []
    wanted: list[bool | None] = []
    size = 0
    for a, b in zip(html, noted):
        page = a.as_py()
        if pages and (len(pages) >= PAGES or size + len(page or "") > CHARACTERS):
            yield pages, wanted
            pages, wanted, size = [], [], 0
        pages.append(page)
        wanted.append(b.as_py())
        size += len(page or "")
    if pages:
        yield pages, wanted


def _read_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html, noted in batches:
        for pages, wanted in _few(html, noted):
            yield _read_pages(pages, wanted)


@F.arrow_udf(_type(FIELDS))
def _page_nodes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from _read_batches(batches)


@F.arrow_udf(_type(PARTS))
def _page_parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for html in batches:
        for pages, _ in _few(html, pa.nulls(len(html), pa.bool_())):
            yield _structs(PARTS, (lambda add, html=html: Page(html or "").parts(add) for html in pages))


# Spark copies what it takes for repeatable into filters that it makes by itself and pushes down, below a shuffle too:
# each page would be read twice, the first time by as few tasks as the input has splits.
_page_nodes = _page_nodes.asNondeterministic()
_page_parts = _page_parts.asNondeterministic()


def page_nodes(html: str = "html", noted: bool = False) -> Column:
    """A page as a struct of three arrays in document order, all empty for a page without HTML.

    ``texts`` are the shown text nodes. ``elements`` have their extent [pos, end), level and the running counts of texts,
    cells, dt and dd at both ends, all NULL at the end where one is open to the last; ``inside`` is the table around it.
    ``notes`` are, where they are asked for by ``noted``, all texts and comments: one in an element (``held``) has the text
    range of that element, and of the element beside it (``beside``), or that one's ``script``.
    """
    return _page_nodes(F.col(html), F.lit(noted))


def page_parts(html: str = "html") -> Column:
    """A page as a struct of the arrays of ``PARTS`` in document order, all empty for a page without HTML.

    ``texts``, and the extents and counts as in ``page_nodes``. ``tags`` are those with attributes, and all of h1, meta and
    img; ``labels`` are the ``notes`` that can hold an SKU label.
    """
    return _page_parts(F.col(html))
