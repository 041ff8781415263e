"""Matches of a pattern with their places, as Spark SQL expressions.

``split`` gives what stands between the leftmost non-overlapping matches and ``regexp_extract_all`` the
matches; running lengths give the places, in code points. They are summed in blocks, so that a long text
full of matches is not copied for each of them.
"""

from __future__ import annotations

SPAN = "array<struct<kind: string, start: bigint, end: bigint, found: string>>"


#: Matches of a block, and code points of a piece of text.
BLOCK, PIECE = 256, 1024


def bound(value: str, name: str) -> str:
    """The beginning of an expression that works ``value`` out once, as ``name``; ends with ``-> ...)[0]``."""
    return f"transform(array({value}), {name}"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, kind: str, gate: str, keep: str = "true") -> str:
    """Array of structs ``kind, start, end, found``. ``gate``: a cheap condition that every text with a match fulfils.

    ``keep`` is a condition on ``s.found``.
    """
    p = quoted(pattern)
    parts = f"zip_with(split({text}, {p}, -1), array_append(regexp_extract_all({text}, {p}, 0), ''), (g, h) -> named_struct('gap', g, 'hit', h))"
    block = f"""aggregate(slice(z, k * {BLOCK} + 1, {BLOCK}), named_struct('at', 0L, 'out', CAST(array() AS {SPAN})),
          (acc, m) -> named_struct(
            'at', acc.at + char_length(m.gap) + char_length(m.hit),
            'out', if(m.hit = '', acc.out, array_append(acc.out, named_struct(
                'kind', '{kind}', 'start', acc.at + char_length(m.gap), 'end', acc.at + char_length(m.gap) + char_length(m.hit), 'found', m.hit)))))"""
    blocks = f"transform(sequence(0, CAST((size(z) - 1) DIV {BLOCK} AS int)), k -> {block})"
    ahead = "aggregate(slice(y, 1, size(y) - 1), array(0L), (a, b) -> array_append(a, element_at(a, -1) + b.at))"
    moved = "transform(b.out, s -> named_struct('kind', s.kind, 'start', s.start + o, 'end', s.end + o, 'found', s.found))"
    placed = f"{bound(blocks, 'y')} -> if(size(y) = 1, y[0].out, flatten(zip_with({ahead}, y, (o, b) -> {moved}))))[0]"
    return f"""
    filter(
      if({gate}, {bound(parts, 'z')} -> {placed})[0], CAST(array() AS {SPAN})),
      s -> {keep})"""


def pieces(text: str) -> str:
    """``text`` in pieces of ``PIECE`` code points."""
    return f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}+', 0)"


def around(spans: str, text: str, left: int = 40) -> str:
    """The spans with up to ``left`` (at most ``PIECE``) code points before and one after each.

    They are cut from pieces of the text, so that a span's cost does not grow with its place.
    """
    before = "concat(if(n > 0, p[n - 1], ''), coalesce(get(p, n), ''))"
    shift = f"s.start - greatest(0, n - 1) * {PIECE}"
    cut = f"""transform(array(CAST(s.start DIV {PIECE} AS int)), n -> substr({before}, CAST(greatest(1, {shift} - {left - 1}) AS int), CAST(least({left}, s.start) AS int)))[0]"""
    after = f"substr(coalesce(get(p, CAST(s.end DIV {PIECE} AS int)), ''), CAST(s.end % {PIECE} + 1 AS int), 1)"
    each = f"transform({spans}, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'found', s.found, 'left', {cut}, 'right', {after}))"
    cuts = f"if(size({spans}) = 0, CAST(array() AS array<string>), {pieces(text)})"
    return f"{bound(cuts, 'p')} -> {each})[0]"


def written(spans: str) -> str:
    """``kind:start:end`` of the spans in their order, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def by_start(spans: str, kinds: list[str]) -> str:
    """Spans ordered by start, then by kind as listed, then by end."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    keyed = f"transform({spans}, s -> named_struct('a', s.start, 'b', array_position(array({listed}), s.kind), 'c', s.end, 's', s))"
    return f"transform(array_sort({keyed}), k -> k.s)"


def by_kind(spans: str, kinds: list[str]) -> str:
    """Spans ordered by kind as listed, then by start and end."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    keyed = f"transform({spans}, s -> named_struct('a', array_position(array({listed}), s.kind), 'b', s.start, 'c', s.end, 's', s))"
    return f"transform(array_sort({keyed}), k -> k.s)"
