"""Licence scans: ordered signature rules behind a keyword prefilter.

Rules are hand-written forms (title, grant, tag, address, package field, body passage) of named licence families
with their versions. A row that holds none of the words that a rule needs, one word a rule, is never matched. Each rule is a
regular expression over the row's words (SPDX identifiers, short names after a form, glued versions, optional
words), with a priority, and is tried where its first word stands; a field ("license": "MIT") or an identifier
(Apache-2.0) also wants its punctuation. A detection whose word interval lies inside one of
another rule with higher priority, or with the same priority and more words, is suppressed.

Words: A-Z lower-cased, maximal runs of digits, a-z and everything beyond ASCII. Null or empty text has
no words and no labels. Repeated rows give repeated rows; a null ``doc_id`` stays null. Only the named
columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm import words
from shelfscan.llm.common import chunks, ship, text_buffers

#: Base phrases and labels, as the contract of the query gives them.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Families: label, names as words, versions ("" is the name alone).
FAMILIES = (
    ("mit", ("mit license", "expat license", "x11 license"), ("",)),
    ("apache", ("apache license", "apache software license"), ("", "1 0", "1 1", "2 0")),
    ("gpl", ("gnu general public license", "general public license", "gnu gpl", "gpl"), ("", "1 0", "2", "2 0", "3", "3 0")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "lesser general public license", "gnu lgpl", "lgpl"), ("", "2", "2 0", "2 1", "3", "3 0")),
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("", "1 0", "3", "3 0")),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("", "1 1", "1 2", "1 3")),
    ("bsd", ("bsd license", "berkeley software distribution license", "bsd 2 clause license", "bsd 3 clause license", "bsd 4 clause license", "simplified bsd license", "new bsd license", "modified bsd license"), ("",)),
    ("mpl", ("mozilla public license", "mpl"), ("", "1 0", "1 1", "2 0")),
    ("epl", ("eclipse public license", "epl"), ("", "1 0", "2 0")),
    ("cpl", ("common public license",), ("", "1 0")),
    ("cddl", ("common development and distribution license", "cddl"), ("", "1 0", "1 1")),
    ("eupl", ("european union public license", "european union public licence", "eupl"), ("", "1 0", "1 1", "1 2")),
    ("artistic", ("artistic license",), ("", "1 0", "2 0")),
    ("boost", ("boost software license",), ("", "1 0")),
    ("isc", ("isc license",), ("",)),
    ("zlib", ("zlib license", "zlib libpng license"), ("",)),
    ("unlicense", ("the unlicense",), ("",)),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl"), ("", "2")),
    ("python", ("python software foundation license", "psf license"), ("", "2")),
    ("ofl", ("sil open font license", "open font license"), ("", "1 0", "1 1")),
    ("ms-pl", ("microsoft public license",), ("",)),
    ("ms-rl", ("microsoft reciprocal license",), ("",)),
    ("osl", ("open software license",), ("", "1 0", "2 0", "2 1", "3 0")),
    ("afl", ("academic free license",), ("", "1 2", "2 0", "2 1", "3 0")),
    ("odbl", ("open database license", "odbl"), ("", "1 0")),
    ("cc0", ("cc0", "creative commons zero"), ("", "1 0")),
    ("cc-by", ("creative commons attribution license", "creative commons attribution", "cc by"), ("", "1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", ("creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"), ("", "1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", ("creative commons attribution noderivatives", "creative commons attribution no derivatives", "cc by nd"), ("", "1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"), ("", "1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", ("creative commons attribution noncommercial sharealike", "cc by nc sa"), ("", "1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", ("creative commons attribution noncommercial noderivatives", "cc by nc nd"), ("", "1 0", "2 0", "2 5", "3 0", "4 0")),
    ("proprietary", ("all rights reserved",), ("",)),
)
#: Passages from the bodies of licences.
BODIES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "dedicated to the public domain"),
)
#: Names that tell a licence only after a form.
SHORT = {
    "mit": ("mit", "expat", "x11"), "apache": ("apache", "asl"), "gfdl": ("gnu fdl", "fdl"), "bsd": ("bsd", "0bsd"), "artistic": ("artistic",), "boost": ("bsl", "boost"),
    "cpl": ("cpl",), "isc": ("isc",), "zlib": ("zlib", "zlib acknowledgement"), "unlicense": ("unlicense",), "python": ("psf", "python"), "ofl": ("ofl", "sil ofl"), "ms-pl": ("ms pl",),
    "ms-rl": ("ms rl",), "osl": ("osl",), "afl": ("afl",), "proprietary": ("proprietary",),
}
#: Names that count in a package field and before "license" or "licensed": none is a word of common speech there.
FIELD = {
    "mit": ("mit",), "apache": ("apache",), "gpl": ("gpl",), "lgpl": ("lgpl",), "agpl": ("agpl",), "bsd": ("bsd", "0bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause"), "mpl": ("mpl",),
    "epl": ("epl",), "eupl": ("eupl",), "isc": ("isc",), "zlib": ("zlib",), "unlicense": ("unlicense",), "wtfpl": ("wtfpl",), "cc0": ("cc0",), "python": ("psf",), "boost": ("bsl",),
}
#: Words of the addresses that name a licence by themselves.
ADDRESSES = (
    ("apache-2.0", "apache org licenses license 2 0"), ("apache-1.1", "apache org licenses license 1 1"), ("apache-1.0", "apache org licenses license 1 0"),
    ("mpl-2.0", "mozilla org mpl 2 0"), ("mpl-2.0", "mozilla org en us mpl 2 0"), ("mpl-1.1", "mozilla org mpl 1 1"), ("mpl-1.1", "mozilla org mpl mpl 1 1"),
    ("epl-1.0", "eclipse org legal epl v10"), ("epl-2.0", "eclipse org legal epl v20"), ("epl-2.0", "eclipse org legal epl 2 0"), ("boost-1.0", "boost org license 1 0"),
    ("unlicense", "unlicense org"), ("cc0-1.0", "creativecommons org publicdomain zero 1 0"), ("wtfpl", "wtfpl net"), ("ofl-1.1", "scripts sil org ofl"), ("odbl-1.0", "opendatacommons org licenses odbl"),
)
#: Short names that need no form before them.
CLAUSES = {"bsd": ("bsd 2 clause", "bsd 3 clause", "bsd 4 clause")}
#: What stands before a name: as words, as a pattern, and how much the form is worth. Higher priority wins.
FORMS = (
    ("spdx license identifier", "spdx licen[sc]e identifier", 40, 1.0),
    ("spdx license identifier zlib and", "spdx licen[sc]e identifier (?:[0-9a-z.]+ ){1,12}?(?:or|and|with)", 40, 1.0),
    *((f"{w} under the", w.replace("licens", "licen[sc]") + " under(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?", 30, 0.95) for w in ("licensed", "released", "distributed", "available", "published", "provided", "covered", "governed")),
    ("under the terms of the", "under the terms(?: and conditions)? of(?: the| an?)?", 30, 0.95),
    *((words, pattern, 35, 1.0) for words, pattern in (
        ("opensource org licenses", "opensource org licenses?"), ("spdx org licenses", "spdx org licenses"), ("choosealicense com licenses", "choosealicense com licenses"),
        ("gnu org licenses", "gnu org (?:licenses|copyleft)(?: old licenses)?"),
    )),
    ("license", "licen[sc]e", 25, 0.9),
    ("", "", 10, 0.8),
)
#: The form of a package field.
OF_FIELD = "licen[sc]e"
SHORT_ALONE = {"gpl", "lgpl", "agpl", "mpl", "epl"}  # too short to count without a form before or a version after
#: Between a name and its version, and after it. A version may be glued to the name, with or without v.
BETWEEN = "(?: licen[sc]e)?(?: as published by the free software foundation)?(?: either)?(?: version | v| |v|)"
AFTER = "(?: only| or(?: any)? later(?: version)?)?"


def _spelled(words: str) -> str:
    return re.sub(r"\blicen[sc]e\b", "licen[sc]e", words)


@lru_cache(1)
def signatures() -> tuple[tuple[tuple[str, ...], str, int, float, str], ...]:
    """All rules in order: words of an example, label, priority, score, and a pattern over words with a blank between.

    A detection is the group ``at`` of the pattern.
    """
    out = {}
    for example, form, priority, score in FORMS:
        for label, names, versions in FAMILIES:
            known = FIELD.get(label, ()) if form == OF_FIELD else (*names, *CLAUSES.get(label, ()), *(SHORT.get(label, ()) if form else ()))
            if not known:
                continue
            for version in versions:
                full, value = (f"{label}-{version.replace(' ', '.')}", priority + 5) if version else (label, priority)
                tail = BETWEEN + version + AFTER if version else ""
                if form:
                    anyone = "(?:" + "|".join(map(_spelled, sorted(known, key=len, reverse=True))) + ")"
                    start = f"{form} (?P<at>" if "identifier (" in form else f"(?P<at>{form} "
                    out.setdefault(tuple(f"{example} {known[0]} {version}".split()), (full, value, score, f"{start}{anyone}{tail})"))
                    continue
                for name in known:
                    if not version and name in SHORT_ALONE:
                        continue
                    pattern = f"(?P<at>{_spelled(name)}{tail})"
                    for between in ("", "version ", "v"):
                        out.setdefault(tuple(f"{name} {between if version else ''}{version}".split()), (full, value, score, pattern))
                    if version and " " not in name:
                        for between in ("", "v"):
                            out.setdefault(tuple(f"{name}{between}{version}".split()), (full, value, score, pattern))
                    if "license" in name.split():
                        out.setdefault(tuple(f"{name.replace('license', 'licence')} {version}".split()), (full, value, score, pattern))
    for label, names in FIELD.items():
        for name in names:
            for word in ("license", "licence", "licensed", "licenced"):
                out.setdefault((*name.split(), word), (label, 12, 0.8, f"(?P<at>{name} licen[sc]ed?)"))
    for label, names, versions in FAMILIES:
        if label.startswith("cc-"):
            path = f"creativecommons org licenses {label[3:].replace('-', ' ')}"
            for version in versions:
                full = f"{label}-{version.replace(' ', '.')}" if version else label
                out.setdefault(tuple(f"{path} {version}".split()), (full, 35 + 5 * bool(version), 1.0, f"(?P<at>{path}{' ' * bool(version)}{version})"))
        if label == "apache":
            for version in filter(None, versions):
                out.setdefault(("apache", *version.split()), (f"apache-{version.replace(' ', '.')}", 15, 0.8, f"(?P<at>apache {version})"))
    for label, path in ADDRESSES:
        out.setdefault(tuple(path.split()), (label, 40, 1.0, f"(?P<at>{path})"))
    for label, body in BODIES:
        out.setdefault(tuple(body.split()), (label, 50, 1.0, f"(?P<at>{body})"))
    return tuple((w, *x) for w, x in sorted(out.items(), key=lambda r: (-r[1][1], -len(r[0]), r[0])))


@lru_cache(1)
def rules() -> tuple[tuple[tuple[str, ...], str, int, float, str], ...]:
    """The signatures that words alone decide."""
    return tuple(r for r in signatures() if not _punctuation(r[-1]))


def _needed(form: str) -> tuple[str, ...]:
    """The words of which a form holds one."""
    if not form:
        return ()
    if form.startswith("spdx"):
        return ("spdx",)
    first = form.split("(")[0].split()
    return ("terms",) if first[0] == "under" else tuple(first[0].replace("licen[sc]", x) for x in ("licens", "licenc")) if "[" in first[0] else (first[0],)


def necessary(texts: list[tuple[str, ...]]) -> dict[tuple[str, ...], str]:
    """A word of every text (words): the longest one, where no word of a shorter text is in it."""
    chosen: dict[str, None] = {}
    out = {}
    for t in sorted(texts, key=lambda t: (len(t), t)):
        out[t] = next((w for w in t if w in chosen), None) or max(t, key=len)
        chosen[out[t]] = None
    return out


@lru_cache(1)
def _words() -> dict[tuple[str, ...], tuple[str, ...]]:
    """By example: the words of which each match of the signature holds one, that of its form or else of its name."""
    forms = {example: _needed(form) for example, form, *_ in FORMS if form}
    out = {}
    for example, *_, pattern in signatures():
        form = next((e for e, f, *_ in FORMS if f and pattern.startswith((f"(?P<at>{f} ", f"{f} (?P<at>"))), None)
        out[example] = forms[form] if form else ()
    named = necessary([e for e, needed in out.items() if not needed])
    return {e: needed or (named[e],) for e, needed in out.items()}


@lru_cache(1)
def gate() -> re.Pattern[bytes]:
    """What every text with a detection or a base place holds: a word of each rule, derived from the rules."""
    some = {w for needed in _words().values() for w in needed} | set(necessary([tuple(p.split()) for p, _ in BASE]).values())
    return re.compile(("(?:" + "|".join(sorted(some, key=lambda w: (-len(w), w))) + r")(?![0-9a-z\x80-\xff])").encode())


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BASE = tuple((tuple(p.encode().split()), label) for p, label in BASE)


def _punctuation(pattern: str) -> bytes:
    """What one sign of has to stand before the second word of a match, if any has."""
    if pattern.startswith(f"(?P<at>{OF_FIELD} "):
        return b":=\"'>"
    return b"-" if re.match(r"\(\?P<at>apache \d", pattern) else b""


@lru_cache(1)
def _starting() -> dict[bytes, dict[re.Pattern[bytes], list[tuple[re.Pattern[bytes], int, str, float, bytes]]]]:
    """The signatures by the word they start with and by the form that all of a list begin with."""
    heads = {f"{form} ": re.compile(f"{form} ".encode()) for _, form, *_ in FORMS if form}
    found: dict[bytes, dict] = {}
    for example, label, priority, score, pattern in signatures():
        form = next((f for f in heads if pattern.startswith((f"(?P<at>{f}", f"{f}(?P<at>"))), None)
        starts = [example[0]] if form is None else [form.split()[0].replace("[sc]", x) for x in ("s", "c")]
        head = heads[form] if form else re.compile(b"")
        for w in starts:
            some = found.setdefault(w.encode(), {}).setdefault(head, {})
            some[pattern, label] = (re.compile(f"{pattern}(?![^ ])".encode()), priority, label, score, _punctuation(pattern))
    return {w: {head: list(some.values()) for head, some in by_head.items()} for w, by_head in found.items()}


def detections(tokens: list[bytes], before: Callable[[int], bytes] | None = None) -> list[tuple[int, int, str, float]]:
    """Labels with their word intervals and scores, after suppression.

    ``before`` gives what stands between a word and the one before it; without it no signature that wants punctuation is found.
    """
    starting = _starting()
    text = b" ".join(tokens)
    places = [0, *accumulate(len(w) + 1 for w in tokens)]
    found = set()
    for i, w in enumerate(tokens):
        for head, some in starting.get(w, {}).items():
            if not head.match(text, places[i]):
                continue
            for pattern, priority, label, score, signs in some:
                m = pattern.match(text, places[i])
                if m and (not signs or (before and any(c in signs for c in before(i + 1)))):
                    start = bisect_left(places, m.start("at"))
                    n = m.group("at").count(b" ") + 1
                    found.add((priority, n, start, start + n, label, score))
    kept: list[tuple[int, int, str, float]] = []
    reach: dict[int, int] = {}  # word: furthest end of a kept interval over it
    for _, _, start, end, label, score in sorted(found, key=lambda d: (-d[0], -d[1], d[2], d[4])):
        if reach.get(start, -1) >= end:
            continue
        kept.append((start, end, label, score))
        for k in range(start, end):
            reach[k] = max(reach.get(k, -1), end)
    return sorted(kept)


def _scan(text: bytes) -> tuple[int, int | None, int | None, str, str, float]:
    spans = [m.span() for m in _WORD.finditer(text)]
    tokens = [text[a:b] for a, b in spans]
    base = [(i, label) for phrase, label in _BASE for i, w in enumerate(tokens) if w == phrase[0] and tuple(tokens[i : i + len(phrase)]) == phrase]
    found = detections(tokens, lambda i: text[spans[i - 1][1] : spans[i][0]])
    miss = 1.0
    for score in [0.9] * len(base) + [d[3] for d in found]:
        miss *= 1 - score
    labels = {label for _, label in base}
    return (
        len(base),
        min((i for i, _ in base), default=None),
        max((i for i, _ in base), default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(labels | {d[2] for d in found})),
        round(1 - miss, 6),
    )


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        data = words.LOWER[data]
        n = batch.num_rows
        counts = np.zeros(n, np.int64)
        found: list[tuple] = [(0, None, None, "", "", 0.0)] * n
        for a, b in chunks(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            counts[a:b] = np.diff(words.bounds(part, at, words.ALNUM)[2])
            raw = part.tobytes()
            for row in range(b - a):
                if gate().search(raw, at[row], at[row + 1]):
                    found[a + row] = _scan(raw[at[row] : at[row + 1]])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def license_scan(docs: DataFrame) -> DataFrame:
    """Base places, labels and a score of every row of ``docs`` (``doc_id``, ``text``), row by row without a shuffle.

    ``score`` is one minus the product of each detection's doubt, 0 where nothing is found.
    """
    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_scanned, schema)
