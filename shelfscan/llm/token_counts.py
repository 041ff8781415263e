"""Token counts: exact counts at every prefix by dynamic programming over byte-level BPE.

The encoding of a prefix that ends at byte j is the encoding of the prefix that ends where its last
token starts, and that token. So one pass gives the count at every prefix: for each j the one token
that ends at j and may follow the last token before it. Pre-tokens (the pieces that merges never
cross) are found on whole buffers, hashed, and each distinct one is worked out once per cache; sorted
pieces share the table of their common prefix. Truncation and budget questions read the table.

Null or empty text counts no token. Repeated rows give repeated rows; a null ``doc_id`` stays null.
Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm import words
from shelfscan.llm.common import chunks, ship, text_buffers

#: Classes of code points in the pattern that splits text before the merges.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct pre-tokens that a worker remembers before it starts anew.
CACHE = 500_000
CHUNK = 2 << 20


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        kinds[i] = LETTER if c == "L" else NUMBER if c == "N" else OTHER
    kinds[WHITE] = SPACE
    return kinds


@lru_cache(1)
def _letters() -> np.ndarray:
    return words.mix(np.arange(1, 0x110001, dtype=words.U) * words.U(0xD6E8FEB86659FD93))


def split_points(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Start of every pre-token in an array of code points; ``rows`` are the starts of texts and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[rows] = True  # of a text
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    last = np.append(first[1:n] | (kind[1:] != kind[:-1]), True)  # of a run
    before_word = np.zeros(n, bool)  # the last white space of a run that a word follows in the same text
    before_word[:-1] = last[:-1] & (kind[:-1] == SPACE) & ~first[1:n]
    start |= before_word  # what stands before it in the run is a piece
    after = np.flatnonzero(before_word & (points == 0x20)) + 1
    start[after] = False  # one blank goes with the word
    quote = np.flatnonzero((points == 0x27) & change & last & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        a = points[quote + 1]
        b = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        b = np.where(first[np.minimum(quote + 2, n)], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[quote[one | two] + 1] = False
        rest = np.concatenate([quote[one] + 2, quote[two & ~one] + 3])
        start[rest[rest < n]] = True
    return np.flatnonzero(start)


class Table:
    """Counts at every prefix of a piece, for one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocab = {bytes(shown[c] for c in t): i for t, i in model["model"]["vocab"].items() if all(c in shown for c in t)}
        self.special = [t["content"] for t in model["added_tokens"]]
        self.ids = vocab
        self.most = max(map(len, vocab))
        self.ranks: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank, left part, right part
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (bytes(shown[c] for c in t) for t in (left, right))
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.ranks[x, y] = rank
            self.parts.setdefault(z, (rank, x, y))
        self.known: dict[int, bool] = {}
        self.totals: dict[int, int] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """From the outermost byte up to the token: each part, and the rank at which it goes into the next."""
        up: list[tuple[int, float]] = [(token, float("inf"))]
        while token in self.parts:
            rank = self.parts[token][0]
            token = self.parts[token][side]
            up.append((token, rank))
        return up[::-1]

    def _follows(self, a: int, b: int) -> bool:
        """Whether the bytes of both tokens are encoded as these two: no merge crosses between them."""
        left, right, i, j = self._spine(a, 2), self._spine(b, 1), 0, 0
        while True:
            (x, when_x), (y, when_y) = left[i], right[j]
            cross = self.ranks.get((x, y), float("inf"))
            if cross < when_x and cross <= when_y:
                return False
            if when_x == when_y == float("inf"):
                return True
            if when_x <= when_y:
                i += 1
            else:
                j += 1

    def prefixes(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """For each of the sorted pieces: tokens of its first 0, 1, 2 ... bytes. The list is reused."""
        ids, most, known = self.ids, self.most, self.known
        last, count, prev = [-1], [0], b""
        for piece in pieces:
            n, j = len(piece), 0
            for x, y in zip(prev, piece):
                if x != y:
                    break
                j += 1
            del last[j + 1 :], count[j + 1 :]
            for end in range(j + 1, n + 1):
                for k in range(end - most if end > most else 0, end):
                    token = ids.get(piece[k:end])
                    if token is None:
                        continue
                    if k:
                        pair = last[k] << 20 | token
                        fits = known.get(pair)
                        if fits is None:
                            fits = known[pair] = self._follows(last[k], token)
                        if not fits:
                            continue
                    last.append(token)
                    count.append(count[k] + 1)
                    break
            prev = piece
            yield count

    def count(self, piece: str) -> int:
        return next(self.prefixes([piece.encode()]))[-1]

    def at_points(self, piece: str) -> list[int]:
        """Tokens of the first 1, 2 ... code points of a piece."""
        raw = piece.encode()
        count = next(self.prefixes([raw]))
        return [count[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]


@lru_cache(2)
def table(path: str) -> Table:
    return Table(path)


def _pieces(text: str) -> list[str]:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = [*split_points(points, np.array([0, len(points)])).tolist(), len(points)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def _plain_counts(t: Table, pieces: list[str]) -> list[int]:
    """Tokens of the first 1, 2 ... code points of the text that the pieces make up."""
    out: list[int] = []
    base = before = 0  # tokens before this piece, and before the one ahead of it
    ahead = ""
    for piece in pieces:
        inside = t.at_points(piece)
        if len(piece) == 3 and piece[0] == "'" and piece[1:] in CONTRACTIONS:
            inside[1] = 1 + t.count(piece[1])
        whole = inside[-1]
        inside = [base + x for x in inside]
        if ahead and ahead.isspace() and piece[0].isspace():  # a prefix that ends here has one run of white space
            inside[0] = before + t.count(ahead + piece[0])
        out += inside
        base, before, ahead = base + whole, base, piece
    return out


def prefix_counts_of(t: Table, text: str) -> list[int]:
    """Tokens of the first 0, 1, 2 ... code points of ``text``; special strings count one token when whole."""
    out, rest = [0], text
    while True:
        at, special = min(((rest.find(s), s) for s in t.special if s in rest), default=(-1, ""))
        plain = rest if at < 0 else rest[:at]
        out += [out[-1] + x for x in _plain_counts(t, _pieces(plain))] if plain else []
        if at < 0:
            return out
        base = out[-len(plain) - 1]
        done = base + (len_tokens(t, plain))
        tail = _pieces(plain)[-2:]
        kept = base + len_tokens(t, plain) - sum(map(t.count, tail))
        out += [kept + len_tokens(t, "".join(tail) + special[:j]) for j in range(1, len(special))]
        out.append(done + 1)
        rest = rest[at + len(special) :]


def len_tokens(t: Table, text: str) -> int:
    return sum(map(t.count, _pieces(text)))


def _totals(t: Table, hashed: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens of each piece."""
    distinct, first, back = np.unique(hashed, return_index=True, return_inverse=True)
    if len(t.totals) + len(distinct) > CACHE:
        t.totals.clear()
    if len(t.known) > 2 * CACHE:
        t.known.clear()
    got = [t.totals.get(h) for h in distinct.tolist()]
    new = [i for i, x in enumerate(got) if x is None]
    if new:
        at = first[new]
        raw = sorted((points[a:b].tobytes().decode("utf-32-le").encode(), i) for a, b, i in zip(starts[at].tolist(), ends[at].tolist(), new))
        keys = distinct.tolist()
        for (_, i), count in zip(raw, t.prefixes([r for r, _ in raw])):
            got[i] = t.totals[keys[i]] = count[-1]
    return np.array(got, np.int64)[back]


def _chunk(t: Table, data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and longest prefix within ``limit`` tokens in code points, of each row of a chunk."""
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
    rows = leads[offsets]
    starts = split_points(points, rows)
    ends = np.append(starts[1:], len(points))
    power, back, _ = words._tables(0, len(points) + 1)
    total = np.zeros(len(points) + 1, words.U)
    np.cumsum(_letters()[points] * power[: len(points)], out=total[1:])
    hashed = words.mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(words.U))
    each = np.zeros(len(starts) + 1, np.int64)
    if len(starts):
        np.cumsum(_totals(t, hashed, points, starts, ends), out=each[1:])
    of = np.searchsorted(starts, rows)
    tokens, keep = each[of[1:]] - each[of[:-1]], rows[1:] - rows[:-1]
    for i in np.flatnonzero(tokens > limit).tolist():
        base = each[of[i]]
        k = int(np.searchsorted(each[of[i] : of[i + 1] + 1], base + limit, "right")) - 1 + of[i]  # the piece that goes beyond
        a = max(of[i], k - 1)
        b = min(of[i + 1], k + 2)
        some = [points[x:y].tobytes().decode("utf-32-le") for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())]
        counts = np.array([0, *_plain_counts(t, some)]) + (each[a] - base)
        keep[i] = starts[a] - rows[i] + np.flatnonzero(counts <= limit)[-1]
    return tokens, keep


def _counted(path: str, limit: int, with_prefixes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            tokens, keep = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            prefixes: list = [None] * batch.num_rows
            for a, b in chunks(offsets, CHUNK):
                part = data[offsets[a] : offsets[b]]
                raw = part.tobytes()
                tokens[a:b], keep[a:b] = _chunk(t, part, offsets[a : b + 1] - offsets[a], limit)
                if with_prefixes or any(s.encode() in raw for s in t.special):
                    for i in range(a, b):
                        text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")
                        if with_prefixes or any(s in text for s in t.special):
                            counts = np.array(prefix_counts_of(t, text))
                            tokens[i], keep[i] = counts[-1], np.flatnonzero(counts <= limit)[-1]
                            prefixes[i] = counts if with_prefixes else None
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit), pa.array(keep)]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "keep_chars"]
            if with_prefixes:
                columns.append(pa.array(prefixes, pa.list_(pa.int32())))
                names.append("prefix_counts")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 1024, with_prefixes: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``keep_chars`` of ``docs`` (``doc_id``, ``text``).

    ``keep_chars`` is the longest prefix, in code points, of at most ``limit`` tokens. ``with_prefixes``
    stores the whole table: entry i of ``prefix_counts`` is the exact count of the first i code points.
    """
    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_bytes long, n_tokens long, over_limit boolean, keep_chars long"
    schema += ", prefix_counts array<int>" if with_prefixes else ""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_counted(path, limit, with_prefixes), schema)


def fit(counted: DataFrame, limit: int) -> DataFrame:
    """Longest prefix within ``limit`` tokens, read from stored ``prefix_counts`` without encoding again."""
    return counted.withColumn("keep_chars", F.expr(f"aggregate(sequence(1, size(prefix_counts)), 0, (m, i) -> if(prefix_counts[i - 1] <= {int(limit)}, i - 1, m))"))
