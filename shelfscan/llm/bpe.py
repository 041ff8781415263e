"""Encoding and decoding with a lower-casing byte-pair vocabulary whose words end in a marked token.

A text is put into composed form, white space parts it into words, and words are lower-cased. Words of the whole
corpus are counted; the frequent ones are encoded once and compiled into a minimal acyclic transducer (see
``transducer``) whose file every executor gets and its workers map into memory. A worker looks the distinct words of
a chunk up in it, all at once. Words that it does not know are cut into letters, digits and signs; pieces that it does
not know either are merged exactly, lowest rank first, leftmost first, many side by side. Which words are frequent decides about time only, never about ids.

Special strings that stand in a text are one id each, as the vocabulary's library has it by default. Null text is
empty text: no ids, decoded to the empty text. Repeated rows give repeated rows; a null ``doc_id`` stays null. Texts
of any length are read whole, in parts cut at white space. Only named columns are read, so others may have any name.
"""

from __future__ import annotations

import heapq
import json
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfscan.llm.common import chunks, ship, staged, text_buffers
from shelfscan.llm.transducer import Builder, Transducer, spread

#: Most words of the lexicon and most bytes of one: with these its file stays below some ten megabytes.
LEXICON, WORD_BYTES = 50_000, 48
#: Distinct words that a task counts before it hands its counts on.
HELD = 200_000
#: Bytes of text that are worked on together, and code points of a part of a long text.
CHUNK, PART = 4 << 20, 1 << 20
#: Most bytes of a piece that is merged side by side with others; longer ones are merged by a queue.
SIDE = 64

# Capital letters younger than this Python's tables, with their small letters.
YOUNG = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
YOUNG |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_YOUNG = re.compile("[" + "".join(map(chr, YOUNG)) + "]")
#: White space to Python but not to the vocabulary.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACE = regex.compile(r"\s+")


def normal(text: str) -> str:
    """Composed form, lower case letter by letter (so without the Greek final s)."""
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    if text.isascii():
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.translate(YOUNG) if _YOUNG.search(text) else text
    return text


def split_words(text: str) -> list[str]:
    """Words between white space, of a normal text."""
    return [w for w in _SPACE.split(text) if w] if any(c in text for c in SEPARATORS) else text.split()


# Letters and digits to the pattern library, but signs to the vocabulary, whose tables are older.
SIGNS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
_SIGNS = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SIGNS)
#: What merges never cross: letters, one digit, signs. A line's end parts words that are cut together.
_PATTERN = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_SIGNS}]]+|[\p{{N}}--[{_SIGNS}]]|[[^\s\p{{L}}\p{{N}}]||[{_SIGNS}]]+|\n")


class Vocabulary:
    """Merges and token texts of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model = stored["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.inner_ids = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.final_ids = np.array([vocab[shown[b] + end] for b in range(256)], np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        texts = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        self.text_ends = np.cumsum([0, *map(len, texts)])
        self.texts = np.frombuffer(b"".join(texts), np.uint8)
        pairs = sorted((a << 20 | b, rank, made) for (a, b), (rank, made) in self.merges.items())
        self.pair, self.rank, _ = (np.array(c, np.int64) for c in zip(*pairs))
        self.made = np.zeros(len(pairs) + 1, np.int64)
        for _, rank, made in pairs:
            self.made[rank] = made

    def _merged(self, symbols: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of them, until none is left."""
        merges, n = self.merges, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        waiting = [(*found, i) for i in range(n - 1) if (found := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(waiting)
        while waiting:
            _, made, i = heapq.heappop(waiting)
            j = after[i]
            if symbols[i] < 0 or j < 0 or (now := merges.get((symbols[i], symbols[j]))) is None or now[1] != made:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if found := merges.get((made, symbols[after[j]])):
                    heapq.heappush(waiting, (*found, i))
            if before[i] >= 0 and (found := merges.get((symbols[before[i]], made))):
                heapq.heappush(waiting, (*found, before[i]))
        return [s for s in symbols if s >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], len(self.pair))

    def _merged_side_by_side(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Many short pieces at once, one merge of each in every round: their ids, and how many each has."""
        never, owner = len(self.pair), np.repeat(np.arange(len(sizes)), sizes)
        sizes, done = sizes.copy(), []
        rank = np.full(len(symbols), never)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            finished = np.repeat(lowest == never, lengths)
            if finished.any():
                done.append((owner[finished], symbols[finished]))
                going = ~finished
                symbols, owner, rank = symbols[going], owner[going], rank[going]
                lengths, lowest = lengths[lowest < never], lowest[lowest < never]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, lengths))
            at = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]  # the leftmost of each piece
            symbols[at] = self.made[rank[at]]
            sizes[owner[at]] -= 1
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))
            near = np.concatenate([at, at[at > 0] - 1])
            rank[near] = never
            near = near[near + 1 < len(symbols)]
            near = near[owner[near] == owner[near + 1]]
            rank[near] = self._ranks(symbols[near], symbols[near + 1])
        owner, symbols = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        return symbols[np.argsort(owner, kind="stable")], sizes

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one piece after the other, and how many each has."""
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner_ids[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.final_ids[data[ends - 1]]
        short = sizes <= SIDE
        counts, ids = np.zeros(len(pieces), np.int64), {}
        merged = np.zeros(0, np.int64)
        if short.any():
            merged, counts[short] = self._merged_side_by_side(symbols[np.repeat(short, sizes)], sizes[short])
        for i in np.flatnonzero(~short).tolist():
            ids[i] = self._merged(symbols[ends[i] - sizes[i] : ends[i]].tolist())
            counts[i] = len(ids[i])
        out, starts = np.zeros(counts.sum(), np.int64), np.cumsum(counts) - counts
        out[spread(starts[short], counts[short])] = merged
        for i, found in ids.items():
            out[starts[i] : starts[i] + len(found)] = found
        return out, counts

    def encode_words(self, found: list[str], lexicon: Transducer | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normal words without white space, one word after the other, and how many each has."""
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pieces = _PATTERN.findall("\n".join(found))
        numbers: dict[str, int] = {"\n": 0}
        order = np.array([numbers.setdefault(p, len(numbers)) for p in pieces], np.int64)
        distinct = list(numbers)[1:]
        ids, counts = _known_or_merged(self, lexicon, distinct)
        starts = np.concatenate([[0], np.cumsum(counts) - counts])
        counts = np.concatenate([[0], counts])  # the line's end has no ids
        word = np.cumsum(order == 0)
        totals = np.zeros(len(found), np.int64)
        np.add.at(totals, word, counts[order])
        return ids[spread(starts[order], counts[order])], totals

    def encode_word(self, word: str) -> list[int]:
        return self.encode_words([word])[0].tolist()

    def words(self, text: str) -> Iterator[list[str]]:
        """Normal words of a text, part by part; a special string is a word that starts with a blank."""
        pieces = self.special_pattern.split(text) if self.special_pattern else [text]
        for i, piece in enumerate(pieces):
            if i % 2:
                yield [" " + piece]
                continue
            a = 0
            while a < len(piece):
                b = a + PART
                if b < len(piece):  # cut before the next blank
                    cut = re.compile(r"[ \n]").search(piece, b)
                    b = cut.start() if cut else len(piece)
                yield split_words(normal(piece[a:b]))
                a = b


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def _lexicon(name: str) -> Transducer:
    return Transducer(SparkFiles.get(name))


# -- frequent words -----------------------------------------------------------


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for part in vocabulary(path).words(text.as_py() or ""):
                    found.update(part)
                if len(found) > HELD:
                    yield rows()
                    found.clear()
        yield rows()

    return run


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """``word`` and ``n``: how often each normal word stands in ``docs`` (``text``). Counted per task before the shuffle."""
    ship(docs.sparkSession)
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_counted(path), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = LEXICON) -> list[str]:
    """Up to ``most`` of the most frequent words, of at most ``WORD_BYTES`` bytes.

    Words are taken by steps of frequency (sixteen to a doubling), so ties are all in or all out, and only as many
    words as will be used leave the executors.
    """
    stepped = counts.filter(f"octet_length(word) <= {WORD_BYTES} AND NOT startswith(word, ' ')").withColumn("step", F.floor(F.log2("n") * 16))
    lowest, total = None, 0
    for row in sorted(stepped.groupBy("step").count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        lowest = row["step"]
    if lowest is None:
        return []
    return [r.word for r in stepped.filter(F.col("step") >= lowest).select("word").collect()]


def publish(docs: DataFrame, path: str, most: int = LEXICON) -> str:
    """Count, compile and hand out the lexicon of ``docs``; the name under which executors find it."""
    spark = docs.sparkSession
    known = vocabulary(path)
    builder = Builder()
    found = sorted(frequent_words(staged(word_counts(docs, path), "word-counts"), most), key=str.encode)
    ids, counts = known.encode_words(found)
    for word, end, n in zip(found, np.cumsum(counts).tolist(), counts.tolist()):
        builder.add(word.encode(), tuple(ids[end - n : end].tolist()))
    name = f"lexicon-{uuid.uuid4().hex}"
    file = Path(tempfile.mkdtemp(prefix="lexicon-")) / name
    builder.write(str(file))
    spark.sparkContext.addFile(str(file))
    return name


# -- encoding and decoding ----------------------------------------------------


def _looked_up(lexicon: Transducer, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [w.encode() for w in found]
    return lexicon.look_up(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def _joined(hit: np.ndarray, counts: np.ndarray, ids: np.ndarray, other_ids: np.ndarray) -> np.ndarray:
    """Ids of the items that were found and of the others, in the items' order."""
    out, starts = np.zeros(counts.sum(), np.int64), np.cumsum(counts) - counts
    out[spread(starts[hit], counts[hit])] = ids
    out[spread(starts[~hit], counts[~hit])] = other_ids
    return out


def _known_or_merged(known: Vocabulary, lexicon: Transducer | None, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pieces, one after the other, and how many each has."""
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if lexicon is None:
        return known.encode_pieces(pieces)
    hit, counts, ids = _looked_up(lexicon, pieces)
    others = [pieces[i] for i in np.flatnonzero(~hit).tolist()]
    merged = np.zeros(0, np.int64)
    if others:
        merged, counts[~hit] = known.encode_pieces(others)
    return _joined(hit, counts, ids, merged), counts


def _ids_of(known: Vocabulary, lexicon: Transducer, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, one after the other, and how many each has; words not in the lexicon are merged."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit, counts, ids = _looked_up(lexicon, found)
    special = np.array([w[0] == " " for w in found])
    new = ~hit & ~special
    merged, counts[new] = known.encode_words([found[i] for i in np.flatnonzero(new).tolist()], lexicon)
    counts[special] = 1
    others = np.zeros(counts[~hit].sum(), np.int64)
    starts = np.cumsum(counts[~hit]) - counts[~hit]
    others[spread(starts[new[~hit]], counts[new])] = merged
    others[starts[special[~hit]]] = [known.special[found[i][1:]] for i in np.flatnonzero(special).tolist()]
    return _joined(hit, counts, ids, others), counts


def _encode_chunk(known: Vocabulary, lexicon: Transducer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and where each text's begin."""
    numbers: dict[str, int] = {}
    parts: list[np.ndarray] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for words in known.words(text):
            for w in words:
                if w not in numbers:
                    numbers[w] = len(numbers)
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            lengths[i] += len(words)
    order = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    ids, counts = _ids_of(known, lexicon, list(numbers))
    starts, sizes = (np.cumsum(counts) - counts)[order], counts[order]
    text_ends = np.cumsum([0, *lengths.tolist()])
    each = np.concatenate([[0], np.cumsum(sizes)])
    return ids[spread(starts, sizes)], each[text_ends]


def _encoder(path: str, name: str, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lexicon = vocabulary(path), _lexicon(name)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets, CHUNK):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, ends = _encode_chunk(known, lexicon, texts)
                if packed:
                    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                else:
                    data = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(ends)), data], names=["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, path: str, most: int = LEXICON, packed: bool = False, lexicon: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of ``docs`` (``doc_id``, ``text``).

    ``ids`` is an array, or with ``packed`` the bytes of little-endian 32-bit numbers. ``lexicon`` names a published
    one; else that of ``docs`` itself, of up to ``most`` words, is made first.
    """
    ship(docs.sparkSession)
    name = lexicon or publish(docs, path, most)
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_tokens long, ids {'binary' if packed else 'array<int>'}"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_encoder(path, name, packed), schema)


def _decode_chunk(known: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts of runs of ids; ``ends`` are the starts of the runs and the end of the last."""
    start = known.text_ends[ids]
    size = known.text_ends[ids + 1] - start
    each = np.concatenate([[0], np.cumsum(size + 1)])  # every token is followed by a blank, but for the last of a text
    data = np.full(each[-1], 0x20, np.uint8)
    data[spread(each[:-1], size)] = known.texts[spread(start, size)]
    some = ends[1:] > ends[:-1]
    data = np.delete(data, each[ends[1:][some]] - 1)
    offsets = each[ends] - np.concatenate([[0], np.cumsum(some)])
    return pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _decoder(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            column = batch.column(at)
            if pa.types.is_list(column.type):
                counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids, offsets = column.flatten().to_numpy().astype(np.int64), np.cumsum([0, *counts.tolist()])
            else:
                data, offsets = text_buffers(column.fill_null(b""))
                ids, offsets = np.frombuffer(data.tobytes(), "<u4").astype(np.int64), offsets // 4
            for a, b in chunks(offsets, CHUNK // 4):
                text = _decode_chunk(known, ids[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), text], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the tokens of ``ids`` (array or packed), parted by one blank; null ids decode to ''."""
    ship(encoded.sparkSession)
    rows = encoded.drop("decoded")
    return rows.mapInArrow(_decoder(path, rows.columns.index("ids")), StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def round_trip_digest(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every document, encoded and decoded again."""
    return decode(encode(docs, path, packed=True), path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
