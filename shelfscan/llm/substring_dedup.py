"""Substring deduplication by seed and extend.

Words of equal texts form a class; its copies beyond the smallest ``doc_id`` are repeats as a whole, so
only one document of a class goes on. Winnowing marks anchors (runs of 20 words, the smallest hash of
every 31 in a row), so that every window of 50 words holds a whole anchor, the same one wherever the
window occurs. Anchors that occur in two documents are the seeds. Each seed is extended both ways to all
windows around it, and windows are grouped by their 128-bit hash: a window is a repeat where a document
with a smaller ``doc_id`` has it too. Adjoining windows make up the maximal repeats, whose words go.
Work grows with the words near shared anchors, not with pairs of documents.

Words: runs between white space, unchanged. Null or empty text has no words. Repeated rows (equal
``doc_id`` and text) give equal rows; rows that share a ``doc_id`` but differ do not remove from one
another; rows without ``doc_id`` stay whole and remove nothing. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm import words
from shelfscan.llm.common import chunks, ship, staged, text_buffers

SEED = 20


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    done, out = 1, x
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[:-rest], out[rest:]) if rest else out


def winnow(seeds: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the smallest value of some ``window`` values in a row."""
    if len(seeds) < window:
        return np.zeros(0, np.int64)
    least = _slide(seeds, window, np.minimum)
    edge = np.zeros(window - 1, words.U)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), window, np.maximum) == seeds)


def _documents(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """The bytes and word hashes of every row."""
    data, offsets = text_buffers(column)
    for a, b in chunks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = words.bounds(part, at, words.SPACED)
        hashed = words.hashes(part, starts, ends)
        raw = part.tobytes()
        for i in range(b - a):
            yield raw[at[i] : at[i + 1]], hashed[first[i] : first[i + 1]]


def _text_class(hashed: np.ndarray) -> tuple[int, int]:
    if not len(hashed):
        return 0, 0
    return tuple(int(words.runs(hashed, len(hashed), seed).view(np.int64)[0]) for seed in (0, 1))


def _seeded(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, kept, seeds, at = [], [], [], [], [], []
            for raw, hashed in _documents(batch.column(1)):
                a, b = _text_class(hashed)
                n.append(len(hashed))
                one.append(a)
                two.append(b)
                kept.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                grams = words.runs(hashed, SEED)
                place = winnow(grams, length - SEED + 1) if len(hashed) >= length else np.zeros(0, np.int64)
                seeds.append(grams[place].view(np.int64))
                at.append(place.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(kept), pa.array(seeds, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))],
                names=["doc_id", "n_words", "one", "two", "whole", "seeds", "places"],
            )

    return run


def _windows(length: int):
    """Both hashes of every window that holds a shared seed whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(3).to_pylist()
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            size = 0
            for i, (_, hashed) in enumerate(_documents(batch.column(2))):
                spots = np.array(places[i], np.int64)
                last = len(hashed) - length
                mark = np.zeros(last + 2, np.int64)
                np.add.at(mark, np.clip(spots - (length - SEED), 0, last + 1), 1)
                np.add.at(mark, np.clip(spots + 1, 0, last + 1), -1)
                start = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                for k, values in enumerate((words.runs(hashed, length).view(np.int64)[start], words.runs(hashed, length, 1).view(np.int64)[start], np.full(len(start), batch.column(0)[i].as_py()), np.full(len(start), batch.column(1)[i].as_py()), start.astype(np.int32))):
                    out[k].append(values)
                size += len(start)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["h1", "h2", "doc_id", "one", "at"])
                    out, size = [[], [], [], [], []], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["h1", "h2", "doc_id", "one", "at"])

    return run


def _cut(length: int):
    """Words removed, and a hash and the text of the words kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept, digest = [], [], []
            for text, at in zip(batch.column(2), batch.column(3).to_pylist()):
                parts = text.as_py().encode().split()
                mark = np.zeros(len(parts) + 1, np.int64)
                starts = np.array(at, np.int64)
                np.add.at(mark, starts, 1)
                np.add.at(mark, starts + length, -1)
                covered = np.cumsum(mark)[:-1] > 0
                rest = b" ".join(p for p, c in zip(parts, covered.tolist()) if not c)
                gone.append(int(covered.sum()))
                kept.append(rest.decode())
                digest.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "one", "gone", "cut", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words, one space between).

    ``with_text`` adds ``kept_text`` where words went (null: nothing went).
    """
    if length < SEED + 1:
        raise ValueError(f"windows need more than {SEED} words")
    ship(docs.sparkSession)
    docs = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text")
    rows = staged(docs.mapInArrow(_seeded(length), "doc_id long, n_words long, one long, two long, whole string, seeds array<long>, places array<int>"), "seeds")
    long_ones = rows.filter(f"n_words >= {length} AND doc_id IS NOT NULL")
    firsts = staged(long_ones.groupBy("one", "two").agg(F.min("doc_id").alias("first")), "text-classes")
    own = long_ones.select("doc_id", "one", "two", "seeds", "places").join(firsts.selectExpr("first AS doc_id", "one", "two"), ["doc_id", "one", "two"], "left_semi")
    spots = own.selectExpr("doc_id", "one", "explode(arrays_zip(seeds, places)) AS s").selectExpr("doc_id", "one", "s.seeds AS seed", "s.places AS place")
    shared = spots.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("seed")
    met = spots.join(staged(shared, "shared-seeds"), "seed").groupBy("doc_id", "one").agg(F.collect_set("place").alias("places"))
    seeded = staged(docs.join(met, "doc_id").select("doc_id", "one", "text", "places").mapInArrow(_same_text, "doc_id long, one long, text string, places array<int>"), "seeded-texts")
    windows = seeded.mapInArrow(_windows(length), "h1 long, h2 long, doc_id long, one long, at int")
    facts = staged(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h1", "h2", "lo"), "shared-windows")
    repeats = windows.join(facts, ["h1", "h2"]).filter("lo < doc_id").groupBy("doc_id", "one").agg(F.collect_set("at").alias("starts"))
    cut = seeded.join(repeats, ["doc_id", "one"]).select("doc_id", "one", "text", "starts").mapInArrow(_cut(length), "doc_id long, one long, gone long, cut string, kept_text string")
    cut = staged((cut if with_text else cut.drop("kept_text")).dropDuplicates(["doc_id", "one"]), "cuts")
    nothing = hashlib.sha256(b"").hexdigest()
    out = rows.select("doc_id", "n_words", "one", "two", "whole").join(firsts, ["one", "two"], "left").join(cut, ["doc_id", "one"], "left")
    copy = f"n_words >= {length} AND doc_id > first"
    columns = ["doc_id", "n_words", f"CASE WHEN {copy} THEN n_words ELSE coalesce(gone, 0L) END AS n_removed", f"CASE WHEN {copy} THEN '{nothing}' ELSE coalesce(cut, whole) END AS kept_sha256"]
    return out.selectExpr(*columns, *([f"CASE WHEN {copy} THEN '' ELSE kept_text END AS kept_text"] if with_text else []))


def _same_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text is of the class that the places belong to."""
    for batch in batches:
        same = [_text_class(hashed)[0] == one for (_, hashed), one in zip(_documents(batch.column(2)), batch.column(1).to_pylist())]
        yield batch.filter(pa.array(same, pa.bool_()))
