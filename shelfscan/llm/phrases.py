"""Phrases whose words stand together more often than chance has it, mined by partitions that are each searched whole.

A shard is a run of a task's rows, of up to ``SHARD`` words and so small that there are ``support`` of them. A phrase that stands ``support`` times in a language
stands in at least one shard at least ``support`` times that shard's part of the language's words. So every shard is
mined whole, length by length, at this lowered support, and names what it found with its count; the union of what the
shards found holds every frequent phrase. Its exact counts are what the shards named, and what one more pass over the same
shards finds of the union where a shard holds too few to have named it. Where every shard's support is one nothing is left
to it. So that the shards are the same in each pass, the rows are staged first.
Three things keep the union small, none of which can lose a phrase:
a shard that did not name a phrase holds fewer of it than its own support, so phrases whose named counts and largest
possible unnamed counts stay under ``support`` go; the words of a phrase are frequent themselves; and longer phrases
are searched (in a second round) only where the first round's pairs stand. Sets are handed to the tasks as bit tables
of a fixed size: a wrong hit costs time, counts are made over the words themselves.

Null text is empty, a null language is ``und``. Repeated rows count each. An empty table gives an empty result.
Only the named columns are read. All numbers are whole; products are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.llm import words as W
from shelfscan.llm.common import chunks, ship, staged, text_buffers
from shelfscan.operators.groups import attach, first_per_group

#: Words, and bytes of words, of a shard; bytes of text read at a time.
SHARD, SHARD_BYTES, CHUNK = 1 << 21, 1 << 25, 2 << 20
#: Bits of a table of phrases, a power of two.
BITS = 1 << 25
#: Languages whose size the tasks are told; in all others every phrase is taken as locally frequent.
LANGUAGES = 4096
LONGEST = 5
#: Phrases that leave a task at a time.
ROWS = 1 << 15

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_INSIDE = ~_PIECE_END
_INSIDE[[0x20, 0x09]] = False

Keep = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Shard:
    """Words in order, each with its language and whether the next one stands in the same piece."""

    def __init__(self) -> None:
        self.texts: list[pa.Array] = []
        self.langs: list[np.ndarray] = []
        self.joined: list[np.ndarray] = []
        self.names: dict[str, int] = {}
        self.words = self.bytes = 0

    def add(self, langs: list[str], data: np.ndarray, offsets: np.ndarray) -> None:
        low = W.LOWER[data]
        starts, ends, of = W.bounds(low, offsets, _INSIDE)
        if not len(starts):
            return
        breaks = np.zeros(len(low) + 1, np.int64)
        np.cumsum(_PIECE_END[low], out=breaks[1:])
        joined = np.zeros(len(starts), bool)
        joined[:-1] = breaks[starts[1:]] == breaks[ends[:-1]]
        joined[of[1:-1][(of[1:-1] > 0)] - 1] = False
        inside = low[_INSIDE[low]]
        at = np.cumsum([0, *(ends - starts).tolist()]).astype(np.int64)
        self.texts.append(pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(inside)))
        numbers = np.array([self.names.setdefault(x, len(self.names)) for x in langs], np.int32)
        self.langs.append(np.repeat(numbers, np.diff(of)))
        self.joined.append(joined)
        self.words += len(starts)
        self.bytes += len(inside)


class Level:
    """The distinct phrases of one length that a shard keeps: counts, languages and where each stands first."""

    def __init__(self, shard: "Opened", length: int, counts: np.ndarray, first: np.ndarray) -> None:
        self.shard, self.length, self.counts, self.first = shard, length, counts, first

    def parts(self) -> Iterator["Level"]:
        """The same in pieces of at most ``ROWS`` phrases: only a piece's texts are held at a time."""
        for a in range(0, len(self.first), ROWS):
            yield Level(self.shard, self.length, self.counts[a : a + ROWS], self.first[a : a + ROWS])

    def langs(self) -> pa.Array:
        return self.shard.names.take(pa.array(self.shard.lang[self.first]))

    def phrases(self) -> pa.Array:
        parts = [self.shard.dictionary.take(pa.array(self.shard.word[self.first + j])) for j in range(self.length)]
        return parts[0] if self.length == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


class Opened:
    """A shard ready to be mined: words as numbers of an exact dictionary."""

    def __init__(self, shard: Shard) -> None:
        encoded = pa.concat_arrays(shard.texts).dictionary_encode()
        self.dictionary = encoded.dictionary
        self.word = encoded.indices.to_numpy().astype(np.int64)
        self.lang = np.concatenate(shard.langs).astype(np.int64)
        self.joined = np.concatenate(shard.joined)
        self.names = pa.array(list(shard.names), pa.string())
        self.sizes = np.bincount(self.lang, minlength=len(shard.names))

        def hashed(column: pa.Array) -> np.ndarray:
            data, offsets = text_buffers(column)
            return W.hashes(data, offsets[:-1], offsets[1:])

        self.word_hash, self.lang_hash = hashed(self.dictionary), hashed(self.names)

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """A hash of the language and words of the phrases that start at ``at``, the same in every shard."""
        h = self.lang_hash[self.lang[at]]
        for j in range(length):
            h = W.mix(h * W.U(0x9E3779B97F4A7C15) + self.word_hash[self.word[at + j]])
        return h

    def _distinct(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        encoded = pa.array(code).dictionary_encode()
        number = encoded.indices.to_numpy()
        first = np.empty(len(encoded.dictionary), np.int64)
        first[number[::-1]] = at[::-1]
        return number, np.bincount(number, minlength=len(first)), first

    def levels(self, longest: int, keep: Keep) -> Iterator[Level]:
        """Kept phrases of 1, 2 ... words. Only phrases whose two parts, one word shorter, are kept are looked at."""
        n = len(self.word)
        every = np.arange(n)
        one, counts, first = self._distinct(self.lang * len(self.dictionary) + self.word, every)
        units, number, at, current = len(first), one, every, every
        for length in range(1, longest + 1):
            if length > 1:
                ok = (current[:-1] >= 0) & (current[1:] >= 0)
                if length == 2:
                    ok &= self.joined[:-1]
                at = np.flatnonzero(ok)
                number, counts, first = self._distinct(current[at] * units + one[at + length - 1], at)
            kept = keep(length, counts, self.lang[first], first) if len(first) else np.zeros(0, bool)
            new = np.cumsum(kept) - 1
            current = np.full(n, -1, np.int64)
            mine = kept[number]
            current[at[mine]] = new[number[mine]]
            yield Level(self, length, counts[kept], first[kept])
            if not kept.any():
                return


def _shards(batches: Iterator[pa.RecordBatch], most: int = SHARD) -> Iterator[Opened]:
    shard = Shard()
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for a, b in chunks(offsets, CHUNK):
            shard.add(batch.column(0).slice(a, b - a).to_pylist(), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if shard.words >= most or shard.bytes >= SHARD_BYTES:
                full, shard = [shard], Shard()
                # Nothing here holds the texts while the shard is mined.
                yield Opened(full.pop())
    if shard.words:
        yield Opened(shard)


def _each(found: Callable[[Opened], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch], most: int = SHARD) -> Iterator[pa.RecordBatch]:
    """What ``found`` gives of every shard; a shard is let go before the next one is read."""
    return chain.from_iterable(map(found, _shards(batches, most)))


def _in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & W.U(BITS - 1)
    return (table[place >> W.U(6)] >> (place & W.U(63)) & W.U(1)).astype(bool)


def _all(length: int, counts: np.ndarray, lang: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.ones(len(counts), bool)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(shard: Opened) -> Iterator[pa.RecordBatch]:
        for level in shard.levels(1, _all):
            for part in level.parts():
                yield _rows(["lang", "phrase", "n"], [part.langs(), part.phrases().cast(pa.string()), pa.array(part.counts)])

    return _each(found, batches)


def _rows(names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def _local(support: int, shard: Opened, sizes: Broadcast) -> np.ndarray:
    """The lowered support of each of a shard's languages."""
    whole = [sizes.value.get(x, 0) for x in shard.names.to_pylist()]
    return np.array([max(1, -(-support * int(n) // m)) if m else 1 for n, m in zip(shard.sizes, whole)], np.int64)


def _mine(support: int, most: int, sizes: Broadcast, frequent: Broadcast, pairs: Broadcast | None, lengths: tuple[int, int]):
    """Locally frequent phrases of the stated lengths: text, count, and how often a shard may hold one that it does not
    name. A row without a phrase says the latter of the whole shard."""

    names = ["lang", "phrase", "n", "slack"]

    def found(shard: Opened) -> Iterator[pa.RecordBatch]:
        local = _local(support, shard, sizes)

        def keep(length: int, counts: np.ndarray, lang: np.ndarray, first: np.ndarray) -> np.ndarray:
            kept = counts >= local[lang]
            if length == 1:
                kept &= _in_table(frequent.value, shard.hashes(first, 1))
            if length == 2 and pairs is not None:
                kept &= _in_table(pairs.value, shard.hashes(first, 2))
            return kept

        here = np.flatnonzero(shard.sizes)
        zero = pa.array(np.zeros(len(here), np.int64))
        yield _rows(names, [shard.names.take(pa.array(here)), pa.nulls(len(here), pa.string()), zero, pa.array(local[here] - 1)])
        for level in shard.levels(lengths[1], keep):
            for part in level.parts() if level.length >= lengths[0] else ():
                slack = local[shard.lang[part.first]] - 1
                yield _rows(names, [part.langs(), part.phrases().cast(pa.string()), pa.array(part.counts), pa.array(slack)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each(found, batches, most)

    return run


def _count(support: int, most: int, sizes: Broadcast, frequent: Broadcast, candidates: Broadcast):
    """Exact counts, in a shard, of every phrase of two words and more that is in the table of candidates and that the
    shard, as ``_mine`` had it, holds too few of to have named it."""

    def found(shard: Opened) -> Iterator[pa.RecordBatch]:
        local = _local(support, shard, sizes)
        if (local == 1).all():
            return

        def keep(length: int, counts: np.ndarray, lang: np.ndarray, first: np.ndarray) -> np.ndarray:
            return _in_table((frequent if length == 1 else candidates).value, shard.hashes(first, length))

        for level in shard.levels(LONGEST, keep):
            few = level.counts < local[shard.lang[level.first]]
            for part in Level(shard, level.length, level.counts[few], level.first[few]).parts() if level.length > 1 else ():
                yield _rows(["lang", "phrase", "n"], [part.langs(), part.phrases().cast(pa.string()), pa.array(part.counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each(found, batches, most)

    return run


def _table_of(hashes: DataFrame) -> np.ndarray:
    """The bit table of a table of ``hash``; what reaches the driver is bounded by its size."""
    place = hashes.select(F.col("hash").bitwiseAND(BITS - 1).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT))) AS bits"))
    found = words.toArrow()
    table = np.zeros(BITS >> 6, np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def _phrase_hashes(phrases: DataFrame) -> DataFrame:
    """``hash`` of each (``lang``, ``phrase``), as the shards have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (lang, at), (text, by) = text_buffers(batch.column(0)), text_buffers(batch.column(1))
            starts, ends, of = W.bounds(text, by, _INSIDE)
            word, size = W.hashes(text, starts, ends), np.diff(of)
            h = W.hashes(lang, at[:-1], at[1:])
            for j in range(int(size.max(initial=0))):
                longer = np.flatnonzero(size > j)
                h[longer] = W.mix(h[longer] * W.U(0x9E3779B97F4A7C15) + word[of[longer] + j])
            yield _rows(["hash"], [pa.array(h.view(np.int64))])

    return phrases.select("lang", "phrase").mapInArrow(run, "hash long")


def frequent_phrases(docs: DataFrame, support: int = 100) -> tuple[DataFrame, DataFrame]:
    """(``lang``, ``phrase``, ``f``) of 1 to 5 words with ``f >= support``, and (``lang``, ``n``), the words of a language."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = staged(rows, "phrase-rows")
    send = spark.sparkContext.broadcast
    words = staged(rows.mapInArrow(_word_counts, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f")), "phrase-words")
    sizes = staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-languages")
    singles = words.filter(F.col("f") >= support)
    largest = send({r.lang: r.n for r in sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()})
    # At least ``support`` shards: each one's support is then one or two, and the union as exact, at every size of ``docs``.
    most = max(1, min(SHARD, (sizes.agg(F.sum("n")).first()[0] or 0) // support))
    frequent = send(_table_of(_phrase_hashes(singles)))

    def union(lengths: tuple[int, int], pairs: Broadcast | None) -> DataFrame:
        """What any shard named, less what cannot reach the support in all shards together; ``unnamed`` is the most that shards hold besides."""
        named = rows.mapInArrow(_mine(support, most, largest, frequent, pairs, lengths), "lang string, phrase string, n long, slack long")
        found = staged(named.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack")), "phrases-named")
        room = found.filter("phrase IS NULL").select("lang", F.col("slack").alias("room"))
        held = attach(found.filter("phrase IS NOT NULL"), room, ["lang"], ["phrase"])
        held = held.select("lang", "phrase", "n", (F.col("room") - F.col("slack")).alias("unnamed"))
        return staged(held.filter(F.col("n") + F.col("unnamed") >= support), "phrases-union")

    first = union((2, 2), None)
    pairs = send(_table_of(_phrase_hashes(first)))
    second = union((3, LONGEST), pairs)
    named = first.unionByName(second)
    counted = named.select("lang", "phrase", "n")
    if not named.filter("unnamed > 0").isEmpty():
        candidates = send(_table_of(_phrase_hashes(named)))
        count = _count(support, most, largest, frequent, candidates)
        counted = counted.unionByName(rows.mapInArrow(count, "lang string, phrase string, n long"))
    counted = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= support)
    return staged(singles.unionByName(counted), "phrases"), sizes


def collocations(docs: DataFrame, support: int = 100, first: int = 2000) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the ``first`` phrases of each language.

    A phrase is scored at the cut that speaks most against it: 1000 * a * n / (l * r), with the counts of the whole, of
    both parts and of all words. Phrases that stand only inside a longer frequent one are left out.
    """
    found, sizes = frequent_phrases(docs, support)
    whole = found.filter("contains(phrase, ' ')").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    inner = whole.filter("size(w) > 2").select("lang", F.col("a").alias("around"), F.expr("explode(array(array_join(slice(w, 1, size(w) - 1), ' '), array_join(slice(w, 2, size(w) - 1), ' '))) AS phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    whole = whole.join(inner, ["lang", "phrase"], "left").filter("around IS NULL OR around < a").drop("around")
    whole = attach(whole, sizes, ["lang"], ["phrase"])
    cuts = whole.select("*", F.expr("explode(sequence(1, size(w) - 1)) AS k"))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", F.expr("array_join(slice(w, 1, k), ' ') AS head"), F.expr("array_join(slice(w, k + 1, size(w)), ' ') AS tail"))
    heads, tails = found.toDF("lang", "head", "l"), found.toDF("lang", "tail", "r")
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    product = "CAST(CAST(a AS DECIMAL(38, 0)) * CAST(n AS DECIMAL(38, 0)) * 1000BD AS DECIMAL(38, 0))"
    scored = cuts.withColumn("score", F.expr(f"{product} DIV (CAST(l AS DECIMAL(38, 0)) * CAST(r AS DECIMAL(38, 0)))"))
    scored = scored.groupBy("lang", "phrase").agg(F.expr("min(struct(score, k, a, l, r, n)) AS s")).select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = first_per_group(scored, ["lang"], order, first, ["phrase"])
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
