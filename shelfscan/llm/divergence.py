"""How far the sources of a language are from each other, and which terms set one apart.

Each task lower-cases, splits, encodes and counts the terms of its rows with Arrow's compute functions and merges
its counts before it hands them on. Counts are added up by (language, source, term); terms that stand in enough
documents of their language are kept. Kept terms are dealt by their hash into columnar shards, as many for a language
as its number of terms and sources asks for, so no task holds more than ``CELLS`` counts beside the list of sources.
A shard has every source of its language, so zero counts need no rows; its sums of divergences are added up at the end.

Null text, language and source are empty text. A text without terms still makes its group known. Repeated rows count
as documents of their own. An empty table gives an empty result. Only the named columns are read.
Whole numbers only: ``ratio`` divides by digits, exact up to 9 * 10 ** 15 terms of a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.llm.common import chunks, salted_lookup, ship, staged, text_buffers

#: What stands between terms, after lower-casing.
BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
CHUNK = 4 << 20
#: Rows of merged counts that a task holds before it hands them on, and counts of a shard.
HELD, CELLS = 400_000, 1 << 20
UNIT = 1_000_000_000


def _merged(tables: list[pa.Table]) -> pa.Table:
    """One row per (lang, source, term)."""
    found = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _chunk_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Occurrences and documents of each term of each group; a group's row with the empty term has none of both."""
    groups = pa.table({"lang": lang, "source": source, "row": pa.array(np.arange(len(lang)))})
    parts = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    terms, rows = parts.flatten(), pc.list_parent_indices(parts)
    real = pc.not_equal(terms, "")
    encoded = terms.filter(real).dictionary_encode()
    each = pa.table({"row": rows.filter(real), "term": encoded.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    taken = groups.take(each["row"])
    one = pa.array(np.ones(each.num_rows, np.int64))
    counts = pa.table({"lang": taken["lang"], "source": taken["source"], "code": each["term"], "n": each["count_all"], "docs": one})
    counts = counts.group_by(["lang", "source", "code"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    term = encoded.dictionary.take(counts["code"].combine_chunks())
    known = groups.group_by(["lang", "source"], use_threads=False).aggregate([])
    zero = pa.array(np.zeros(known.num_rows, np.int64))
    empty = pa.array([""] * known.num_rows, pa.string())
    found = pa.table({"lang": counts["lang"], "source": counts["source"], "term": term, "n": counts["n_sum"], "docs": counts["docs_sum"]})
    return pa.concat_tables([found, pa.table({"lang": known["lang"], "source": known["source"], "term": empty, "n": zero, "docs": zero})])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = merged = 0
    for batch in batches:
        _, offsets = text_buffers(batch.column(2))
        for a, b in chunks(offsets, CHUNK):
            some = _chunk_counts(*(batch.column(i).slice(a, b - a) for i in range(3)))
            held.append(some)
            rows += some.num_rows
            if rows > 2 * max(merged, HELD // 4):
                held = [_merged(held)]
                rows = merged = held[0].num_rows
                if merged > HELD:
                    yield from held[0].to_batches()
                    held, rows, merged = [], 0, 0
    if held:
        yield from _merged(held).to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` (documents) of ``docs`` (``text``, ``lang``, ``source``).

    A group's row with the empty term says only that the group occurs. Shuffled once, by (lang, term), so that
    questions over the sources of a term need no further shuffle.
    """
    ship(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = rows.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def ratio(part: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(UNIT * part / whole), by three digits at a time; ``part`` is at most ``whole``."""
    digits, rest = np.divmod(part, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        digits = digits * 1000 + more
    return digits + 1


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shard(top: int):
    def run(shard: pa.Table) -> pa.Table:
        term = shard["term"].combine_chunks()
        facts = shard.filter(pc.is_null(term))
        lang = facts["lang"][0].as_py()
        total, n_terms = facts["n"].to_numpy(), facts["n_terms"][0].as_py()
        sources = facts["source"].to_pylist()
        place = {s: i for i, s in enumerate(sources)}
        rows = shard.filter(pc.is_valid(term))
        kept = rows["term"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(kept.dictionary).to_numpy()
        words = kept.dictionary.take(pa.array(order)).to_pylist()
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        counts = np.zeros((len(sources), len(words)), np.int64)
        if len(words):
            line = rows["source"].combine_chunks().dictionary_encode()
            lines = np.array([place[s] for s in line.dictionary.to_pylist()])
            counts[lines[line.indices.to_numpy()], column[kept.indices.to_numpy()]] = rows["n"].to_numpy()
        p = np.stack([ratio(c + 2, int(n) + 2 * n_terms) for c, n in zip(counts, total)]) if len(words) else counts
        q = ratio(counts.sum(axis=0) + 2, int(total.sum()) + 2 * n_terms) if len(words) else np.zeros(0, np.int64)
        out: list[tuple] = []
        for i, source in enumerate(sources):
            for j in range(i + 1, len(sources)):
                value = int(_divergence(p[i], p[j]).sum())
                out += [(lang, source, "pair", sources[j], value), (lang, sources[j], "pair", source, value)]
            own = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = _divergence(p[i][own], q[own])
            first = np.lexsort((own, -value))[:top]
            out += [(lang, source, "term", words[own[k]], int(value[k])) for k in first]
        columns = list(zip(*out)) or [[]] * 5
        types = [pa.string()] * 4 + [pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "source", "part", "item", "value"])

    return run


def divergences(docs: DataFrame, least_docs: int = 10, top: int = 10, cells: int = CELLS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of ``docs`` (``text``, ``lang``, ``source``).

    ``pair``: the divergence from each other source of the language. ``term``: the ``top`` terms that the source has
    more often than its language. Terms of fewer than ``least_docs`` documents of a language are left out.
    """
    over = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumn("_docs", F.sum("docs").over(over)).withColumn("_first", F.row_number().over(over.orderBy("source")) == 1)
    counted = staged(counted.filter((F.col("_docs") >= least_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "_first"), "term-counts")
    groups = counted.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.expr("count_if(_first AND term <> '') AS _terms"))
    langs = groups.groupBy("lang").agg(F.sum("_terms").alias("n_terms"), F.count("*").alias("_groups"))
    langs = staged(langs.withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("n_terms") * F.col("_groups") / F.lit(cells))).cast("int")), "languages")
    facts = salted_lookup(groups.select("lang", "source", "n"), langs, ["lang"])
    facts = facts.select("lang", "source", F.lit(None).cast("string").alias("term"), "n", "n_terms", F.expr("explode(sequence(0, _shards - 1)) AS shard"))
    rows = salted_lookup(counted.filter("term <> ''").drop("_first"), langs, ["lang"])
    rows = rows.select("lang", "source", "term", "n", "n_terms", F.expr("pmod(xxhash64(term), _shards)").cast("int").alias("shard"))
    parts = rows.unionByName(facts).groupBy("lang", "shard").applyInArrow(_shard(top), "lang string, source string, part string, item string, value long")
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter(f"part = 'pair' OR rank <= {int(top)}").select("lang", "source", "part", "item", "value", "rank")
