"""Benchmark decontamination: a prefix-filtered set join with exact containment.

An item's windows are its runs of ``width`` words (an item with fewer words is one window). Exact
containment asks for every word of a window, so the necessary prefix of a window is its one rarest
word, by frequency over all documents. Only document words that are such anchors become candidates; the
anchor's offset fixes where the window would start, length bounds drop starts outside the document, and
the words themselves are compared.

A bit table of fixed size (``2 ** bits`` bits, whatever the benchmark's size) drops most other words
before rows are made of them; it lets false ones through, never drops a true one. Everything is
DataFrame or SQL.

Words: A-Z lower-cased, maximal runs of digits, a-z and everything beyond ASCII. Null or empty texts have
no words. Repeated rows give repeated rows, also with the same ``doc_id``; repeated items count by their
distinct ``item_id``; items without ``item_id`` mark words but are not listed. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.common import staged

WORDS = r"filter(split(translate(coalesce(CAST({} AS string), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), w -> w != '')"
#: Rows up to which a benchmark-sized table is broadcast; beyond, Spark shuffles and splits hot keys.
SMALL = 200_000


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """``item_id``, the words ``win`` of every window and their number ``k``."""
    listed = items.selectExpr("item_id", WORDS.format("text") + " AS words").filter("size(words) > 0")
    return listed.selectExpr("item_id", f"explode(transform(sequence(1, greatest(1, size(words) - {width - 1})), i -> slice(words, i, {width}))) AS win").selectExpr("item_id", "win", "size(win) AS k")


def find_hits(docs: DataFrame, items: DataFrame, width: int = 10, bits: int = 20) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``hits`` (arrays of start and length in words) and ``item_ids``."""
    windows = staged(windows_of(items, width).groupBy("win", "k").agg(F.collect_set("item_id").alias("items")), "windows")
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    words = docs.select(F.expr(f"explode({WORDS.format('text')})").alias("word"))
    seen = words.join(_hint(vocabulary), "word").groupBy("word").count()
    rarity = vocabulary.join(seen, "word", "left").fillna(0, ["count"])
    rare = staged(rarity.select("word", F.col("count").alias("n")), "rarity")
    placed = windows.select("win", "k", "items", F.posexplode("win").alias("o", "word")).join(_hint(rare), "word")
    anchors = placed.groupBy("win", "k", "items").agg(F.expr("min(named_struct('n', n, 'word', word, 'o', o)) AS a"))
    anchors = staged(anchors.selectExpr("a.word AS word", "a.o AS o", "k", "win", "items").filter("word IS NOT NULL"), "anchors")
    cells = 1 << (bits - 6)
    filled = anchors.selectExpr(f"pmod(xxhash64(word), {cells}) AS cell", "shiftleft(1L, CAST(pmod(hash(word), 64) AS int)) AS bit").groupBy("cell").agg(F.expr("bit_or(bit) AS b"))
    spread = docs.sparkSession.range(cells).selectExpr("id AS cell").join(filled, "cell", "left")
    table = staged(spread.agg(F.expr("transform(array_sort(collect_list(named_struct('c', cell, 'b', coalesce(b, 0L)))), x -> x.b) AS bits")), "bits")
    test = f"shiftright(element_at(bits, CAST(pmod(xxhash64(w), {cells}) AS int) + 1), CAST(pmod(hash(w), 64) AS int)) & 1L = 1L"
    around = f"named_struct('at', i, 'word', words[i], 'left', least(i, {width - 1}), 'near', slice(words, greatest(0, i - {width - 1}) + 1, {2 * width - 1}))"
    cand = (
        docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.expr(WORDS.format("text")).alias("words"))
        .withColumn("bits", table.scalar())
        .selectExpr(
            "_row",
            "doc_id",
            "CAST(size(words) AS bigint) AS n_words",
            f"transform(filter(zip_with(words, sequence(0, size(words)), (w, i) -> if(w IS NOT NULL AND {test}, i, NULL)), i -> i IS NOT NULL), i -> {around}) AS cands",
        )
        .selectExpr("_row", "doc_id", "n_words", "explode_outer(cands) AS c")
    )
    fits = F.expr("c.word = word AND c.left >= o AND c.at - o + k <= n_words AND slice(c.near, c.left - o + 1, k) = win")
    met = cand.join(_hint(anchors), fits, "left")
    grouped = met.groupBy("_row", "doc_id", "n_words").agg(
        F.expr("array_sort(collect_set(if(word IS NULL, NULL, named_struct('start', c.at - o, 'k', k)))) AS hits"), F.expr("array_distinct(flatten(collect_list(items))) AS item_ids")
    )
    return grouped.select("doc_id", "n_words", "hits", "item_ids")


#: Words under at least one window: each window adds what reaches beyond those that start before it.
COVERED = "aggregate(hits, named_struct('n', 0L, 'end', 0), (acc, h) -> named_struct('n', acc.n + greatest(0, h.start + h.k - greatest(acc.end, h.start)), 'end', greatest(acc.end, h.start + h.k)), acc -> acc.n)"


def decontamination_digest(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    found = find_hits(docs, items, width)
    return found.selectExpr(
        "doc_id",
        "n_words",
        f"{COVERED} AS n_hit",
        "CAST(size(item_ids) AS bigint) AS n_items",
        "sha2(array_join(array_sort(transform(item_ids, i -> CAST(i AS string))), ','), 256) AS items_sha256",
        "size(hits) > 0 AS contaminated",
    )
